"""Relational operators by area: each area is a dict from a query's name to its SQL."""

from . import costs, dictionary, language, markup, ordering, records, relational, structure

AREAS = (records, markup, dictionary, ordering, structure, language, costs, relational)
