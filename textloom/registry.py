"""All queries of the engine by name, each with its SQL where plain SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import streaming
from .operators import AREAS, containers, contexts, inverse, kernels, language, scans, sequential
from .plans.sql import oracle, plan


def _texts() -> dict[str, str]:
    return {name: text for area in AREAS for name, text in area.QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan(text) for name, text in _texts().items()} | scans.QUERIES | containers.QUERIES | inverse.QUERIES | language.FRAMES | kernels.QUERIES | contexts.QUERIES | sequential.QUERIES | streaming.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: oracle(text) for name, text in _texts().items()} | scans.ORACLES | containers.ORACLES | inverse.ORACLES | language.ORACLES | kernels.ORACLES | contexts.ORACLES | streaming.ORACLES
