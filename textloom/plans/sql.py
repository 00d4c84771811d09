"""Queries as declarative plans: SQL over named tables, with Spark and DuckDB spellings of the few functions that differ."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Spark's spelling -> DuckDB's, where both mean the same.
_DUCK = (
    (r"\bexplode\(", "unnest("), (r"\bsequence\(", "generate_series("), (r"\bsize\(", "len("), (r"\brlike\(", "regexp_matches("),
    (r"\bcollect_list\(", "list("), (r"\barray_join\(", "array_to_string("), (r"\boctet_length\(", "strlen("), (r"\bchar_at\((\w+), (\w+)\)", r"substr(\1, \2, 1)"),
)
_SPARK = ((r"\belement_at_1\(((?:[^(),]|\([^()]*\))+), (\w+)\)", r"element_at(\1, CAST(\2 AS INT))"), (r"\bDIV_\b", "DIV"), (r"\bbin_of\(", "bin("), (r"\bsecond_of\(", "second("), (r"'([^']*)#2 #1'", r"'\1$2 $1'"), (r"#1', GLOBAL_", r"$1'"), (r"\bslice_first\(([^,]*\)), n\)", r"slice(\1, 1, n)"), (r"\bchar_at\((\w+), (\w+)\)", r"substr(\1, \2, 1)"), (r"\bsplit_lines\((\w+)\)", r"split(\1, '\\n')"), (r"\bfold\((\w+)\)", r"translate(\1, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
_DUCK_MORE = ((r"\belement_at_1\(((?:[^(),]|\([^()]*\))+), (\w+)\)", r"(\1)[\2]"), (r"\bDIV_\b", "//"), (r"\bbin_of\(", "bin("), (r"\bsecond_of\(", "second("), (r"'([^']*)#2 #1'", r"'\1\\2 \\1'"), (r"#1', GLOBAL_", r"\\1', 'g'"), (r"\bslice_first\(([^,]*\)), n\)", r"list_slice(\1, 1, n)"), (r"\\\\", r"\\"), (r"AS STRING\)", "AS VARCHAR)"), (r"\bsplit_lines\((\w+)\)", r"string_split(\1, chr(10))"), (r"\bfold\((\w+)\)", r"translate(\1, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))


def _spelled(text: str, rules) -> str:
    for pattern, new in rules:
        text = re.sub(pattern, new, text)
    return text


def plan(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of a SQL text in which tables stand as ``@name``."""
    names = sorted(set(re.findall(r"@(\w+)", text)))
    spelled = _spelled(text, _SPARK)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = re.sub(r"@(\w+)", r"{\1}", spelled.replace("{", "{{").replace("}", "}}"))
        return spark.sql(body, **{n: table(spark, sf_dir, n) for n in names})

    return run


def oracle(text: str) -> str:
    """The same text as DuckDB spells it."""
    return re.sub(r"@(\w+)", r"\1", _spelled(text, _DUCK_MORE + _DUCK))
