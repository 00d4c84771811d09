"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WHERE = {
    "op1_sum_of_squares_packing": "packing",
    "op2_host_reputation": "hosts",
    "op3_hash_tree_sharding": "sharding",
    "op4_suffix_dedup": "suffix",
    "op5_separator_scan": "tokencount",
    "op6_simhash_decontamination": "decontaminate",
    "op7_jaccard_join": "jaccard",
    "op8_archive_media": "media",
    "op9_language_id": "language",
    "op10_substring_dedup": "substring",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from .decontaminate import OP6_SQL
    from .hosts import OP2_SQL
    from .jaccard import OP7_SQL
    from .sharding import OP3_SQL
    from .substring import OP10_SQL
    from .suffix import OP4_SQL

    return {
        "op2_host_reputation": OP2_SQL, "op3_hash_tree_sharding": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op6_simhash_decontamination": OP6_SQL, "op7_jaccard_join": OP7_SQL,
        "op10_substring_dedup": OP10_SQL,
    }
