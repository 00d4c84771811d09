"""Running values over ordered groups of any size, by a prefix scan over range partitions.

A window over one group is one task, however large the group is. Here the rows are partitioned by ranges of (keys, order), so
that a large group lies in many partitions; windows run within (keys, partition), and what the partitions before hold is
added from a table of partition ends. Only ends of groups that began in an earlier partition are needed, which is at most one
row for each partition: that bounds what is broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coding import lehmer
from ..sources.shared import materialized

#: Rows of one block of :func:`smaller_later`.
BLOCK = 1 << 15


def scan(df: DataFrame, keys: list[str], order: list[str], number: str | None = None, lags: dict[str, str] | None = None, sums: dict[str, str] | None = None, maxes: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running values of each group of ``keys`` in ascending ``order`` (nulls first), as new column -> column.

    ``number`` counts from 1; ``lags`` are values of the row before; ``sums`` and ``maxes`` include the row itself, a null adds
    nothing. Rows of a null key are a group. ``order`` must tell all rows of a group apart, or equal rows share their values
    in any order. An empty table stays empty. Columns that begin with ``_scan`` are reserved.
    """
    lags, sums, maxes = lags or {}, sums or {}, maxes or {}
    rows = materialized(df.repartitionByRange(*keys, *order).withColumn("_scan_part", F.spark_partition_id()), "scan")
    own = Window.partitionBy(*keys, "_scan_part").orderBy(*order)
    running = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max_by(F.struct(F.lit(1).alias("_scan_any"), *dict.fromkeys(lags.values())), F.struct(*order))
    ends = rows.groupBy(*keys, "_scan_part").agg(
        F.count("*").alias("_scan_n"), last.alias("_scan_last"),
        *[F.sum(c).alias(f"_scan_s_{new}") for new, c in sums.items()], *[F.max(c).alias(f"_scan_m_{new}") for new, c in maxes.items()],
    )
    parts = Window.partitionBy(*keys).orderBy("_scan_part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_scan_k{i}") for i, k in enumerate(keys)], F.col("_scan_part").alias("_scan_at"),
        F.sum("_scan_n").over(before).alias("_scan_base"), F.lag("_scan_last").over(parts).alias("_scan_last"),
        *[F.sum(f"_scan_s_{new}").over(before).alias(f"_scan_s_{new}") for new in sums], *[F.max(f"_scan_m_{new}").over(before).alias(f"_scan_m_{new}") for new in maxes],
    ).where("_scan_base is not null")
    got = rows.select(
        "*", F.row_number().over(own).alias("_scan_row"), *[F.lag(c).over(own).alias(f"_scan_l_{new}") for new, c in lags.items()],
        *[F.sum(c).over(running).alias(f"_scan_r_{new}") for new, c in sums.items()], *[F.max(c).over(running).alias(f"_scan_x_{new}") for new, c in maxes.items()],
    )
    same = F.col("_scan_part") == F.col("_scan_at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_scan_k{i}"))
    both = got.join(F.broadcast(carried), same, "left")
    zero = F.lit(0)
    return both.select(
        *df.columns,
        *([(F.col("_scan_row") + F.coalesce("_scan_base", zero)).alias(number)] if number else []),
        *[F.when(F.col("_scan_row") == 1, F.col("_scan_last")[c]).otherwise(F.col(f"_scan_l_{new}")).alias(new) for new, c in lags.items()],
        *[(F.coalesce(f"_scan_r_{new}", zero) + F.coalesce(f"_scan_s_{new}", zero)).alias(new) for new in sums],
        *[F.greatest(f"_scan_x_{new}", f"_scan_m_{new}").alias(new) for new in maxes],
    )


def smaller_later(df: DataFrame, keys: list[str], order: list[str], value: str, new: str = "smaller_later", block: int = BLOCK) -> DataFrame:
    """``df`` with the Lehmer digit of each row: how many later rows of its group have a smaller ``value``.

    Positions and ranks are cut into blocks. A later, smaller row lies in a later block of positions and a lower block of
    ranks (a grid of counts), or in the same block of either, which a Fenwick tree counts; no task holds more than a block.
    A null counts as less than all values.
    """
    placed = scan(scan(df, keys, order, number="_pos"), keys, [value, "_pos"], number="_rank")
    rows = placed.withColumn("_pb", F.expr(f"(_pos - 1) div {block}")).withColumn("_vb", F.expr(f"(_rank - 1) div {block}"))
    rows = materialized(rows, "lehmer")
    slim = rows.select(*keys, "_pos", "_rank", "_pb", "_vb")

    def by_position(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_pos")
        return g.assign(_same=lehmer(g["_rank"].tolist()) - g.groupby("_vb")["_rank"].transform(lambda x: lehmer(x.tolist())))

    def by_rank(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_pos")
        return g.assign(_same=g["_same"] + lehmer(g["_rank"].tolist()))

    near = slim.groupBy(*keys, "_pb").applyInPandas(by_position, slim.withColumn("_same", F.lit(0).cast("long")).schema)
    near = near.groupBy(*keys, "_vb").applyInPandas(by_rank, near.schema)

    cells = slim.groupBy(*keys, "_pb", "_vb").agg(F.count("*").alias("_c"))
    side = slim.groupBy(*keys).agg(F.max("_pb").alias("_most"))
    axis = side.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("_pb"), "_most")
    grid = axis.select(*keys, "_pb", F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("_vb"))
    lower = Window.partitionBy(*keys, "_pb").orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys, "_vb").orderBy("_pb").rowsBetween(1, Window.unboundedFollowing)
    full = _joined(grid, cells, [*keys, "_pb", "_vb"], "left").withColumn("_below", F.sum("_c").over(lower))
    far = full.select(*keys, "_pb", "_vb", F.coalesce(F.sum("_below").over(later), F.lit(0)).alias("_far"))
    digits = _joined(near, far, [*keys, "_pb", "_vb"], "inner").select(*keys, "_pos", (F.col("_same") + F.col("_far")).alias(new))
    return _joined(rows, digits, [*keys, "_pos"], "inner").select(*df.columns, new)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which a null key meets a null key."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, same, how).drop(*[f"_r_{k}" for k in keys])
