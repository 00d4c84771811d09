"""Operator 3, sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, where u is made of the first 52 bits of
the MD5 of the row's key and the child's path (a hash that every SQL engine has), and the least draw wins, so a child gets rows by its weight. A child's draws depend on nothing but its own name
and weight: rows move only into a subtree whose weight grew, or out of one whose weight fell.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch

#: Groups within a shard in which rows are numbered; a shard's rows are never gathered in one task.
BUCKETS = 1024


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(n: int, racks: int = 2, shards: int = 4) -> list[Shard]:
    """``n`` shards of weight 1: racks of ``shards`` shards, regions of ``racks`` racks, filled in order."""
    return [Shard(f"region{i // (racks * shards)}", f"rack{i // shards % racks}", i) for i in range(n)]


def grown(old: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own: no other subtree's weight changes, so rows move only into the new shard."""
    number = max((s.shard for s in old), default=-1) + 1
    return [*old, Shard(f"region-of-{number}", "rack0", number, weight)]


def _number(text: Column) -> Column:
    """The first 52 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _least(key: Column, children: list[tuple[str, float]]) -> Column:
    """The place of the child with the least weighted draw; ties go to the first."""
    draws = []
    for i, (name, weight) in enumerate(children):
        unit = (_number(F.concat(key, F.lit(name))) + 0.5) / float(1 << 52)
        draws.append(F.struct((-F.ln(unit) / weight).alias("draw"), F.lit(i).alias("at")))
    return F.array_min(F.array(*draws))["at"] if len(draws) > 1 else F.lit(0)


def placed(key: Column, shards: Sequence[Shard]) -> Column:
    """The shard number of a key: a text, or what can be cast to one; a null is an empty text."""
    key = F.coalesce(key.cast("string"), F.lit(""))

    def descend(members: list[Shard], level: int, path: str) -> Column:
        if level == 3:
            return F.lit(members[0].shard)
        names = list(dict.fromkeys(str(m[level]) for m in members))
        below = [[m for m in members if str(m[level]) == name] for name in names]
        if len(names) == 1:
            return descend(below[0], level + 1, f"{path}/{names[0]}")
        at = _least(key, [(f"{path}/{name}", sum(m.weight for m in own)) for name, own in zip(names, below, strict=True)])
        inner = [descend(own, level + 1, f"{path}/{name}") for name, own in zip(names, below, strict=True)]
        if level == 2:
            return F.element_at(F.array(*inner), at + 1)
        out = inner[-1]
        for i in range(len(inner) - 2, -1, -1):
            out = F.when(at == i, inner[i]).otherwise(out)
        return out

    live = [s for s in shards if s.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    return descend(live, 0, "").cast("int")


def assign(docs: DataFrame, shards: Sequence[Shard], doc_id: str = "doc_id", text: str = "text", then: Sequence[Shard] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size is the text's UTF-8 bytes plus 8, 8 for null; the checksum of a null text is that of no bytes. slot numbers a shard's
    rows from 0 without gaps, in groups by hash and then by id, checksum and size, nulls first. grown_shard is the place in the
    tree ``then`` (null without). The key is the id alone, of any kind that has a text form: rows of equal or null id share a
    shard, and repeated rows have slots of their own. An empty table gives an empty result; other columns are ignored.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"),
        placed(key, shards).alias("shard"), (placed(key, then) if then else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(_number(key), F.lit(buckets)).cast("int").alias("bucket"),
    )
    narrow = scratch(narrow, "sharding-rows")
    shares = narrow.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch(shares.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "sharding-base")
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    rows = narrow.withColumn("at", F.row_number().over(within) - 1).join(base, ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("at")).alias("slot"), "grown_shard")


def op3_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = tree(24)
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards, then=grown(shards))


def _place_sql(shards: Sequence[Shard]) -> str:
    """Each step of the tree as a SQL expression over the text ``k``: lists of draws, of which the least is taken."""

    def descend(members: list[Shard], level: int, path: str) -> str:
        if level == 3:
            return str(members[0].shard)
        names = list(dict.fromkeys(str(m[level]) for m in members))
        below = [[m for m in members if str(m[level]) == name] for name in names]
        inner = [descend(own, level + 1, f"{path}/{name}") for name, own in zip(names, below, strict=True)]
        if len(names) == 1:
            return inner[0]
        draws = ", ".join(f"-ln((('0x' || substr(md5(k || '{path}/{name}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / {sum(m.weight for m in own)}" for name, own in zip(names, below, strict=True))
        return f"[{', '.join(inner)}][list_position([{draws}], list_min([{draws}]))]"

    return descend([s for s in shards if s.weight > 0], 0, "")


#: SQL has no CRC-32: a table of 256 remainders is made by its rule, and bytes are taken from the text's hexadecimal form.
OP3_SQL = f"""
WITH RECURSIVE t(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tb FROM t WHERE k = 8),
b AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, '')) AS n FROM documents),
d AS (SELECT doc_id, k, n + 8 AS size, CASE WHEN n = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(0, n - 1), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)),
  lambda a, x: xor(a >> 8, tb[(xor(a, x) & 255) + 1])), 4294967295) END AS text_crc32 FROM b, crc),
p AS (SELECT *, ('0x' || substr(md5(k), 1, 13))::BIGINT % {BUCKETS} AS bucket, {_place_sql(tree(24))} AS shard, {_place_sql(grown(tree(24)))} AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM p
"""
