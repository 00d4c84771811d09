"""Binary containers: headers, trailers, assembly, slices and the check of a pair (survey 2.1).

A container is its parts one after the other and a trailer of their sizes, each as a little-endian 32-bit number. It is read
from the tail; a container with a negative size, or sizes that don't add up, is refused (``ok`` false, parts null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import table

#: A header's flag is the top bit of its five bytes; texts from this length on carry their alphabet.
FLAG, LONG = 1 << 39, 10_000


def size32(n: Column) -> Column:
    """Four bytes, the lowest first."""
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))


def read32(data: Column, at: Column) -> Column:
    """The signed number whose four bytes begin at ``at`` (from 1)."""
    digits = F.hex(F.substring(data, at, F.lit(4)))
    n = F.conv(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)


def assembled(parts: list[Column]) -> Column:
    """Null if a part is null."""
    return F.concat(*parts, *[size32(F.octet_length(p).cast("long")) for p in parts])


def sliced(df: DataFrame, column: str, names: list[str], keep: list[str]) -> DataFrame:
    """(keep ..., ok, names ...): the parts of each container; refused and null ones have null parts."""
    data, tail = F.col("_data"), 4 * len(names)
    sizes = [F.when(F.col("_n") >= tail, read32(data, F.col("_n") - tail + 4 * i + 1)) for i in range(len(names))]
    rows = df.select(*keep, F.col(column).alias("_data"), F.octet_length(column).cast("int").alias("_n")).select("*", F.array(*sizes).alias("_sizes"))
    total = F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    fits = F.coalesce(F.forall("_sizes", lambda x: x >= 0) & (total + tail == F.col("_n")), F.lit(False))
    rows = rows.select("*", fits.alias("ok"))
    starts = [F.aggregate(F.slice("_sizes", 1, i), F.lit(1).cast("long"), lambda a, x: a + x) if i else F.lit(1).cast("long") for i in range(len(names))]
    cut = [F.when(F.col("ok"), F.substring(data, s.cast("int"), F.col("_sizes")[i].cast("int"))).alias(name) for i, (name, s) in enumerate(zip(names, starts, strict=True))]
    return rows.select(*keep, "ok", *cut)


def verified(programs: DataFrame, archives: DataFrame, key: str) -> DataFrame:
    """(key, same): whether program and archive of one key, as (key, program_bytes, total_bytes), hold the same program.

    A key that one side lacks is not the same. Keys are thought to be unique; null keys match nothing.
    """
    both = programs.alias("p").join(archives.alias("a"), key, "full")
    return both.select(key, F.coalesce((F.col("p.program_bytes") == F.col("a.program_bytes")) & (F.col("p.total_bytes") <= F.col("a.total_bytes")), F.lit(False)).alias("same"))


def header(text: Column, folded: Column) -> Column:
    """Five bytes as hex digits: the length, the highest byte first, and the flag on top."""
    return F.lpad(F.hex(F.octet_length(text).cast("long") + F.when(folded, F.lit(FLAG)).otherwise(F.lit(0))), 10, "0")


def header_read(digits: Column) -> tuple[Column, Column]:
    """The length and the flag."""
    n = F.conv(digits, 16, 10).cast("long")
    return n.bitwiseAND(FLAG - 1), n >= FLAG


_PARTS = ["program", "dictionary", "payload"]


def _containers(s: SparkSession, d: str) -> DataFrame:
    raw = lambda c: F.coalesce(F.col(c).cast("binary"), F.lit(b""))
    parts = {"program": F.encode(F.col("page_id").cast("string"), "UTF-8"), "dictionary": raw("url"), "payload": raw("html")}
    return table(s, d, "pages").select("page_id", *[v.alias(k) for k, v in parts.items()], assembled(list(parts.values())).alias("image"))


def _headers(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", header(F.col("text"), F.col("lang") == "en").alias("header"), F.octet_length("text").alias("n"))
    length, flag = header_read(F.col("header"))
    return rows.select("doc_id", "header", length.alias("length"), flag.alias("flag"), (F.col("n") >= LONG).alias("has_alphabet"))


def _slices(s: SparkSession, d: str) -> DataFrame:
    got = sliced(_containers(s, d), "image", _PARTS, ["page_id"])
    return got.select("page_id", "ok", *[F.octet_length(p).cast("long").alias(f"{p}_bytes") for p in _PARTS], F.md5("payload").alias("payload_md5"))


def _refused(s: SparkSession, d: str) -> DataFrame:
    """Containers that lost their last byte, and their first."""
    rows = _containers(s, d)
    cut = rows.select("page_id", F.lit("last").alias("lost"), F.expr("substring(image, 1, octet_length(image) - 1)").alias("image"))
    cut = cut.unionByName(rows.select("page_id", F.lit("first").alias("lost"), F.expr("substring(image, 2)").alias("image")))
    return sliced(cut, "image", _PARTS, ["page_id", "lost"])


def _pairs(s: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.octet_length(c).cast("long")
    rows = _containers(s, d)
    programs = rows.select("page_id", size("program").alias("program_bytes"), size("program").alias("total_bytes"))
    archives = sliced(rows, "image", _PARTS, ["page_id"]).select("page_id", size("program").alias("program_bytes"), (size("program") + size("payload")).alias("total_bytes"))
    return verified(programs, archives, "page_id")


QUERIES = {
    "archive_header": _headers,
    "container_slice": _slices,
    "container_refused": lambda s, d: _refused(s, d).groupBy("lost", "ok").agg(F.count("*").alias("n")),
    "container_pair": _pairs,
}
ORACLES = {
    "archive_header": f"SELECT doc_id, lpad(hex(strlen(text) + CASE WHEN lang = 'en' THEN {FLAG} ELSE 0 END), 10, '0') AS header, strlen(text) AS length, lang = 'en' AS flag, strlen(text) >= {LONG} AS has_alphabet FROM documents",
    "container_slice": "SELECT page_id, TRUE AS ok, strlen(CAST(page_id AS VARCHAR)) AS program_bytes, strlen(url) AS dictionary_bytes, strlen(html) AS payload_bytes, md5(html) AS payload_md5 FROM pages",
    "container_refused": "SELECT lost, FALSE AS ok, count(*) AS n FROM pages, (VALUES ('first'), ('last')) v(lost) GROUP BY lost",
    "container_pair": "SELECT page_id, TRUE AS same FROM pages",
}
