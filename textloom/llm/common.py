"""What the operators share: scratch tables, document keys, Arrow helpers.

Recovery: lineage is cut with Parquet tables below ``spark.checkpoint.dir`` only, so any executor can be lost.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Sorts after every document that has an id.
NO_ID = (1 << 63) - 1
#: While a scratch table is written, shuffles are freed behind it.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Small Arrow batches, so that neither executors nor Python workers hold much of a long text at once.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: What frees the caches that an operator keeps in a Python process from task to task.
CACHES: list[Callable[[], None]] = []
#: Bits of the filter that :func:`maybe_in` sends to all tasks, whatever the input.
FILTER_BITS = 1 << 26


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches; they hold for what is run later, so they are not set back."""
    for k, most in _BATCHES.items():
        if not 0 < int(spark.conf.get(k).rstrip("b")) <= most:
            spark.conf.set(k, str(most))


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; the shuffles behind it are freed at once."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    small_batches(spark)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read again: what was made of them has been written."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_number(docs: DataFrame, doc_id: str) -> None:
    """Refuse ids that are not whole numbers, before any of them is read."""
    kind = docs.schema[doc_id].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id} has to be a column of whole numbers, not of {kind}")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(_id, _h, doc_id, raw): raw is the UTF-8 text, empty for null; rows alike in _id and _h are copies of one row.

    With ``whole``, a struct ``row`` of all columns takes the place of doc_id and raw.

    A null id counts as 2^63 - 1, the largest; ids that are not whole numbers raise a TypeError. Other columns are left
    behind, whatever their names.
    """
    whole_number(docs, doc_id)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(raw).alias("_h"),
        *([F.struct(*docs.columns).alias("row")] if whole else [F.col(doc_id).alias("doc_id"), raw.alias("raw")]),
    )


def maybe_in(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` (a long hash) is not in ``few``; none of the others is lost.

    A bitmap of a fixed number of bits goes to every task, so that what a following join drops is not shuffled first. With
    more and more keys it lets more rows pass, and costs no more.
    """
    spark = rows.sparkSession
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).cast("int")
    words = few.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    got = words.toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            at = b.column("_slot").to_numpy()
            hit = (bits[at >> 6] >> (at & 63)) & 1
            if hit.any():
                yield b.filter(pa.array(hit.astype(bool))).drop_columns(["_slot"])

    return rows.withColumn("_slot", slot).mapInArrow(keep, rows.schema)


def small(batches: Iterator[pa.RecordBatch], column: str = "raw", limit: int = 1 << 20, caches: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, or of one row. Without ``caches``, none are kept meanwhile."""
    if not caches:
        without_caches()
    done = 0
    for b in batches:
        at = blob(b.column(column))[1]
        i, done = 0, done + b.nbytes
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield b.slice(i, j - i)
            i = j
    tidy(done)


def without_caches() -> None:
    for free in CACHES:
        free()


#: A task that had fewer bytes of input leaves what it used to the next one.
TIDIED = 1 << 18


def tidy(done: int = TIDIED) -> None:
    """After ``done`` bytes of input: give back what this process does not use; Python workers live on from task to task.

    What was there before the first time, modules above all, is not searched again: that takes longer than a small task.
    """
    if done < TIDIED:
        return
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def blob(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column without nulls as one array, and the n + 1 places where values begin."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    """A record batch of the long, int, double and binary columns that a DDL-like ``name kind, ...`` list names."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    names, arrays = [], []
    for part, column in zip(schema.split(","), columns, strict=True):
        name, kind = part.split()
        names.append(name)
        if isinstance(column, np.ndarray) and column.dtype == np.uint64:
            column = column.view(np.int64)
        arrays.append(column if isinstance(column, (pa.Array, pa.ChunkedArray)) else pa.array(column, kinds[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Of batches sorted by ``key``: one table for each run of equal keys, held in memory one at a time."""
    without_caches()
    held: list[pa.RecordBatch] = []
    last, done = None, 0
    for b in batches:
        done += b.nbytes
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows > 1 else np.zeros(0, int)
        for i, j in zip([0, *cut], [*cut, b.num_rows], strict=True):
            now = tuple(c[i] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(int(i), int(j - i)))
    if held:
        yield pa.Table.from_batches(held)
    held, b = [], None
    tidy(done)


def letters_folded(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
