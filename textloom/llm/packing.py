"""Operator 1, best-fit packing by sums of squares: a document goes where the squared counts of open bins per residual gap
become smallest.

The rule looks at nothing but the number of open bins for each gap, and documents of one length are alike. So the plan is made
from the histogram of lengths, longest first, and it is a list of patterns: how many sequences hold which lengths in which order.
Documents then find their place by their length and their rank among equals, with no shuffle of texts.

The rule itself takes the items one by one (as many at once as leave the best gap the best). To keep that bounded, a histogram of
more than ``ITEMS`` items for each token of the capacity is planned for one of k equal shares, and every sequence stands for k; what
does not divide by k, and the items of the emptiest sequences, are planned after that in the same way, down to k = 1. After the
rule the emptiest sequences are opened again and their items put where they fit best, if that saves sequences.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import batch_of, scratch, small

CAPACITY, END = 2048, 0
#: Items that are planned one by one, for each token of the capacity: bounds the plan and the time on the driver.
ITEMS = 64
#: Of the sequences of a share, the emptiest of so many are planned again with what is left.
AGAIN = 50


class _Patterns:
    """Sequences by what they hold: each pattern is a number, made of a shorter one and a length; 0 is empty."""

    def __init__(self):
        self.made, self.parts = {}, [(0, 0)]

    def longer(self, pattern: int, size: int) -> int:
        key = pattern, size
        if key not in self.made:
            self.made[key] = len(self.parts)
            self.parts.append(key)
        return self.made[key]

    def sizes(self, pattern: int) -> list[int]:
        out = []
        while pattern:
            pattern, size = self.parts[pattern]
            out.append(size)
        return out[::-1]


def by_rule(counts: dict[int, int], capacity: int = CAPACITY) -> Counter[tuple[int, ...]]:
    """How many sequences hold which lengths: items in falling order, each where the sum of squares becomes smallest.

    Placing an item of size s into one of N[g] bins with gap g changes the sum of squares by 2 * (N[g - s] - N[g] + 1);
    a new bin by 2 * N[capacity - s] + 1. Gap 0 does not count, since such a bin is not open: filling one up changes it by
    1 - 2 * N[s]. Of equal changes the smaller gap is taken, a new bin last.
    """
    made, open_bins = _Patterns(), np.zeros(capacity + 1, np.int64)
    where: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # of each gap: pattern -> bins
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            cost = 2 * (open_bins[: capacity - s] - open_bins[s:capacity] + 1)  # of gaps s to capacity - 1
            if len(cost):
                cost[0] = 1 - 2 * open_bins[s]
                cost[open_bins[s:capacity] == 0] = 1 << 62
            new = 2 * int(open_bins[capacity - s]) + 1 if s < capacity else 1
            at = int(cost.argmin()) if len(cost) else 0
            if len(cost) and cost[at] <= new:
                gap, mine = at + s, int(cost[at])
                # each placement makes this gap dearer by 4 (2 if it is filled up), the gaps s off and a new bin cheaper by 2
                own = 4 if gap > s else 2
                cost[at] = 1 << 62
                near = [(at + d, 2) for d in (-s, s) if 0 <= at + d < len(cost)]
                fall = [(int(cost[k]), step, k < at) for k, step in near] + [(new, 2 if gap == capacity - s else 0, False)]
                for k, _ in near:
                    cost[k] = 1 << 62
                k = int(cost.argmin())
                fall.append((int(cost[k]), 0, k < at))
                # it stays the best for as many placements j as mine + own * j < other - step * j, or equal with a later other
                most = min((other - mine - (1 if before else 0)) // (own + step) + 1 for other, step, before in fall)
                n = max(1, min(left, int(open_bins[gap]), most))
                pattern, have = next(iter(where[gap].items()))
                n = min(n, have)
                if n == have:
                    del where[gap][pattern]
                else:
                    where[gap][pattern] = have - n
                open_bins[gap] -= n
            else:
                gap, pattern = capacity, 0
                best = int(cost.min()) if len(cost) else 1 << 62
                n = max(1, min(left, (best - new - 1) // 2 + 1)) if s < capacity else left
                if 2 * s <= capacity:  # the new bins are themselves a gap that gets cheaper
                    n = 1
            longer, rest = made.longer(pattern, s), gap - s
            where[rest][longer] = where[rest].get(longer, 0) + n
            if rest:
                open_bins[rest] += n
            left -= n
    out: Counter[tuple[int, ...]] = Counter()
    for bins in where:
        for pattern, n in bins.items():
            out[tuple(made.sizes(pattern))] += n
    return out


def _emptiest(bins: Counter[tuple[int, ...]], most: int) -> Counter[tuple[int, ...]]:
    out: Counter[tuple[int, ...]] = Counter()
    for pattern in sorted(bins, key=lambda p: (sum(p), p)):
        if most <= 0:
            break
        out[pattern] = min(bins[pattern], most)
        most -= out[pattern]
    return out


def _lengths(bins: Counter[tuple[int, ...]]) -> Counter[int]:
    out: Counter[int] = Counter()
    for pattern, n in bins.items():
        for s in pattern:
            out[s] += n
    return out


def _fitted(bins: Counter[tuple[int, ...]], sizes: Counter[int], capacity: int) -> Counter[tuple[int, ...]]:
    """``bins`` and ``sizes`` together: each item, longest first, goes into the fullest sequence that takes it."""
    made, where = _Patterns(), [Counter() for _ in range(capacity + 1)]
    for pattern, n in bins.items():
        number = 0
        for s in pattern:
            number = made.longer(number, s)
        where[capacity - sum(pattern)][number] += n
    full = np.array([sum(c.values()) for c in where])
    for s in sorted(sizes, reverse=True):
        for _ in range(sizes[s]):
            fits = np.flatnonzero(full[s:])
            gap, pattern = (int(fits[0]) + s, next(iter(where[fits[0] + s]))) if len(fits) else (capacity, 0)
            if len(fits):
                full[gap] -= 1
                where[gap][pattern] -= 1
                if not where[gap][pattern]:
                    del where[gap][pattern]
            full[gap - s] += 1
            where[gap - s][made.longer(pattern, s)] += 1
    out: Counter[tuple[int, ...]] = Counter()
    for c in where:
        for pattern, n in c.items():
            out[tuple(made.sizes(pattern))] += n
    return out


def _repaired(bins: Counter[tuple[int, ...]], capacity: int) -> Counter[tuple[int, ...]]:
    """The same items in fewer sequences, if opening the emptiest 1, 2, 4, ... of them again and fitting their items saves any."""
    best, used, n = bins, sum(bins.values()), 1
    least = -(-sum(sum(p) * k for p, k in bins.items()) // capacity)
    while n <= used and sum(best.values()) > least:
        opened = _emptiest(bins, n)
        got = _fitted(bins - opened, _lengths(opened), capacity)
        best = min(best, got, key=lambda b: sum(b.values()))
        n *= 2
    return best


def sequences(counts: dict[int, int], capacity: int = CAPACITY, items: int = ITEMS) -> Counter[tuple[int, ...]]:
    """How many sequences hold which lengths, for any number of items."""
    out: Counter[tuple[int, ...]] = Counter()
    counts = Counter({s: n for s, n in counts.items() if n})
    while counts:
        k = -(-sum(counts.values()) // (items * capacity))
        share = {s: n // k for s, n in counts.items() if n >= k}
        bins = _repaired(by_rule(share, capacity), capacity)
        if k > 1:
            bins = bins - _emptiest(bins, sum(bins.values()) // AGAIN)
        for pattern, n in bins.items():
            out[pattern] += n * k
        for s, n in _lengths(bins).items():
            counts[s] -= n * k
        counts = +counts
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, items: int = ITEMS) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): a line for each length in each pattern of :func:`sequences`."""
    ranks: Counter[int] = Counter()
    out, first = [], 0
    for pattern, n in sorted(sequences(counts, capacity, items).items(), reverse=True):
        at = 0
        for s in pattern:
            out.append((s, ranks[s], n, first, at))
            ranks[s] += n
            at += s
        first += n
    return out


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank): each document's ids and an end id, cut to the capacity.

    A document over the capacity is cut into pieces of just the capacity, but for the first, which takes the rest. rank
    numbers the pieces of one length within a task.
    """
    path = tokenizer or tokens.default_path()
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for b in small(batches, caches=True):
            names, rows = b.column("doc_id"), []
            for i, got in enumerate(tokens.ids(path).of([x.decode() for x in b.column("raw").to_pylist()])):
                whole = got + END.to_bytes(4, "little")
                total = len(whole) // 4
                start, end, k = 0, (total - 1) % capacity + 1, 0
                while start < total:
                    n = end - start
                    rows.append((i, k, start, n, zlib.crc32(whole[4 * start : 4 * end]), task, int(ranks[n])))
                    ranks[n] += 1
                    start, end, k = end, end + capacity, k + 1
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(cols[0])), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
        tokens.ids(path).rest()

    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(doc_id).alias("doc_id"), raw.alias("raw")).mapInArrow(run, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place in sequences of ``capacity`` tokens.

    Null and empty texts are one end id. Repeated rows and null ids are packed like others. An empty table packs to nothing.
    """
    spark = docs.sparkSession
    cut = scratch(pieces(docs, doc_id, text, capacity, tokenizer), "packing-pieces")
    shares = scratch(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "packing-shares")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch(shares.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-base")
    total = shares.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each possible length
    lines = np.array(plan(dict(zip(total.column("length").to_pylist(), total.column("n").to_pylist(), strict=True)), capacity) or np.zeros((0, 5)), np.int64)
    order = np.lexsort([lines[:, 1], lines[:, 0]])
    sent = spark.sparkContext.broadcast(lines[order])
    schema = cut.drop("task", "rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sent.value
        key = got[:, 0] * (1 << 45) + got[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("base").to_numpy()
            at = np.searchsorted(key, length * (1 << 45) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-2]), pa.array(got[at, 3] + rank - got[at, 1]), pa.array(got[at, 4])], names=schema.names)

    # a base for each length and task: it grows with the tasks, so it is not sent to all of them
    return cut.join(base.hint("merge"), ["length", "task"]).mapInArrow(place, schema)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
