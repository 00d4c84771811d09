"""Windows of a fixed width that repeat across a corpus: what both substring operators share.

1. Winnowing gives every window one anchor (its least short gram); equal windows have equal anchors. Only anchors that occur
   twice are joined back to their places, so unique text leaves after one narrow shuffle.
2. Runs of windows with equal anchors and equal content are settled together, by one aggregation.
3. What is left are the runs at the edges of repeats, one for each distinct content. Their symbols (no longer than a window and
   its anchors' reach) go to a block with all others of their anchor, where the operator's own method decides: a suffix sort for
   bytes, an extension from the seed for words. An anchor of more than ``MOST`` such runs is in no block: the windows of its
   runs are grouped by 128 bits of hash, so no task holds a hot anchor.
4. Every repeat names a source. Neighbouring windows of one source and distance are chained to one repeat, and a repeat and its
   source are both digested (BLAKE2b) while texts are cut: if any two differ, hashes of runs had a collision, and all is done
   again with other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import batch_of, blob, discard, scratch, small, tidy, without_caches

#: Turns a batch's bytes and document places into symbols, document places among them, and the bytes' starts and ends.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
#: Open runs of an anchor, and bytes of them, that go to one block; and about the bytes of a block of several anchors.
MOST, MOST_BYTES, BLOCK_BYTES = 512, 8 << 20, 1 << 20
#: Tries at hashes of runs without a collision.
ATTEMPTS = 3


def as_bytes(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(data) + 1)
    return rolling.bytes_as_symbols(data), places, at[:-1], at[1:]


def as_words(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return rolling.words(data, places)


class Block:
    """Open runs of some anchors: their places, whether they are asked for, how often their content occurs, and their bytes."""

    def __init__(self, table: pa.Table):
        part = table.column("part").combine_chunks()
        self.data, self.places = blob(part.chunk(0) if isinstance(part, pa.ChunkedArray) else part)
        self.anchor, self.ids, self.hashes, self.pos, self.n, self.weight, self.asked = (table.column(c).to_numpy() for c in ("anchor", "_id", "_h", "pos", "n", "weight", "asked"))
        #: Windows: which run they belong to and how far into it they start.
        self.run = np.repeat(np.arange(len(self.n)), self.n)
        self.step = np.arange(len(self.run)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        #: Of each run, its place when all are in the order of id, hash and position.
        self.rank = np.empty(len(self.n), np.int64)
        self.rank[np.lexsort([self.pos, self.hashes, self.ids])] = np.arange(len(self.n))


#: Of a block: windows that are asked for and repeat, and for each its source window.
Decide = Callable[[Block], tuple[np.ndarray, np.ndarray]]

_SEGS = "anchor long, s1 long, s2 long, _id long, _h long, pos long, n int"
_OPEN = "anchor long, _id long, _h long, pos long, n int, weight int, asked boolean, part binary"
_SPANS = "_id long, _h long, pos long, n long, s_id long, s_h long, s_pos long"
_WINS = "h1 long, h2 long, _id long, _h long, pos long, weight int, asked boolean"


def _segments(docs: DataFrame, units: Units, width: int, gram: int, attempt: int, wide: bool) -> DataFrame:
    schema = _SEGS if wide else "anchor long, s long, _id long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            data, places = blob(b.column("raw"))
            ids, hashes = (b.column(c).to_numpy() for c in ("_id", "_h"))
            symbols, at = units(data, places)[:2]
            for anchor, s1, s2, start, n in rolling.segments(symbols, at, width, gram, attempt):
                doc = np.searchsorted(at, start, "right") - 1
                cols = [anchor, s1, s2, ids[doc], hashes[doc], start - at[doc], n.astype(np.int32)] if wide else [anchor, rolling.mix(s1 ^ (s2 << np.uint64(1))), ids[doc]]
                yield batch_of(schema, cols)

    return docs.select("_id", "_h", "raw").mapInArrow(scan, schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of batches sorted by anchor: tables of whole anchors, of about ``BLOCK_BYTES``."""
    without_caches()
    held: list[pa.RecordBatch] = []
    size, b, table = 0, None, None
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column("part").nbytes
        if size >= BLOCK_BYTES:
            table = pa.Table.from_batches(held)
            anchors = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1], "left"))  # the last anchor may go on
            if cut:
                yield table.slice(0, cut)
                held, size = table.slice(cut).to_batches(), table.slice(cut).column("part").nbytes
    if held:
        yield pa.Table.from_batches(held)
    held, b, table = [], None, None
    tidy()


def _islands(cols: list[np.ndarray]) -> list[np.ndarray]:
    """(_id, _h, pos, n, s_id, s_h, s_pos) of windows or runs with the neighbours chained that have one source at one distance."""
    i, h, pos, n, si, sh, sp = cols
    order = np.lexsort([pos, pos - sp, sh, si, h, i])
    i, h, pos, n, si, sh, sp = (c[order] for c in (i, h, pos, n, si, sh, sp))
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (h[1:] != h[:-1]) | (si[1:] != si[:-1]) | (sh[1:] != sh[:-1]) | (pos[1:] != pos[:-1] + n[:-1]) | (sp[1:] != sp[:-1] + n[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(n, first) if len(first) else n
    return [i[first], h[first], pos[first], total, si[first], sh[first], sp[first]]


def _in_blocks(opened: DataFrame, decide: Decide) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            b = Block(t)
            own, source = decide(b)
            if len(own):
                r, s = b.run[own], b.run[source]
                yield batch_of(_SPANS, _islands([b.ids[r], b.hashes[r], b.pos[r] + b.step[own], np.ones(len(own), np.int64), b.ids[s], b.hashes[s], b.pos[s] + b.step[source]]))

    return opened.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _SPANS)


def _by_windows(opened: DataFrame, units: Units, width: int, earlier: bool, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The same for anchors of any number of runs: windows are grouped by 128 bits of hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in small(batches, "part"):
            b = Block(pa.Table.from_batches([x]))
            symbols, at, _, _ = units(b.data, b.places)
            for i in range(0, len(b.run), 1 << 16):
                r, step = b.run[i : i + (1 << 16)], b.step[i : i + (1 << 16)]
                h1, h2 = rolling.strong(np.ascontiguousarray(symbols).view(np.uint8), 8 * (at[r] + step), np.full(len(r), 8 * width))
                yield batch_of(_WINS, [h1, h2, b.ids[r], b.hashes[r], b.pos[r] + step, b.weight[r], b.asked[r]])

    single = scratch(opened.mapInArrow(each, _WINS), f"{name}-windows")
    place = F.struct("_id", "_h", "pos")
    total = single.groupBy("h1", "h2").agg(F.sum("weight").alias("c"), F.min(place).alias("first"), F.max(place).alias("last"))
    total = scratch(total.where("first._id < last._id" if earlier else "c > 1").select("h1", "h2", "first", "last"), f"{name}-repeated")
    more = single.where("asked").join(total, ["h1", "h2"])
    source = F.col("first") if earlier else F.when(F.col("first") == place, F.col("last")).otherwise(F.col("first"))
    more = (more.where(F.col("first._id") < F.col("_id")) if earlier else more).withColumn("s", source)
    return more.select("_id", "_h", "pos", F.lit(1).cast("long").alias("n"), F.col("s._id").alias("s_id"), F.col("s._h").alias("s_h"), F.col("s.pos").alias("s_pos")), [single, total]


def repeated(docs: DataFrame, units: Units, width: int, gram: int, earlier: bool, decide: Decide, name: str = "repeats", attempt: int = 0) -> DataFrame:
    """(_id, _h, marks: [(own, pos, n, s_id, s_h, s_pos)]): for each document its repeats, and which of its places are sources.

    ``docs`` comes from :func:`common.keyed`. A mark with ``own`` says that the n windows from symbol pos also start at s_pos of
    the document (s_id, s_h); one without, that other documents name the n windows from pos as their source. With ``earlier``, a
    window counts only if it also starts in a document of a smaller id; else a second start anywhere, in the same document too,
    is enough. Repeats of different sources may overlap in what they cover; marks are in no order.
    """
    found = _segments(docs, units, width, gram, attempt, False).groupBy("anchor").agg(
        F.count("*").alias("c"), F.min("_id").alias("least"), F.max("_id").alias("most"), (F.min("s") != F.max("s")).alias("mixed")
    )
    found = found.where(F.col("least") < F.col("most")) if earlier else found.where("c > 1")
    found = scratch(found.select("anchor", "least", "mixed"), f"{name}-anchors")
    placed = scratch(_segments(docs, units, width, gram, attempt, True).join(found, "anchor"), f"{name}-seeds")
    discard(found)

    run = ["anchor", "s1", "s2"]
    place = F.struct("_id", "_h", "pos")
    same = placed.groupBy(*run).agg(F.count("*").alias("c"), F.min(place).alias("head"), F.max(place).alias("tail"))
    # a run of which there is one, with an anchor that has no other content, has nothing more to say
    same = scratch(same.where("c > 1").select(*run, "c", "head", "tail"), f"{name}-runs")
    both = placed.join(same, run, "left")
    first = F.coalesce(F.col("head._id"), F.col("_id"))
    settled = (F.col("_id") > first) if earlier else F.col("c").isNotNull()
    asked = (F.col("least") < first) if earlier else F.col("c").isNull()
    is_head = F.coalesce(place == F.col("head"), F.lit(True))
    evidence = (F.col("_id") == first) if earlier else is_head
    source = F.when(settled, F.when(is_head, F.col("tail")).otherwise(F.col("head")))
    both = scratch(
        both.select(
            "anchor", "_id", "_h", "pos", "n", settled.alias("settled"), (F.col("mixed") & evidence).alias("open"), asked.alias("asked"), F.when(F.col("c") > 1, 2).otherwise(1).alias("weight"), source.alias("s")
        ).where("settled or open"),
        f"{name}-both",
    )
    discard(placed, same)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            data, places = blob(b.column("raw"))
            _, at, starts, ends = units(data, places)
            ids, hashes = (b.column(c).to_numpy() for c in ("_id", "_h"))
            lists = b.column("runs")
            flat = lists.flatten()
            doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            anchor, pos, n, weight, asks = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "pos", "n", "weight", "asked"))
            for i in range(0, len(doc), 4096):
                part = slice(i, i + 4096)
                low = at[doc[part]] + pos[part]
                begin, size = starts[low], ends[low + n[part] + width - 2] - starts[low]
                upto = np.cumsum(size)
                got = data[np.arange(upto[-1]) + np.repeat(begin - (upto - size), size)]
                bytes_ = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, upto].astype(np.int32).tobytes()), pa.py_buffer(got.tobytes())])
                yield batch_of(_OPEN, [anchor[part], ids[doc[part]], hashes[doc[part]], pos[part], n[part], weight[part], asks[part], bytes_])

    runs = both.where("open").groupBy("_id", "_h").agg(F.collect_set(F.struct("anchor", "pos", "n", "weight", "asked")).alias("runs"))
    opened = scratch(docs.select("_id", "_h", "raw").join(runs, ["_id", "_h"]).mapInArrow(look, _OPEN), f"{name}-open")
    hot = opened.groupBy("anchor").agg(F.count("*").alias("c"), F.sum(F.length("part")).alias("b")).where((F.col("c") > MOST) | (F.col("b") > MOST_BYTES)).select("anchor")
    hot, rest = scratch(hot, f"{name}-hot"), []
    spans = both.where("settled").select("_id", "_h", "pos", F.col("n").cast("long").alias("n"), F.col("s._id").alias("s_id"), F.col("s._h").alias("s_h"), F.col("s.pos").alias("s_pos"))
    spans = spans.unionByName(_in_blocks(opened.join(hot, "anchor", "left_anti"), decide))
    if not hot.isEmpty():
        more, rest = _by_windows(opened.join(hot, "anchor", "left_semi"), units, width, earlier, name)
        spans = spans.unionByName(more)
    spans = scratch(spans.groupBy("_id", "_h").agg(F.collect_list(F.struct("pos", "n", "s_id", "s_h", "s_pos")).alias("spans")), f"{name}-spans")
    discard(both, opened, hot, *rest)

    kinds = "_id long, _h long, own boolean, pos long, n long, s_id long, s_h long, s_pos long"

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists, (ids, hashes) = b.column("spans"), (b.column(c).to_numpy() for c in ("_id", "_h"))
            doc, flat = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()
            i, h, pos, n, si, sh, sp = _islands([ids[doc], hashes[doc], *(flat.field(k).to_numpy() for k in ("pos", "n", "s_id", "s_h", "s_pos"))])
            yield batch_of(kinds, [i, h, np.ones(len(i), bool), pos, n, si, sh, sp])
            none = pa.nulls(len(i), pa.int64())
            yield batch_of(kinds, [si, sh, np.zeros(len(i), bool), sp, n, none, none, none])

    marks = spans.mapInArrow(chain, kinds).groupBy("_id", "_h").agg(F.collect_set(F.struct("own", "pos", "n", "s_id", "s_h", "s_pos")).alias("marks"))
    marks = scratch(marks, f"{name}-marks")
    discard(spans)
    return marks


class Marks:
    """The marks of the documents of a batch, and what they say about one of them."""

    CLAIMS = pa.struct([("id", pa.int64()), ("h", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("own", pa.bool_()), ("digest", pa.binary())])

    def __init__(self, batch: pa.RecordBatch, width: int):
        lists, self.width = batch.column("marks"), width
        self.keys = batch.column("_id").to_pylist(), batch.column("_h").to_pylist()
        self.at = lists.offsets.to_numpy()
        self.valid = lists.is_valid().to_numpy(zero_copy_only=False)
        flat = lists.values
        self.own = flat.field("own").to_numpy(zero_copy_only=False)
        self.pos, self.n, *self.source = (flat.field(k).fill_null(0).to_numpy() for k in ("pos", "n", "s_id", "s_h", "s_pos"))
        self.claims: list[list] = []

    def of(self, row: int, units: list[bytes] | bytes) -> tuple[np.ndarray, int]:
        """Which of a document's units (bytes, or a list of words) a repeat covers, and how many repeats it has.

        Digests of the units of all marks go to ``claims``.
        """
        edge, repeats, claims = np.zeros(len(units) + 1, np.int64), 0, []
        for k in range(self.at[row], self.at[row + 1]) if self.valid[row] else ():
            pos, n = int(self.pos[k]), int(self.n[k])
            part = units[pos : pos + n + self.width - 1]
            digest = hashlib.blake2b(part if isinstance(part, bytes) else b" ".join(part), digest_size=16).digest()
            if self.own[k]:
                edge[pos] += 1
                edge[pos + n + self.width - 1] -= 1
                repeats += 1
                claims.append((*(int(s[k]) for s in self.source), n, True, digest))
            else:
                claims.append((self.keys[0][row], self.keys[1][row], pos, n, False, digest))
        self.claims.append([dict(zip(("id", "h", "pos", "n", "own", "digest"), c, strict=True)) for c in claims])
        return np.cumsum(edge[:-1]) > 0, repeats

    def claimed(self) -> pa.Array:
        return pa.array(self.claims, pa.list_(self.CLAIMS))


#: The last column of what a cut has to give to :func:`verified`.
CLAIMS = "claims array<struct<id: long, h: long, pos: long, n: long, own: boolean, digest: binary>>"


def verified(cut: Callable[[int], DataFrame], name: str) -> DataFrame:
    """What ``cut`` makes (with a column ``claims``) at its first attempt at which each repeat is like its source."""
    for attempt in range(ATTEMPTS):
        done = scratch(cut(attempt), f"{name}-cut")
        claims = done.select(F.explode("claims").alias("x")).select("x.*")
        bad = claims.groupBy("id", "h", "pos", "n").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.min("own").alias("alone")).where("a <> b or alone")
        if bad.isEmpty():
            return done.drop("claims")
        discard(done)
    raise RuntimeError(f"hashes of runs collided in each of {ATTEMPTS} attempts")
