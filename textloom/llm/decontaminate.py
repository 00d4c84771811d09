"""Operator 6, benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, and exact
weighted-shingle similarity for what they find.

A document is read once, against a block of benchmark items. Windows as long as an item are laid at every start where what they
share with the item weighs at least the least similarity times the item's weight (a union weighs no less than the item, so any
other window is less similar). Which items a window is compared with is up to its fingerprint of ``BITS`` bits, cut into
``BITS / WIDTH`` blocks: of two fingerprints within ``RADIUS`` bits, at most RADIUS // (NEAR + 1) blocks differ in more than
``NEAR`` bits, so all other blocks are near. For each block an index lists the items by the block's value; an item that is near
in so many blocks is a candidate, so none within the radius is missed, while of other items a few in a thousand are. Candidates
of the window's size within the radius are verified by the weighted Jaccard similarity of the shingle sets.

Fingerprints of sets of similarity 0.75 differ in 44 bits of 256 on average, with a deviation of 6.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blob, small, small_batches
from .rolling import Prefix, mix, words

SHINGLE, SIMILARITY = 5, 0.75
BITS, WIDTH, RADIUS, NEAR = 256, 16, 64, 4
#: Items and bytes of items that are sent to all tasks at once; a larger benchmark takes several rounds.
MOST_ITEMS, MOST_BYTES = 100_000, 16 << 20
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def _shingles(data: np.ndarray, places: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each text, the hash of each run of k words; of a text of fewer words, of all its words."""
    symbols, at, _, _ = words(data, places, fold=True)
    out = []
    for i, j in zip(at[:-1], at[1:], strict=True):
        n = min(k, j - i)
        out.append(mix(Prefix(symbols[i:j]).run(n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
    return out


def fingerprint(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The signs of the weighted sums of bits, as ``BITS / WIDTH`` numbers."""
    wide = mix(hashes[:, None] ^ _SALTS[None, :])
    bits = np.unpackbits(wide.view(np.uint8), axis=1).astype(np.float64) * 2 - 1
    return np.packbits(weights @ bits >= 0).view(np.uint16)


def _number(blocks: np.ndarray) -> int:
    return int.from_bytes(blocks.tobytes(), "little")


class Blocks:
    """Fingerprints by the values of their blocks."""

    def __init__(self, prints: np.ndarray, radius: int, near: int):
        self.prints, self.radius, self.near = prints, radius, near
        self.least = max(0, prints.shape[1] - radius // (near + 1))
        self.tables = []
        for column in prints.T:
            order = np.argsort(column, kind="stable")
            values, first = np.unique(column[order], return_index=True)
            self.tables.append((values, np.r_[first, len(order)], order))

    def candidates(self, print_: np.ndarray) -> np.ndarray:
        """Those that are near in enough blocks."""
        hits = np.zeros(len(self.prints), np.int16)
        for value, (values, at, order) in zip(print_, self.tables, strict=True):
            for k in np.flatnonzero(np.bitwise_count(values ^ value) <= self.near).tolist():
                hits[order[at[k] : at[k + 1]]] += 1
        return np.flatnonzero(hits >= self.least)

    def within(self, print_: np.ndarray) -> np.ndarray:
        some = self.candidates(print_)
        return some[np.bitwise_count(self.prints[some] ^ print_).sum(axis=1, dtype=np.int64) <= self.radius]


class Index:
    """Items by their shingles, and their fingerprints by Hamming blocks.

    ``whole`` is of a benchmark of which these are a part: its number of items, and its shingles of two items or more, ascending,
    with their numbers of items. Without it these are all items.
    """

    def __init__(self, ids: list, texts: list[bytes], k: int = SHINGLE, radius: int = RADIUS, near: int = NEAR, whole: tuple[int, np.ndarray, np.ndarray] | None = None):
        data = np.frombuffer(b"".join(texts), np.uint8)
        rows = _shingles(data, np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)], k)
        keep = [i for i, r in enumerate(rows) if len(r)]
        self.ids, self.k = [ids[i] for i in keep], k
        self.sizes = [len(rows[i]) for i in keep]
        self.own = rows = [np.unique(rows[i]) for i in keep]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        count, self.hashes, n = (len(rows), *np.unique(flat, return_counts=True)) if whole is None else whole
        self.rare = float(np.log1p(count))
        self.weights = np.log1p(count / n)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(rows)), [len(u) for u in rows])[order]
        weights = [self.weight(u) for u in rows]
        self.totals = np.array([float(w.sum()) for w in weights])
        wide = np.array([fingerprint(u, w) for u, w in zip(rows, weights, strict=True)], np.uint16).reshape(len(rows), BITS // WIDTH)
        self.prints = [_number(p) for p in wide]
        self.blocks = Blocks(wide, radius, near)
        self.sized: dict[int, tuple[np.ndarray, Blocks]] = {}
        of = np.array(self.sizes)
        for size in set(self.sizes):
            some = np.flatnonzero(of == size)
            self.sized[size] = some, Blocks(wide[some], radius, near)

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        """log(1 + items / items with the shingle); a shingle of no item counts as one of a single item."""
        if not len(self.hashes):
            return np.full(len(hashes), self.rare)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.weights[at], self.rare)

    def within(self, print_: int) -> list[int]:
        """Items of any size whose fingerprints are within the radius."""
        return self.blocks.within(np.frombuffer(print_.to_bytes(BITS // 8, "little"), np.uint16)).tolist()

    def alike(self, size: int, print_: np.ndarray) -> list[int]:
        """Items of a size whose fingerprints are within the radius."""
        some, blocks = self.sized[size]
        return some[blocks.within(print_)].tolist()

    def similarity(self, item: int, hashes: np.ndarray, weights: np.ndarray) -> float:
        own = self.own[item]
        both = float(weights[own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes].sum())
        return round(both / (self.totals[item] + float(weights.sum()) - both), 9)

    def windows(self, shingles: np.ndarray, least: float) -> set[tuple[int, int]]:
        """(start, size) of the windows of a document that can have similarity ``least`` to an item of their size."""
        laid: set[tuple[int, int]] = set()
        if not len(self.flat) or not len(shingles):
            return laid
        kinds = np.unique(shingles)
        low, high = np.searchsorted(self.flat, kinds), np.searchsorted(self.flat, kinds, "right")
        n = high - low
        if not n.any():
            return laid
        at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        bound = self.totals * (least - 1e-9)
        some = np.flatnonzero(np.bincount(self.owner[at], np.repeat(self.weight(kinds), n), len(bound)) >= bound)
        if not len(some):
            return laid
        order = np.argsort(shingles, kind="stable")
        before = np.full(len(shingles), -1)  # the last place of the same shingle
        again = np.flatnonzero(shingles[order[1:]] == shingles[order[:-1]])
        before[order[again + 1]] = order[again]
        for item in some.tolist():
            size, own = self.sizes[item], self.own[item]
            p = np.flatnonzero(own[np.minimum(np.searchsorted(own, shingles), len(own) - 1)] == shingles)
            # the starts of windows in which a place is the first of its shingle
            first, end = np.maximum(p - size, before[p]) + 1, np.minimum(p, max(0, len(shingles) - size)) + 1
            p, first, end = p[first < end], first[first < end], end[first < end]
            w = self.weight(shingles[p])
            points, step = np.unique(np.r_[first, end], return_inverse=True)
            both = np.cumsum(np.bincount(step, np.r_[w, -w]))
            for i in np.flatnonzero(both[:-1] >= bound[item]).tolist():
                laid.update((start, size) for start in range(points[i], points[i + 1]))
        return laid

    def found(self, shingles: np.ndarray, least: float) -> dict[int, tuple[float, int]]:
        """Of a document's shingles: item -> (similarity, first word) of its best window with similarity ``least``."""
        best: dict[int, tuple[float, int]] = {}
        for start, size in self.windows(shingles, least):
            own = np.unique(shingles[start : start + size])
            weights = self.weight(own)
            for item in self.alike(size, fingerprint(own, weights)):
                s = self.similarity(item, own, weights)
                if s >= least and (item not in best or (s, -start) > (best[item][0], -best[item][1])):
                    best[item] = (s, start)
        return best


def _whole(rows: DataFrame, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many items have a shingle, and the shingles of two items or more with their numbers of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            own = [np.unique(r) for r in _shingles(*blob(b.column("raw")), k) if len(r)]
            if own:
                # an item gives a null besides its shingles
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.nulls(len(own), pa.int64())])], names=["h"])

    got = rows.select("raw").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or h is null").toArrow()
    h, n = got.column("h"), got.column("n").to_numpy()
    alone = h.is_null().to_numpy()
    hashes, n, total = h.filter(h.is_valid()).to_numpy().view(np.uint64), n[~alone], int(n[alone].sum())
    order = np.argsort(hashes)
    return total, hashes[order], n[order]


def _indexes(items: DataFrame, item_id: str, text: str, k: int, named: bool = True) -> Iterator[Index]:
    """Indexes of blocks of items; together they hold all items, with ``named`` those of an id, and all weigh shingles by the whole benchmark."""
    small_batches(items.sparkSession)
    rows = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw")).distinct()
    rows = rows.where("item_id is not null") if named else rows
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("b")).first()
    rounds = max(1, -(-size.n // MOST_ITEMS), -(-size.b // MOST_BYTES))
    whole = _whole(rows, k) if rounds > 1 else None
    for i in range(rounds):
        part = rows.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(rounds)) == i).orderBy("item_id", "raw").toArrow()
        yield Index(part.column("item_id").to_pylist(), part.column("raw").to_pylist(), k, whole=whole)


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): documents with a window that is like an item, and the best such window.

    The similarity has nine digits; of windows alike in it, the first counts.

    Null, empty and blank texts, of documents or items, match nothing; items of null id are left out; a text of fewer than
    ``k`` words is one shingle. Repeated documents give a row each. Empty tables give none.
    """
    kinds = docs.select(F.col(doc_id).alias("doc_id")).schema.add("item_id", items.schema[item_id].dataType).add("similarity", "double").add("first_word", "long")
    rows, parts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw")), []
    for index in _indexes(items, item_id, item_text, k):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in small(batches):
                out = [(i, sent.value.ids[t], s, w) for i, x in enumerate(_shingles(*blob(b.column("raw")), k)) for t, (s, w) in sorted(sent.value.found(x, least).items())]
                if out:
                    at, item, s, w = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(item), pa.array(s), pa.array(w, pa.int64())], names=kinds.names)

        parts.append(rows.mapInArrow(run, kinds))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", least: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows in which :func:`contaminated` finds an item, or would if its id were not null; nothing is shuffled."""
    for index in _indexes(items, "item_id", "text", k, named=False):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        rows = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"), F.struct(*docs.columns).alias("row"))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in small(batches):
                clean = [not sent.value.found(x, least) for x in _shingles(*blob(b.column("raw")), k)]
                yield b.select(["row"]).filter(pa.array(clean, pa.bool_()))

        docs = rows.mapInArrow(run, rows.select("row").schema).select("row.*")
    return docs


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: All windows of an item's size in the documents that share enough weight with it, without fingerprints.
OP6_SQL = r"""
WITH raw AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM raw),
each AS (SELECT kind, id, unnest(ws) AS x, unnest(generate_series(0, len(ws) - 1)) AS i, len(ws) AS n FROM w),
run AS (SELECT kind, id, i, n, md5(string_agg(x, ' ') OVER (PARTITION BY kind, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS s FROM each),
sh AS (SELECT kind, id, i, s FROM run WHERE i < greatest(n - 4, 1)),
many AS (SELECT count(DISTINCT id) AS items FROM sh WHERE kind = 1),
df AS (SELECT s, ln(1 + items / count(DISTINCT id)) AS weight FROM sh, many WHERE kind = 1 GROUP BY s, items),
item AS (SELECT DISTINCT id AS item_id, s, weight FROM sh JOIN df USING (s) WHERE kind = 1),
total AS (SELECT item_id, sum(weight) AS t FROM item GROUP BY item_id),
size AS (SELECT id AS item_id, count(*) AS k FROM sh WHERE kind = 1 GROUP BY id),
doc AS (SELECT id AS doc_id, i, s FROM sh WHERE kind = 0),
long AS (SELECT doc_id, count(*) AS n FROM doc GROUP BY doc_id),
pair AS (SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, s FROM doc) JOIN item USING (s) JOIN total USING (item_id) GROUP BY doc_id, item_id, t HAVING sum(weight) >= 0.7 * t),
start AS (SELECT doc_id, item_id, k, unnest(generate_series(0, greatest(n - k, 0))) AS pos FROM pair JOIN size USING (item_id) JOIN long USING (doc_id)),
inside AS (SELECT DISTINCT start.doc_id, start.item_id, start.pos, doc.s FROM start JOIN doc ON doc.doc_id = start.doc_id AND doc.i BETWEEN start.pos AND start.pos + k - 1),
scored AS (SELECT doc_id, x.item_id, pos, sum(CASE WHEN item.s IS NOT NULL THEN item.weight ELSE 0 END) AS both_, sum(coalesce(df.weight, ln(1 + items))) AS own FROM inside x CROSS JOIN many LEFT JOIN df ON df.s = x.s LEFT JOIN item ON item.item_id = x.item_id AND item.s = x.s GROUP BY ALL),
alike AS (SELECT doc_id, item_id, pos, round(both_ / (t + own - both_), 9) AS similarity FROM scored JOIN total USING (item_id))
SELECT doc_id, item_id, max(similarity) AS similarity, min(pos) FILTER (best) AS first_word FROM (SELECT *, similarity = max(similarity) OVER (PARTITION BY doc_id, item_id) AS best FROM alike) WHERE similarity >= 0.75 GROUP BY doc_id, item_id
"""
