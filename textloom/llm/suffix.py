"""Operator 4, substring dedup of long byte strings by a hash-compared suffix sort.

Suffixes are sorted by a mergesort whose comparisons find the common extension of two suffixes by binary search on prefix
polynomial hashes (logarithmic in the length). Neighbours in the order are verified byte by byte, which proves the order, and
those that agree over the whole length repeat. The engine in :mod:`repeats` picks which suffixes have to be sorted at all and
brings all that can be equal into one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed
from .repeats import CLAIMS, Block, Decide, Marks, as_bytes, repeated, verified
from .rolling import Prefix, bytes_as_symbols

LENGTH, GRAM = 200, 137
_LEAD = 24


class Suffixes:
    """Suffixes of ``data`` at ``starts``, compared over ``length`` bytes; all lie within the data."""

    def __init__(self, data: np.ndarray, symbols: np.ndarray, starts: np.ndarray, length: int):
        self.data, self.starts, self.length, self.hash = data, starts, length, Prefix(symbols)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, ``length`` at most."""
        x, y = self.starts[a], self.starts[b]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash.of(x, mid) == self.hash.of(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how suffixes a and b compare."""
        lcp = self.common(a, b)
        at = np.minimum(lcp, self.length - 1)
        x, y = self.data[self.starts[a] + at].astype(np.int16), self.data[self.starts[b] + at].astype(np.int16)
        return np.where(lcp == self.length, 0, np.sign(x - y))

    def sort(self) -> np.ndarray:
        """The order of the suffixes: by the first bytes as numbers, then by mergesort within what is tied there."""
        lead = min(_LEAD, self.length // 8 * 8)
        keys = [self.data[self.starts[:, None] + np.arange(k, k + 8)].copy().view(">u8").ravel() for k in range(0, lead, 8)]
        order = np.lexsort(keys[::-1]) if keys else np.arange(len(self.starts))
        tie = np.zeros(len(order), bool)
        tie[1:] = True
        for k in keys:
            tie[1:] &= k[order][1:] == k[order][:-1]
        head = np.flatnonzero(~tie)
        size = np.diff(np.r_[head, len(order)])
        of = np.repeat(head, size)  # where each one's tied group begins
        many = np.flatnonzero(np.repeat(size, size) > 1)
        width = 1
        while width < size.max(initial=0):
            at = many - of[many]
            half = at // width
            other = of[many] + (half ^ 1) * width
            stop = np.minimum(other + width, of[many] + np.repeat(size, size)[many])
            low, high = np.minimum(other, stop), stop
            right = half & 1
            me = order[many]
            while (go := np.flatnonzero(low < high)).size:
                mid = (low[go] + high[go]) // 2
                c = self.before(order[mid], me[go])
                smaller = (c < 0) | ((c == 0) & (right[go] == 1))
                low[go], high[go] = np.where(smaller, mid + 1, low[go]), np.where(smaller, high[go], mid)
            rank = low - np.minimum(other, stop)
            place = of[many] + (half - right) * width + at % width + rank
            order[place] = me
            width *= 2
        return order

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """The order, and which suffix begins a new class of suffixes that agree over the whole length.

        The order is proved by bytes: each suffix and the next agree as far as the hashes say, and there the next is larger. If
        that fails anywhere, hashes collided, and the bytes alone sort.
        """
        order = self.sort()
        new = np.ones(len(order), bool)
        rows = np.lib.stride_tricks.sliding_window_view(self.data, self.length) if len(order) else None
        for i in range(0, len(order) - 1, 4096):
            a, b = order[i : i + 4096], order[i + 1 : i + 4097]
            a = a[: len(b)]
            x, y = rows[self.starts[a]], rows[self.starts[b]]
            apart = x != y
            first = np.where(apart.any(axis=1), apart.argmax(axis=1), self.length)
            lcp, at = self.common(a, b), np.arange(len(a))
            inner = np.minimum(first, self.length - 1)
            if not ((first == lcp) & ((first == self.length) | (x[at, inner] < y[at, inner]))).all():
                return self._by_bytes(rows)
            new[i + 1 : i + 1 + len(a)] = first < self.length
        return order, new

    def _by_bytes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.ascontiguousarray(rows[self.starts])
        order = np.lexsort(every.T[::-1])
        new = np.ones(len(order), bool)
        new[1:] = (every[order[1:]] != every[order[:-1]]).any(axis=1)
        return order, new


def sorting(length: int) -> Decide:
    """Which windows of a block's runs occur again, and where: neighbours in the sorted order of all suffixes that start one."""

    def decide(b: Block) -> tuple[np.ndarray, np.ndarray]:
        starts = b.places[b.run] + b.step
        order, new = Suffixes(b.data, bytes_as_symbols(b.data), starts, length).classes()
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        listed = np.lexsort([b.step, b.rank[b.run], of])  # each class from its first place in the corpus to its last
        head = np.flatnonzero(np.r_[True, of[listed[1:]] != of[listed[:-1]]])
        first, last = listed[head], listed[np.r_[head[1:], len(listed)] - 1]
        again = np.bincount(of, b.weight[b.run]) > 1
        own = np.flatnonzero(b.asked[b.run] & again[of])
        return own, np.where(first[of[own]] == own, last[of[own]], first[of[own]])

    return decide


_OUT = "doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, " + CLAIMS


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): without bytes covered by a ``length``-byte string that starts twice.

    Null text is empty; documents shorter than ``length`` stay whole; of a repeated row, and of copies, every byte that a
    string of that length covers goes. Null ids are kept as null; ids that are not whole numbers raise a TypeError. Empty tables
    give empty results. ``kept`` is binary, since a cut may fall inside a character.
    """
    rows = keyed(docs, doc_id, text)
    out = _OUT.format(kind=docs.schema[doc_id].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list] = [[] for _ in range(5)]
            marks, raws = Marks(b, length), b.column("raw")
            for i in range(b.num_rows):
                raw = kept = raws[i].as_py()
                mask, gone, runs = marks.of(i, raw)[0], 0, 0
                if mask.any():
                    gone, runs = int(mask.sum()), int(np.count_nonzero(np.diff(np.r_[0, mask.view(np.int8)]) == 1))
                    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                for o, v in zip(found, (len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [b.column("doc_id"), *(pa.array(v, k) for v, k in zip(found, kinds, strict=True)), marks.claimed()]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "claims"])

    def once(attempt: int) -> DataFrame:
        marks = repeated(rows, as_bytes, length, gram, False, sorting(length), "suffix", attempt)
        return rows.join(marks, ["_id", "_h"], "left").select("_id", "_h", "doc_id", "raw", "marks").mapInArrow(cut, out)

    return verified(once, "suffix")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Strings by the MD5 of their hexadecimal form; a span ends where the next string starts over a length behind.
OP4_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, hx, unnest(generate_series(0, n - 200)) AS i FROM b WHERE n >= 200)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM win SEMI JOIN again USING (h)),
numbered AS (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hit),
spans AS (SELECT doc_id, span, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY doc_id, span),
before AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM spans),
cut AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(hx, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) || substr(any_value(hx), 2 * max(e) + 1) AS kept FROM before JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256 FROM b LEFT JOIN cut USING (doc_id)
"""
