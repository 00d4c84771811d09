"""Operator 10, substring dedup by seed and extend.

Seeds are winnowed anchors: the least short gram of each window of words. Documents are joined on the seeds that two of them
share. What stands around a seed is extended to the left and to the right one word at a time, for all places of the seed at
once: places stay together as long as their words are equal, so each window finds the earliest document with the same words
without a pair being made. Windows of one source chain to maximal repeats of at least ``window`` words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import keyed, tidy, without_caches
from .repeats import CLAIMS, Block, Decide, Marks, as_words, repeated, verified
from .rolling import Prefix, mix, words

WINDOW, SEED = 13, 5
_OUT = "doc_id {kind}, n_words long, n_removed long, n_repeats long, kept_sha256 string, kept binary, " + CLAIMS


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, by its bytes and no hash: equal words, and only they, have equal numbers."""
    size = ends - starts
    upto = np.cumsum(size)
    got = data[np.arange(size.sum()) + np.repeat(starts - (upto - size), size)]
    each = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, upto].astype(np.int64).tobytes()), pa.py_buffer(got.tobytes())])
    return each.dictionary_encode().indices.to_numpy().astype(np.int64)


def _split(of: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Classes of those that were in one class and have equal numbers."""
    return np.unique(of * (int(numbers.max(initial=0)) + 1) + numbers, return_inverse=True)[1]


def extending(window: int, seed: int, attempt: int = 0) -> Decide:
    """Which windows of a block's runs stand in an earlier document too, and where: from the seed, word by word, both ways."""

    def decide(b: Block) -> tuple[np.ndarray, np.ndarray]:
        symbols, at, starts, ends = words(b.data, b.places)
        number, grams, reach = word_numbers(b.data, starts, ends), mix(Prefix(symbols, 2 * attempt).run(seed)), window - seed
        count, low = len(b.n), at[:-1]
        where = np.full(count, -1)  # the seed's first word in a run: the leftmost that all its windows hold
        for g in range(reach, -1, -1):
            where = np.where((g >= b.n - 1) & (grams[low + g] == b.anchor.view(np.uint64)), g, where)
        same = np.unique(b.anchor, return_inverse=True)[1]
        for k in range(seed):
            same = _split(same, number[low + where + k])
        left, right = [same], [same]
        for k in range(reach):  # a run of fewer words on a side has no window that reaches so far, so any class will do there
            before, after = where - k - 1, where + seed + k
            left.append(_split(left[-1], number[low + np.maximum(before, 0)]))
            right.append(_split(right[-1], number[low + np.minimum(after, b.n + window - 2)]))
        first, by_rank = np.cumsum(b.n) - b.n, np.argsort(b.rank)
        own, source = [], []
        for k in range(reach + 1):  # windows with k words before the seed
            some = np.flatnonzero((where - k >= 0) & (where - k < b.n))
            kind = _split(left[k][some], right[reach - k][some])
            least = np.full(len(some), count)
            np.minimum.at(least, kind, b.rank[some])
            head = by_rank[least[kind]] if len(some) else some
            late = b.asked[some] & (b.ids[head] < b.ids[some])
            some, head = some[late], head[late]
            own.append(first[some] + where[some] - k)
            source.append(first[head] + where[head] - k)
        return np.concatenate(own), np.concatenate(source)

    return decide


def _marked(docs: DataFrame, rows: DataFrame, window: int, seed: int, attempt: int) -> DataFrame:
    return rows.join(repeated(docs, as_words, window, seed, True, extending(window, seed, attempt), "substring", attempt), ["_id", "_h"], "left")


def _without(raw: bytes, mask: np.ndarray) -> bytes:
    """The text without the words of a mask, each with the white space behind it."""
    data = np.frombuffer(raw, np.uint8)
    starts = words(data, np.array([0, len(data)]))[2]
    upto = np.r_[starts[1:], len(data)]
    flags = np.zeros(len(data) + 1, np.int8)
    np.add.at(flags, starts[mask], 1)
    np.add.at(flags, upto[mask], -1)
    return data[np.cumsum(flags[:-1]) == 0].tobytes()


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, n_repeats, kept_sha256, kept): words that a repeat covers are removed.

    A repeat is a maximal run of words, ``window`` at least, that a document has in common with the earliest document that has
    them; ``n_repeats`` counts them. The copy in the smallest id stays. ``kept`` is the text without the removed words (other
    white space is as it was), or null without ``with_text``.

    Null or empty text: no words, nothing removed. A null id counts as 2^63 - 1, the largest; ids that are not whole numbers
    raise a TypeError. Rows of equal id do not remove from one another, so repeated rows give the same result each. Empty tables
    give empty results; other columns are ignored.
    """
    rows = keyed(docs, doc_id, text)
    out = _OUT.format(kind=docs.schema[doc_id].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_caches()
        for b in batches:
            found: list[list] = [[] for _ in range(5)]
            marks, raws = Marks(b, window), b.column("raw")
            for i in range(b.num_rows):
                raw = raws[i].as_py()
                parts = raw.split()
                mask, repeats = marks.of(i, parts)
                n, gone = len(parts), int(mask.sum())
                if gone:
                    parts = [w for w, m in zip(parts, mask.tolist(), strict=True) if not m]
                    raw = _without(raw, mask) if with_text else raw
                for o, v in zip(found, (n, gone, repeats, hashlib.sha256(b" ".join(parts)).hexdigest(), raw if with_text else None), strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [b.column("doc_id"), *(pa.array(v, k) for v, k in zip(found, kinds, strict=True)), marks.claimed()]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "n_repeats", "kept_sha256", "kept", "claims"])
        tidy()

    done = verified(lambda attempt: _marked(rows, rows, window, seed, attempt).select("_id", "_h", "doc_id", "raw", "marks").mapInArrow(cut, out), "substring")
    return done.withColumn("kept", F.col("kept").cast("string"))


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with the repeats cut out of their texts, and without the documents of which no word is left by that.

    A column ``n_chars`` is set to the new length where a text was cut. Other rows and columns stay as they are: rows of null,
    empty or blank text have no repeats and stay; a null id counts as 2^63 - 1, the largest, so such a row loses what any other
    document has too; rows of equal id do not cut one another.
    """
    rows = keyed(docs, doc_id, text, whole=True)
    schema = rows.select("row").schema.add("cut", "boolean").add("kept", "string").add(StructType.fromDDL(CLAIMS)["claims"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_caches()
        for b in batches:
            marks, raws, kept, touched = Marks(b, window), b.column("row").field(text), [], []
            for i in range(b.num_rows):
                raw = (raws[i].as_py() or "").encode() if marks.valid[i] else b""
                mask = marks.of(i, raw.split())[0]
                touched.append(bool(mask.any()))
                kept.append(_without(raw, mask).decode() if touched[-1] else None)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(touched, pa.bool_()), pa.array(kept, pa.string()), marks.claimed()], names=["row", "cut", "kept", "claims"])
        tidy()

    plain = keyed(docs, doc_id, text)
    found = verified(lambda attempt: _marked(plain, rows, window, seed, attempt).select("_id", "_h", "row", "marks").mapInArrow(cut, schema), "substring")
    found = found.where("not cut or kept rlike '[^ \\t-\\r]'")
    new = {text: F.when(F.col("cut"), F.col("kept")).otherwise(F.col("row")[text])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut"), F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Windows by the MD5 of their words with a space between, of which no word has one.
OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
each AS (SELECT doc_id, unnest(ws) AS x, unnest(generate_series(1, len(ws))) AS i FROM w),
win AS (SELECT doc_id, i, md5(string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) AS h, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM each),
least_id AS (SELECT h, min(doc_id) AS d FROM win WHERE n = 13 GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN least_id USING (h) WHERE n = 13 AND d < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i, TRUE AS yes FROM hit, (SELECT unnest(generate_series(0, 12)) AS k)),
kept AS (SELECT doc_id, count(yes) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (yes IS NULL) AS t FROM each LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
