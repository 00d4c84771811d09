"""Character statistics in one pass over whole texts, and byte codes; their SQL is written apart and works row by row.

A text's characters stay in the task that has the text: a count of what came before is a rank in a stable sort, so no row is made
for a character and nothing is shuffled but results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def per_text(docs: DataFrame, keep: list[str], schema: str, f: Callable, form: Callable[[str], object] = code_points) -> DataFrame:
    """``keep`` and the columns of ``schema``: the rows that ``f`` makes of a text's ``form``; none for null or empty ones."""
    kind = docs.select(*keep).schema
    for field in StructType.fromDDL(schema):
        kind = kind.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for b in batches:
            rows, at = [], []
            for i, raw in enumerate(b.column("_raw").to_pylist()):
                if raw:
                    got = f(form(raw.decode()))
                    rows += got
                    at += [i] * len(got)
            types = types or [{"bigint": pa.int64(), "string": pa.string()}.get(x.dataType.simpleString(), pa.float64()) for x in kind.fields[len(keep) :]]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in keep), *made], names=kind.names)

    return docs.select(*keep, F.col("text").cast("binary").alias("_raw")).mapInArrow(run, kind)


def contexts(chars: np.ndarray, order: int) -> np.ndarray:
    """A number for what stands before each character, ``order`` of them at most: 0 at the beginning."""
    key = np.zeros(len(chars), np.int64)
    for k in range(order, 0, -1):
        before = np.zeros(len(chars), np.int64)
        before[k:] = chars[:-k] + 1
        key = key * 0x110001 + before
    return key


def earlier(key: np.ndarray) -> np.ndarray:
    """How often each value stood before."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    return out


def _pairs(chars: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each context, and for each context with its character."""
    context = np.unique(contexts(chars, order), return_inverse=True)[1]
    return context, context * 0x110000 + chars


def kt_bits(chars: np.ndarray, order: int) -> float:
    """Cost under the estimator (n_cs + 0.5) / (n_c + 0.5 * V) of what came before."""
    context, both = _pairs(chars, order)
    return float(np.log2((earlier(context) + 0.5 * len(np.unique(chars))) / (earlier(both) + 0.5)).sum())


def entropy(chars: np.ndarray, order: int) -> float:
    """Bits for each character, given what stands before it."""
    _, both = _pairs(chars, order)
    kinds, k = np.unique(both, return_counts=True)
    total = np.bincount(kinds // 0x110000, k)[kinds // 0x110000]
    return float((k * np.log2(total / k)).sum() / len(chars))


def _depths(chars: np.ndarray) -> list[tuple]:
    step = np.isin(chars, [ord(c) for c in "([{"]).astype(np.int64) - np.isin(chars, [ord(c) for c in ")]}"])
    depth = np.cumsum(step)
    return [(int(depth.max()), int(depth[-1]))]


def _distances(chars: np.ndarray) -> list[tuple]:
    place = np.arange(len(chars))
    last = np.maximum.accumulate(np.where(chars == 32, place, -1))
    d = np.where(last < 0, 255, np.minimum(place - last, 255))  # before the first space it is as far as can be
    return [(int(d.sum()), int(d.max()))]


def _gaps(chars: np.ndarray) -> list[tuple]:
    """Distances at which a character came three times in a row, with how often."""
    order = np.argsort(chars, kind="stable")
    same = chars[order][1:] == chars[order][:-1]
    gap = np.where(same, np.diff(order), -1)
    hit = gap[2:][(gap[2:] > 0) & (gap[2:] == gap[1:-1]) & (gap[1:-1] == gap[:-2])] if len(gap) > 2 else gap[:0]
    return [(int(g), int(n)) for g, n in zip(*np.unique(hit, return_counts=True), strict=True)]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _entropies(order: int):
    return lambda s, d: per_text(_docs(s, d), ["doc_id"], "n long, bits double", lambda c: [(len(c), entropy(c, order))]).withColumn("bits", F.round("bits", 6))


def _costs(order: int):
    return lambda s, d: per_text(_docs(s, d), ["doc_id"], "n long, bits double", lambda c: [(len(c), kt_bits(c, order))]).withColumn("bits", F.round("bits", 4))


def _by_lang(s: SparkSession, d: str) -> DataFrame:
    rows = per_text(_docs(s, d), ["lang"], "n long, bits double", lambda c: [(len(c), kt_bits(c, 1))])
    return rows.groupBy("lang").agg(F.round(F.sum("bits") / F.sum("n"), 5).alias("bpc"))


#: Bytes that stand for something else in a coded text (end of upper case, upper case, escape, capital).
MARKS = ("06", "07", "0C", "40")
ESCAPE = "0C"
#: The bytes that change places.
SWAPPED = ("{|}~PQRS:;<=>?JKLMNOX`", "PQRS{|}~JKLMNO:;<=>?`X")
#: Abbreviations before a full stop, by language.
ABBREVIATIONS = {"en": ("mr", "mrs", "ms", "dr", "st", "jr"), "fr": ("m", "mm"), "de": ("fr", "hr", "hrn")}


def escaped(column: str):
    """The hexadecimal bytes of a text with the escape before each mark and each byte from 0x80 on."""
    spaced = F.regexp_replace(F.hex(F.col(column).cast("binary")), "(..)", "$1 ")
    return F.replace(F.regexp_replace(spaced, f"({'|'.join(MARKS)}|[89A-F].) ", f"{ESCAPE} $1 "), F.lit(" "), F.lit(""))


def _abbreviations(s: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("([a-z]+)[.]"), 1)
    listed = F.lit(None)
    for lang, own in ABBREVIATIONS.items():
        listed = F.when(F.col("lang") == lang, F.array(*map(F.lit, own))).otherwise(listed)
    got = _docs(s, d).select("doc_id", words.alias("w"), F.coalesce(listed, F.array().cast("array<string>")).alias("l"))
    return got.select("doc_id", F.size("w").alias("stops"), F.size(F.filter("w", lambda x: F.array_contains("l", x))).alias("abbreviations")).where("stops >= 0")


def _norms(s: SparkSession, d: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", "label", F.round(F.sqrt(square), 5).alias("norm"))


def _logits(s: SparkSession, d: str) -> DataFrame:
    p = 1 / (1 + F.exp(-F.col("value") / 100))
    return table(s, d, "events").where("value between 0 and 999").select("event_id", F.round(p, 6).alias("p"), F.round(F.ln(p / (1 - p)), 4).alias("logit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "entropy_order0": _entropies(0),
    "entropy_order1": _entropies(1),
    "entropy_order2": _entropies(2),
    "kt_cost_order0": _costs(0),
    "kt_cost_order1": _costs(1),
    "bits_per_char_by_lang": _by_lang,
    "bracket_depth": lambda s, d: per_text(_docs(s, d), ["doc_id"], "deepest long, open_at_end long", _depths),
    "distance_to_char": lambda s, d: per_text(_docs(s, d), ["doc_id"], "total long, longest long", _distances),
    "record_distance": lambda s, d: per_text(_docs(s, d), ["doc_id"], "gap long, votes long", _gaps),
    "byte_permute": lambda s, d: _docs(s, d).select("doc_id", F.translate("text", *SWAPPED).alias("permuted")),
    "escape_bytes": lambda s, d: _docs(s, d).select("doc_id", escaped("text").alias("escaped")),
    "abbreviations": _abbreviations,
    "squash_stretch": _logits,
    "vector_norms": _norms,
    "json_field": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null"),
}
_STOPS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([a-z]+)[.]', 1)"
_IN = " OR ".join(f"(lang = '{k}' AND x IN ({', '.join(repr(w) for w in v)}))" for k, v in ABBREVIATIONS.items())
#: SQL of those whose rule is not in :mod:`structure` and :mod:`costs`; swaps as sums and exclusive ors of codes, as the survey has them.
ORACLES = {
    "byte_permute": """SELECT doc_id, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(string_split(text, ''), lambda c: CASE
 WHEN ascii(c) BETWEEN 123 AND 126 THEN chr(ascii(c) - 43) WHEN ascii(c) BETWEEN 80 AND 83 THEN chr(ascii(c) + 43)
 WHEN ascii(c) BETWEEN 58 AND 63 OR ascii(c) BETWEEN 74 AND 79 THEN chr(xor(ascii(c), 112)) WHEN ascii(c) IN (88, 96) THEN chr(xor(ascii(c), 56)) ELSE c END), '') END AS permuted FROM documents""",
    "escape_bytes": r"""SELECT doc_id, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(string_split(text, ''), lambda c:
 CASE WHEN ascii(c) IN (6, 7, 12, 64) THEN '0C' || hex(encode(c)) WHEN ascii(c) >= 128 THEN regexp_replace(hex(encode(c)), '(..)', '0C\1', 'g') ELSE hex(encode(c)) END), '') END AS escaped FROM documents""",
    "abbreviations": f"SELECT doc_id, CAST(len(w) AS INT) AS stops, CAST(coalesce(n, 0) AS INT) AS abbreviations FROM (SELECT doc_id, {_STOPS} AS w FROM documents) LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, lang, unnest({_STOPS}) AS x FROM documents) WHERE {_IN} GROUP BY doc_id) USING (doc_id) WHERE w IS NOT NULL",
    "squash_stretch": "SELECT event_id, round(0.5 + 0.5 * (exp(value / 100) - 1) / (exp(value / 100) + 1), 6) AS p, round(value / 100, 4) AS logit FROM events WHERE value BETWEEN 0 AND 999",
    "vector_norms": "SELECT vec_id, label, round(sqrt(sum(x::DOUBLE * x::DOUBLE)), 5) AS norm FROM (SELECT vec_id, label, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id, label",
    "json_field": "SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE regexp_matches(props, '\"k\": [0-9]+')",
}
