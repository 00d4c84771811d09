"""Operator 9, language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and elastic-net penalties, then calibrated by a temperature.

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE`` documents, the languages in equal parts); the
document frequencies count all of them. Prediction reads whole texts and needs one gather for each n-gram and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, small_batches
from .rolling import U, mix

#: Documents that the classifier is fitted on, at most (up to chance); n-grams of 1 to ORDER characters; hashed features.
SAMPLE, ORDER, FEATURES = 4000, 3, 1 << 16
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 3
_SCALE = 10.0
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # languages x features, document frequencies included
    bias: np.ndarray
    temperature: float


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: features of all n-grams of lower-cased texts, and where texts begin among them (n + 1 places)."""
    lowered = [t.lower() for t in texts]
    size = np.array([len(t) for t in lowered], np.int64)
    at = np.r_[0, np.cumsum(size)]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32).astype(U)
    code = np.zeros(len(chars), U)
    for n in range(1, ORDER + 1):
        code = code[: len(chars) - n + 1] * U(0x100000001B3) + chars[n - 1 :] if n > 1 else chars
        if not len(code):
            return
        whole = np.ones(len(code), bool)
        for k in range(1, n):  # starts so near to a text's end that the n-gram would cross it
            edge = at[1:] - k
            whole[edge[(edge >= 0) & (edge < len(code))]] = False
        count = np.maximum(size - n + 1, 0)
        features = (mix(code + U(n << 56)) & U(FEATURES - 1)).astype(np.int64)[whole]
        yield features, np.r_[0, np.cumsum(count)]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x.decode() for x in batch.column("raw").to_pylist()]


def _counted(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, counts) of each text."""
    orders = list(grams(texts))
    for i in range(len(texts)):
        own = [f[at[i] : at[i + 1]] for f, at in orders]
        yield np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """texts x languages: logits over the temperature."""
    total, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for features, at in grams(texts):
        filled = np.flatnonzero(at[1:] > at[:-1])
        n += np.diff(at)
        if len(filled):
            for k in range(len(model.languages)):
                total[filled, k] += np.add.reduceat(model.weights[k][features], at[filled], dtype=np.float64)
    return (_SCALE * total / np.maximum(n, 1)[:, None] + model.bias) / model.temperature


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_languages: int, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x languages, many of them zero) and bias by follow-the-regularised-leader, a row at a time."""
    z, n = np.zeros((FEATURES + 1, n_languages)), np.zeros((FEATURES + 1, n_languages))

    def weights(at):
        raw = -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, raw)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], FEATURES), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that gives the held-out labels the largest likelihood."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _ready(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"), *more)


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """The model learned from rows with a language and a letter; None if there are no such rows.

    The driver gets one row for each language, at most ``FEATURES`` document frequencies, and the n-gram counts of about
    ``sample`` documents; a fifth of these is left out of the training and sets the temperature.
    """
    small_batches(labelled.sparkSession)
    rows = _ready(labelled, text, F.col(lang).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(doc_id), F.lit("sample")), F.lit(1 << 30)).alias("draw")).where("letters and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    total = sum(sizes.values())
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, int((1 << 30) * min(1.0, max(1, sample // len(languages)) / sizes[k])))])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, bool)
        for b in small(batches):
            orders = list(grams(_texts(b)))
            for i in range(b.num_rows):
                for f, at in orders:
                    seen[f[at[i] : at[i + 1]]] = True
                got = np.flatnonzero(seen)
                df[got] += 1
                seen[got] = False
        got = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(df[got])], names=["f", "n"])

    df = np.zeros(FEATURES)
    got = rows.select("raw").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df[got.column("f").to_numpy()] = got.column("n").to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = list(_counted(_texts(b)))
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("draw"), pa.array([f.astype("<u4").tobytes() for f, _ in found], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())], names=["lang", "draw", "f", "c"])

    drawn = rows.where(F.col("draw") < share[F.col("lang")]).select("raw", "lang", "draw").mapInArrow(counts, "lang string, draw long, f binary, c binary").toArrow()
    drawn = drawn.sort_by([("draw", "ascending"), ("lang", "ascending"), ("f", "ascending")])
    place = {k: i for i, k in enumerate(languages)}
    labels = np.array([place[k] for k in drawn.column("lang").to_pylist()])
    samples = []
    for f, c in zip(drawn.column("f").to_pylist(), drawn.column("c").to_pylist(), strict=True):
        at, n = np.frombuffer(f, np.uint32).astype(np.int64), np.frombuffer(c, np.uint32).astype(float)
        samples.append((at, _SCALE * n / n.sum() * idf[at]))
    held = np.arange(len(samples)) % 5 == 4
    train = np.flatnonzero(~held)
    w, bias = fit_rows([samples[i] for i in train], labels[train], len(languages))
    logits = np.array([samples[i][1] @ w[samples[i][0]] + bias for i in np.flatnonzero(held)])
    return Model(languages, np.ascontiguousarray((w * idf[:, None]).T.astype(np.float32)), bias, temperature(logits, labels[held]))


def predict(docs: DataFrame, model: Model | None, text: str = "text", *keep: Column) -> DataFrame:
    """(keep ..., lang_pred, score): ``und`` with score 0 for null texts, texts without a letter, or without a model."""
    small_batches(docs.sparkSession)
    rows = _ready(docs, text, *keep)
    names = rows.columns[2:]
    schema = rows.select(*names).schema.add("lang_pred", "string").add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in small(batches):
            known = b.column("letters").to_numpy(zero_copy_only=False)
            best, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            if m is not None and known.any():
                p = _softmax(scores(m, _texts(b)))[known]
                best[known], score[known] = np.array(m.languages, object)[p.argmax(1)], p.max(1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(best, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def _fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the labelled rows of three folds in four, predicted for all.

    A row of null id is neither learned from nor held out. Repeated rows are alike; without labelled rows all are ``und``.
    """
    model = fit(docs.where(_fold(doc_id) != 2), doc_id, text, lang)
    return predict(docs, model, text, F.col(doc_id).alias("doc_id"), F.coalesce(_fold(doc_id) == 2, F.lit(False)).alias("held_out"))


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.3) -> DataFrame:
    """``docs`` without rows that have no language (``und``) or none with a probability of ``least``."""
    model = fit(docs.where(_fold(doc_id) != 2), doc_id, text, lang)
    found = predict(docs, model, text, F.struct(*docs.columns).alias("row"))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
