import zlib

import fixtures
import numpy as np

from textloom.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs.withColumn("score", docs.n_chars).withColumn("raw", docs.lang)).join(docs, "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    sure = [r for r in got if r.lang_pred != "und"]
    assert all(0 <= r.score <= 1 for r in got) and abs(np.mean([r.score for r in sure]) - np.mean([r.lang_pred == r.lang for r in sure])) < 0.1


def test_odd_rows(spark):
    docs = [(i, t) for i, t in fixtures.rows(3, 40)] + [(7000, "1234 !?"), (7001, "İ" * 50)]
    frame = fixtures.frame(spark, docs)
    got = language.identify(frame).collect()
    assert len(got) == len(docs)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {7000, 1000} <= und and 7001 not in und and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(r.lang_pred == "und" for r in language.identify(frame.where("lang is null")).collect())
    assert language.identify(frame.limit(0)).collect() == []
    kept = language.keep_known(frame)
    assert kept.columns == frame.columns and all(r.text and any(c.isalpha() for c in r.text) for r in kept.collect())


def test_weights_are_sparse_and_grams_stay_in_their_text():
    r = np.random.default_rng(0)
    rows, labels = [], np.arange(200) % 2
    for i in labels:
        rows.append((np.r_[np.array([i * 5 + 1]), r.integers(100, 60000, 20)], np.full(21, 0.5)))
    w, _ = language.fit_rows(rows, labels, 2, l1=1.0)
    assert (w[1].argmax(), w[6].argmax()) == (0, 1) and np.count_nonzero(w) < 300
    for texts in (["ab", "", "cde", "f"], ["", ""], ["x"]):
        together = [f[at[i] : at[i + 1]].tolist() for f, at in language.grams(texts) for i in range(len(texts))]
        alone = [next((f.tolist() for k, (f, _) in enumerate(language.grams([t])) if k == n), []) for n in range(len(list(language.grams(texts)))) for t in texts]
        assert together == alone
