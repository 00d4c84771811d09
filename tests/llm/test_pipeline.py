import brute
import fixtures
import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_the_fixture(spark):
    docs = [(d, t) for d, t in fixtures.rows(3, 80) if d is not None]
    frame = fixtures.frame(spark, list(dict.fromkeys(docs)))
    got = pipeline.join_near_copies(spark, frame, "")
    least = {d: c for d, _, c in brute.op7(docs)}
    assert got.columns == frame.columns
    linked = {(d, t): c for (d, t), (_, _, c) in zip(docs, brute.op7(docs))}
    gone = {d for (d, _), c in linked.items() if c != d}
    assert sorted({r.doc_id for r in got.collect()}) == sorted({d for d, _ in docs} - gone) and least

    cut = pipeline.cut_substrings(spark, frame, "")
    want = {}
    for (d, t), (_, n, k, sha) in zip(docs, brute.op10(docs)):
        if k == 0 or n > k:
            want.setdefault(d, set()).add(sha)
    import hashlib

    have = {}
    for r in cut.collect():
        have.setdefault(r.doc_id, set()).add(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest())
        assert r.text is None or r.n_chars == len(r.text)
    assert cut.columns == frame.columns and have == want


def test_run(spark):
    rows = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len(pipeline.STAGES) == 5
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.collect() == []
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
