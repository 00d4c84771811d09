"""Containers, side streams and automata on small inputs."""

from textloom.functions import automata
from textloom.operators import containers, inverse, language


def test_containers(spark):
    rows = spark.createDataFrame([(1, b"abc", b""), (2, b"", b"\xff" * 300), (3, None, b"x")], "i int, a binary, b binary")
    images = rows.select("i", "a", "b", containers.assembled([rows.a, rows.b]).alias("c"))
    got = {r.i: (r.ok, r.a, r.b) for r in containers.sliced(images, "c", ["a", "b"], ["i"]).collect()}
    assert got[1] == (True, b"abc", b"") and got[2] == (True, b"", b"\xff" * 300) and got[3] == (False, None, None)
    bad = [(1, b""), (2, b"short"), (3, b"\xff\xff\xff\xff\x01\0\0\0"), (4, b"xy\x01\0\0\0\x02\0\0\0"), (5, b"xyz\x01\0\0\0\x02\0\0\0"), (6, b"\0" * 8), (7, b"a\xff\xff\xff\xff\x02\0\0\0")]
    got = {r.i: r.ok for r in containers.sliced(spark.createDataFrame(bad, "i int, c binary"), "c", ["a", "b"], ["i"]).collect()}
    assert [i for i, ok in got.items() if ok] == [5, 6]


def test_trailing(spark):
    lines = [(k, i, t) for k, ts in {"a": ["0", "[x", "2", "[y", "4"], "b": ["0", "1", None], "c": ["[z"]}.items() for i, t in enumerate(ts)]
    frame = spark.createDataFrame(lines, "key string, at int, line string")
    body, side = inverse.trailing(frame, r"^\[", 2)
    assert sorted(map(tuple, side.collect())) == [("a", 0, "[y"), ("a", 1, "4")]
    assert sorted(map(tuple, inverse.put_back(body, side).collect()), key=repr) == sorted(lines, key=repr)


def test_shredded(spark):
    pages = [(1, "<a><title>t</title>rest"), (2, "no title"), (3, ""), (4, "<title></title>"), (5, None)]
    parts = inverse.shredded(spark.createDataFrame(pages, "page_id int, html string"))
    assert sorted(map(tuple, inverse.rebuilt(parts).collect())) == pages


def test_similar(spark):
    docs = [(1, "a b c i. a b h i. a b c d."), (2, "a b c i k l. a b c d."), (3, None), (4, ""), (5, "x y. x z z z.")]
    got = sorted(map(tuple, language.similar_sentences(spark.createDataFrame(docs, "doc_id int, text string")).collect()))
    assert got == [(1, 1, 0, 3), (1, 2, 0, 3)]


def test_dmc():
    data = b"the cat sat on the mat. " * 40
    assert automata.dmc_bits(b"") == 0 and automata.dmc_bits(data) < 2 * len(data)
    assert automata.dmc_bits(bytes(range(256)) * 2) > automata.dmc_bits(b"a" * 512)
    small = automata.Dmc(most=260)
    for bit in [0, 1] * 4000:
        small.step(bit)
        assert 0 < small.p1() < 1
    assert len(small.next) <= 260
