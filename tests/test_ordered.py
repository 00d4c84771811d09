"""Prefix scans against plain loops: hot groups, nulls, ties, empty tables, many partitions."""

import random

import pytest

from textloom.operators.scans import QUERIES, within
from textloom.plans.ordered import scan, smaller_later


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    keys = ["hot"] * 400 + [None] * 40 + [f"k{i}" for i in range(30)]
    out = [(k, i, r.choice([None, *range(50)])) for i, k in enumerate(keys)]
    r.shuffle(out)
    return out


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "k string, i long, v long").repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
def test_scan(spark, rows, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.i): (r.n, r.before, r.s, r.m) for r in scan(frame(spark, rows, parts), ["k"], ["i"], number="n", lags={"before": "v"}, sums={"s": "v"}, maxes={"m": "v"}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k in {r[0] for r in rows}:
        seen = []
        for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            before = seen[-1] if seen else None
            seen.append(v)
            known = [x for x in seen if x is not None]
            want[(k, i)] = (len(seen), before, sum(known), max(known, default=None))
    assert got == want


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_smaller_later(spark, rows, block):
    got = {(r.k, r.i): r.d for r in smaller_later(frame(spark, rows, 3), ["k"], ["i"], "v", "d", block).collect()}
    low = lambda v: -1 if v is None else v
    assert got == {(k, i): sum(k2 == k and j > i and low(w) < low(v) for k2, j, w in rows) for k, i, v in rows}


def test_within(spark, rows):
    timed = [(k, i, None if v is None else v * 3 - 40) for k, i, v in rows]
    got = {(r.k, r.i): r.n for r in within(frame(spark, timed, 3), ["k"], "v", 10, "n").collect()}
    assert got == {(k, i): sum(k2 == k and v is not None and w is not None and v < w <= v + 10 for k2, _, w in timed) for k, i, v in timed}


def test_empty(spark):
    none = frame(spark, [], 1)
    assert scan(none, ["k"], ["i"], number="n").columns == ["k", "i", "v", "n"] and scan(none, ["k"], ["i"], number="n").count() == 0
    assert smaller_later(none, ["k"], ["i"], "v").count() == 0 and within(none, ["k"], "v", 5, "n").count() == 0


def test_block_sort_reads_the_whole_key(spark, tmp_path):
    same = "first line\nsecond line\n" + "x" * 100
    texts = [same + "b", same + "a", "z\nz\n" + "x" * 100, "one line", "two\nlines", "", None, "a\r\n\nw\u2028y"]
    spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda i: "\n".join((texts[i] or "").split("\n")[2:])
    want = {i: n + 1 for n, i in enumerate(sorted(range(len(texts)), key=lambda i: (key(i), i)))}
    assert {r.doc_id: r.place for r in QUERIES["block_sort_whole"](spark, str(tmp_path)).collect()} == want


def test_move_to_front_rank(spark, tmp_path):
    r = random.Random(9)
    used = {1: "ABABB", 2: "".join(r.choice("ABCDEFG") for _ in range(120)), 3: "AAA"}
    rows = [(u, 1000 * u + i, t) for u, types in used.items() for i, t in enumerate(types)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.rank for r in QUERIES["move_to_front_rank"](spark, str(tmp_path)).collect()}
    want = {}
    for u, types in used.items():
        front = []
        for i, t in enumerate(types):
            want[1000 * u + i] = front.index(t) if t in front else len(front)
            front = [t, *(x for x in front if x != t)]
    assert got == want and [got[1000 + i] for i in range(5)] == [0, 1, 1, 1, 0]
