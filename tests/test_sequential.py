import math
import random

import pytest

from textloom import registry, streaming
from textloom.functions import coding
from textloom.operators import sequential
from textloom.sources import table

SF = "/root/testdata/sf0.001"


def test_lehmer():
    r = random.Random(1)
    for n in (0, 1, 2, 7, 200):
        p = list(range(n))
        r.shuffle(p)
        code = coding.lehmer(p)
        assert code == [sum(b < a for b in p[i + 1 :]) for i, a in enumerate(p)] and coding.unlehmer(code) == p
    assert coding.lehmer([2, 0, 1]) == [2, 0, 0]


@pytest.mark.parametrize(("x", "n"), [(0, 1), (127, 1), (128, 2), (16383, 2), (16384, 3)])
def test_varint(x, n):
    assert len(coding.varint(x)) == n and coding.unvarint(coding.varint(x)) == x


@pytest.mark.parametrize("data", [b"", b"short text", b"ab" * 500, bytes(random.Random(2).randrange(256) for _ in range(2000)), "prose É ".encode() * 90])
def test_range_coder(data):
    code = coding.range_encode(data)
    assert coding.range_decode(code) == data
    if data == b"ab" * 500:
        assert len(code) < 320


def test_segments():
    text = (b"x" * 99 + b" ") * 6
    assert coding.segments(text) == [("text", 0, 600)] and coding.segments(b"x" * 600) == [("binary", 0, 600)]
    found = coding.segments(text + b"\x90" * 120 + b"y")
    assert [k for k, _, _ in found] == ["text", "binary"] and found[0][2] == 600 + 101 - 100 and sum(n for _, _, n in found) == 721


def test_stems():
    for w, s in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "relational": "relat", "happy": "happi", "adoption": "adopt", "probate": "probat", "controll": "control"}.items():
        assert coding.stem_english(w) == s
    assert coding.stem_german("häusern") == "haus" and coding.stem_german("aufeinanderfolgend").startswith("aufeinanderfolg")
    assert coding.stem_french("continuellement") != "continuellement" and coding.stem_french("chats") == "chat"


def test_models_learn():
    data = b"the cat sat on the mat. " * 40
    assert coding.ppm_bits(data) < coding.mixed_bits(data) < 8 * len(data)
    assert abs(coding.ppm_bits(b"a") - 8) < 1e-9 and coding.mixed_bits(b"") == 0
    assert coding.brackets('a(b)c"d"') == [0, 256 * 40, 256 * 40 + 1, 0, 0, 256 * 34, 256 * 34 + 1, 0]


def test_queries_run(spark):
    for name, query in sequential.QUERIES.items():
        rows = query(spark, SF).collect()
        assert rows, name
        if name == "range_coder_round_trip":
            assert all(r.same for r in rows)
    entities = spark.createDataFrame([("&#960;&#65;",), (None,)], "c string").select(sequential.numeric_entities("c").alias("c")).collect()
    assert [r.c for r in entities] == ["π&#65;", None]


def test_streams(spark):
    batch = table(spark, SF, "events")
    got = {k: q(spark, SF) for k, q in streaming.QUERIES.items()}
    assert got["stream_running_mean"].count() == batch.select("event_type").distinct().count()
    assert got["stream_sessions"].agg({"n": "sum"}).first()[0] == batch.count()
    assert got["stream_sliding"].agg({"n": "sum"}).first()[0] == 2 * batch.count()
    assert set(registry.oracle_sql()) <= set(registry.queries()) and math.isfinite(len(registry.queries()))
