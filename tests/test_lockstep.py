import random

import pytest

from textloom.functions import automata, coding, lockstep
from textloom.operators import sequential

R = random.Random(5)
TEXTS = [b"", b"a", b"\0\0\0", b"ab" * 400, "prose É ".encode() * 90, bytes(R.randrange(256) for _ in range(900))]
TEXTS += [b"the cat sat on the mat. " * R.randrange(1, 30) + bytes(R.choices(b"abc ", k=R.randrange(200))) for _ in range(40)]


@pytest.fixture(params=[(lockstep.GROUP, lockstep.ROWS, 24), (lockstep.GROUP, lockstep.ROWS, 0), (2000, 40, 2)], ids=["default", "no rest", "many groups"])
def sizes(request, monkeypatch):
    for name, value in zip(("GROUP", "ROWS", "FEW"), request.param, strict=True):
        monkeypatch.setattr(lockstep, name, value)


def test_costs(sizes):
    assert lockstep.dmc_bits(TEXTS) == pytest.approx([automata.dmc_bits(t) for t in TEXTS], rel=1e-9)
    assert lockstep.mixed_bits(TEXTS) == pytest.approx([coding.mixed_bits(t) for t in TEXTS], rel=1e-9)
    assert lockstep.dmc_bits([]) == lockstep.mixed_bits([]) == []


def test_limit_of_states(monkeypatch):
    start = automata.Dmc.__init__
    monkeypatch.setattr(automata.Dmc, "__init__", lambda self: start(self, most=300))
    for few in (0, 10):
        monkeypatch.setattr(lockstep, "FEW", few)
        assert lockstep.dmc_bits(TEXTS) == pytest.approx([automata.dmc_bits(t) for t in TEXTS], rel=1e-9)


def test_codes(sizes):
    codes = lockstep.range_encode(TEXTS)
    assert codes == [coding.range_encode(t) for t in TEXTS]
    assert lockstep.range_decode(codes) == TEXTS == [coding.range_decode(c) for c in codes]
    assert lockstep.range_encode([]) == lockstep.range_decode([]) == []


def test_each_text_is_encoded_once(monkeypatch):
    seen, encode = [], lockstep.range_encode
    monkeypatch.setattr(lockstep, "range_encode", lambda texts: seen.extend(texts) or encode(texts))
    rows = sequential.round_trip(TEXTS)
    assert seen == TEXTS and all(r["same"] for r in rows) and [r["n_bytes"] for r in rows] == [len(coding.range_encode(t)) for t in TEXTS]


def test_nulls(spark):
    docs = spark.createDataFrame([(1, "ab" * 90), (2, None), (3, ""), (4, "é🙂")], "doc_id long, text string").repartition(1)
    got = {r.doc_id: (r.same, r.n_bytes) for r in sequential._round_trips(docs).collect()}
    assert got == {i: (True, len(coding.range_encode(t))) for i, t in ((1, b"ab" * 90), (3, b""), (4, "é🙂".encode()))} | {2: (None, None)}
    cost = {r.doc_id: r.bits for r in docs.select("doc_id", sequential.mapped_together(lockstep.dmc_bits, "double")(sequential._raw("text")).alias("bits")).collect()}
    assert cost[2] is None and cost[3] == 0 and cost[1] == pytest.approx(automata.dmc_bits(b"ab" * 90))
