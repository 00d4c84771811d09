"""What each scan of the texts does in one pass, or in half the time, against the plain way."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from textloom.llm import common, jaccard, linked, tokens
from textloom.llm.common import blob, keyed


def test_splitter():
    import public_tokenizers

    fast, plain = tokens._splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    assert fast is not plain and tokens._PATTERN == public_tokenizers.PATTERN
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    narrow = every[: every.index("\U00010000")]
    assert fast(every) == plain(every) and fast(narrow) == plain(narrow)
    assert all(fast(f" {c}a{c}'{c}") == plain(f" {c}a{c}'{c}") for c in narrow)
    r = random.Random(3)
    for letters in (" \n\t'stredvlmaeAE12é½　\x1c\x85\xa0、漢²'", narrow, every):
        for _ in range(3000):
            text = "".join(r.choices(letters, k=r.randrange(40)))
            assert fast(text) == plain(text)
    assert tokens._splitter("a+")("aab a") == ["aa", "a"]


@pytest.mark.parametrize("texts", [["a plain text, 12 words", " \x7f\x01 ~ control", "ünïcode  é", "tab\tand\n\nlines  "]])
def test_pieces_seen_once_and_again(texts):
    ids = tokens.Ids(tokens.default_path())
    for _ in range(3):
        assert ids.of(texts) == [np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_classes_count_shingles_too(spark):
    """One scan gives the classes and the frequent shingles."""
    texts = ["one two three four five six"] * 50 + [f"a text of its own, number {i}" for i in range(40)] + [None, "", "  "]
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    every = jaccard.classes(docs).cache()
    assert every.where("counts is null").count() == len(texts)
    assert every.where("counts is not null and cid is null and doc_id is null and _id is null").count() == every.where("counts is not null").count() > 0
    raw = pa.array([(t or "").encode() for t in texts], pa.binary())
    times = Counter(jaccard.sets(*blob(raw), jaccard.SHINGLE)[0].tolist())
    want = sorted(h for h, n in times.items() if n >= jaccard.OFTEN)
    assert len(want) == 4  # two shingles of the copies and two that all other texts have
    assert jaccard._frequent(every.where("counts is not null").select("counts")).tolist() == want
    empty = jaccard.classes(docs.where("false"))
    assert empty.count() == 0 and not len(jaccard._frequent(empty.select("counts")))


def test_sets_are_sorted_and_distinct():
    hashes, at = jaccard.sets(*blob(pa.array([b"a b c d e a b c d e a b c d e", b"", b"x", b"A B"], pa.binary())), 5)
    assert np.diff(at).tolist() == [5, 0, 1, 1] and all((np.diff(hashes[i:j].astype(object)) > 0).all() for i, j in zip(at[:-1], at[1:], strict=True))


def test_small_tasks_do_not_search_all_objects(monkeypatch):
    """Where tables lie in hundreds of small parts, looking for garbage after each took longer than the parts themselves."""
    calls = []
    monkeypatch.setattr(common.gc, "collect", lambda: calls.append(1))
    monkeypatch.setattr(common.gc, "freeze", lambda: calls.append(2))
    rows = [pa.RecordBatch.from_pydict({"k": [1, 1, 2], "raw": [b"a", b"b", b""]})] * 3
    assert [b.num_rows for b in common.small(iter(rows))] == [3] * 3
    assert [t.num_rows for t in common.grouped(iter(rows), ["k"])] == [2, 1] * 3
    assert not list(common.small(iter([]))) and not list(common.grouped(iter([]), ["k"])) and not calls
    large = pa.RecordBatch.from_pydict({"k": [1], "raw": [b"x" * common.TIDIED]})
    assert len(list(common.small(iter([large])))) == len(list(common.grouped(iter([large]), ["k"]))) == 1
    assert calls.count(1) == 2


def test_few_links_need_no_rounds(spark, monkeypatch):
    """Each round costs several stages of all partitions, however small the table."""
    r = random.Random(8)
    pairs = [(bytes([200 + r.randrange(56), r.randrange(9)]), bytes([200 + r.randrange(56), r.randrange(9)])) for _ in range(330)] + [(b"x", b"x"), (b"z", b"a"), (b"a", None)]
    links = spark.createDataFrame(pairs, "a binary, b binary")
    rounds = {(bytes(r.node), bytes(r.label)) for r in _rounds(linked, links, monkeypatch)}
    written = []
    monkeypatch.setattr(linked, "scratch", lambda df, name: written.append(name) or common.scratch(df, name))
    got = linked.components(links)
    assert len(written) == 1 and got.schema.simpleString() == "struct<node:binary,label:binary>"
    assert {(bytes(r.node), bytes(r.label)) for r in got.collect()} == rounds and (b"z", b"a") in rounds and len(rounds) > 300
    assert linked.components(links.where("false")).count() == 0
    common.discard(got)


def _rounds(linked, links, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(linked, "FEW", -1)
        return linked.components(links.where("b is not null")).collect()
