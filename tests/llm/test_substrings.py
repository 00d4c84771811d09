import brute
import fixtures
import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import repeats, rolling, substring, suffix


@pytest.mark.parametrize("seed", [3, 11])
def test_substring_dedup(spark, seed):
    docs = fixtures.rows(seed)
    got = substring.deduplicate(fixtures.frame(spark, docs))
    assert fixtures.collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op10(docs), key=repr)
    assert all(" ".join(r.kept.split(" ")) is not None and r.n_words - r.n_removed == len(r.kept.encode().split()) for r in got.collect())


@pytest.mark.parametrize("seed", [3, 11])
def test_suffix_dedup(spark, seed):
    docs = fixtures.rows(seed)
    got = suffix.deduplicate(fixtures.frame(spark, docs), with_text=False)
    assert fixtures.collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op4(docs), key=repr)


def test_empty(spark):
    none = fixtures.frame(spark, []).limit(0)
    assert substring.deduplicate(none).collect() == [] and suffix.deduplicate(none).collect() == []


def test_suffix_sort_is_the_sorted_order():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    starts = np.concatenate([np.arange(0, 2900), np.arange(300, 500)])
    order, new = suffix.Suffixes(data, rolling.bytes_as_symbols(data), starts, 64).classes()
    strings = [data[s : s + 64].tobytes() for s in starts]
    assert [strings[i] for i in order] == sorted(strings)
    assert int(new.sum()) == len(set(strings))


def test_blocks_do_not_matter(spark, monkeypatch):
    docs = fixtures.rows(5)
    data = np.frombuffer("".join(t or "" for _, t in docs).encode(), np.uint8)
    at = np.r_[0, np.cumsum([len((t or "").encode()) for _, t in docs])]
    one = rolling.words(data, at)
    monkeypatch.setattr(rolling, "BLOCK", 64)
    for a, b in zip(one, rolling.words(data, at)):
        assert (a == b).all()
    assert sum(int(x[4].sum()) for x in rolling.segments(one[0], one[1], 13, 5)) == sum(max(0, n - 12) for n in np.diff(one[1]))


def opposite_words(n=1024):
    """Two words of a and b that every polynomial of an odd base modulo 2^64 takes for one another."""
    one = "a"
    while len(one) < n:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_a_polynomial_confuses(spark):
    one, two = opposite_words()
    rest = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{two} {rest}"), (4, f"{one} {one}"), (5, f"{one * 3}\0 {rest}")]
    got = substring.deduplicate(fixtures.frame(spark, docs))
    assert fixtures.collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op10(docs), key=repr)
    got = suffix.deduplicate(fixtures.frame(spark, docs))
    assert fixtures.collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op4(docs), key=repr)


@pytest.mark.parametrize("most", [0, 2])
def test_hot_anchors(spark, monkeypatch, most):
    """Anchors of more open runs than a block takes are handled another way, with the same rows."""
    monkeypatch.setattr(repeats, "MOST", most)
    docs = fixtures.rows(7)
    got = substring.deduplicate(fixtures.frame(spark, docs))
    assert fixtures.collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op10(docs), key=repr)
    got = suffix.deduplicate(fixtures.frame(spark, docs), with_text=False)
    assert fixtures.collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op4(docs), key=repr)


def test_largest_id_and_ids_that_are_no_numbers(spark):
    docs = [(2**63 - 1, fixtures.texts()[1] * 4), (-(2**63), fixtures.texts()[1] * 2), (0, None)]
    got = substring.deduplicate(fixtures.frame(spark, docs))
    assert fixtures.collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op10(docs), key=repr)
    got = suffix.deduplicate(fixtures.frame(spark, docs), with_text=False)
    assert fixtures.collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op4(docs), key=repr)
    named = spark.createDataFrame([("x", "some text")], "doc_id string, text string")
    for f in (substring.deduplicate, suffix.deduplicate, substring.cut_repeats):
        with pytest.raises(TypeError, match="whole numbers"):
            f(named)


def test_very_long_texts(spark):
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in r.integers(0, 5000, 200_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[50_000:90_000])), (3, "z" * 300_000), (4, " ".join(["again"] * 20_000))]
    got = substring.deduplicate(fixtures.frame(spark, docs))
    assert fixtures.collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op10(docs), key=repr)
    short = [(1, " ".join(words[:9000])), (2, " ".join(words[3000:6000])), (3, "z" * 9000)]
    got = suffix.deduplicate(fixtures.frame(spark, short), with_text=False)
    assert fixtures.collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op4(short), key=repr)


def test_colliding_hashes_of_runs_are_found_out(spark, monkeypatch):
    """With base 1, runs of the same words in another order have one hash: the digests differ, and other bases are taken."""
    words = [f"w{i}" for i in range(40)]
    swapped = [*words[:30], words[31], words[30], *words[32:]]
    docs = [(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join([*words[:20], "x", *words[:14]]))]
    got = substring.deduplicate(fixtures.frame(spark, docs))
    assert fixtures.collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op10(docs), key=repr)
    rows, tries = fixtures.frame(spark, docs), []

    def cut(attempt):
        tries.append(attempt)
        digests = ["a", "b"] if attempt == 0 else ["a", "a"]
        claims = ", ".join(f"struct(1L as id, 2L as h, 3L as pos, 4L as n, {own} as own, cast('{d}' as binary) as digest)" for own, d in zip(("true", "false"), digests))
        return rows.selectExpr("doc_id", f"array({claims}) as claims")

    assert repeats.verified(cut, "test").columns == ["doc_id"] and tries == [0, 1]
    with pytest.raises(RuntimeError):
        repeats.verified(lambda attempt: rows.selectExpr("array(struct(1L as id, 2L as h, 3L as pos, 4L as n, true as own, cast('a' as binary) as digest)) as claims"), "test")


def runs_of(texts, width, gram, units):
    """The runs of all windows of some texts, as a block would get them, with those of the most frequent anchor only."""
    raws = [t.encode() for t in texts]
    data, places = np.frombuffer(b"".join(raws), np.uint8), np.r_[0, np.cumsum([len(r) for r in raws])]
    symbols, at, starts, ends = units(data, places)
    rows = []
    for anchor, _, _, start, n in rolling.segments(symbols, at, width, gram):
        for a, s, k in zip(anchor.view(np.int64).tolist(), start.tolist(), n.tolist()):
            doc = int(np.searchsorted(at, s, "right")) - 1
            rows.append((a, doc, 0, s - int(at[doc]), k, 1, True, data[starts[s] : ends[s + k + width - 2]].tobytes()))
    rows.sort(key=lambda r: r[0])
    names = ["anchor", "_id", "_h", "pos", "n", "weight", "asked", "part"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return repeats.Block(pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names))


def test_extension_finds_the_earliest_words(monkeypatch):
    """The extension compares words, not hashes: names that collide around a seed change nothing."""
    import random

    r = random.Random(4)
    texts = [" ".join(r.choice(["aa", "bb", "cc", "dd"]) for _ in range(120)) for _ in range(12)]
    texts += [f"{texts[0][:150]} {texts[3][30:200]}", texts[5][60:300]]
    block = runs_of(texts, 13, 5, repeats.as_words)
    own, source = substring.extending(13, 5)(block)
    words, least = [t.split() for t in texts], {}
    for d, w in enumerate(words):
        for i in range(len(w) - 12):
            least.setdefault(tuple(w[i : i + 13]), d)
    place = lambda k: (int(block.ids[block.run[k]]), int(block.pos[block.run[k]] + block.step[k]))
    want = {(d, i) for d, w in enumerate(words) for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < d}
    assert {place(k) for k in own} == want and len(want) > 40
    for k, s in zip(own, source):
        (d, i), (e, j) = place(k), place(s)
        assert words[d][i : i + 13] == words[e][j : j + 13] and e == least[tuple(words[e][j : j + 13])]


def test_suffix_sort_finds_the_second_start():
    r = np.random.default_rng(6)
    texts = ["".join(r.choice(list("ab"), 400)) for _ in range(5)]
    texts += [texts[1][50:250] + texts[2][100:300], "ab" * 150]
    block = runs_of(texts, 64, 40, repeats.as_bytes)
    own, source = suffix.sorting(64)(block)
    place = lambda k: (int(block.ids[block.run[k]]), int(block.pos[block.run[k]] + block.step[k]))
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 63):
            seen.setdefault(t[i : i + 64], []).append((d, i))
    assert {place(k) for k in own} == {p for v in seen.values() if len(v) > 1 for p in v}
    for k, s in zip(own, source):
        (d, i), (e, j) = place(k), place(s)
        assert (d, i) != (e, j) and texts[d][i : i + 64] == texts[e][j : j + 64]


def test_an_order_by_colliding_hashes_is_not_taken(monkeypatch):
    """The neighbours' bytes prove the order: with hashes that all agree, the sort falls back on bytes."""
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 2000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    monkeypatch.setattr(rolling.Prefix, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    starts = np.arange(0, 1900)
    order, new = suffix.Suffixes(data, rolling.bytes_as_symbols(data), starts, 64).classes()
    strings = [data[s : s + 64].tobytes() for s in starts]
    assert [strings[i] for i in order] == sorted(strings) and int(new.sum()) == len(set(strings))


def test_maximal_repeats_are_counted(spark):
    words = [f"w{i}" for i in range(90)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[5:45], "new", *words[50:80], "x"])), (3, " ".join(words[10:22]))]
    got = {r.doc_id: (r.n_removed, r.n_repeats) for r in substring.deduplicate(fixtures.frame(spark, docs)).collect()}
    assert got == {1: (0, 0), 2: (70, 2), 3: (0, 0)}
