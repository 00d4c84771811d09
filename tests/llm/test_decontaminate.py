import math

import brute
import fixtures
import numpy as np

from textloom.llm import decontaminate


def brute_force(docs, items, least=0.75, k=5):
    import re

    word = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    cut = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else [])
    sets = [(i, cut(word(t))) for i, t in items if i is not None and brute.shingles(t)]
    df = {}
    for _, s in sets:
        for x in set(s):
            df[x] = df.get(x, 0) + 1
    weight = lambda x: math.log1p(len(sets) / df.get(x, 1))
    out = []
    for d, t in docs:
        s = cut(word(t))
        for i, own in sets:
            best = 0
            for a in range(max(1, len(s) - len(own) + 1)):
                win = set(s[a : a + len(own)])
                both = sum(map(weight, win & set(own)))
                best = max(best, both / sum(map(weight, win | set(own))) if win else 0)
            if best >= least:
                out.append((d, i, round(best, 9)))
    return sorted(out, key=repr)


def test_against_all_windows(spark):
    docs = fixtures.rows(3, 70)
    texts = [t for _, t in docs if t]
    items = [(i, " ".join(texts[i * 3].split()[2:40])) for i in range(8)] + [(20, None), (21, ""), (22, "one"), (None, texts[1]), (23, texts[6]), (23, texts[6])]
    near = texts[6].split()
    near[len(near) // 2] = "changed"
    docs += [(8000, f"{texts[1]} {' '.join(near)} and {texts[2]}"), (8001, "Nothing like any of these items at all, really")]
    frame = fixtures.frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as raw")
    got = decontaminate.contaminated(frame, bench)
    rows = sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got.collect()), key=repr)
    want = brute_force(docs, list(dict.fromkeys(items)))
    assert rows == want and len(want) > 20
    kept = decontaminate.without_contaminated(frame, bench)
    bad = {d for d, _, _ in want if d is not None}
    assert kept.columns == frame.columns and 8001 in {r.doc_id for r in kept.collect()} and not {8000} & {r.doc_id for r in kept.collect()} and bad


def test_rounds_and_empty_tables(spark, monkeypatch):
    docs = fixtures.rows(5, 40)
    frame = fixtures.frame(spark, docs)
    bench = spark.createDataFrame([(i, t) for i, t in docs[:30] if t and len(t.split()) > 20], "item_id long, text string")
    pairs = lambda: sorted((r.doc_id or -1, r.item_id) for r in decontaminate.contaminated(frame, bench).collect())
    once = pairs()
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", 7)
    assert pairs() == once and once
    assert decontaminate.contaminated(frame, bench.limit(0)).collect() == [] and decontaminate.contaminated(frame.limit(0), bench).collect() == []
    assert decontaminate.without_contaminated(frame, bench.limit(0)).count() == len(docs)


def test_index_misses_none_within_the_radius():
    texts = [f"item {i} with words w{i * 7} x{i} y{i % 3} z and more {i * i}".encode() for i in range(50)]
    index = decontaminate.Index(list(range(50)), texts)
    import random

    r = random.Random(1)
    for i in range(50):
        p = int(index.prints[i])
        for b in r.sample(range(64), decontaminate.RADIUS):
            p ^= 1 << b
        assert i in index.within(p)
        assert set(index.within(p)) == {j for j in range(50) if (int(index.prints[j]) ^ p).bit_count() <= decontaminate.RADIUS}


def test_words_inserted_in_a_passage(spark):
    import random

    r = random.Random(5)
    say = lambda n: [f"w{r.randrange(100000)}" for _ in range(n)]
    head, tail, docs, items = say(5), say(5), [], []
    for i in range(200):
        words = [*head, *say(31 + i % 4), *tail]
        items.append((i, " ".join(words)))
        if i < 6:
            half = len(words) // 2
            docs.append((i, " ".join([*say(50), *words[:half], *say(2), *words[half:], *say(50)])))
    got = decontaminate.contaminated(fixtures.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_force(docs, items)
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got) == want and len(want) > 2
    assert {r.first_word for r in got} == {51}


def test_every_start_that_can_be_like_an_item_is_laid():
    import random

    r = random.Random(7)
    for _ in range(60):
        texts = [" ".join(r.choice("abcd") for _ in range(r.randint(1, 14))) for _ in range(6)]
        doc = " ".join(r.choice("abcd") for _ in range(r.randint(1, 60))).encode()
        index = decontaminate.Index(list(range(6)), [t.encode() for t in texts], 2)
        s = decontaminate._shingles(np.frombuffer(doc, np.uint8), np.array([0, len(doc)]), 2)[0]
        laid = index.windows(s, 0.6)
        for item, size in enumerate(index.sizes):
            for start in range(max(0, len(s) - size) + 1):
                own = np.unique(s[start : start + size])
                assert (start, size) in laid or index.similarity(item, own, index.weight(own)) < 0.6


def test_rounds_do_not_change_the_similarity(spark, monkeypatch):
    import random

    r = random.Random(8)
    say = lambda n: [f"w{r.randrange(100000)}" for _ in range(n)]
    head, tail, docs, items = say(60), say(60), [], []
    for i in range(60):
        words = [*head, *say(16), *tail]
        items.append((i, " ".join(words)))
        if i < 18:
            words[68 : 68 + i % 3] = say(i % 3)
            docs.append((i, " ".join([*say(9), *words, *say(9)])))
    frame, bench = fixtures.frame(spark, docs), spark.createDataFrame([*items, (90, None), (91, " ")], "item_id long, text string")
    rows = lambda: sorted((x.doc_id, x.item_id, round(x.similarity, 9), x.first_word) for x in decontaminate.contaminated(frame, bench).collect())
    once, kept = rows(), sorted(x.doc_id for x in decontaminate.without_contaminated(frame, bench).collect())
    assert [x[:3] for x in once] == sorted(brute_force(docs, items)) and len(once) == 12
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", 13)
    assert rows() == once and sorted(x.doc_id for x in decontaminate.without_contaminated(frame, bench).collect()) == kept


def test_items_of_null_id_count_in_the_filter(spark, monkeypatch):
    item = " ".join(f"i{j}" for j in range(30))
    frame = fixtures.frame(spark, [(1, f"before it {item} after it"), (2, " ".join(f"d{j}" for j in range(50))), (3, None)])
    bench = spark.createDataFrame([(None, item), (4, " ".join(f"o{j}" for j in range(30))), (None, None)], "item_id long, text string")
    for most in (10_000, 1):
        monkeypatch.setattr(decontaminate, "MOST_ITEMS", most)
        assert sorted(r.doc_id for r in decontaminate.without_contaminated(frame, bench).collect()) == [2, 3]


def test_an_item_whose_halves_stand_the_other_way_round(spark):
    words = [f"w{i}" for i in range(48)]
    docs = [(1, " ".join(["before", *words[24:], *words[:24], "behind"])), (2, " ".join(words[::-1])), (3, " ".join([*words[:20], *words[:20], *words[20:]]))]
    items = [(7, " ".join(words))]
    got = decontaminate.contaminated(fixtures.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_force(docs, items)
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got) == want and [w[:2] for w in want] == [(1, 7), (3, 7)]


def near_and_far(rounds=3000):
    """Of pairs of sets of similarity 0.75 to 0.8: whether the index gives one for the other; and how many of others it takes up."""
    r = np.random.default_rng(9)
    found, taken, others = 0, 0, 0
    for k in range(rounds):
        size = int(r.choice([8, 12, 20, 40, 80]))
        own = np.unique(r.integers(0, 1 << 63, size + 2).astype(np.uint64))[:size]
        new = max(1, int(size * 0.14))  # of size, so many replaced: (size - new) / (size + new) is 0.75 or a little more
        like = np.r_[own[:-new], np.unique(r.integers(0, 1 << 63, new).astype(np.uint64))]
        assert 0.74 < (size - new) / (size + new) < 0.9
        a, b = (decontaminate.fingerprint(np.sort(x), np.ones(len(x))) for x in (own, like))
        far = np.stack([decontaminate.fingerprint(r.integers(0, 1 << 63, size).astype(np.uint64), np.ones(size)) for _ in range(4)])
        blocks = decontaminate.Blocks(np.vstack([a[None, :], far]), decontaminate.RADIUS, decontaminate.NEAR)
        found += 0 in blocks.within(b).tolist()
        taken += int((blocks.candidates(b) > 0).sum())
        others += len(far)
    return found / rounds, taken / others


def test_recall_of_the_radius_and_share_of_candidates():
    recall, share = near_and_far()
    print(f"recall {recall:.4f}, candidates {share:.4f}")
    assert recall >= 0.99 and share < 0.02
