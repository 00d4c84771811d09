import collections
import zlib

import fixtures
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from textloom.llm import packing


def sound(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_pack(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = fixtures.rows(3, 80) + [(3000, "a <|endoftext|> b"), (3001, "it's  don't\n\n x123 " * 900)]
    for capacity in (64, 2048):
        rows = packing.pack(fixtures.frame(spark, docs), capacity=capacity).collect()
        want = collections.Counter()
        for d, x in docs:
            ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
            first = (len(ids) - 1) % capacity + 1
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                want[(d, k, i, j - i, zlib.crc32(ids[i:j].tobytes()))] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        used, least = sound(rows, capacity), -(-sum(r.length for r in rows) // capacity)
        assert used <= 1.1 * least + 2


def test_empty(spark):
    assert packing.pack(fixtures.frame(spark, []).limit(0)).collect() == []


def naive(sizes, capacity):
    """Sum of squares, one item at a time, trying every gap."""
    bins = collections.Counter()
    used = 0
    for s in sorted(sizes, reverse=True):
        best = None
        for g in [g for g in bins if bins[g] > 0 and g >= s] + [capacity]:
            after = bins.copy()
            if g != capacity:
                after[g] -= 1
            if g > s:
                after[g - s] += 1
            cost = (sum(v * v for v in after.values()), g == capacity)
            best = min(best, (cost, g)) if best else (cost, g)
        g = best[1]
        used += g == capacity
        if g != capacity:
            bins[g] -= 1
        if g > s:
            bins[g - s] += 1
    return used


def test_plan_is_near_the_rule_one_by_one():
    r = np.random.default_rng(4)
    sizes = np.clip(r.lognormal(2.5, 0.9, 900).astype(int) + 1, 1, 100)
    lines = packing.plan(dict(collections.Counter(sizes.tolist())), 100)
    used = max(f + n for _, _, n, f, _ in lines)
    least = -(-int(sizes.sum()) // 100)
    assert used <= naive(sizes.tolist(), 100) + 3 and used <= least + 6
    big = packing.plan({k: 10**9 * k for k in range(1, 101)}, 100)  # counts do not matter for the time
    assert sum(n for _, _, n, _, _ in big) == sum(10**9 * k for k in range(1, 101)) and len(big) < 10_000


def test_the_rule_is_followed_item_by_item():
    r = np.random.default_rng(8)
    for k in range(12):
        sizes = np.clip(r.lognormal(2.5, 0.9, 500).astype(int) + 1, 1, 60) if k % 2 else r.choice([5, 7, 13, 20, 30, 31, 50, 59, 60], 700)
        assert sum(packing.by_rule(dict(collections.Counter(sizes.tolist())), 60).values()) == naive(sizes.tolist(), 60)
    many = {3: 4000, 7: 3000, 11: 2500}  # thousands of one length
    assert sum(packing.by_rule(many, 16).values()) == naive([s for s, n in many.items() for _ in range(n)], 16)


def test_a_plan_holds_every_item_once_and_wastes_little():
    r = np.random.default_rng(2)
    counts = {int(s): int(n) for s, n in zip(range(1, 65), r.integers(0, 5000, 64))}
    for items in (1, 8, 64):  # shares of many sizes
        lines = packing.plan(counts, 64, items)
        ranks = {s: sorted((a, n) for t, a, n, _, _ in lines if t == s) for s in counts}
        for s, runs in ranks.items():
            at = 0
            for a, n in runs:
                assert a == at
                at += n
            assert at == counts[s]
        ends = collections.Counter()
        for s, _, n, first, offset in lines:
            for q in range(first, first + n):
                ends[q] += s
        assert max(ends.values()) <= 64 and set(ends) == set(range(len(ends)))
        large = sum(n for s, n in counts.items() if s > 32)
        assert len(ends) <= 1.08 * max(large, -(-sum(s * n for s, n in counts.items()) // 64)) + 2
    assert packing.plan({}, 64) == []
