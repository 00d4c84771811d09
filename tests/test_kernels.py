"""Values worked out by hand, and plain versions, of byte codes and character statistics."""

import math
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from textloom.operators import contexts, dictionary, kernels


def chars(text):
    return np.array([ord(c) for c in text], np.int64)


def test_swaps_are_their_own_inverse():
    table = str.maketrans(*kernels.SWAPPED)
    every = "".join(map(chr, range(128)))
    assert every.translate(table).translate(table) == every
    assert "{|}~:;<=>?X".translate(table) == "PQRSJKLMNO`" and "aZ09 ".translate(table) == "aZ09 "


def test_escapes(spark):
    text = "a@\x06b\x07\x0cé"
    got = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(kernels.escaped("text").alias("x")).collect()
    assert [r.x for r in got] == ["610C400C06620C070C0C0CC30CA9", "", None]


def test_codewords_have_the_first_byte_in_the_lowest_place(spark):
    spark.createDataFrame([(r,) for r in (0, 79, 80, 3919, 3920, 44879)], "r long").createOrReplaceTempView("ranks")
    code = dictionary._CODE.replace("DIV_", "DIV")
    got = [r.code for r in spark.sql(f"SELECT r, CAST({code} AS BIGINT) AS code FROM ranks ORDER BY r").collect()]
    assert [c.to_bytes(3, "little").rstrip(b"\0").hex() for c in got] == ["80", "cf", "d080", "ffcf", "f0d080", "ffefcf"]


def test_costs_one_character_at_a_time():
    text = "abracadabra, ab racad ab"
    for order in (0, 1, 2):
        seen, pairs, bits, kinds = Counter(), Counter(), 0.0, len(set(text))
        for i, c in enumerate(text):
            before = text[max(0, i - order) : i]
            bits -= math.log2((pairs[before, c] + 0.5) / (seen[before] + 0.5 * kinds))
            seen[before] += 1
            pairs[before, c] += 1
        assert abs(kernels.kt_bits(chars(text), order) - bits) < 1e-9
        whole = sum(n * math.log2(seen[b] / n) for (b, _), n in pairs.items()) / len(text)
        assert abs(kernels.entropy(chars(text), order) - whole) < 1e-9


def test_gaps_depths_and_distances():
    assert kernels._gaps(chars("abcabcabcabc")) == [(3, 3)] and kernels._gaps(chars("ab")) == [] and kernels._gaps(chars("aaaa")) == [(1, 1)]
    assert kernels._depths(chars("(a[b]{c}")) == [(2, 1)] and kernels._distances(chars("ab cd")) == [(513, 255)]


def test_places_in_lines():
    assert contexts.line_bounds(chars("a\nbb\n")) == [(0, 0, 1), (1, 2, 4), (2, 5, 5)] and contexts.line_bounds(chars("x")) == [(0, 0, 1)]
    assert contexts.line_places(chars("ab\ncd")) == [(0 + 1 + 2 + 0 + 1, 2)] and contexts.line_places(chars("a" * 150)) == [(4950 + 99 * 50, 99)]
    assert contexts.quantised(chars("ab")) == [] and contexts.quantised(chars("a a")) == [(3 * 64 + 1 * 8 + 3, 1)]


def test_sparse_matches():
    got = {k: (tried, hits) for k, tried, hits in contexts.sparse_matches(contexts.words("A b c a b c a x c a b"))}
    want = {}
    text = "a b c a b c a x c a b".split()
    for back in contexts.SPARSE:
        last, tried, hits = {}, 0, 0
        for i in range(max(back), len(text)):
            key = tuple(text[i - b] for b in back)
            tried, hits = tried + (key in last), hits + (last.get(key) == text[i])
            last[key] = text[i]
        want["".join(map(str, back))] = (tried, hits)
    assert got == want and contexts.sparse_matches(contexts.words("1 2")) == []


def test_numbers(spark):
    rows = [" \t-12x", "+7", "x9", "", "99999999999999999999", "18446744073709551615", "18446744073709551616", "0000000000000000000000007", "9223372036854775808", None]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(contexts.leading_number(F.col("t")).alias("a"), contexts.exact_number(F.col("t")).cast("string").alias("b")).collect()
    assert [r.a for r in got] == [-12, 7, 0, 0, None, None, None, 7, None, None]
    assert [r.b for r in got] == [None, None, None, None, None, "18446744073709551615", None, "7", "9223372036854775808", None]
