"""Hashes over symbols (bytes or words) of many documents at once, in numpy.

A document collection is one array of symbols and the places where documents begin. Symbols are 64-bit values drawn by a
mixing function, so a byte and a word are handled alike.

Prefix polynomials modulo 2^64 hash any range in constant time. They choose what is compared (shingles, anchors, runs); over
long ranges of few kinds of symbols they have collisions for every odd base, so no word is named by them. A word of under eight
bytes is its bytes and their number under a bijection; a longer one goes through two non-linear lanes, one over ``LONG_WORD`` bytes through
BLAKE2b. Ranges that have to be told apart for good go through :func:`strong`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Window starts that are handled at once; bounds the memory whatever a document's length.
BLOCK = 1 << 18
_POS = U((1 << 20) - 1)
#: Words over so many bytes are named by a keyed digest, one at a time.
LONG_WORD = 64
_KEY = b"words of a corpus"
_LANES = (U(0x243F6A8885A308D3), U(0x13198A2E03707344))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd numbers; each pair is one try at the hashes of runs.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of a base and of its inverse modulo 2^64; a process keeps one table for each base."""
    if which not in _tables or len(_tables[which][0]) < n:
        base, size = _BASES[which], max(BLOCK + (1 << 12), 1 << (n - 1).bit_length())
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _tables[which] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _tables[which]


class Prefix:
    """Prefix hashes of a symbol array: the hash of any range in constant time."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        up, self.down = powers(which, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:], dtype=U)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Unmixed hashes of symbols[start : start + length]."""
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def run(self, length: int) -> np.ndarray:
        """Unmixed hashes of all ranges of one length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def bytes_as_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def _chunk(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number, or the ``left`` ones, if fewer."""
    got = view[at]
    short = left < 8
    got[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
    return got


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` as a number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.r_[data, np.zeros(8, np.uint8)], 0, (1,))


def strong(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of data[start : start + size] for each range: two lanes of multiplications and shifts, which no sum undoes."""
    view = _eights(data)
    one, two = mix(size.astype(U) + _LANES[0]), mix(size.astype(U) ^ _LANES[1])
    todo, k = np.arange(len(starts)), 0
    while len(todo := todo[size[todo] > k]):
        got = _chunk(view, starts[todo] + k, size[todo] - k)
        one[todo] = mix(one[todo] ^ got)
        two[todo] = mix(two[todo] + got * U(_BASES[0]) + one[todo])
        k += 8
    return one, two


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word."""
    size = ends - starts
    out = np.empty(len(starts), U)
    short = np.flatnonzero(size < 8)
    out[short] = mix(_chunk(_eights(data), starts[short], size[short]) | size[short].astype(U) << U(56))
    more = np.flatnonzero((size >= 8) & (size <= LONG_WORD))
    one, two = strong(data, starts[more], size[more])
    out[more] = mix(one ^ (two << U(1)))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
    return out


def words(data: np.ndarray, places: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of documents: a symbol for each, where documents begin among them, their byte starts and ends."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = ~_SPACE[data]
    edge = inside[1:] != inside[:-1]
    begin = np.zeros(n + 1, bool)
    begin[places] = True
    starts = np.flatnonzero(inside[1:] & (edge | begin))
    ends = np.flatnonzero(inside[:-1] & (edge | begin))
    at = np.searchsorted(starts, places)
    symbols = np.empty(len(starts), U)
    i = 0
    while i < len(starts):  # whole words up to about a block of bytes
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        low = starts[i]
        part = data[low : ends[j - 1]]
        symbols[i:j] = _names(_LOWER[part] if fold else part, starts[i:j] - low, ends[i:j] - low)
        i = j
    return symbols, at, starts, ends


def windows(symbols: np.ndarray, places: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (first start, end of starts, symbols of the block with what windows reach into, which starts are whole windows)."""
    n = len(symbols) - width + 1
    for s in range(0, max(n, 0), BLOCK):
        e = min(n, s + BLOCK)
        good = np.ones(e - s, bool)
        for p in places[np.searchsorted(places, s, "right") : np.searchsorted(places, e + width, "left")]:
            good[max(0, p - width + 1 - s) : max(0, p - s)] = False
        yield s, e, symbols[s : e + width - 1], good


def segments(symbols: np.ndarray, places: np.ndarray, width: int, gram: int, attempt: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Winnowed anchors: (anchor, hash 1, hash 2, start, windows) of runs of windows with the same least ``gram``.

    Every window of ``width`` symbols belongs to just one run. Equal windows have equal anchors at equal distances, so they
    lie in runs of equal anchors. The hashes are of all symbols that the run's windows cover.
    """
    span = width - gram + 1
    for s, _, part, good in windows(symbols, places, width):
        if not good.any():
            continue
        one, two = Prefix(part, 2 * attempt), Prefix(part, 2 * attempt + 1)
        grams = mix(one.run(gram))
        keys = (grams & ~_POS) | np.arange(len(grams), dtype=U)
        low, have = keys, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        at = (low & _POS).astype(np.int64)
        at[~good] = -1
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)]
        keep = at[first] >= 0
        first, last = first[keep], last[keep]
        size = last - first + width - 1
        yield grams[at[first]], mix(one.of(first, size) + size.astype(U)), mix(two.of(first, size) + size.astype(U)), first + s, last - first
