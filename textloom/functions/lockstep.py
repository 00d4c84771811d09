"""The sequential models of many documents at once: each step takes one bit of every document that still has one.

Documents go in groups of like length. What a document does in a step depends on its own past only, as in the functions for a
single one (``automata``, ``coding``); once few documents of a group are left, these finish one by one, from where they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

from .automata import Dmc
from .coding import decode_from, encode_from, mixed_from, unvarint, varint

#: Bytes of a group, and documents that are no longer worth a step together.
GROUP, FEW = 6 << 20, 24
#: Rows of 256 contexts (2 KB) that the mixed predictors of a group may use.
ROWS = 1 << 16


def _groups(sizes: np.ndarray, weights: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Documents by falling size, cut where their weights pass ``limit``."""
    order = np.argsort(-sizes, kind="stable")
    at = np.cumsum(weights[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(at, (at[i - 1] if i else 0) + limit, "right")))
        yield order[i:j]
        i = j


def _grouped(texts: list, run: Callable[[list], list], weigh: Callable[[bytes], int] = len, limit: int | None = None) -> list:
    out: list = [None] * len(texts)
    sizes, weights = (np.array([f(t) for t in texts], np.int64) for f in (len, weigh))
    for group in _groups(sizes, weights, limit or GROUP):
        for i, x in zip(group.tolist(), run([texts[i] for i in group.tolist()]), strict=True):
            out[i] = x
    return out


class _Columns:
    """Values of documents by place: those of the first place, then of the second, ...; documents have falling sizes."""

    def __init__(self, sizes: list[int]):
        self.size = np.array(sizes, np.int64)
        longest = sizes[0] if sizes else 0
        self.active = np.searchsorted(-self.size, -np.arange(longest), "left")  # documents longer than each place
        self.first = np.r_[0, np.cumsum(self.active)]

    def of(self, values: list[np.ndarray], kind: type) -> np.ndarray:
        out = np.empty(int(self.first[-1]), kind)
        for i, v in enumerate(values):
            out[self.first[: len(v)] + i] = v
        return out

    def steps(self) -> Iterator[tuple[int, int, slice]]:
        """(place, documents, where its values are) as long as there are more than a few documents."""
        for t, n in enumerate(self.active.tolist()):
            if n <= FEW:
                return
            yield t, n, slice(int(self.first[t]), int(self.first[t]) + n)

    def together(self) -> int:
        """Places that documents go through together; what is beyond is done one by one."""
        return int(np.count_nonzero(self.active > FEW))


def _bytes(texts: list[bytes]) -> tuple[_Columns, np.ndarray]:
    columns = _Columns([len(t) for t in texts])
    return columns, columns.of([np.frombuffer(t, np.uint8) for t in texts], np.uint8)


def dmc_bits(texts: list[bytes]) -> list[float]:
    """``automata.dmc_bits`` of each."""
    return _grouped(texts, _dmc_group)


def _dmc_group(texts: list[bytes]) -> list[float]:
    columns, data = _bytes(texts)
    n_docs, model = len(texts), Dmc()
    chain = len(model.next)
    made = chain * n_docs
    # a state is an even number s; its counts and successors are at s and s + 1
    count, after = np.empty(4 * made), np.empty(4 * made, np.int32)
    count[: 2 * made] = np.tile(np.array(model.count).ravel(), n_docs)
    after[: 2 * made] = (np.tile(2 * np.array(model.next).ravel(), n_docs).reshape(n_docs, -1) + 2 * chain * np.arange(n_docs)[:, None]).ravel()
    owner = np.empty(2 * made, np.int32)
    owner[:made] = np.repeat(np.arange(n_docs), chain)
    at, states, total = 2 * chain * np.arange(n_docs), np.full(n_docs, chain), np.zeros(n_docs)
    for _, n, where in columns.steps():
        symbol = data[where].astype(np.int64)
        if made + 8 * n > len(owner):
            count, after, owner = (np.concatenate([x, np.empty(max(len(x) // 2, m * 8 * n), x.dtype)]) for x, m in ((count, 2), (after, 2), (owner, 1)))
        now, cost = at[:n], total[:n]
        for k in range(7, -1, -1):
            a = now + (symbol >> k & 1)
            here = count[a]
            cost -= np.log2(here / (here + count[a ^ 1]))
            to = after[a].astype(np.int64)
            there = count[to] + count[to + 1]
            clone = np.flatnonzero((here > model.own) & (there - here > model.others) & (states[:n] < model.most))
            if len(clone):
                old, new = to[clone], 2 * np.arange(made, made + len(clone))
                share = here[clone] / there[clone]
                for bit in (0, 1):
                    moved = count[old + bit] * share
                    count[old + bit] -= moved
                    count[new + bit] = moved
                    after[new + bit] = after[old + bit]
                after[a[clone]] = new
                owner[new >> 1] = clone
                to[clone] = new
                states[clone] += 1
                made += len(clone)
            count[a] += 1
            now[:] = to
    start = columns.together()
    for i, text in enumerate(texts):
        if len(text) <= start:
            break
        own = np.flatnonzero(owner[:made] == i)
        model = Dmc()
        model.count = count[: 2 * made].reshape(-1, 2)[own].tolist()
        model.next = np.searchsorted(own, after[: 2 * made].reshape(-1, 2)[own] >> 1).tolist()
        model.at = int(np.searchsorted(own, at[i] >> 1))
        total[i] += model.cost(text[start:])
    return total.tolist()


def mixed_bits(texts: list[bytes]) -> list[float]:
    """``coding.mixed_bits`` of each."""
    return _grouped(texts, _mixed_group, lambda t: max(len(set(t)) + 2, len(t) * ROWS // GROUP), ROWS)


def _mixed_group(texts: list[bytes]) -> list[float]:
    columns, data = _bytes(texts)
    n_docs, made, rows, kinds = len(texts), 0, [], []
    for text in texts:  # a row of counts for order 0, and one for each byte that comes before another
        before = np.frombuffer(b"\0" + text[:-1] if text else b"", np.uint8)
        kind = np.unique(before)
        kinds.append((made, kind))
        seat = np.zeros(256, np.int32)
        seat[kind] = np.arange(made + 1, made + 1 + len(kind))
        rows.append(seat[before])
        made += 1 + len(kind)
    row = columns.of(rows, np.int32)
    zero = np.array([first for first, _ in kinds], np.int64)
    counts = np.zeros(512 * made, np.int32)
    logs = np.log(np.arange(len(texts[0]) + 1 if texts else 1) + 0.4)
    most, rate = math.log((1 - 1e-4) / 1e-4), 0.02
    weight, total = np.full((2, n_docs), 0.5), np.zeros(n_docs)
    for _, n, where in columns.steps():
        symbol = data[where].astype(np.int64)
        base = 512 * np.stack([zero[:n], row[where]])
        w, cost = weight[:, :n], total[:n]
        for k in range(7, -1, -1):
            seat = base + 2 * ((symbol | 256) >> (k + 1))
            bit = symbol >> k & 1
            x = logs[counts[seat + 1]] - logs[counts[seat]]
            np.clip(x, -most, most, out=x)
            p = 1 / (1 + np.exp(-(w[0] * x[0] + w[1] * x[1])))
            w += rate * (bit - p) * x
            np.clip(p, 1e-6, 1 - 1e-6, out=p)
            cost -= np.log2(np.abs(1 - bit - p))
            counts[(seat + bit).ravel()] += 1
    start = columns.together()
    for i, text in enumerate(texts):
        if len(text) <= start:
            break
        first, kind = kinds[i]
        own = counts[512 * first : 512 * (first + 1 + len(kind))].reshape(-1, 512)
        total[i] += mixed_from(text, start, own[0].tolist(), {b: c.tolist() for b, c in zip(kind.tolist(), own[1:], strict=True)}, weight[:, i].tolist())
    return total.tolist()


def _odds(counts: np.ndarray, seat: np.ndarray) -> np.ndarray:
    one = counts[seat + 1]
    return np.minimum(np.maximum((one << 16) // (counts[seat] + one), 1), 65535)


def range_encode(texts: list[bytes]) -> list[bytes]:
    """``coding.range_encode`` of each."""
    return _grouped(texts, _encode_group)


def _encode_group(texts: list[bytes]) -> list[bytes]:
    columns, data = _bytes(texts)
    n_docs = len(texts)
    counts, base = np.ones(512 * n_docs, np.int64), 512 * np.arange(n_docs)
    low, high = np.zeros(n_docs, np.int64), np.full(n_docs, 0xFFFFFFFF, np.int64)
    docs, sent, parts = [], [], []

    def gather() -> None:
        if docs:
            parts.append((np.concatenate(docs).astype(np.int32), np.concatenate(sent).astype(np.uint8)))
            docs.clear()
            sent.clear()

    for t, n, where in columns.steps():
        symbol = data[where].astype(np.int64)
        lo, hi = low[:n], high[:n]
        for k in range(7, -1, -1):
            seat = base[:n] + 2 * ((symbol | 256) >> (k + 1))
            bit = symbol >> k & 1
            mid = lo + ((hi - lo) * _odds(counts, seat) >> 16)
            one = bit.astype(bool)
            np.copyto(hi, mid, where=one)
            np.copyto(lo, mid + 1, where=~one)
            counts[seat + bit] += 1
            out = np.flatnonzero(lo ^ hi < 1 << 24)
            while len(out):
                docs.append(out)
                sent.append(hi[out] >> 24)
                lo[out] = lo[out] << 8 & 0xFFFFFFFF
                hi[out] = hi[out] << 8 & 0xFFFFFFFF | 255
                out = out[lo[out] ^ hi[out] < 1 << 24]
        if t % 512 == 511:
            gather()
    gather()
    who = np.concatenate([np.zeros(0, np.int32), *(a for a, _ in parts)])
    order = np.argsort(who, kind="stable")
    code = np.concatenate([np.zeros(0, np.uint8), *(b for _, b in parts)])[order]
    ends, start, codes = np.cumsum(np.bincount(who, minlength=n_docs)), columns.together(), []
    for i, text in enumerate(texts):
        mine = code[ends[i - 1] if i else 0 : ends[i]].tobytes()
        codes.append(varint(len(text)) + encode_from(text[start:], counts[512 * i : 512 * i + 512].tolist(), int(low[i]), int(high[i]), bytearray(mine)))
    return codes


def range_decode(codes: list[bytes]) -> list[bytes]:
    """``coding.range_decode`` of each."""
    heads = [next(i for i, b in enumerate(c) if b < 128) + 1 for c in codes]
    sizes = [unvarint(c[:i]) for c, i in zip(codes, heads, strict=True)]
    out: list = [None] * len(codes)
    for group in _groups(np.array(sizes, np.int64), np.array(sizes, np.int64), GROUP):
        mine = group.tolist()
        for i, x in zip(mine, _decode_group([codes[i][heads[i] :] for i in mine], [sizes[i] for i in mine]), strict=True):
            out[i] = x
    return out


def _decode_group(codes: list[bytes], sizes: list[int]) -> list[bytes]:
    columns, n_docs = _Columns(sizes), len(codes)
    data = np.zeros(int(columns.first[-1]), np.uint8)
    counts, base = np.ones(512 * n_docs, np.int64), 512 * np.arange(n_docs)
    low, high = np.zeros(n_docs, np.int64), np.full(n_docs, 0xFFFFFFFF, np.int64)
    x = np.array([int.from_bytes(c[:4].ljust(4, b"\0"), "big") for c in codes], np.int64)
    ends = np.cumsum([len(c) for c in codes])
    at = ends - [len(c) for c in codes] + 4
    flat = np.frombuffer(b"".join(codes) + b"\0", np.uint8)
    for _, n, where in columns.steps():
        node = np.ones(n, np.int64)
        lo, hi, value = low[:n], high[:n], x[:n]
        for _ in range(8):
            seat = base[:n] + 2 * node
            mid = lo + ((hi - lo) * _odds(counts, seat) >> 16)
            one = value <= mid
            np.copyto(hi, mid, where=one)
            np.copyto(lo, mid + 1, where=~one)
            counts[seat + one] += 1
            node = 2 * node + one
            out = np.flatnonzero(lo ^ hi < 1 << 24)
            while len(out):
                lo[out] = lo[out] << 8 & 0xFFFFFFFF
                hi[out] = hi[out] << 8 & 0xFFFFFFFF | 255
                place = at[out]
                value[out] = value[out] << 8 & 0xFFFFFFFF | np.where(place < ends[out], flat[np.minimum(place, len(flat) - 1)], 0)
                at[out] = place + 1
                out = out[lo[out] ^ hi[out] < 1 << 24]
        data[where] = node - 256
    start, texts = columns.together(), []
    for i, size in enumerate(sizes):
        head = data[columns.first[: min(size, start)] + i].tobytes()
        if size > start:
            first = int(ends[i]) - len(codes[i])
            head += decode_from(size - start, codes[i], int(at[i]) - first, counts[512 * i : 512 * i + 512].tolist(), int(low[i]), int(high[i]), int(x[i]))
        texts.append(head)
    return texts
