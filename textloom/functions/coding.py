"""Sequential operators that SQL cannot express, over one document at a time: rank codes, segments, mixing, PPM, range coding.

Each is a plain function of one value, so a pandas UDF maps it over a column and documents stay independent.
"""

from __future__ import annotations

import math
from collections import defaultdict


def lehmer(values: list[int]) -> list[int]:
    """For each value, how many later ones are smaller: a Fenwick tree over ranks."""
    rank = {v: i + 1 for i, v in enumerate(sorted(set(values)))}
    tree, out = [0] * (len(rank) + 1), []
    for v in reversed(values):
        i, n = rank[v] - 1, 0
        while i > 0:
            n += tree[i]
            i -= i & -i
        out.append(n)
        i = rank[v]
        while i < len(tree):
            tree[i] += 1
            i += i & -i
    return out[::-1]


def unlehmer(code: list[int]) -> list[int]:
    """The permutation of 0..n-1 with this code."""
    left = list(range(len(code)))
    return [left.pop(k) for k in code]


def varint(x: int) -> bytes:
    """LEB128 of an unsigned number."""
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def unvarint(data: bytes) -> int:
    return sum((b & 127) << 7 * i for i, b in enumerate(data))


def segments(data: bytes, text_run: int = 500, spaces: int = 5, most: int = 300, back: int = 100) -> list[tuple[str, int, int]]:
    """(kind, start, length): text begins with a run of over ``text_run`` ASCII bytes with enough spaces; it ends when a leaky
    score (+3 for a byte that is not ASCII, -2 for one that is, 0 at least) passes ``most``, ``back`` bytes before that."""
    out, start, kind, run, blank, score, i = [], 0, "binary", 0, 0, 0, 0
    while i < len(data):
        plain = data[i] < 128
        if kind == "binary":
            run, blank = (run + 1, blank + (data[i] == 32)) if plain else (0, 0)
            if run > text_run:
                if blank >= spaces:
                    begin = i - run + 1
                    if begin > start:
                        out.append((kind, start, begin - start))
                    kind, start, score = "text", begin, 0
                run = blank = 0
        else:
            score = max(0, score + (-2 if plain else 3))
            if score > most:
                end = max(start, i + 1 - back)
                if end > start:
                    out.append((kind, start, end - start))
                kind, start, run, blank = "binary", end, 0, 0
        i += 1
    if start < len(data):
        out.append((kind, start, len(data) - start))
    return out


_PAIRS = {"(": ")", "[": "]", "{": "}", '"': '"'}


def brackets(text: str, limit: int = 255) -> list[int]:
    """For each character, 256 * the open bracket's code + the distance to it; an opener is forgotten at the limit."""
    out, stack = [], []
    for c in text:
        popped = False
        if stack:
            stack[-1][1] += 1
            if c == _PAIRS[stack[-1][0]] or stack[-1][1] >= limit:
                stack.pop()
                popped = True
        if c in _PAIRS and not (popped and c == '"'):
            stack.append([c, 0])
        out.append(256 * ord(stack[-1][0]) + min(stack[-1][1], 255) if stack else 0)
    return out


class Ppm:
    """Prediction by partial matching, method C with exclusions: escape counts are the number of symbols seen in a context."""

    def __init__(self, order: int = 3, alphabet: int = 256):
        self.order, self.alphabet = order, alphabet
        self.seen: dict = defaultdict(lambda: defaultdict(int))

    def step(self, before: bytes, symbol: int) -> float:
        """The probability of the symbol, then the update."""
        p, excluded, done = 1.0, set(), False
        for k in range(min(self.order, len(before)), -1, -1):
            ctx = before[len(before) - k :]
            counts = self.seen.get(ctx)
            if not done and counts:
                live = {s: n for s, n in counts.items() if s not in excluded}
                total = sum(live.values()) + len(live)
                if symbol in live:
                    p *= live[symbol] / total
                    done = True
                elif live:
                    p *= len(live) / total
                    excluded |= set(live)
        if not done:
            p *= 1 / (self.alphabet - len(excluded))
        for k in range(min(self.order, len(before)) + 1):
            self.seen[before[len(before) - k :]][symbol] += 1
        return p


def ppm_bits(data: bytes, order: int = 3) -> float:
    """Cost of a document in bits, its own past being all the model knows."""
    model = Ppm(order)
    return -sum(math.log2(model.step(data[max(0, i - order) : i], s)) for i, s in enumerate(data))


class Mixer:
    """Online logistic mixing: p = sigma(w . stretch(inputs)), w moves against the error."""

    def __init__(self, n: int, rate: float = 0.02):
        self.w, self.rate = [1.0 / n] * n, rate

    def step(self, inputs: list[float], bit: int) -> float:
        x = [math.log(p / (1 - p)) for p in (min(max(q, 1e-4), 1 - 1e-4) for q in inputs)]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(self.w, x))))
        self.w = [a + self.rate * (bit - p) * b for a, b in zip(self.w, x)]
        return min(max(p, 1e-6), 1 - 1e-6)


def mixed_bits(data: bytes) -> float:
    """Cost in bits of a document by two bitwise count predictors (orders 0 and 1), mixed."""
    counts: dict = defaultdict(lambda: [0.4, 0.4])
    mixer, total, before = Mixer(2), 0.0, 0
    for b in data:
        node = 1
        for k in range(7, -1, -1):
            bit = b >> k & 1
            own = [counts[(0, node)], counts[(1, before, node)]]
            p = mixer.step([c[1] / (c[0] + c[1]) for c in own], bit)
            total -= math.log2(p if bit else 1 - p)
            for c in own:
                c[bit] += 1
            node = 2 * node + bit
        before = b
    return total


def mixed_from(data: bytes, start: int, zero: list[int], one: dict[int, list[int]], weights: list[float]) -> float:
    """What :func:`mixed_bits` adds from a place on; counts (without the 0.4) are at 2 * node + bit, of order 1 by the byte before."""
    w0, w1 = weights
    log, log2, exp, most, total = math.log, math.log2, math.exp, math.log((1 - 1e-4) / 1e-4), 0.0
    for i in range(start, len(data)):
        own, b, node = one[data[i - 1] if i else 0], data[i] | 256, 1
        for k in range(7, -1, -1):
            bit = b >> k & 1
            x = min(max(log((zero[2 * node + 1] + 0.4) / (zero[2 * node] + 0.4)), -most), most)
            y = min(max(log((own[2 * node + 1] + 0.4) / (own[2 * node] + 0.4)), -most), most)
            p = 1 / (1 + exp(-(w0 * x + w1 * y)))
            step = 0.02 * (bit - p)
            w0, w1 = w0 + step * x, w1 + step * y
            p = min(max(p, 1e-6), 1 - 1e-6)
            total -= log2(p if bit else 1 - p)
            zero[2 * node + bit] += 1
            own[2 * node + bit] += 1
            node = 2 * node + bit
    return total


def encode_from(data: bytes, model: list[int], low: int, high: int, out: bytearray) -> bytes:
    """The rest of a code: ``model`` has the counts of a node's bits at 2 * node + bit."""
    for b in data:
        node = 1
        for k in range(7, -1, -1):
            bit, one = b >> k & 1, model[2 * node + 1]
            mid = low + (high - low) * max(1, min(65535, 65536 * one // (model[2 * node] + one))) // 65536
            low, high = (low, mid) if bit else (mid + 1, high)
            node = 2 * node + bit
            model[node] += 1
            while (low ^ high) >> 24 == 0:
                out.append(high >> 24)
                low, high = low << 8 & 0xFFFFFFFF, high << 8 & 0xFFFFFFFF | 255
    return bytes(out + (low + (high - low) // 2).to_bytes(4, "big"))


def range_encode(data: bytes) -> bytes:
    """A 32-bit binary range coder over an order-0 bit model; the length goes before as a varint."""
    return varint(len(data)) + encode_from(data, [1] * 512, 0, 0xFFFFFFFF, bytearray())


def decode_from(n: int, code: bytes, at: int, model: list[int], low: int, high: int, x: int) -> bytes:
    """The next ``n`` bytes of a code read up to ``at``; ``model`` as in :func:`encode_from`."""
    out = bytearray()
    for _ in range(n):
        node = 1
        while node < 256:
            one = model[2 * node + 1]
            mid = low + (high - low) * max(1, min(65535, 65536 * one // (model[2 * node] + one))) // 65536
            bit = int(x <= mid)
            low, high = (low, mid) if bit else (mid + 1, high)
            node = 2 * node + bit
            model[node] += 1
            while (low ^ high) >> 24 == 0:
                low, high = low << 8 & 0xFFFFFFFF, high << 8 & 0xFFFFFFFF | 255
                x, at = x << 8 & 0xFFFFFFFF | (code[at] if at < len(code) else 0), at + 1
        out.append(node - 256)
    return bytes(out)


def range_decode(code: bytes) -> bytes:
    at = next(i for i, b in enumerate(code) if b < 128) + 1
    return decode_from(unvarint(code[:at]), code, at + 4, [1] * 512, 0, 0xFFFFFFFF, int.from_bytes(code[at : at + 4].ljust(4, b"\0"), "big"))


_VOWELS = "aeiouy"


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    return sum(1 for a, b in zip(kinds, kinds[1:]) if a == "v" and b == "c")


#: Suffixes of the published English algorithm (step: suffix -> replacement), longest first in use.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowel(stem: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i) for i, c in enumerate(stem))


def _cvc(w: str) -> bool:
    return len(w) > 2 and w[-1] not in "aeiouwxy" and w[-2] in _VOWELS and w[-3] not in "aeiou"


def stem_english(w: str) -> str:
    """Porter's published algorithm."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and _vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for step in (_STEP2, _STEP3):
        for s in sorted(step, key=len, reverse=True):
            if w.endswith(s):
                w = w[: -len(s)] + step[s] if _measure(w[: -len(s)]) > 0 else w
                break
    for s in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(s):
            root = w[: -len(s)]
            if _measure(root) > 1 and (s != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or (m == 1 and not _cvc(w[:-1])) else w
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def _region(w: str, vowels: str) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    return next((i + 1 for i in range(1, len(w)) if w[i] not in vowels and w[i - 1] in vowels), len(w))


def stem_german(w: str) -> str:
    """The published German algorithm: umlauts folded, inflections and derivations cut in their regions."""
    vowels = "aeiouyäöü"
    w = w.replace("ß", "ss")
    r1 = max(3, _region(w, vowels))
    r2 = _region(w[r1:], vowels) + r1 if r1 < len(w) else len(w)
    for s in ("ern", "em", "er", "en", "es", "e", "s"):
        if w.endswith(s) and len(w) - len(s) >= r1 and (s != "s" or w[-2] in "bdfghklmnrt"):
            w = w[: -len(s)]
            w = w[:-1] if s in ("en", "es", "e") and w.endswith("niss") else w
            break
    for s in ("est", "en", "er", "st"):
        if w.endswith(s) and len(w) - len(s) >= r1 and (s != "st" or (len(w) > 5 and w[-3] in "bdfghklmnt")):
            w = w[: -len(s)]
            break
    for s in ("heit", "keit", "lich", "isch", "end", "ung", "ig", "ik"):
        if w.endswith(s) and len(w) - len(s) >= r2:
            w = w[: -len(s)]
            break
    return w.translate(str.maketrans("äöü", "aou"))


def stem_french(w: str) -> str:
    """A light version of the published French algorithm: plural, verb and derivation endings in their regions."""
    vowels = "aeiouyâàëéêèïîôûù"
    r1 = _region(w, vowels)
    r2 = _region(w[r1:], vowels) + r1 if r1 < len(w) else len(w)
    for s in ("issements", "issement", "atrices", "ateurs", "ations", "logies", "ements", "atrice", "ateur", "ation", "logie", "ement", "ances", "iques", "ismes", "ables", "istes", "ance", "ique", "isme", "able", "iste", "ité", "ités", "if", "ive", "eux", "euse"):
        if w.endswith(s) and len(w) - len(s) >= r2:
            return w[: -len(s)]
    for s in ("eraient", "eront", "erait", "aient", "erez", "eras", "erai", "era", "ées", "ant", "ait", "ais", "ées", "ée", "és", "er", "ez", "é", "es", "e", "s"):
        if w.endswith(s) and len(w) - len(s) >= max(3, r1 if len(s) > 1 else 3):
            return w[: -len(s)]
    return w
