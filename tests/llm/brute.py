"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict


def op10(docs, window=13):
    rows = [(d if d is not None else 1 << 70, (t or "").encode()) for d, t in docs]
    least = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for (d0, _), (d, t) in zip(docs, rows):
        w = t.split()
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d0, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def op4(docs, length=200):
    seen = Counter()
    rows = [(d, (t or "").encode()) for d, t in docs]
    for _, t in rows:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for d, t in rows:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, mask) if not m)
        out.append((d, len(t), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k=5):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def op7(docs):
    sets = [(d, frozenset(shingles(t))) for d, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].add(i)
    done = set()
    for members in by.values():
        m = sorted(members)
        for i in m:
            for j in m:
                if i < j and (i, j) not in done:
                    done.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    n = len(a & b)
                    if 100 * n >= 75 * (len(a) + len(b) - n):
                        parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)]
