"""Brute-force helpers of the tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = WORD.findall(fold(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_copies(seed, families=6, members=12, words=60):
    """Texts in families with growing numbers of edits, and texts on their own."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(6, words))]
        for m in range(members):
            t = list(base)
            for _ in range(rng.randint(0, 1 + m // 3)):
                at = rng.randrange(len(t))
                if rng.random() < 0.4 and len(t) > 6:
                    del t[at]
                else:
                    t[at] = rng.choice(vocab)
            out.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in t))
    return out


def components(ids, sets, num, den):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = {}
    for i in ids:
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    for i in ids:
        if not sets[i]:
            continue
        hits = {}
        for s in sets[i]:
            for j in index[s]:
                if j < i:
                    hits[j] = hits.get(j, 0) + 1
        for j, both in hits.items():
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
