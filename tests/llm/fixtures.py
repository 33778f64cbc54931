"""Small corpora and brute-force versions that the operators are held against."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def invented(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}q" for _ in range(n))


def corpus(seed=1, n=40):
    """Documents with exact and near copies, shared passages, repeated rows, empty, NULL and one long text."""
    rng = random.Random(seed)
    passage = invented(rng, 60, 10_000)
    out = []
    for i in range(n):
        out.append((i, invented(rng, rng.randrange(5, 160), 3000), "en", f"src{i % 3}"))
    out.append((100, out[3][1], "en", "src0"))
    out.append((101, out[3][1].upper() + "!", "en", "src1"))
    for j in range(4):
        w = out[5][1].split() + invented(rng, 60, 3000).split()
        if j:
            w = base[:]
            w[j * 7] = "changed"
        else:
            base = w
        out.append((110 + j, " ".join(w), "en", "src0"))
    for j in range(3):
        out.append((120 + j, f"{invented(rng, 30, 3000)}. {passage}. {invented(rng, 20 + j, 3000)}", "en", "src2"))
    out.append((130, "the same line again\n" * 40, "en", "src0"))
    out.append((131, invented(rng, 5000, 3000), "en", "src1"))
    out.append((132, "", "en", "src0"))
    out.append((133, None, None, None))
    out.append((134, "...!? \n", "en", "src1"))
    out.append((None, out[7][1], "en", "src1"))
    out.append((None, "a text without an id " * 20, "en", "src1"))
    out.append(out[8])
    return [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d in out]


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(t, k=3):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_groups(texts, threshold=0.5, k=3):
    """Component of each index of texts, by all pairs."""
    sets = [shingle_set(t, k) for t in texts]
    edges = []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(sets[i] & sets[j])
            if both and (both >= threshold * len(sets[i] | sets[j]) or words(texts[i]) == words(texts[j])):
                edges.append((i, j))
    return components(edges, range(len(texts)))


def repeated_words(docs, window):
    """For documents in order: which words lie in a window that occurred before."""
    seen, out = set(), []
    for t in docs:
        w = words(t)
        bad = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                bad[i : i + window] = [True] * window
            seen.add(key)
        out.append(bad)
    return out
