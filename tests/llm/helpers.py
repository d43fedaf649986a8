"""Plain versions of operators, and made-up texts, for several tests."""

import re
from collections import Counter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, base=200):
    return " ".join(f"w{rng.randrange(base)}" for _ in range(n))


def plain_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_dedup(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[p : p + length] for t in raw for p in range(len(t) - length + 1))
    out = []
    for t in raw:
        cover = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(t, cover) if not c)
        out.append((len(t), sum(cover), len(re.findall(b"\1+", bytes(cover))), kept))
    return out


def plain_passages(texts, n):
    """(passages, what is left) of each text: runs of words that n words cover which also start elsewhere."""
    found = [list(re.finditer("[\u3000-\u9fff]|[^ \t\n\x0b\x0c\r\u3000-\u9fff]+", t or "")) for t in texts]
    said = [[m.group().encode().lower() for m in own] for own in found]
    count = Counter(tuple(w[p : p + n]) for w in said for p in range(len(w) - n + 1))
    out = []
    for t, own, w in zip(texts, found, said):
        cover = bytearray(len(w))
        for p in range(len(w) - n + 1):
            if count[tuple(w[p : p + n])] > 1:
                cover[p : p + n] = b"\1" * n
        cuts = [(own[m.start()].start(), own[m.end() - 1].end()) for m in re.finditer(b"\1+", bytes(cover))]
        edges = [0, *(x for c in cuts for x in c), len(t or "")]
        out.append((len(cuts), "".join((t or "")[a:b] for a, b in zip(edges[::2], edges[1::2]))))
    return out


def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best / (2 * len(a))
