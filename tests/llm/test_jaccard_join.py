"""The n-gram Jaccard join against all pairs."""

import random

import pytest

from granary.llm import components, jaccard_join
from tests.llm.helpers import words, plain_components


def near_copies(rng, n=60):
    """Families of near copies, one large, with passages that several share."""
    passage = words(rng, 60)
    base = [words(rng, rng.randrange(5, 300), 3000) for _ in range(8)]
    rows = []
    for k in range(n):
        w = base[0 if k % 2 else rng.randrange(len(base))].split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(w) + (" " + passage if k % 5 == 0 else "")))
    return rows


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (3, 50)])
def test_jaccard_join_finds_all_links(spark, n, percent):
    rows = near_copies(random.Random(n))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.components(docs, n, percent).collect()}
    assert got == plain_components(rows, n, percent)


def test_jaccard_join_awkward(awkward_docs, awkward):
    out = jaccard_join.components(awkward_docs, 3, 90).collect()
    assert len(out) == len(awkward)
    expected = plain_components([(r[0], r[1]) for r in awkward if r[0] is not None], 3, 90)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == expected
    assert all(r.component_id is None for r in out if r.doc_id is None)
    assert all((r.n_shingles == 0) == (r.doc_id in (0, 1, 2)) for r in out if r.doc_id is not None)


@pytest.mark.parametrize("size", [10, 60, 400, 1000])
def test_prefixes_share_enough(size):
    """Sets just similar enough share as many prefix shingles as is asked for, in any order."""
    rng = random.Random(size)
    for percent in (80, 90):
        keep = -(-size * percent // 100)
        a = set(range(size))
        b = set(rng.sample(sorted(a), keep))
        for _ in range(20):
            order = {x: rng.random() for x in a}
            pa_, pb = (sorted(s, key=order.get)[: jaccard_join.prefix_size(len(s), percent)] for s in (a, b))
            least = 1 + (len(b) - (percent * len(b) + 99) // 100 + 1) // 4
            assert len(set(pa_) & set(pb)) >= min(least, len(b))


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40, 70)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(18)] + [(5, 5)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
