"""Hard negatives against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import hard_negatives as H
from granary.llm.common import stored

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, every=50, positives=5, negatives=3):
    known = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(float(np.float32(x))) * 256 >= H.LARGEST for x in v):
            continue
        known.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a in known:
        if a[0] % every:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))  # noqa: B023, E731
        alike = [r for r in known if len(r[2]) == len(a[2]) and r != a]
        best = sorted((-score(r), r[0]) for r in alike if r[1] == a[1])[:positives]
        others = sorted((-score(r), r[0]) for r in alike if r[1] != a[1])
        for p, i in best:
            fit = [(s, j) for s, j in others if 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(a[0], i, k + 1, j, -p, -s) for k, (s, j) in enumerate(fit)]
    return sorted(out)


def got(spark, rows):
    made = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("v", "h", "cell", "size", "anchor", "low", "place")}).repartition(6)
    found = H.whole_numbers(made).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in H.mine(found).collect())


def vectors(kind, n, size, rng):
    if kind == "random":
        return rng.normal(size=(n, size))
    centres = rng.normal(size=(12, size))
    return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, size)) * (0 if kind == "copies" else 0.1)


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_against_all_products(spark, kind, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 300)
    rng = np.random.default_rng(4)
    x = vectors(kind, 1500, 8, rng).tolist()
    rows = [(k, v, int(rng.integers(0, 4))) for k, v in enumerate(x)]
    assert got(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rng = random.Random(2)
    v = lambda n=4: [rng.uniform(-2, 2) for _ in range(n)]
    rows = [(50 * k, v(), k % 2) for k in range(12)] + [(50 * k + 1, v(3), k % 2) for k in range(12)] + [(50 * k, v(3), 1) for k in range(6)]
    rows += [(None, v(), 1), (7, None, 1), (8, v(), None), (9, [1.0, None, 0.0, 2.0], 1), (10, [math.nan] * 4, 1), (11, [math.inf] * 4, 1), (12, [], 1), (150, [], 1), (13, [], 0), (14, [1e30] * 4, 1), (15, [5e5] * 4, 1), (16, [5e5] * 4, 0), (-50, v(), 1), (-49, [0.0] * 4, 0)]
    rows += rows[:5] + [(k, rows[0][1], k % 3) for k in range(300, 340)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == [] and got(spark, [(50, v(), 1)]) == []


def test_given_table(spark, data):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    found = H.query(spark, data)
    assert sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == plain(rows)


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(1)
    points = np.floor(256 * vectors("clusters", 4000, 6, rng)).astype("<i4")
    tree = H.Tree.build(np.arange(4000), np.zeros(4000, np.int64), points)
    x = points.astype(float)
    x = np.column_stack([x, np.sqrt((x**2).sum(1).max() - (x**2).sum(1))])
    below, nodes = {}, len(tree.radii)
    for k in reversed(range(nodes)):
        span = slice(tree.starts[k], tree.starts[k + 1])
        own = {int(tree.centres[k])} | {int(p) for p in tree.child_points[span]}
        for n in tree.child_nodes[span]:
            own |= below[int(n)] if n >= 0 else set()
        below[k] = own
        assert np.sqrt(((x[sorted(own)] - x[tree.centres[k]]) ** 2).sum(1)).max() <= tree.radii[k] + 1e-3
    assert below[0] == set(range(4000)) and nodes > 20
    seen = []
    wanted = H.Wanted(np.array([-1]), np.array([0]), points[:1], np.full((1, 1), H._NEVER), np.full((1, 1), -H._NEVER), 3, True)
    offer = wanted.offer
    wanted.offer = lambda who, tree, points, score: (seen.extend(points), offer(who, tree, points, score))
    tree.descend(wanted)
    assert sorted(-s for s, _ in wanted.found[0][0]) == sorted((points @ points[0].astype(np.int64)).tolist())[-3:]
    assert len(seen) == len(set(map(int, seen))) < 2500


def test_packs_go_to_no_broadcast(spark, monkeypatch):
    """Packs grow with the input: they must not be collected by the driver, least of all one copy for each partition."""
    monkeypatch.setattr(H, "PACK", 3)
    monkeypatch.setattr(H, "GROUP", 2, raising=False)
    rng = np.random.default_rng(7)
    rows = [(k, v, int(rng.integers(0, 3))) for k, v in enumerate(vectors("random", 1100, 8, rng).tolist())]
    found = stored(H.index(H.whole_numbers(spark.createDataFrame(rows, ROWS)), 50, 5, 6), "trees")
    anchors = stored(H._anchors(found), "anchors").withColumns({"low": F.array("low"), "high": F.array(F.lit(-H._NEVER))})
    met = H._met(anchors, found, 1, 5, True)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange ") == 1
    assert met.rdd.getNumPartitions() >= 4 and met.select("anchor").distinct().count() == 22
    assert got(spark, rows) == plain(rows)
