"""The approximate vector index: recall against all distances, lists by cell, pruning."""

import re
import tracemalloc

import numpy as np

from granary.operators import ivfpq as Q
from granary.operators import vectors as V
from granary.plans import registry

ROWS = "vec_id long, embedding array<float>"


def exact(ids, x, queries, k):
    gaps = ((x[None] - queries[:, None]) ** 2).sum(2)
    return [set(ids[np.lexsort((ids, g))[:k]].tolist()) for g in gaps]


def test_recall_on_the_given_vectors(spark, data):
    got = {}
    for r in registry.queries()["knn_ivfpq"](spark, data).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.distance)
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32).astype(float)
    asked = np.flatnonzero(ids % 50 == 0)
    true = exact(ids, x, x[asked], 10)
    assert set(got) == set(ids[asked].tolist()) and all(sorted(p for p, _ in own.values()) == list(range(1, 11)) for own in got.values())
    assert sum(len(t & set(got[ids[a]])) for t, a in zip(true, asked)) >= 0.9 * 10 * len(asked)
    for a in asked:
        for i, (_, d) in got[ids[a]].items():
            assert abs(d - ((x[a] - x[ids == i][0]) ** 2).sum()) < 1e-4


def test_clusters_prune_cells_and_keep_recall(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 64)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 12)) * 4
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 12))
    x[1000:2000] = x[0]  # a third of all rows in one cell
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    store = spark.createDataFrame([*rows, (None, rows[0][1]), (9999, None)], ROWS)
    books = Q.fit(store)
    assert books.probes < len(books.centres) / 2
    Q.write(store, books, str(tmp_path / "lists"))
    lists = spark.read.parquet(str(tmp_path / "lists")).collect()
    held = np.concatenate([np.frombuffer(r.ids, "<i8") for r in lists])
    assert sorted(held.tolist()) == list(range(3000)) and max(len(r.ids) // 8 for r in lists) <= 64
    queries = spark.createDataFrame([(k, x[k * 31].tolist()) for k in range(40) if not 1000 <= k * 31 < 2000] + [(77, None)], "query_id long, embedding array<float>")
    found = Q.search(store, books, str(tmp_path / "lists"), queries, 5, 10)
    assert re.search(r"PartitionFilters: \[[^\]]*cell", found._jdf.queryExecution().toString())
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    single = x.astype(np.float32).astype(float)
    true = exact(np.arange(3000), single, single[[q * 31 for q in got]], 5)
    assert 77 not in got and sum(len(t & got[q]) for t, q in zip(true, got)) >= 0.9 * 5 * len(got)


def test_empty_and_small_stores(spark, tmp_path):
    assert Q.fit(spark.createDataFrame([], ROWS)) is None
    store = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0])], ROWS)
    books = Q.fit(store)
    Q.write(store, books, str(tmp_path / "l"))
    got = Q.search(store, books, str(tmp_path / "l"), spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, embedding array<float>"), 5).collect()
    assert [(r.vec_id, r.distance, r["rank"]) for r in got] == [(1, 1.0, 1), (3, 1.0, 2)]


def test_exact_search_leaves_out_null_ids(spark):
    store = spark.createDataFrame([(None, [1.0]), (2, [2.0]), (3, None)], ROWS)
    queries = spark.createDataFrame([(1, [1.0]), (None, [0.0])], "query_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.distance) for r in V.nearest_for_each(store, queries, 2).collect()] == [(1, 2, 1.0)]


def test_few_distances_from_centres_are_in_memory_at_once():
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(20_000, 4)), rng.normal(size=(500, 4))
    tracemalloc.start()
    near, far = Q.nearest(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    some = ((x[:50, None] - centres) ** 2).sum(2)
    assert (near[:50] == some.argmin(1)).all() and np.allclose(far[:50], some.min(1)) and peak < 40 << 20


def test_shares_parts_and_turns_find_the_same_rows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 8))
    x[:600] = x[0] + rng.normal(size=(600, 8)) * 1e-3  # a cell with many rows
    store = spark.createDataFrame(list(enumerate(x.tolist())), ROWS)
    books = Q.fit(store)
    monkeypatch.setattr(Q, "BLOCK", 32)
    Q.write(store, books, str(tmp_path / "lists"))
    queries = store.filter("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id")
    run = lambda asked: Q.search(store, books, str(tmp_path / "lists"), asked, 5, 10)
    rows = lambda found: sorted((r.query_id, r.vec_id, r["rank"]) for r in found.collect())
    once = rows(run(queries))
    for name, value in (("SHARE", 9), ("PARTS", 3), ("PART", 500), ("MOST", 100)):
        monkeypatch.setattr(Q, name, value)
    split = run(queries)
    assert len(once) == 250 and rows(split) == once
    assert str(split._jdf.queryExecution().optimizedPlan()).count("WindowGroupLimit") <= 1  # coded rows are not sorted
    assert rows(run(queries.filter("query_id < 0"))) == []
