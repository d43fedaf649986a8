"""Vectors: hash embedding, dimension checks, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block that is compared at once.
BLOCK = 1024


def hash_embedding(text: Column, dimensions: int) -> Column:
    """Each value is a byte of the text's SHA-256, over and over, scaled to [-1, 1)."""
    value = lambda digest, i: (F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128
    bytes_of = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: value(digest, i))
    once = F.element_at(F.transform(F.array(F.sha2(text, 256)), bytes_of), 1)  # the digest is made once for each text
    return F.slice(F.flatten(F.array_repeat(once, -(-dimensions // 32))), 1, dimensions)


def checked(vector: Column, dimensions: int) -> Column:
    """The vector; one of another size fails the query."""
    return F.when(F.assert_true(F.size(vector) == dimensions, F.lit(f"vector must have {dimensions} dimensions")).isNull(), vector)


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    if metric == "l2sq":
        return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    raise ValueError(f"unknown metric {metric!r}")


def nearest(store: DataFrame, query: list[float], k: int, where: Column | None = None, metric: str = "l2sq") -> DataFrame:
    """The k nearest (vec_id, distance, score) to one vector, among rows where the filter holds; ties by vec_id."""
    rows = store if where is None else store.filter(where)
    d = distance(F.col("embedding"), F.array(*map(F.lit, query)), metric)
    found = rows.select("vec_id", d.alias("distance")).orderBy("distance", "vec_id").limit(k)
    return found.withColumn("score", 1 - F.col("distance"))


def packed(rows: DataFrame, key: str) -> DataFrame:
    """(ids, vectors) in blocks of up to BLOCK rows (key, embedding), as bytes of 64-bit numbers. Rows
    with a null key or vector go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                some = batch.slice(lo, BLOCK)
                vectors = some.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([some.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["ids", "vectors"])

    return rows.filter(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long"), "embedding").mapInArrow(run, "ids binary, vectors binary")


def nearest_for_each(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance) of the k nearest by squared distance for each query (query_id, embedding).

    All rows are compared, exactly: each block of the store meets each block of queries in one matrix product, which
    leaves few pairs to be measured anew and ranked. A window takes the best of all blocks. Both tables must hold vectors
    of one size; null ones, and rows without an id, are left out.
    """
    pairs = packed(store, "vec_id").crossJoin(packed(queries, "query_id").withColumnsRenamed({"ids": "query_ids", "vectors": "query_vectors"}))  # of blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("ids", "vectors", "query_ids", "query_vectors"))):
                ids, vectors, names, wanted = (np.frombuffer(x.as_py(), t) for x, t in zip(row, ("<i8", "<f8", "<i8", "<f8")))
                vectors, wanted = vectors.reshape(len(ids), -1), wanted.reshape(len(names), -1)
                about = (wanted**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1) - 2 * (wanted @ vectors.T)
                last = np.partition(about, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                q, v = np.nonzero(about <= (last + 1e-9 * (1 + np.abs(last)))[:, None])
                d = ((wanted[q] - vectors[v]) ** 2).sum(axis=1)
                order = np.lexsort((ids[v], d, q))
                q, v, d = q[order], v[order], d[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.RecordBatch.from_arrays([pa.array(names[q[best]]), pa.array(ids[v[best]]), pa.array(d[best])], names=["query_id", "vec_id", "distance"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def model_embedding(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], dimensions: int) -> DataFrame:
    """(doc_id, vector) by a model, in Arrow batches. load runs once in each Python worker; blank and null texts get zeros
    without asking the model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            said = [t if isinstance(t, str) and t.strip() else None for t in frame["text"]]
            made = iter(model([t for t in said if t is not None]))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "vector": [[0.0] * dimensions if t is None else list(next(made)) for t in said]})

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id long, vector array<float>")


def mean_vectors(store: DataFrame, group: str) -> DataFrame:
    """(group, position, mean) by component."""
    return store.select(group, F.posexplode("embedding").alias("position", "x")).groupBy(group, "position").agg(F.avg("x").alias("mean"))
