"""Queries of vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import ivfpq as Q
from granary.operators import vectors as V
from granary.sources.tables import shared_folder, table


def _query(store: DataFrame, vec_id: int) -> list[float]:
    return store.filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    v = V.checked(V.hash_embedding(F.col("text"), 768), 768)
    docs = table(spark, sf, "documents").select("doc_id", v.alias("v"))
    return docs.select("doc_id", F.size("v").alias("size"), *(F.element_at("v", k).alias(f"v{k}") for k in (1, 2, 32, 33, 768)))


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    store = table(spark, sf, "embeddings")
    return V.nearest(store, _query(store, 0), 10).select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    store = table(spark, sf, "embeddings")
    return V.nearest(store, _query(store, 1), 10, F.col("label").isin(1, 2, 3), "cosine").select("vec_id", F.round("distance", 6).alias("distance"))


def knn_per_query(spark: SparkSession, sf: str) -> DataFrame:
    """All rows whose id is divisible by 50, against all rows."""
    store = table(spark, sf, "embeddings")
    queries = store.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.nearest_for_each(store, queries, 5).select("query_id", "vec_id", F.round("distance", 5).alias("distance"))


def knn_ivfpq(spark: SparkSession, sf: str) -> DataFrame:
    """The queries of knn_per_query by the approximate index, which is built over all rows: about the 10 nearest of each."""
    store = table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries = store.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    books = Q.fit(store)
    if books is None:
        return V.nearest_for_each(store, queries, 10).select("query_id", "vec_id", "distance", "rank")
    path = f"{shared_folder(spark)}/ivfpq-{uuid.uuid4().hex}"
    Q.write(store, books, path)
    return Q.search(store, books, path, queries).select("query_id", "vec_id", F.round("distance", 5).alias("distance"), "rank")


def vector_means(spark: SparkSession, sf: str) -> DataFrame:
    return V.mean_vectors(table(spark, sf, "embeddings"), "label").select("label", "position", F.round("mean", 6).alias("mean"))


_L2 = "list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

QUERIES = {
    "hash_embed": (
        hash_embed,
        "WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT doc_id, 768 AS size, "
        + ", ".join(f"(CAST('0x' || substr(h, {(k - 1) % 32 * 2 + 1}, 2) AS INTEGER) - 128) / 128.0::DOUBLE AS v{k}" for k in (1, 2, 32, 33, 768))
        + " FROM h",
    ),
    "knn_topk": (knn_topk, f"SELECT b.vec_id, round({_L2}, 6) AS distance, round(1 - {_L2}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {_L2}, b.vec_id LIMIT 10"),
    "knn_filtered": (
        knn_filtered,
        """SELECT b.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a, embeddings b
        WHERE a.vec_id = 1 AND b.label IN (1, 2, 3) ORDER BY 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id LIMIT 10""",
    ),
    "knn_per_query": (
        knn_per_query,
        f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, {_L2} AS d FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS k FROM d) SELECT query_id, vec_id, round(d, 5) AS distance FROM r WHERE k <= 5""",
    ),
    "knn_ivfpq": (knn_ivfpq, None),
    "vector_means": (vector_means, "SELECT label, CAST(p - 1 AS INTEGER) AS position, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY ALL"),
}
