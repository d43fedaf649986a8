"""Keyword ranking, rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
FUSION_K = 60


def counted(documents: DataFrame, words: Column, terms: Sequence[str]) -> DataFrame:
    """(doc_id, length, t0, t1 ...) of all documents: words, and how often each term is among them.

    The words are made once for each document; all terms are counted in that one list.
    """
    wanted = list(dict.fromkeys(terms))
    made = F.transform(F.array(words), lambda ws: F.struct(F.size(ws).alias("length"), F.filter(ws, lambda w: w.isin(*wanted)).alias("hits")))
    rows = documents.select("doc_id", F.explode(made).alias("m")).select("doc_id", "m.length", "m.hits")
    times = lambda term: F.size(F.filter("hits", lambda w: w == term))
    return rows.select("doc_id", "length", *(times(t).alias(f"t{k}") for k, t in enumerate(wanted)))


def bm25(counts: DataFrame, columns: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of the documents in counts (doc_id, length, and a column of occurrences for each term) that hold
    a term. Statistics come from all documents: their number, mean length, and in how many each term occurs. They are
    one row, made with partial sums; nothing else is shuffled. counts is read twice, so it should be stored.
    """
    stats = counts.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(c) > 0).alias(f"d{k}") for k, c in enumerate(columns)))
    one = stats.select(F.struct("*").alias("s")).scalar()
    held = " or ".join(f"{c} > 0" for c in columns)
    rows = counts.filter(held).withColumn("s", one).select("*", "s.*")
    score = F.lit(0.0)
    for k, c in enumerate(columns):
        tf, df = F.col(c), F.col(f"d{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))).otherwise(0.0)
    return rows.select("doc_id", score.alias("score")).filter("score > 0")


def top(ranked: DataFrame, k: int, id_column: str = "doc_id") -> DataFrame:
    return ranked.orderBy(F.desc("score"), id_column).limit(k)


def ranks(scored: DataFrame, name: str, depth: int) -> DataFrame:
    """(list, doc_id, rank) of a list's best, from 0."""
    best = top(scored, depth)
    return best.select(F.lit(name).alias("list"), "doc_id", (F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1).alias("rank"))


def fuse(lists: DataFrame, k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of (list, doc_id, rank)."""
    return lists.groupBy("doc_id").agg(F.sum(1 / (F.lit(k) + F.col("rank") + 1)).alias("score"), F.count("*").alias("lists"))


def best_of_duplicates(results: DataFrame, key: str) -> DataFrame:
    return results.groupBy(key).agg(F.max("score").alias("score"))


def boost_terms(results: DataFrame, terms: Sequence[str], factor: float = 1.2) -> DataFrame:
    """Scores times factor where a term is in the lower-case text."""
    low = F.lower("text")
    hit = F.lit(False)
    for t in terms:
        hit = hit | low.contains(t.lower())
    return results.withColumn("score", F.col("score") * F.when(hit, factor).otherwise(1.0))


def fresh(score: Column, seen: Column, now: Column, weight: float, half_life_days: float, corpus: Column | None = None) -> Column:
    """Mixes the score with an age factor that halves each half_life_days; the score itself where the time is not known,
    or the corpus is no conversation (CONVO_...)."""
    seconds = lambda t: F.unix_timestamp(t.cast("timestamp"))
    age = (seconds(now) - seconds(seen)) / 86400
    timed = seen.isNotNull() if corpus is None else seen.isNotNull() & F.coalesce(corpus.startswith("CONVO_"), F.lit(False))
    return F.when(timed, (1 - weight) * score + weight * F.exp(-0.693 * age / half_life_days)).otherwise(score)


def merge_graph(vector: DataFrame, graph: DataFrame, factor: float = 0.9) -> DataFrame:
    """Vector results first, then graph results at factor of their score; the first of an id counts."""
    both = vector.withColumn("source", F.lit(0)).unionByName(graph.withColumn("score", F.col("score") * factor).withColumn("source", F.lit(1)))
    return both.groupBy("doc_id").agg(F.min_by(F.struct("score", "source"), F.struct("source", -F.col("score"))).alias("x")).select("doc_id", "x.score", "x.source")


def boost_corpus(results: DataFrame, query: str, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Scores times the greatest factor of the rules (keyword, corpus, factor) whose keyword is in the query."""
    factor = F.lit(1.0)
    for keyword, corpus, value in rules:
        if keyword in query.lower():
            factor = F.greatest(factor, F.when(F.col("corpus") == corpus, value).otherwise(1.0))
    return results.withColumn("score", F.col("score") * factor)


def rerank(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[float]]], k: int = 50) -> DataFrame:
    """(query_id, doc_id, score): the k best pairs (query_id, doc_id, query, text, score) of each query scored anew by a
    model. load runs once in each Python worker and gives a function of queries and texts."""
    best = pairs.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("n") <= k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            yield frame[["query_id", "doc_id"]].assign(score=model(list(frame["query"]), list(frame["text"])))

    return best.select("query_id", "doc_id", "query", "text").mapInPandas(run, "query_id long, doc_id long, score double")


def with_context(text: Column, prefix: Column) -> Column:
    """What is embedded: the context's line before the text, if there is one."""
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("\n"), text)).otherwise(text)
