"""Queries of ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import keyword_index as I
from granary.operators import search as S
from granary.sources.tables import cut_lineage, shared_folder, table

TERMS, NEAR = ("thing", "erth", "quele"), ("inor", "eneux")
NOW = "2024-02-01 00:00:00"


def _counts(spark: SparkSession, sf: str, terms: tuple[str, ...]) -> DataFrame:
    docs = table(spark, sf, "documents")
    return cut_lineage(S.counted(docs, T.code_words(F.col("text")), terms))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    scored = S.bm25(_counts(spark, sf, TERMS), [f"t{k}" for k in range(len(TERMS))])
    return S.top(scored.withColumn("score", F.round("score", 6)), 20)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Two queries on one count of both queries' terms."""
    counts = _counts(spark, sf, (*TERMS, *NEAR))
    columns = [f"t{k}" for k in range(len(TERMS) + len(NEAR))]
    lists = [S.ranks(S.bm25(counts, c).withColumn("score", F.round("score", 6)), n, 50) for n, c in (("a", columns[: len(TERMS)]), ("b", columns[len(TERMS) :]))]
    return S.fuse(lists[0].unionByName(lists[1])).select("doc_id", F.round("score", 8).alias("score"), "lists")


def _index(spark: SparkSession, sf: str) -> I.Index:
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("corpus"), "text")
    return I.build(docs, T.code_words(F.col("text")), f"{shared_folder(spark)}/keywords-{uuid.uuid4().hex}")


def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark item as a query for all its words, in one job on one index; those of odd ids among English texts only."""
    items = table(spark, sf, "benchmark").select("item_id", F.explode(T.code_words(F.col("text"))).alias("term"))
    queries = items.select(F.col("item_id").alias("query_id"), "term", F.when(F.col("item_id") % 2 == 1, "en").alias("corpus"))
    return I.search(_index(spark, sf), queries, 10).select("query_id", "doc_id", "score", "rank")


def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    """In how many documents each word of the index is, and its share."""
    index = _index(spark, sf)
    return index.terms(spark).select("term", "df", F.round(F.col("df") / index.n, 6).alias("share"))


def rerank_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.col("value").alias("score"))
    return S.best_of_duplicates(rows, "user_id")


def term_boost(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "text", (F.col("n_chars") / 1000).alias("score"))
    return S.boost_terms(rows, TERMS).select("doc_id", F.round("score", 6).alias("score"))


def freshness_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Views are conversations here; every ninth event has no time."""
    rows = table(spark, sf, "events").filter("value is not null").withColumn("ts", F.when(F.col("event_id") % 9 != 0, F.col("ts")))
    corpus = F.when(F.col("event_type") == "view", "CONVO_SLACK").otherwise("DOC_DESIGN")
    return rows.select("event_id", F.round(S.fresh(F.col("value"), F.col("ts"), F.lit(NOW).cast("timestamp"), 0.3, 7.0, corpus), 6).alias("score"))


def hybrid_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 100).alias("score"))
    return S.merge_graph(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 3 = 0")).select("doc_id", F.round("score", 6).alias("score"), "source")


def corpus_boost(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("corpus"), (F.col("n_chars") / 100).alias("score"))
    return S.boost_corpus(rows, "Where is the German page", (("german", "de", 1.5), ("french", "fr", 1.5), ("page", "en", 1.1))).select("doc_id", F.round("score", 6).alias("score"))


def _bm25(terms: tuple[str, ...]) -> str:
    tf = ", ".join(f"len(list_filter(l, lambda x: x = '{t}')) AS t{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (t{k} > 0) AS d{k}" for k in range(len(terms)))
    part = " + ".join(f"CASE WHEN t{k} > 0 THEN ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5)) * t{k} * 2.5 / (t{k} + 1.5 * (0.25 + 0.75 * len / mean)) ELSE 0 END" for k in range(len(terms)))
    stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    return rf"""(WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({stop})) AS l FROM documents),
    c AS (SELECT doc_id, len(l) AS len, {tf} FROM w), s AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM c)
    SELECT doc_id, round({part}, 6) AS score FROM c, s WHERE {part} > 0)"""


def _words(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace(coalesce({text}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({stop}))"


QUERIES = {
    "bm25_topk": (bm25_topk, f"SELECT doc_id, score FROM {_bm25(TERMS)} ORDER BY score DESC, doc_id LIMIT 20"),
    "bm25_index": (
        bm25_index,
        rf"""WITH w AS (SELECT doc_id, lang, {_words("text")} AS l FROM documents), s AS (SELECT count(*) AS n, avg(len(l)) AS mean FROM w),
        p AS (SELECT doc_id, lang, len(l) AS len, unnest(l) AS term FROM w), t AS (SELECT doc_id, lang, len, term, count(*) AS tf FROM p GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
        q AS (SELECT DISTINCT item_id AS query_id, unnest({_words("text")}) AS term FROM benchmark),
        c AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN d USING (term) JOIN t USING (term), s WHERE query_id % 2 = 0 OR lang = 'en' GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
    ),
    "bm25_terms": (
        bm25_terms,
        rf"""WITH w AS (SELECT doc_id, {_words("text")} AS l FROM documents), t AS (SELECT DISTINCT doc_id, unnest(l) AS term FROM w)
        SELECT term, count(*) AS df, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS share FROM t GROUP BY 1""",
    ),
    "rrf_fusion": (
        rrf_fusion,
        f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM {_bm25(TERMS)}), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM {_bm25(NEAR)}),
        u AS (SELECT * FROM a WHERE r < 50 UNION ALL SELECT * FROM b WHERE r < 50) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r + 1)), 8) AS score, count(*) AS lists FROM u GROUP BY 1""",
    ),
    "rerank_dedupe": (rerank_dedupe, "SELECT user_id, max(value) AS score FROM events GROUP BY 1"),
    "term_boost": (term_boost, "SELECT doc_id, round(n_chars / 1000.0::DOUBLE * CASE WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in TERMS) + " THEN 1.2::DOUBLE ELSE 1 END, 6) AS score FROM documents"),
    "freshness_boost": (freshness_boost, f"SELECT event_id, round(CASE WHEN event_type <> 'view' OR event_id % 9 = 0 THEN value ELSE 0.7::DOUBLE * value + 0.3::DOUBLE * exp(-0.693::DOUBLE * ((epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(ts))::BIGINT) / 86400.0::DOUBLE) / 7.0::DOUBLE) END, 6) AS score FROM events WHERE value IS NOT NULL"),
    "hybrid_merge": (
        hybrid_merge,
        "SELECT doc_id, round(n_chars / 100.0::DOUBLE * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0.9::DOUBLE END, 6) AS score, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS source FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    ),
    "corpus_boost": (corpus_boost, "SELECT doc_id, round(n_chars / 100.0::DOUBLE * CASE lang WHEN 'de' THEN 1.5::DOUBLE WHEN 'en' THEN 1.1::DOUBLE ELSE 1 END, 6) AS score FROM documents"),
}
