"""Queries of personal data and secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import scrub as S
from granary.sources.tables import table

SALT = "granary"
TIERS = (("en", "clean"), ("de", "sensitive"), ("fr", "maybe_sensitive"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.entity_rows(_docs(spark, sf)).groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def pii_scrub_constant(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.sha2(S.scrub_constants(F.col("text")), 256).alias("clean_sha256"))


def pii_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.entity_rows(_docs(spark, sf)).filter(F.col("entity").isin("EMAIL_ADDRESS", "PHONE_NUMBER"))
    return rows.select("entity", "value", S.pseudonym(F.col("entity"), F.col("value"), SALT).alias("pseudonym")).distinct()


def pii_audit(spark: SparkSession, sf: str) -> DataFrame:
    return S.scrub(_docs(spark, sf)).select("doc_id", F.sha2("clean", 256).alias("clean_sha256"), F.size("log").alias("n"), F.to_json("log").alias("log"))


def scrub_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.entity_rows(_docs(spark, sf), keep=["lang"])
    return rows.rollup("lang", "entity").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("entity", F.lit("all")).alias("entity"), "n")


def sensitivity_gate(spark: SparkSession, sf: str) -> DataFrame:
    tiers = spark.createDataFrame(TIERS, "lang string, tier string")
    return S.gate(_docs(spark, sf), tiers, "lang").select("doc_id", F.sha2("clean", 256).alias("clean_sha256"), "tier")


def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    secrets = [(n, p, "[SECRET]", 1.0) for n, p in S.SECRETS]
    return S.entity_rows(_docs(spark, sf), secrets).select("doc_id", F.col("entity").alias("kind"), F.substring(F.sha2("value", 256), 1, 8).alias("value_hash"))


def pii_threshold(spark: SparkSession, sf: str) -> DataFrame:
    corpus = F.when(F.col("doc_id") % 2 == 0, "CONVO_SLACK").otherwise("DOC_DESIGN")
    rows = S.entity_rows(_docs(spark, sf).withColumn("corpus", corpus), keep=["corpus"])
    often = rows.groupBy("value").agg(F.countDistinct("doc_id").alias("n")).filter("n > 2").select("value")
    return S.over_threshold(rows, F.col("corpus"), often).groupBy("corpus", "entity").agg(F.count("*").alias("n"))


def custom_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts of pages as internal names, and member numbers."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("see "), F.regexp_replace("url", r"\.example\.", ".corp."), F.lit(" of ABC"), F.lpad(F.col("page_id").cast("string"), 9, "4")).alias("text"))
    return S.entity_rows(p, S.CUSTOM).groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def context_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Record numbers of patients, plan numbers of members, and plan numbers far from any such word."""
    k = F.col("o_orderkey")
    padded = F.lpad(k.cast("string"), 8, "0")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("🙂 Patient é: MRN-"), padded, F.lit(" and MRN: "), padded))
        .when(k % 3 == 1, F.concat(F.lit("ABC1"), padded, F.lit(" is the number of a member")))
        .otherwise(F.concat(F.lit("member "), F.repeat(F.lit("x "), 30), F.lit("ABC1"), padded, F.lit(" policyholder")))
    )
    docs = table(spark, sf, "orders").select(k.alias("doc_id"), text.alias("text"))
    return S.in_context(docs).select("doc_id", "entity", "value", "start", F.round("score", 6).alias("score"))


def _spans(docs: DataFrame, pattern: str) -> DataFrame:
    found = S.in_context(docs, [("x", pattern, 1.0, ())], keep=["lang"])
    return found.select("doc_id", "lang", "start", (F.col("start") + F.length("value")).alias("end"))


def span_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of two digits or more, held against words of three signs or more that have a digit, by language."""
    docs = _docs(spark, sf)
    out = S.span_evaluation(_spans(docs, "[0-9]{2,}"), _spans(docs, r"[^ \n]*[0-9][^ \n]{2,}"), "lang")
    return out.select(F.col("group").alias("lang"), "hit", "right", "truth", "predicted", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "f2")))


def mention_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("@"), F.col("role"), F.lit(": "), "text", F.lit(" cc @team"), F.col("conv_id").cast("string")).alias("text"))
    return made.select("conv_id", "turn", S.mention_pseudonyms(F.col("text"), SALT).alias("text"))


def thread_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn mentions its own speaker."""
    made = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.concat(F.lit("by @"), "role").alias("text"))
    return S.thread_pseudonyms(made, SALT)


def pii_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in which anything is found, against those labelled as toxic: a measure that the pieces fit together."""
    labels = table(spark, sf, "labels")
    found = S.entity_rows(_docs(spark, sf)).select("doc_id").join(labels.select("doc_id"), "doc_id", "left_semi")
    out = S.evaluation(found, labels.filter("toxic = 1"), ["doc_id"])
    return out.select(*(F.round(c, 8).alias(c) for c in ("recall", "precision", "f2")))


def _rows(entities) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{n}' AS entity, unnest(regexp_extract_all(text, '{p}')) AS value, {s}::DOUBLE AS score FROM documents" for n, p, _, s in entities)


def _clean() -> str:
    out = "text"
    for _, p, label, _ in S.ENTITIES:
        out = f"regexp_replace({out}, '{p}', '{label}', 'g')"
    return out


_MENTION = "@[A-Za-z0-9_.-]+"
_PSEUDO = f"lower(entity) || '-' || substr(sha256('{SALT}' || entity || ':' || lower(trim(value))), 1, 16)"

def _spans_sql(pattern: str) -> str:
    return rf"""(SELECT doc_id, lang, e - length(m) AS a, e AS b FROM (SELECT doc_id, lang, x[2] AS m, sum(length(x[1]) + length(x[2])) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM
      (SELECT doc_id, lang, unnest(list_zip(regexp_split_to_array(text, '{pattern}'), regexp_extract_all(text, '{pattern}'))) AS x, generate_subscripts(regexp_split_to_array(text, '{pattern}'), 1) AS i FROM documents)) WHERE m IS NOT NULL)"""


QUERIES = {
    "context_entities": (
        context_entities,
        """WITH o AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS p FROM orders)
        SELECT k AS doc_id, 'MEDICAL_RECORD_NUMBER' AS entity, unnest(['MRN-' || p, 'MRN: ' || p]) AS value, CAST(unnest([13, 30]) AS BIGINT) AS start, 1.0::DOUBLE AS score FROM o WHERE k % 3 = 0
        UNION ALL SELECT k, 'HEALTH_PLAN_ID', 'ABC1' || p, CASE WHEN k % 3 = 1 THEN 0 ELSE 67 END, CASE WHEN k % 3 = 1 THEN 0.65::DOUBLE ELSE 0.3::DOUBLE END FROM o WHERE k % 3 > 0""",
    ),
    "span_evaluation": (
        span_evaluation,
        rf"""WITH p AS {_spans_sql("[0-9]{2,}")}, t AS {_spans_sql(r"[^ \n]*[0-9][^ \n]{2,}".replace(chr(92) * 2, chr(92)))},
        g AS (SELECT lang FROM p UNION SELECT lang FROM t),
        c AS (SELECT g.lang, (SELECT count(*) FROM t WHERE t.lang IS NOT DISTINCT FROM g.lang AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = t.doc_id AND p.a < t.b AND t.a < p.b)) AS hit,
          (SELECT count(*) FROM p WHERE p.lang IS NOT DISTINCT FROM g.lang AND EXISTS (SELECT 1 FROM t WHERE p.doc_id = t.doc_id AND p.a < t.b AND t.a < p.b)) AS "right",
          (SELECT count(*) FROM t WHERE t.lang IS NOT DISTINCT FROM g.lang) AS truth, (SELECT count(*) FROM p WHERE p.lang IS NOT DISTINCT FROM g.lang) AS predicted FROM g),
        r AS (SELECT *, hit / nullif(truth, 0)::DOUBLE AS recall, "right" / nullif(predicted, 0)::DOUBLE AS precision FROM c)
        SELECT lang, hit, "right", truth, predicted, round(recall, 6) AS recall, round(precision, 6) AS precision, round(5 * precision * recall / nullif(4 * precision + recall, 0), 6) AS f2 FROM r""",
    ),
    "pii_counts": (pii_counts, f"SELECT entity, count(*) AS n, count(DISTINCT value) AS n_values FROM ({_rows(S.ENTITIES)}) GROUP BY 1"),
    "pii_scrub_constant": (pii_scrub_constant, f"SELECT doc_id, sha256({_clean()}) AS clean_sha256 FROM documents"),
    "pii_pseudonyms": (pii_pseudonyms, f"SELECT DISTINCT entity, value, {_PSEUDO} AS pseudonym FROM ({_rows(S.ENTITIES)}) WHERE entity IN ('EMAIL_ADDRESS', 'PHONE_NUMBER')"),
    "pii_audit": (pii_audit, None),
    "scrub_report": (scrub_report, f"SELECT coalesce(lang, 'all') AS lang, coalesce(entity, 'all') AS entity, count(*) AS n FROM ({_rows(S.ENTITIES)}) JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, entity)"),
    "sensitivity_gate": (
        sensitivity_gate,
        f"""WITH t AS (SELECT *, CASE lang WHEN 'en' THEN 'clean' WHEN 'fr' THEN 'maybe_sensitive' ELSE 'sensitive' END AS tier FROM documents)
        SELECT doc_id, sha256(CASE WHEN tier = 'clean' THEN text ELSE {_clean()} END) AS clean_sha256, tier FROM t""",
    ),
    "secret_scan": (secret_scan, f"SELECT doc_id, entity AS kind, substr(sha256(value), 1, 8) AS value_hash FROM ({_rows([(n, p, '', 1.0) for n, p in S.SECRETS])})"),
    "pii_threshold": (
        pii_threshold,
        f"""WITH r AS ({_rows(S.ENTITIES)}), o AS (SELECT value FROM r GROUP BY 1 HAVING count(DISTINCT doc_id) > 2), c AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'CONVO_SLACK' ELSE 'DOC_DESIGN' END AS corpus FROM r)
        SELECT corpus, entity, count(*) AS n FROM c WHERE score >= CASE WHEN starts_with(corpus, 'CONVO') THEN 0.3 ELSE 0.5 END AND lower(value) NOT IN (SELECT lower(value) FROM o) GROUP BY ALL""",
    ),
    "custom_entities": (
        custom_entities,
        "WITH documents AS (SELECT page_id AS doc_id, 'see ' || regexp_replace(url, '\\.example\\.', '.corp.', 'g') || ' of ABC' || lpad(CAST(page_id AS VARCHAR), 9, '4') AS text FROM pages) "
        + f"SELECT entity, count(*) AS n, count(DISTINCT value) AS n_values FROM ({_rows(S.CUSTOM)}) GROUP BY 1",
    ),
    "mention_pseudonyms": (
        mention_pseudonyms,
        rf"""WITH m AS (SELECT conv_id, turn, '@' || role || ': ' || text || ' cc @team' || conv_id AS t FROM conversations),
        p AS (SELECT conv_id, turn, list_zip(regexp_split_to_array(t, '{_MENTION}'), regexp_extract_all(t, '{_MENTION}')) AS z FROM m)
        SELECT conv_id, turn, array_to_string(list_transform(z, lambda x: x[1] || coalesce('@user-' || substr(sha256('{SALT}USER:' || lower(trim(x[2]))), 1, 16), '')), '') AS text FROM p""",
    ),
    "thread_pseudonyms": (
        thread_pseudonyms,
        f"""WITH p AS (SELECT conv_id, turn, '@user-' || substr(sha256('{SALT}USER:@' || role), 1, 16) AS speaker FROM conversations) SELECT conv_id, turn, speaker, 'by ' || speaker AS text FROM p""",
    ),
    "pii_evaluation": (
        pii_evaluation,
        f"""WITH p AS (SELECT DISTINCT doc_id FROM ({_rows(S.ENTITIES)}) WHERE doc_id IN (SELECT doc_id FROM labels)), t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
        s AS (SELECT (SELECT count(*) FROM p JOIN t USING (doc_id))::DOUBLE AS h, (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM t) AS t), m AS (SELECT h / t AS recall, h / p AS precision FROM s)
        SELECT round(recall, 8) AS recall, round(precision, 8) AS precision, round(5 * precision * recall / (4 * precision + recall), 8) AS f2 FROM m""",
    ),
}
