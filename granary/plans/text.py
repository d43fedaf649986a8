"""Queries of scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.numbering import numbered
from granary.sources.tables import table

#: SQL of the token count of an expression, for DuckDB.
WEIGHT = "CASE WHEN length(t) > 10 AND regexp_matches(t, '^[a-zA-Z]') THEN CAST(ceil(length(t) / (length(t) // greatest(1, length(t) // 4))) AS INTEGER) ELSE 1 END"


def tokens_sql(text: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({text}, '{T.TOKEN}'), lambda t: {WEIGHT})), 0)"


def paths(pages: DataFrame) -> DataFrame:
    """File paths made of urls: host, path, and an extension by the page's number."""
    names = list(T.LANGUAGES)
    ext = F.element_at(F.array(*map(F.lit, [*names, "md", "txt"])), (F.col("page_id") % (len(names) + 2) + 1).cast("int"))
    return pages.select("page_id", "url", F.concat(T.url_service(F.col("url")), F.regexp_replace(T.normal_path(T.url_path(F.col("url"))), "[#.].*$", ""), F.lit("."), ext).alias("path"))


def paths_sql() -> str:
    names = ", ".join(f"'{n}'" for n in [*T.LANGUAGES, "md", "txt"])
    host = "regexp_extract(url, 'https?://([^/:]+)', 1)"
    path = r"""regexp_extract(url, 'https?://[^/]+(/[^"'')\s]*)', 1)"""
    normal = rf"regexp_replace(split_part({path}, '?', 1), '/+$', '')"
    return rf"""SELECT page_id, url, {host} || regexp_replace(CASE WHEN {normal} = '' THEN '/' ELSE {normal} END, '[#.].*$', '')
        || '.' || ([{names}])[page_id % {len(T.LANGUAGES) + 2} + 1] AS path FROM pages"""


def token_count_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("n_tokens"))


def truncate_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.truncate_tokens(F.col("text"), 64).alias("head"))


def doc_uri() -> F.Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, sf, "documents").select("doc_id", T.chunk_id(doc_uri(), F.lit(0), size).alias("chunk_id"), T.content_hash(F.col("text")).alias("content_hash"))


def corpus_class(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    files = paths(table(spark, sf, "pages"))
    return files.select("page_id", T.code_corpus(p).alias("code"), T.doc_corpus(p).alias("doc"), T.talk_corpus(p).alias("talk"), T.doc_class(p).alias("class"), T.language_of(p).alias("language"))


def url_service_path(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    path = T.url_path(u)
    return table(spark, sf, "pages").select("page_id", T.url_service(u).alias("service"), path.alias("path"), T.normal_path(path).alias("normal"))


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


def kind_names(spark: SparkSession, sf: str) -> DataFrame:
    kind = (F.col("event_id") % 30).cast("int")
    return table(spark, sf, "events").groupBy(T.kind_name(kind).alias("kind")).agg(F.count("*").alias("n"))


def code_words(spark: SparkSession, sf: str) -> DataFrame:
    found = T.code_words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n_words"), F.array_join(F.slice(found, 1, 8), " ").alias("head"), F.sha2(F.array_join(found, " "), 256).alias("words_sha256"))


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text"), 3).alias("snippet"))


def line_checks(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.line_ending(t).alias("ending"), T.balanced(t).alias("balanced"), (T.occurrences(t, '"') % 2 == 0).alias("quotes_even"),
        t.startswith("﻿").alias("bom"), F.size(F.split(t, "\n")).cast("long").alias("n_lines"), F.array_join(F.slice(F.split(t, "\n"), 2, 2), "\n").alias("lines_2_3"),
    )


def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit("---\nlens: "), F.col("lang"), F.lit("\nfocus: "), F.col("source"), F.lit("\n---\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.front_matter(made, "lens").alias("lens"), T.front_matter(made, "focus").alias("focus"), T.front_matter(made, "missing").alias("missing"))


def task_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines `id [priority] [type] status - title`, parsed into columns; a line of another form gives none."""
    lines = table(spark, sf, "orders").select(F.concat(F.lit("t-"), F.col("o_orderkey"), F.lit(" [P"), F.substring("o_orderpriority", 1, 1), F.lit("] [task] "), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed"), F.lit(" - "), F.col("o_orderdate").cast("string")).alias("line"))
    pattern = r"^(\S+) \[([^\]]+)\] \[([^\]]+)\] (\S+) - (.*)$"
    names = ("id", "priority", "type", "status", "title")
    return lines.filter(F.col("line").rlike(pattern)).select(*(F.regexp_extract("line", pattern, k).alias(n) for k, n in enumerate(names, 1)))


def worker_names(spark: SparkSession, sf: str) -> DataFrame:
    """Valid names, made unique by -1, -2 ... in order of arrival."""
    asked = table(spark, sf, "events").select("event_id", F.concat("event_type", F.lit("_"), F.col("user_id") % 10).alias("name")).filter(F.col("name").rlike("^[A-Za-z0-9_-]{1,64}$"))
    nth = F.col("nth") - 1
    return numbered(asked, ["name"], ["event_id"], "nth").select("event_id", F.when(nth == 0, F.col("name")).otherwise(F.concat("name", F.lit("-"), nth.cast("string"))).alias("worker"))


def hover_text(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    value, said = F.to_json(F.struct(k.alias("value"))), F.concat(F.lit('"'), k, F.lit('"'))
    made = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["k"'), F.lit(", "), value, F.lit(', "end"]'))).when(F.col("event_id") % 3 == 1, value).otherwise(said)
    return table(spark, sf, "events").select("event_id", made.alias("c")).select("event_id", T.hover_text(F.col("c")).alias("hover"))


def file_uris(spark: SparkSession, sf: str) -> DataFrame:
    made = paths(table(spark, sf, "pages")).select("page_id", F.concat(F.lit("/src dir/100%+/"), F.col("path")).alias("path"))
    return made.select("page_id", T.file_uri(F.col("path")).alias("uri"), T.uri_path(T.file_uri(F.col("path"))).alias("path"))


_HOST, _PATH = "regexp_extract(url, 'https?://([^/:]+)', 1)", r"""regexp_extract(url, 'https?://[^/]+(/[^"'')\s]*)', 1)"""
_SLUG = "regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items()) + "}"

QUERIES = {
    "token_count_docs": (token_count_docs, f"SELECT doc_id, CAST({tokens_sql('text')} AS BIGINT) AS n_tokens FROM documents"),
    "truncate_docs": (
        truncate_docs,
        rf"""WITH w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS l FROM documents)),
        s AS (SELECT doc_id, w, k, sum({tokens_sql('w')}) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM w),
        h AS (SELECT doc_id, string_agg(w, ' ' ORDER BY k) FILTER (n <= 64) AS head FROM s GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN {tokens_sql('d.text')} <= 64 THEN d.text ELSE coalesce(h.head, '') END AS head FROM documents d LEFT JOIN h USING (doc_id)""",
    ),
    "chunk_ids": (chunk_ids, "SELECT doc_id, sha256(source || '/' || doc_id || ':0:' || strlen(text)) AS chunk_id, substr(sha256(text), 1, 8) AS content_hash FROM documents"),
    "corpus_class": (
        corpus_class,
        f"""SELECT page_id, CASE WHEN contains(lower(path), 'test') THEN 'CODE_TEST' ELSE 'CODE_LOGIC' END AS code,
        CASE WHEN contains(upper(path), 'README') THEN 'DOC_README' ELSE 'DOC_DESIGN' END AS doc,
        CASE WHEN contains(lower(path), 'slack') THEN 'CONVO_SLACK' ELSE 'CONVO_TRANSCRIPT' END AS talk,
        CASE WHEN contains(lower(path), 'runbook') THEN 'RUNBOOK' WHEN regexp_matches(lower(path), '(^|/)adr(/|-)|decision') THEN 'ADR'
          WHEN contains(lower(path), 'readme') OR contains(lower(path), 'docs/') THEN 'DOC_README' ELSE 'DOC_DESIGN' END AS class,
        coalesce({_MAP}[lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))], 'unknown') AS language FROM ({paths_sql()})""".replace("\\\\", "\\"),
    ),
    "url_service_path": (
        url_service_path,
        rf"""WITH p AS (SELECT page_id, nullif({_HOST}, '') AS service, nullif({_PATH}, '') AS path FROM pages),
        q AS (SELECT page_id, CASE WHEN service NOT IN ('localhost', '127.0.0.1', '0.0.0.0') THEN service END AS service, path FROM p),
        r AS (SELECT page_id, service, CASE WHEN service IS NOT NULL THEN path END AS path FROM q)
        SELECT *, coalesce(nullif(regexp_replace(split_part(path, '?', 1), '/+$', ''), ''), CASE WHEN path IS NOT NULL THEN '/' END) AS normal FROM r""",
    ),
    "slugs": (slugs, f"SELECT page_id, CASE WHEN length({_SLUG}) > 50 THEN regexp_replace(substr({_SLUG}, 1, 45), '-+$', '') || '-' || substr(sha256(url), 1, 4) ELSE {_SLUG} END AS slug FROM pages"),
    "kind_names": (kind_names, f"SELECT coalesce((['{"', '".join(T.SYMBOL_KINDS)}'])[nullif(event_id % 30, 0)], 'unknown') AS kind, count(*) AS n FROM events GROUP BY 1"),
    "code_words": (
        code_words,
        rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({_STOP})) AS l FROM documents)
        SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(array_to_string(l[1:8], ' '), '') AS head, sha256(coalesce(array_to_string(l, ' '), '')) AS words_sha256 FROM w""",
    ),
    "snippets": (
        snippets,
        """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
        SELECT doc_id, CASE WHEN len(l) > 3 THEN array_to_string(l[1:3], chr(10)) || chr(10) || '... (' || (len(l) - 3) || ' more lines)' ELSE text END AS snippet FROM l""",
    ),
    "line_checks": (
        line_checks,
        """WITH n AS (SELECT doc_id, text, lambda_x AS t FROM (SELECT *, text AS lambda_x FROM documents))
        SELECT doc_id, CASE WHEN contains(t, chr(13) || chr(10)) AND contains(replace(t, chr(13) || chr(10), ''), chr(10)) THEN 'mixed'
          WHEN contains(t, chr(13) || chr(10)) THEN 'crlf' WHEN contains(t, chr(10)) THEN 'lf' ELSE 'none' END AS ending,
        length(replace(t, '(', '')) = length(replace(t, ')', '')) AND length(replace(t, '[', '')) = length(replace(t, ']', '')) AND length(replace(t, '{', '')) = length(replace(t, '}', '')) AS balanced,
        (length(t) - length(replace(t, '"', ''))) % 2 = 0 AS quotes_even, starts_with(t, chr(65279)) AS bom,
        CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, coalesce(array_to_string(string_split(t, chr(10))[2:3], chr(10)), '') AS lines_2_3 FROM n""",
    ),
    "front_matter": (front_matter, "SELECT doc_id, lang AS lens, source AS focus, CAST(NULL AS VARCHAR) AS missing FROM documents"),
    "task_lines": (
        task_lines,
        "SELECT 't-' || o_orderkey AS id, 'P' || substr(o_orderpriority, 1, 1) AS priority, 'task' AS type, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS status, CAST(o_orderdate AS VARCHAR) AS title FROM orders",
    ),
    "worker_names": (
        worker_names,
        """WITH n AS (SELECT event_id, event_type || '_' || user_id % 10 AS name FROM events),
        r AS (SELECT event_id, name, row_number() OVER (PARTITION BY name ORDER BY event_id) - 1 AS k FROM n WHERE regexp_matches(name, '^[A-Za-z0-9_-]{1,64}$'))
        SELECT event_id, CASE WHEN k = 0 THEN name ELSE name || '-' || k END AS worker FROM r""",
    ),
    "hover_text": (hover_text, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'k' || chr(10) || json_extract_string(props, '$.k') || chr(10) || 'end' ELSE json_extract_string(props, '$.k') END AS hover FROM events"),
    "file_uris": (file_uris, f"SELECT page_id, 'file:///src dir/100%25+/' || path AS uri, '/src dir/100%+/' || path AS path FROM ({paths_sql()})"),
}
