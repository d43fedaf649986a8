"""Queries of call linking: calls are the pages' urls, routes the urls of every third page with numbers as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import linking
from granary.sources.tables import table

METHODS = ("GET", "POST", "PUT")


def method_of() -> F.Column:
    return F.element_at(F.array(*map(F.lit, METHODS)), (F.col("page_id") % 3 + 1).cast("int"))


def calls(pages: DataFrame) -> DataFrame:
    u = F.col("url")
    kind = F.when(F.col("page_id") % 10 == 9, "grpc").otherwise("http")
    return pages.select(
        F.col("page_id").alias("call_id"), T.url_service(u).alias("target_service"), kind.alias("call_type"),
        F.when(F.col("page_id") % 7 != 6, method_of()).alias("method"), F.regexp_replace(T.url_path(u), "#.*$", "").alias("url_path"),
        (F.col("page_id") % 5 * 0.1 + 0.5).alias("confidence"),
    )


def routes(pages: DataFrame) -> DataFrame:
    u = F.col("url")
    path = T.normal_path(F.regexp_replace(F.regexp_replace(T.url_path(u), "#.*$", ""), "/[0-9]+", "/{id}"))
    rows = pages.filter("page_id % 3 = 0").select(T.url_service(u).alias("service"), method_of().alias("method"), path.alias("path"), "page_id")
    return rows.groupBy("service", "method", "path").agg(F.min("page_id").alias("seq")).withColumn("handler", F.concat(F.lit("h"), F.col("seq").cast("string")))


def link_calls(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return linking.link(calls(pages), routes(pages))


def link_miss_reasons(spark: SparkSession, sf: str) -> DataFrame:
    found = link_calls(spark, sf)
    return found.groupBy(F.coalesce("miss_reason", F.lit("linked")).alias("reason")).agg(F.count("*").alias("n"))


def link_confident(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    kept = linking.confident(calls(pages))
    return linking.link(kept, routes(pages)).groupBy(F.col("handler").isNotNull().alias("linked")).agg(F.count("*").alias("n"))


def route_services(spark: SparkSession, sf: str) -> DataFrame:
    return routes(table(spark, sf, "pages")).select("service").distinct()


def route_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return linking.most_specific(routes(table(spark, sf, "pages"))).select("service", "method", "path", "rank")


def service_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts resolved against a registry of the hosts' second labels."""
    hosts = table(spark, sf, "pages").select(T.url_service(F.col("url")).alias("name")).distinct()
    label = F.regexp_extract("name", r"([a-z0-9-]+)\.example\.", 1)
    registry = hosts.groupBy(label.alias("label")).agg(F.min("name").alias("first")).filter("label <> ''").select(F.col("label").alias("name"), "first").withColumn("seq", F.length("name"))
    return linking.resolve_services(hosts, registry)


_U = r"regexp_extract(url, 'https?://([^/:]+)', 1)"
_P = r"""regexp_replace(regexp_extract(url, 'https?://[^/]+(/[^"'')\s]*)', 1), '#.*$', '')"""


def _n(p: str) -> str:
    return rf"coalesce(nullif(regexp_replace(split_part({p}, '?', 1), '/+$', ''), ''), '/')"


_M = "(['GET', 'POST', 'PUT'])[page_id % 3 + 1]"
_LINK = rf"""WITH c AS (SELECT page_id AS call_id, {_U} AS s, page_id % 10 <> 9 AS http, CASE WHEN page_id % 7 <> 6 THEN {_M} END AS method, string_split({_n(_P)}, '/') AS parts, page_id % 5 * 0.1 + 0.5 AS confidence FROM pages),
r0 AS (SELECT {_U} AS s, {_M} AS m, {_n(f"regexp_replace({_P}, '/[0-9]+', '/{{id}}', 'g')")} AS path, min(page_id) AS seq FROM pages WHERE page_id % 3 = 0 GROUP BY ALL),
r AS (SELECT *, string_split(path, '/') AS t, len(list_filter(string_split(path, '/'), lambda x: NOT (starts_with(x, '{{') AND ends_with(x, '}}')))) AS lit FROM r0),
j AS (SELECT c.call_id, r.path, r.seq, row_number() OVER (PARTITION BY c.call_id ORDER BY r.lit DESC, len(r.t) DESC, r.seq) AS k
  FROM c JOIN r ON c.http AND c.s = r.s AND coalesce(c.method, 'GET') = r.m AND len(c.parts) = len(r.t)
  AND list_bool_and(list_transform(range(1, len(r.t) + 1), lambda i: CASE WHEN starts_with(r.t[i], '{{') AND ends_with(r.t[i], '}}') THEN c.parts[i] <> '' ELSE c.parts[i] = r.t[i] END))),
l AS (SELECT c.call_id, c.s AS target_service, c.method, c.confidence,
  CASE WHEN NOT c.http AND k.s IS NOT NULL THEN '<service>' WHEN j.seq IS NOT NULL THEN 'h' || j.seq END AS handler, j.path AS route_path,
  CASE WHEN j.seq IS NOT NULL OR (NOT c.http AND k.s IS NOT NULL) THEN NULL WHEN k.s IS NULL THEN 'no_routes' WHEN c.http AND m.s IS NULL THEN 'method_mismatch' ELSE 'path_mismatch' END AS miss_reason
  FROM c LEFT JOIN j ON c.call_id = j.call_id AND j.k = 1 LEFT JOIN (SELECT DISTINCT s FROM r) k ON k.s = c.s LEFT JOIN (SELECT DISTINCT s, m FROM r) m ON m.s = c.s AND m.m = coalesce(c.method, 'GET'))"""

QUERIES = {
    "link_calls": (link_calls, f"{_LINK} SELECT call_id, target_service, method, handler, route_path, miss_reason FROM l"),
    "link_miss_reasons": (link_miss_reasons, f"{_LINK} SELECT coalesce(miss_reason, 'linked') AS reason, count(*) AS n FROM l GROUP BY 1"),
    "link_confident": (link_confident, f"{_LINK} SELECT handler IS NOT NULL AS linked, count(*) AS n FROM l WHERE confidence >= 0.7 GROUP BY 1"),
    "route_services": (route_services, f"{_LINK} SELECT DISTINCT s AS service FROM r"),
    "route_ranks": (route_ranks, f"{_LINK} SELECT s AS service, m AS method, path, CAST(row_number() OVER (PARTITION BY s, m ORDER BY lit DESC, len(t) DESC, seq) AS INTEGER) AS rank FROM r"),
    "service_resolution": (
        service_resolution,
        rf"""WITH h AS (SELECT DISTINCT {_U} AS name FROM pages), c AS (SELECT name, lower(split_part(split_part(name, ':', 1), '.', 1)) AS cleaned FROM h),
        g AS (SELECT DISTINCT regexp_extract(name, '([a-z0-9-]+)\.example\.', 1) AS service FROM h WHERE regexp_extract(name, '([a-z0-9-]+)\.example\.', 1) <> ''),
        p AS (SELECT c.name, g.service, CASE WHEN service = name THEN 0 WHEN service = cleaned THEN 1 ELSE 2 END AS rank, length(service) AS seq FROM c JOIN g ON service = name OR service = cleaned OR contains(service, cleaned) OR contains(cleaned, service)),
        b AS (SELECT name, arg_min(service, (rank, seq, service)) AS service FROM p GROUP BY 1)
        SELECT h.name, b.service FROM h LEFT JOIN b USING (name)""",
    ),
}
