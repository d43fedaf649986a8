"""Linking service calls to route definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import normal_path
from granary.operators.automaton import contained

MIN_CONFIDENCE = 0.7


def segments(path: Column) -> Column:
    return F.split(normal_path(path), "/")


def is_parameter(segment: Column) -> Column:
    return segment.startswith("{") & segment.endswith("}")


def link(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Each call (call_id, target_service, call_type, method, url_path) with its best route (service, method, path, handler, seq).

    A route fits by service, method and path template. A service's routes of a method and size have few masks, which say
    where parameters are; a call's path is written under each such mask and joined by equality, so no two templates are
    tried in turn, however many routes a service has. The one with most literal segments wins, then most segments, then the first
    registered. A call that is not HTTP, or has no path, links to its service as such if that has any route.
    Without a route, miss_reason says what was lacking first: no_routes, method_mismatch or path_mismatch.
    """
    s = segments(F.col("path"))
    shaped = routes.select(
        F.col("service").alias("target_service"), F.upper("method").alias("m"), F.size(s).alias("shape"), s.alias("template"),
        F.size(F.filter(s, lambda x: ~is_parameter(x))).alias("literal"), F.col("path").alias("route_path"), "handler", "seq",
    )
    http = (F.col("call_type") == "http") & F.col("url_path").isNotNull()
    asked = calls.withColumn("is_http", F.coalesce(http, F.lit(False))).withColumn("m", F.upper(F.coalesce("method", F.lit("GET"))))
    asked = asked.withColumn("parts", segments(F.col("url_path"))).withColumn("shape", F.size("parts"))
    mask = F.array_join(F.transform("template", lambda x: F.when(is_parameter(x), "1").otherwise("0")), "")
    written = F.array_join(F.transform("template", lambda x: F.when(is_parameter(x), "{}").otherwise(x)), "/")
    keyed = shaped.withColumns({"mask": mask, "written": written}).drop("template")
    masks = keyed.select("target_service", "m", "shape", "mask").distinct()
    open_at = lambda i: F.substring(F.col("mask"), i + 1, F.lit(1)) == "1"
    under = F.array_join(F.transform("parts", lambda x, i: F.when(open_at(i), F.when(x != "", "{}")).otherwise(x)), "/", "\0")  # an empty segment fits no parameter
    tried = asked.filter("is_http").join(masks, ["target_service", "m", "shape"]).withColumn("written", under)
    met = tried.join(keyed, ["target_service", "m", "shape", "mask", "written"])
    best = met.groupBy("call_id").agg(F.min_by(F.struct("route_path", "handler"), F.struct(-F.col("literal"), -F.col("shape"), "seq")).alias("route"))
    services = routes.groupBy(F.col("service").alias("target_service")).agg(F.lit(True).alias("known"))
    methods = shaped.select("target_service", "m").distinct().withColumn("has_method", F.lit(True))
    joined = asked.join(best, "call_id", "left").join(services, "target_service", "left").join(methods, ["target_service", "m"], "left")
    whole = ~F.col("is_http") & F.col("known").isNotNull()
    linked = F.col("route").isNotNull() | whole
    reason = F.when(linked, None).when(F.col("known").isNull(), "no_routes").when(F.col("is_http") & F.col("has_method").isNull(), "method_mismatch").otherwise("path_mismatch")
    return joined.select(
        "call_id", "target_service", "method",
        F.when(whole, "<service>").otherwise(F.col("route.handler")).alias("handler"),
        F.col("route.route_path").alias("route_path"), reason.alias("miss_reason"),
    )


def confident(calls: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    return calls.filter(F.col("confidence") >= least)


def resolve_services(names: DataFrame, services: DataFrame) -> DataFrame:
    """(name, service): exact name, else the host without port and domain, else the first registered of which one
    contains the other; else null.

    The registry (name, seq) may be of any size. Whole names are joined by equality; containment is told by automata
    over the registry, and over the names that are looked up.
    """
    cleaned = F.lower(F.substring_index(F.substring_index("name", ":", 1), ".", 1))
    asked = names.select("name").distinct().withColumn("cleaned", cleaned)
    known = services.groupBy(F.col("name").alias("service")).agg(F.min("seq").alias("seq"))
    exact = asked.join(known, F.col("name") == F.col("service")).select("name", F.lit(0).alias("rank"), "seq", "service")
    host = asked.join(known, F.col("cleaned") == F.col("service")).select("name", F.lit(1).alias("rank"), "seq", "service")
    rank = lambda pairs: pairs.select("cleaned", F.lit(2).alias("rank"), "seq", "service").groupBy("cleaned", "rank").agg(F.min(F.struct("seq", "service")).alias("x")).select("cleaned", "rank", "x.*")
    sought = asked.select("cleaned").filter("cleaned <> ''").distinct()
    inside = rank(contained(sought, "cleaned", "cleaned", known.select(F.col("service").alias("name"))).join(known, F.col("name") == F.col("service")))
    around = rank(contained(known, "service", "service", sought.select(F.col("cleaned").alias("name"))).withColumnRenamed("name", "cleaned").join(known, "service"))
    near = asked.join(inside.unionByName(around), "cleaned").select("name", "rank", "seq", "service")
    first = known.select(F.min_by(F.struct("seq", "service"), F.struct("seq", "service"))).scalar()
    every = asked.filter("cleaned = ''").select("name", first.alias("x")).select("name", F.lit(2).alias("rank"), "x.seq", "x.service")
    found = exact.unionByName(host).unionByName(near).unionByName(every).filter("service is not null")
    best = found.groupBy("name").agg(F.min_by("service", F.struct("rank", "seq", "service")).alias("service"))
    return asked.select("name").join(best, "name", "left")


def service_references(texts: DataFrame, services: DataFrame) -> DataFrame:
    """(doc_id, service, n) of texts (doc_id, text): 1 if a known service (name) stands anywhere in the lower-case text,
    and 1 more for each url whose host is its name.

    An automaton over the services reads each text once.
    """
    lowered = texts.select("doc_id", F.lower("text").alias("low"))
    hosts = lowered.select("doc_id", F.explode(F.regexp_extract_all("low", F.lit(r"https?://([a-z0-9\-]+)[:\./]"), F.lit(1))).alias("service"))
    known = services.select(F.col("name").alias("service")).distinct().filter("service <> ''").withColumn("name", F.lower("service"))
    named = hosts.join(known, "service", "left_semi").select("doc_id", "service")
    there = contained(lowered, "doc_id", "low", known).join(known, "name").select("doc_id", "service")
    return named.unionByName(there).groupBy("doc_id", "service").agg(F.count("*").alias("n"))


def most_specific(routes: DataFrame) -> DataFrame:
    """Routes of a service and method in order of how specific they are, from 1."""
    s = segments(F.col("path"))
    order = Window.partitionBy("service", "method").orderBy(F.size(F.filter(s, lambda x: ~is_parameter(x))).desc(), F.size(s).desc(), "seq")
    return routes.withColumn("rank", F.row_number().over(order))
