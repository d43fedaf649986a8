"""Queries of the graph: customers of nations, orders, parts and suppliers as nodes, and hosts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import graph as G
from granary.sources.tables import table


#: Suppliers' numbers as nodes begin here, after all parts'.
SUPPLIERS = 1_000_000_000


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """part -> supplier of each lineitem."""
    lines = table(spark, sf, "lineitem")
    return lines.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIERS).alias("dst"), F.when(F.col("l_linenumber") == 1, "CALLS").otherwise("MENTIONS").alias("type"))


def chain(spark: SparkSession, sf: str) -> DataFrame:
    """customer -> a customer of about a third of its number: paths of some length."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 3).alias("dst"), F.lit("DEPENDS").alias("type"))


def graph_upsert(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("type"), F.col("o_custkey").cast("string").alias("name"), "o_orderkey", "o_totalprice")
    return G.upsert_entities(orders, F.col("o_orderkey"))


def neighbors_2hop(spark: SparkSession, sf: str) -> DataFrame:
    """From all parts whose number is divisible by 50, over all edges."""
    e = edges(spark, sf)
    starts = e.filter("src % 50 = 0").select(F.col("src").alias("start")).distinct()
    return G.neighbours(e, starts, 2, "both").select("start", "node", "hop", "via")


def calls_1hop(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return G.neighbours(e, e.select(F.col("src").alias("start")).distinct(), 1, "out", ["CALLS"]).select("start", "node")


def blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("start"))
    return G.dependents(chain(spark, sf), starts).groupBy("start").agg(F.count("*").alias("n"), F.max("hop").alias("depth"))


def called_by(spark: SparkSession, sf: str) -> DataFrame:
    return G.called_by(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target")))


def entity_search(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), F.col("p_name").alias("name"))
    return G.search(parts, "A", ["Brand#11", "Brand#12", "Brand#13"], 20)


def service_graph(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    pages = table(spark, sf, "pages").select(F.regexp_extract(T.url_service(u), r"\.([a-z]+)$", 1).alias("src"), T.url_service(u).alias("dst"), F.when(u.startswith("https"), "CALLS").otherwise("MENTIONS").alias("type"), F.col("page_id").alias("evidence_id"))
    return G.service_graph(pages)


def file_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of relations between files: each file once, with how often it calls and is called."""
    e = edges(spark, sf)
    ends = e.select(F.col("src").alias("file"), F.lit(1).alias("calls"), F.lit(0).alias("called")).unionByName(e.select(F.col("dst").alias("file"), F.lit(0).alias("calls"), F.lit(1).alias("called")))
    return ends.groupBy("file").agg(F.sum("calls").alias("calls"), F.sum("called").alias("called"))


def file_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between files of parts and of suppliers, with properties."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    relations = l.select(F.concat(F.lit("p"), "l_partkey").alias("source_file"), F.concat(F.lit("s"), "l_suppkey").alias("target_file"), F.col("l_linestatus").alias("relation_type"), F.col("l_returnflag").alias("route_path"), F.col("l_linenumber").alias("source_line"))
    entities, edges = G.relation_graph(relations)
    return edges.join(entities.select(F.col("name").alias("src")), "src").select("src", "dst", "type", "properties.*")


_E = f"e AS (SELECT l_partkey AS src, l_suppkey + {SUPPLIERS} AS dst, CASE WHEN l_linenumber = 1 THEN 'CALLS' ELSE 'MENTIONS' END AS type FROM lineitem)"

QUERIES = {
    "graph_upsert": (graph_upsert, "SELECT type, name, o_orderkey, o_totalprice FROM (SELECT o_orderstatus AS type, CAST(o_custkey AS VARCHAR) AS name, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1"),
    "neighbors_2hop": (
        neighbors_2hop,
        f"""WITH {_E}, s AS (SELECT DISTINCT src AS a, dst AS b, type FROM e UNION SELECT DISTINCT dst, src, type FROM e), st AS (SELECT DISTINCT src AS start FROM e WHERE src % 50 = 0),
        h1 AS (SELECT start, b AS node, min(struct_pack(a := a, t := type)) AS x FROM st JOIN s ON s.a = start WHERE b <> start GROUP BY ALL),
        h2 AS (SELECT start, b AS node, min(struct_pack(a := s.a, t := s.type)) AS x FROM h1 JOIN s ON s.a = h1.node WHERE b <> start AND NOT EXISTS (SELECT 1 FROM h1 q WHERE q.start = h1.start AND q.node = s.b) GROUP BY ALL)
        SELECT start, node, 1 AS hop, x.a || ':' || x.t AS via FROM h1 UNION ALL SELECT start, node, 2, x.a || ':' || x.t FROM h2""",
    ),
    "calls_1hop": (calls_1hop, f"WITH {_E} SELECT DISTINCT src AS start, dst AS node FROM e WHERE type = 'CALLS'"),
    "blast_radius": (
        blast_radius,
        """WITH RECURSIVE w(start, node, hop) AS (SELECT n_nationkey + 1, CAST(n_nationkey + 1 AS BIGINT), 0 FROM nation
        UNION ALL SELECT w.start, c_custkey, w.hop + 1 FROM w JOIN customer ON c_custkey // 3 = w.node WHERE c_custkey <> w.start)
        SELECT start, count(*) AS n, max(hop) AS depth FROM w WHERE hop > 0 GROUP BY 1""",
    ),
    "called_by": (called_by, "SELECT l_suppkey AS target, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY 1"),
    "entity_search": (entity_search, "SELECT p_partkey AS id, p_brand AS type, p_name AS name FROM part WHERE contains(lower(p_name), 'a') AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') ORDER BY name, id LIMIT 20"),
    "service_graph": (
        service_graph,
        r"""WITH p AS (SELECT regexp_extract(url, 'https?://([^/:]+)', 1) AS dst, CASE WHEN starts_with(url, 'https') THEN 'CALLS' ELSE 'MENTIONS' END AS type, page_id FROM pages)
        SELECT regexp_extract(dst, '\.([a-z]+)$', 1) AS src, dst, type, count(*) AS n, min(page_id) AS first FROM p GROUP BY ALL""",
    ),
    "file_graph": (file_graph, "SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, 'CALLS' AS type, l_linestatus AS call_type, l_returnflag AS route_path, l_linenumber AS source_line FROM lineitem"),
    "file_relations": (file_relations, f"WITH {_E} SELECT file, sum(c)::BIGINT AS calls, sum(d)::BIGINT AS called FROM (SELECT src AS file, 1 AS c, 0 AS d FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1"),
}
