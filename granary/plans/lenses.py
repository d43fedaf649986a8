"""Queries of the lens table, of conversations' metadata, and of workers and files by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import lens as L
from granary.operators import linking, tasks
from granary.plans.lens import NOW, workers
from granary.plans.text import paths, paths_sql
from granary.sources.tables import table

#: Extract and ignore patterns by lens; one of them is no expression.
PATTERNS = {"interfaces": (("economy", "small"), ("_1", "#7")), "flows": (("brass", "(anodized"), ()), "boundaries": ((), ("steel",)), "contracts": (("copper$", "plated"), ("9",)), "trust-zones": ((), ("Brand#[1-4]",))}
SEARCHED = ("que[a-z]", "ing ", "ent[aeiou]")


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as symbols with numbers for kinds."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.col("p_type").alias("name"), F.col("p_brand").alias("uri"), (F.col("p_partkey") % 26 + 1).cast("int").alias("kind"), F.col("p_size").alias("line"), F.lit(0).alias("column"))


def lens_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """All lenses over all symbols at once."""
    return L.lens_symbols(numbered(spark, sf), L.lens_table(spark, PATTERNS)).select("lens", "p_partkey", "kind")


def definition_plan(spark: SparkSession, sf: str) -> DataFrame:
    found = L.lens_symbols(numbered(spark, sf), L.lens_table(spark, PATTERNS))
    return L.plan_definitions(found, ("p_partkey",), 50).groupBy("lens", "operation").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


def agent_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What agents' requests ask for, by lens and operation."""
    agent = F.element_at(F.array(*map(F.lit, L.AGENT_LENSES)), (F.col("user_id") % 4 + 1).cast("int"))
    asked = L.with_lens(L.agent_lenses(table(spark, sf, "events").select(agent.alias("agent"))), L.lens_table(spark).drop("agent"))
    return asked.select("agent", "lens", "folder", F.explode("operations").alias("operation")).groupBy("agent", "lens", "folder", "operation").agg(F.count("*").alias("n"))


def report_sections(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.element_at(F.array(*(F.lit(n) for n, *_ in L.LENSES)), (F.col("event_id") % 5 + 1).cast("int")).alias("lens"),
        F.element_at(F.array(*map(F.lit, ("handler", "method", "module", "class"))), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"),
        F.concat("event_type", F.when(F.col("user_id") % 7 == 0, "Auth").when(F.col("user_id") % 7 == 1, "Role").otherwise("")).alias("name"),
        F.when(F.col("user_id") % 3 == 0, "reads the JWT").alias("description"), (F.col("user_id") % 11 == 0).alias("trusted"),
    )
    groups = L.report_groups(*(F.col(c) for c in ("lens", "kind", "name", "description", "trusted")))
    return e.select("lens", F.explode(groups).alias("section")).groupBy("lens", "section").agg(F.count("*").alias("n"))


def structural_lines(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return L.structural_search(files, SEARCHED, 40).select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "pattern")


def pattern_sets(spark: SparkSession, sf: str) -> DataFrame:
    made = F.create_map(F.lit("python"), F.array(F.lit("class $N"), F.lit("def $N")), F.lit("go"), F.array(F.lit("func $N")), F.lit("generic"), F.array(F.lit("$N(")))
    files = paths(table(spark, sf, "pages")).select(T.language_of(F.col("path")).alias("language"), made.alias("patterns"))
    return files.select("language", F.array_join(L.pattern_set(files, F.col("language")), ",").alias("patterns")).groupBy("language", "patterns").agg(F.count("*").alias("n"))


def focus_files(spark: SparkSession, sf: str) -> DataFrame:
    globs = L.focus_patterns("en", ("**/index.{ts,go}",), ("*.java",))
    return L.first_matching_files(paths(table(spark, sf, "pages")), [L.glob_expression(g) for g in globs], "node_modules", 200)


def sorted_index(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "documents").select(F.col("lang").alias("lens"), F.initcap("source").alias("focus")).distinct()
    return pairs.orderBy(*L.index_order())


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    host = T.url_service(F.col("url"))
    return table(spark, sf, "pages").select(F.regexp_extract(host, r"([a-z0-9-]+)\.example\.", 1).alias("name")).filter("name <> ''").distinct()


def service_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Known services in texts that have a page's url, and every third one a word before it."""
    said = F.concat(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Ask "), F.upper(F.regexp_extract("url", r"([a-z0-9-]+)\.example\.", 1)), F.lit(" about "))).otherwise(""), "url")
    texts = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), said.alias("text"))
    return linking.service_references(texts, _registry(spark, sf))


def talk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Who is mentioned in each conversation, and in how many turns."""
    t = table(spark, sf, "conversations").select("conv_id", F.concat(F.lit("@"), "role", F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" cc @team."), (F.col("turn") % 3).cast("string")).alias("text"))
    rows = t.select("conv_id", F.explode(F.array_distinct(T.mentions(F.col("text")))).alias("mention"))
    return rows.groupBy("conv_id", "mention").agg(F.count("*").alias("turns"))


def _pending(spark: SparkSession, sf: str) -> DataFrame:
    return workers(spark, sf).filter("seq % 5 = 0").select("name", F.concat(F.lit("t"), F.col("seq").cast("string")).alias("task"))


def worker_states(spark: SparkSession, sf: str) -> DataFrame:
    w = workers(spark, sf).withColumn("current_task", F.when(F.col("status") == "executing", F.concat(F.lit("x"), F.col("seq").cast("string"))))
    return tasks.worker_states(w, _pending(spark, sf), F.lit(NOW).cast("timestamp"))


def bus_counts(spark: SparkSession, sf: str) -> DataFrame:
    waiting = table(spark, sf, "orders").filter("o_orderstatus = 'O'")
    return tasks.bus_counts(workers(spark, sf), _pending(spark, sf), waiting)


def tasks_by_status(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    return tasks.with_status(o, "open")


def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What one pass over the documents read, observed while their chunk ids are made."""
    docs, seen = table(spark, sf, "documents"), Observation("ingest")
    size = F.octet_length("text")
    observed = docs.observe(seen, F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(F.coalesce(size, F.lit(0)) == 0).alias("empty"))
    observed.select(T.chunk_id(F.col("source"), F.lit(0), size)).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["files"], seen.get["bytes"], seen.get["empty"])], "files long, bytes long, empty long")


def _lens_sql() -> str:
    rows = []
    for name, _, _, _, kinds in L.LENSES:
        extract, ignore = (["|".join(map(L.safe_pattern, p)) for p in PATTERNS[name]])
        tests = [f"kind IN ({', '.join(str(L.KIND_NUMBERS[k]) for k in kinds)})"] if kinds else []
        tests += [f"regexp_matches(name, '(?i)({extract})')"] if extract else []
        tests += [f"NOT regexp_matches({c}, '(?i)({ignore})')" for c in ("name", "uri")] if ignore else []
        rows.append(f"SELECT '{name}' AS lens, p_partkey, kind, line FROM s WHERE {' AND '.join(tests) or 'true'}")
    return "s AS (SELECT p_partkey, p_type AS name, p_brand AS uri, CAST(p_partkey % 26 + 1 AS INTEGER) AS kind, p_size AS line FROM part), f AS (" + " UNION ALL ".join(rows) + ")"


def _agents_sql() -> str:
    by = {n: (d, o) for n, _, d, o, _ in L.LENSES}
    rows = [f"({k}, '{a}', '{n}', '{by[n][0]}', '{op}')" for k, (a, names) in enumerate(L.AGENT_LENSES.items()) for n in names for op in by[n][1]]
    return f"SELECT agent, lens, folder, operation, count(*) AS n FROM events JOIN (VALUES {', '.join(rows)}) v(k, agent, lens, folder, operation) ON user_id % 4 = k GROUP BY ALL"


def _search_sql() -> str:
    place = lambda p: f"CASE WHEN regexp_matches(line_text, '{p}') THEN strpos(line_text, regexp_extract(line_text, '{p}')) END"
    each = ", ".join(f"{{'k': {k}, 'p': '{p}', 'c': {place(p)}}}" for k, p in enumerate(SEARCHED))
    return f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    h AS (SELECT path, line, unnest([{each}]) AS m FROM l), o AS (SELECT path, line, m.c AS c, arg_min(m.p, m.k) AS pattern FROM h WHERE m.c IS NOT NULL GROUP BY ALL),
    f AS (SELECT DISTINCT path FROM o ORDER BY path LIMIT 40) SELECT path, CAST(line AS BIGINT) AS line, CAST(c AS BIGINT) AS "column", pattern FROM o WHERE path IN (SELECT path FROM f)"""


def _focus_sql() -> str:
    globs = [L.glob_expression(g) for g in L.focus_patterns("en", ("**/index.{ts,go}",), ("*.java",))]
    cases = " ".join(f"WHEN regexp_matches(path, '{g}') THEN {k}" for k, g in enumerate(globs))
    return f"WITH f AS (SELECT DISTINCT path FROM ({paths_sql()})), g AS (SELECT path, CASE {cases} END AS pattern FROM f) SELECT path, pattern FROM g WHERE pattern IS NOT NULL AND NOT contains(path, 'node_modules') ORDER BY pattern, path LIMIT 200"


_W = """w AS (SELECT user_id AS seq, 'w' || user_id AS name, CASE event_id % 3 WHEN 0 THEN 'polling' WHEN 1 THEN 'idle' ELSE 'executing' END AS status, ts AS last_activity
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)"""

QUERIES = {
    "lens_symbols": (lens_symbols, f"WITH {_lens_sql()} SELECT lens, p_partkey, kind FROM f"),
    "definition_plan": (
        definition_plan,
        f"WITH {_lens_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY lens ORDER BY p_partkey) AS k FROM f) SELECT lens, 'goToDefinition' AS operation, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM n WHERE k <= 50 GROUP BY 1",
    ),
    "agent_plan": (agent_plan, _agents_sql()),
    "report_sections": (
        report_sections,
        """WITH e AS (SELECT (['interfaces', 'flows', 'boundaries', 'contracts', 'trust-zones'])[event_id % 5 + 1] AS lens, (['handler', 'method', 'module', 'class'])[event_id % 4 + 1] AS kind,
          user_id % 7 = 0 OR user_id % 3 = 0 AS auth, user_id % 11 = 0 OR user_id % 7 = 1 AS authz FROM events),
        g AS (SELECT lens, unnest(CASE lens WHEN 'flows' THEN [CASE kind WHEN 'handler' THEN 'Entry Points' WHEN 'method' THEN 'Functions' ELSE 'Other' END]
          WHEN 'boundaries' THEN [CASE kind WHEN 'module' THEN 'Modules' WHEN 'class' THEN 'Classes' ELSE 'Other' END]
          WHEN 'trust-zones' THEN list_filter([CASE WHEN auth THEN 'Authentication' END, CASE WHEN authz THEN 'Authorization' END, CASE WHEN NOT auth AND NOT authz THEN 'Other' END], lambda x: x IS NOT NULL)
          ELSE [upper(kind[1]) || kind[2:] || 's'] END) AS section FROM e) SELECT lens, section, count(*) AS n FROM g GROUP BY ALL""",
    ),
    "structural_lines": (structural_lines, _search_sql()),
    "pattern_sets": (
        pattern_sets,
        f"""WITH l AS (SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM ({paths_sql()})),
        n AS (SELECT coalesce((MAP {{{', '.join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items())}}})[x], 'unknown') AS language FROM l)
        SELECT language, CASE language WHEN 'python' THEN 'class $N,def $N,$N(' WHEN 'go' THEN 'func $N,$N(' ELSE '$N(' END AS patterns, count(*) AS n FROM n GROUP BY ALL""",
    ),
    "focus_files": (focus_files, _focus_sql()),
    "sorted_index": (sorted_index, "SELECT DISTINCT lang AS lens, upper(source[1]) || lower(source[2:]) AS focus FROM documents"),
    "service_mentions": (
        service_mentions,
        r"""WITH g AS (SELECT DISTINCT regexp_extract(url, 'https?://[^/:]*?([a-z0-9-]+)\.example\.', 1) AS service FROM pages WHERE regexp_extract(url, 'https?://[^/:]*?([a-z0-9-]+)\.example\.', 1) <> ''),
        t AS (SELECT page_id AS doc_id, lower(CASE WHEN page_id % 3 = 0 THEN 'Ask ' || upper(regexp_extract(url, '([a-z0-9-]+)\.example\.', 1)) || ' about ' ELSE '' END || url) AS low FROM pages),
        u AS (SELECT doc_id, service FROM t JOIN g ON contains(low, service) UNION ALL SELECT doc_id, h FROM (SELECT doc_id, unnest(regexp_extract_all(low, 'https?://([a-z0-9\-]+)[:\./]', 1)) AS h FROM t) JOIN g ON h = service)
        SELECT doc_id, service, count(*) AS n FROM u GROUP BY ALL""",
    ),
    "talk_metadata": (
        talk_metadata,
        r"""WITH t AS (SELECT conv_id, list_distinct(regexp_extract_all('@' || role || ' ' || coalesce(text, '') || ' cc @team.' || turn % 3, '@[A-Za-z0-9_.-]+')) AS m FROM conversations),
        u AS (SELECT conv_id, unnest(m) AS mention FROM t) SELECT conv_id, mention, count(*) AS turns FROM u GROUP BY ALL""",
    ),
    "worker_states": (
        worker_states,
        f"""WITH {_W} SELECT name, status, CASE WHEN status = 'executing' THEN 'x' || seq END AS current_task,
        CASE WHEN status <> 'executing' THEN CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - CAST(floor(epoch(last_activity)) AS BIGINT) END AS idle_seconds, CASE WHEN seq % 5 = 0 THEN 't' || seq END AS pending_task FROM w""",
    ),
    "bus_counts": (bus_counts, f"WITH {_W} SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS queued_tasks, count(*) FILTER (status = 'polling') AS polling_workers, count(*) FILTER (seq % 5 = 0) AS pending_workers FROM w"),
    "tasks_by_status": (tasks_by_status, "SELECT o_orderkey, 'open' AS status FROM orders WHERE o_orderstatus = 'O'"),
    "ingest_stats": (ingest_stats, "SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (coalesce(text, '') = '') AS empty FROM documents"),
}
