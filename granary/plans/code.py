"""Queries of chunking and extraction. Sources are written from the pages' urls, markdown from the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import chunking as C
from granary.operators import extract as X
from granary.plans.text import doc_uri, tokens_sql
from granary.sources.datasource import register
from granary.sources.tables import shared_folder, table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", doc_uri().alias("uri"), "text", "source")


def _digest(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "ordinal", "chunk_id", "start", "end", "kind", "name", F.sha2("text", 256).alias("text_sha256"))


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(C.line_chunks(_docs(spark, sf), 128, 16))


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their second line and each one that begins with a vowel as headings."""
    text = F.regexp_replace(F.regexp_replace("text", r"\n([AEIOU])", "\n\n## $1"), r"^([A-D])", "# $1")
    return _docs(spark, sf).withColumn("text", text)


def md_sections(spark: SparkSession, sf: str) -> DataFrame:
    return C.markdown_sections(markdown(spark, sf)).select("doc_id", F.col("section").cast("long").alias("section"), "heading", "level", F.sha2("text", 256).alias("text_sha256"))


def md_chunks(spark: SparkSession, sf: str) -> DataFrame:
    sections = C.markdown_sections(markdown(spark, sf)).withColumn("uri", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("section").cast("string")))
    return _digest(C.section_chunks(sections, 64))


def sibling_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of a document joined as long as 128 tokens allow."""
    sections = C.markdown_sections(markdown(spark, sf)).select("doc_id", F.col("section").cast("int").alias("ordinal"), "text")
    return C.merged_siblings(sections, 128).select("doc_id", "ordinal", "first", "last", "n_tokens", F.sha2("text", 256).alias("text_sha256"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn"))
    return t.select(F.concat(F.lit("slack://"), F.col("conv_id").cast("string")).alias("uri"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 2, "side").alias("thread"), F.when(F.col("turn") > 0, ts).alias("ts"), F.col("role").alias("speaker"), "text")


def thread_format(spark: SparkSession, sf: str) -> DataFrame:
    return C.threads(_messages(spark, sf)).select("uri", "thread", F.sha2("text", 256).alias("text_sha256"), "n", F.array_join("speakers", ",").alias("speakers"))


def thread_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = _messages(spark, sf).select("doc_id", "pos", F.concat("speaker", F.lit(": "), "text").alias("line"))
    return C.thread_chunks(rows, 128).select("doc_id", "ordinal", "first", "last", F.sha2("text", 256).alias("text_sha256"))


def chat_source(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as an export of seven channels; those of two channels read by the data source and cut by the
    table function."""
    register(spark)
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    t = table(spark, sf, "conversations")
    said = F.struct("turn", F.struct(F.lit("message").alias("type"), F.col("role").alias("user"), "text", F.col("conv_id").cast("string").alias("thread_ts")).alias("m"))
    talks = t.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(said)), lambda x: x.m)).alias("value"))
    talks.select("value", (F.col("conv_id") % 7).alias("channel")).write.partitionBy("channel").text(folder)
    read = spark.read.format("chat_export").load(folder).filter(F.col("channel").isin("channel=1", "channel=3"))
    rows = read.select(F.col("thread").cast("long").alias("doc_id"), "pos", F.concat("speaker", F.lit(": "), "text").alias("line"))
    name = f"messages_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    chunks = spark.sql(f"SELECT doc_id, ordinal, first, last, text FROM chunk_messages(TABLE({name}) PARTITION BY doc_id ORDER BY (pos), 128)")
    return chunks.select("doc_id", "ordinal", "first", "last", F.sha2("text", 256).alias("text_sha256"))


def word_windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.windows(_docs(spark, sf), 100, 10).select("doc_id", "window", F.sha2("text", 256).alias("text_sha256"))


def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.token_windows(_docs(spark, sf), 160, 16).select("doc_id", "ordinal", "first", "last", F.sha2("text", 256).alias("text_sha256"))


OTHER = "https://b.example/x"


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """A source file for each page, in one of four languages, that calls its url in one of six ways, by the url's hash:
    plainly; in a comment only; with a built url; behind a string with comment marks; with a url joined from two parts;
    and around another call."""
    u, k, way = F.col("url"), F.col("page_id"), F.ascii(F.md5("url")) % 6
    verb = F.element_at(F.array(*map(F.lit, ("get", "post", "delete"))), (k % 3 + 1).cast("int"))
    q = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    def ways(*made) -> F.Column:
        out = F.lit(None).cast("string")
        for n, m in enumerate(made):
            out = F.when(way == n, q(*m)).otherwise(out)
        return out

    head = F.when(way % 2 == 1, '("net/http") // import "no"').otherwise('"net/http"')
    py, go, cs = ("session.", verb), ("httpClient.", F.initcap(verb)), ("client.", F.initcap(verb), "Async")
    python = q("import os\nimport http_tools.client\n\ndef call_", k.cast("string"), "(session):\n    ", ways(
        (*py, '("', u, '")'), ("# ", *py, '("', u, '")'), (*py, '(f"', u, '/{k}")'), ('t = "# \\" ("; ', *py, '("', u, '")'), (*py, '("', u, '" + x)'), (*py, '("', u, f'", data=f(session.get("{OTHER}")))')), "\n    return os.name\n")
    golang = q("package main\nimport ", head, "\n\nfunc call() {\n\t", ways(
        (*go, '("', u, '")'), ("// ", *go, '("', u, '")'), (*go, '(fmt.Sprintf("', u, '/%d", k))'), ('s := "/* \\" ("; ', *go, '("', u, '") // */'), (*go, '("', u, '" + x)'), (*go, '("', u, f'", f(http.Get("{OTHER}")))')), "\n}\n")
    script = q("import axios from 'axios'; // import x from 'no'\n\nexport async function call() {\n  ", ways(
        ("await axios.", verb, "('", u, "');"), ("// await axios.", verb, "('", u, "');"), ("await axios.", verb, "(`", u, "/${k}`);"), ("const t = '// ` {'; await axios.", verb, "('", u, "');"), ("await axios.", verb, "('", u, "' + x);"), ("fetch('", u, "', {headers: {a: '}'}, body: await axios.get('" + OTHER + "'), method: \"", verb, '"});')), "\n}\n")
    sharp = q("using System.Net;\n\nclass C {\n  void Call() { ", ways(
        (*cs, '("', u, '");'), ("// ", *cs, '("', u, '");'), (*cs, '($"', u, '/{k}");'), ('var t = "/* {"; ', *cs, '("', u, '"); // */'), (*cs, '("', u, '" + x);'), (*cs, '("', u, f'", F(client.GetAsync("{OTHER}")));')), "\n  }\n}\n")
    language = F.element_at(F.array(*map(F.lit, ("python", "go", "typescript", "csharp"))), (k % 4 + 1).cast("int"))
    content = F.when(k % 4 == 0, python).when(k % 4 == 1, golang).when(k % 4 == 2, script).otherwise(sharp)
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("src/f"), k.cast("string")).alias("path"), language.alias("language"), content.alias("content"))


def extract_calls(spark: SparkSession, sf: str) -> DataFrame:
    return X.service_calls(sources(spark, sf))


def extract_imports(spark: SparkSession, sf: str) -> DataFrame:
    return X.imports(sources(spark, sf)).groupBy("module").agg(F.count("*").alias("n"))


def _chunked(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's source, and beside its short call a function that says the page's whole html, line by line."""
    k = F.col("page_id")
    body = F.transform(F.split(F.regexp_replace("html", r"[^A-Za-z0-9 .\n>]", ""), "[\n>]"), lambda x: F.concat(F.lit("    say "), x))
    opened = F.when(k % 4 == 0, F.concat(F.lit('\ndef page():\n    """\n'), F.array_join(body, "\n"), F.lit('\n    """\n')))
    braces = F.when(k % 4 == 1, F.lit("\nfunc page() {\n")).when(k % 4 == 2, F.lit("\nfunction page() {\n")).otherwise(F.lit("\nclass Page {\n"))
    whole = F.coalesce(opened, F.concat(braces, F.array_join(body, "\n"), F.lit("\n}\n")))
    html = table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html")).select("page_id", whole.alias("page"))
    return sources(spark, sf).join(html, "page_id").select(F.col("page_id").alias("doc_id"), F.col("path").alias("uri"), "language", F.concat("content", "page").alias("text"))


def code_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(C.code_chunks(_chunked(spark, sf), 128, 16))


def code_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(C.tree_chunks(_chunked(spark, sf), 64))


def python_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(C.code_chunks(_chunked(spark, sf).filter("language = 'python'"), 128, 16))


def talk_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as export JSON, as an object with messages, as lines, or as plain text, and parsed."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.translate("text", "\n:", "  ").alias("text"))
    item = F.struct("turn", F.struct(F.when(F.col("turn") != 1, "message").otherwise("join").alias("type"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("user"), F.col("role").alias("username"), "text", F.col("turn").cast("string").alias("ts")).alias("m"), F.concat("role", F.lit(": "), "text").alias("line"))
    talks = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    listed = F.transform("l", lambda x: x.m)
    k = F.col("conv_id") % 4
    content = F.when(k == 0, F.to_json(listed)).when(k == 1, F.to_json(F.struct(listed.alias("messages")))).when(k == 2, F.array_join(F.transform("l", lambda x: x.line), "\n")).otherwise(F.concat(F.lit("  "), F.get("l", 0)["m"]["text"], F.lit("\n")))
    made = talks.select(F.concat(F.lit("talk://"), "conv_id").alias("uri"), F.col("conv_id").alias("doc_id"), content.alias("content"))
    return C.messages(made).select("doc_id", "pos", F.unix_timestamp("ts").alias("ts"), "speaker", "text")


def confidences(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    kind = F.element_at(F.array(*map(F.lit, ("string", "formatted_string", "template_string", "identifier"))), (F.col("page_id") % 4 + 1).cast("int"))
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return p.select("page_id", X.confidence(url, kind).alias("confidence"))


def extract_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Route files: a decorator for each order line's part."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    part = F.concat(F.lit("@app."), F.when(F.col("l_linenumber") == 1, "get").otherwise("post"), F.lit("('/parts/{id}/"), F.col("l_suppkey").cast("string"), F.lit("')\ndef f(): ..."))
    files = l.groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.array_join(F.array_sort(F.collect_list(part)), "\n").alias("content"))
    return X.routes(files).groupBy("method", "route").agg(F.count("*").alias("n"))


def extract_names(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("The "), "event_type", F.lit("_service met INC-"), F.col("user_id").cast("string"), F.lit(" says @user"), F.col("user_id").cast("string")).alias("text"))
    return X.named_things(e).groupBy("type", "name").agg(F.count("*").alias("n"))


def queue_topics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.concat(F.lit("bus.publish('"), "event_type", F.lit("')\nbus.subscribe(['u."), (F.col("user_id") % 5).cast("string"), F.lit("'])\nch = grpc.insecure_channel('svc-"), (F.col("user_id") % 3).cast("string"), F.lit(":50051')")).alias("content"))
    return X.queue_calls(e).groupBy("kind", "target").agg(F.count("*").alias("n"))


_MD = r"regexp_replace(regexp_replace(text, '\n([AEIOU])', chr(10) || chr(10) || '## \1', 'g'), '^([A-D])', '# \1')"

_SECTIONS = rf"""WITH d AS (SELECT doc_id, string_split({_MD}, chr(10)) AS l FROM documents), l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\s+\S') THEN 1 ELSE 0 END AS head FROM l),
n AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY pos) AS section, sum(head) OVER (PARTITION BY doc_id) AS heads FROM m),
g AS (SELECT doc_id, section, heads, string_agg(line, chr(10) ORDER BY pos) AS raw, arg_min(line, pos) AS line FROM n GROUP BY ALL),
t AS (SELECT *, CASE WHEN heads = 0 THEN raw ELSE regexp_replace(raw, '^\s+|\s+$', '', 'g') END AS text FROM g),
sec AS (SELECT doc_id, section, text, CASE WHEN heads = 0 THEN '' WHEN section = 0 THEN '(preamble)' ELSE regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1) END AS heading,
CASE WHEN section = 0 THEN 0 ELSE length(regexp_extract(line, '^(#{{1,6}})', 1)) END AS level FROM t WHERE heads = 0 OR section > 0 OR text <> '')"""

QUERIES = {
    "line_chunks": (
        line_chunks,
        f"""WITH RECURSIVE d AS (SELECT doc_id, source || '/' || doc_id AS uri, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        l AS (SELECT doc_id, uri, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM d),
        t AS (SELECT *, {tokens_sql('line')} AS size, strlen(line) + 1 AS bytes FROM l),
        s AS (SELECT *, sum(size) OVER w - size AS s, sum(bytes) OVER w - bytes AS b FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        m AS (SELECT *, min(i) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN 16 PRECEDING AND CURRENT ROW) AS back FROM s),
        r(doc_id, i, first, ordinal) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM m WHERE i = 0
          UNION ALL SELECT m.doc_id, m.i, CASE WHEN m.s - f.s + m.size > 128 AND m.i > r.first THEN m.back ELSE r.first END, CASE WHEN m.s - f.s + m.size > 128 AND m.i > r.first THEN ordinal + 1 ELSE ordinal END
          FROM r JOIN m ON m.doc_id = r.doc_id AND m.i = r.i + 1 JOIN m f ON f.doc_id = r.doc_id AND f.i = r.first),
        c AS (SELECT doc_id, ordinal, min(first) AS first, max(i) AS last FROM r GROUP BY ALL),
        p AS (SELECT c.doc_id, ordinal, min(uri) AS uri, min(b) AS start, string_agg(line, chr(10) ORDER BY i) AS text FROM c JOIN m ON m.doc_id = c.doc_id AND m.i BETWEEN c.first AND c.last GROUP BY ALL)
        SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, sha256(uri || ':' || start || ':' || (start + strlen(text))) AS chunk_id, CAST(start AS BIGINT) AS start, CAST(start + strlen(text) AS BIGINT) AS "end",
        'segment' AS kind, '<file_segment>' AS name, sha256(text) AS text_sha256 FROM p""",
    ),
    "md_sections": (md_sections, f"{_SECTIONS} SELECT doc_id, CAST(section AS BIGINT) AS section, heading, level, sha256(text) AS text_sha256 FROM sec"),
    "md_chunks": (
        md_chunks,
        rf"""{_SECTIONS.replace("WITH ", "WITH RECURSIVE ", 1)}, z AS (SELECT doc_id, section, text, {tokens_sql('text')} AS size FROM sec),
        u AS (SELECT doc_id, section, unnest(regexp_split_to_array(text, '

+')) AS para, generate_subscripts(regexp_split_to_array(text, '

+'), 1) AS j FROM z WHERE size > 64),
        v AS (SELECT *, {tokens_sql('para')} AS size FROM u),
        w AS (SELECT *, sum(size) OVER o - size AS s, sum(strlen(para) + 2) OVER o - strlen(para) - 2 AS b, max(j) OVER (PARTITION BY doc_id, section) AS paras FROM v WINDOW o AS (PARTITION BY doc_id, section ORDER BY j)),
        r(doc_id, section, j, first) AS (SELECT doc_id, section, j, j FROM w WHERE j = 1
          UNION ALL SELECT w.doc_id, w.section, w.j, CASE WHEN w.s - f.s + w.size > 64 THEN w.j ELSE r.first END FROM r JOIN w ON w.doc_id = r.doc_id AND w.section = r.section AND w.j = r.j + 1 JOIN w f ON f.doc_id = r.doc_id AND f.section = r.section AND f.j = r.first),
        c AS (SELECT r.doc_id, r.section, r.first, max(r.j) AS last, string_agg(para, chr(10) || chr(10) ORDER BY r.j) AS text, min(b) AS b, max(size) > 64 AS over, max(paras) AS paras FROM r JOIN w ON w.doc_id = r.doc_id AND w.section = r.section AND w.j = r.j GROUP BY ALL),
        ll AS (SELECT doc_id, section, first, b, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM c WHERE over),
        lt AS (SELECT *, {tokens_sql('line')} AS size, strlen(line) + 1 AS bytes FROM ll),
        lm AS (SELECT *, sum(size) OVER o - size AS s, sum(bytes) OVER o - bytes AS lb FROM lt WINDOW o AS (PARTITION BY doc_id, section, first ORDER BY i)),
        lr(doc_id, section, first, i, a) AS (SELECT doc_id, section, first, i, i FROM lm WHERE i = 1
          UNION ALL SELECT m.doc_id, m.section, m.first, m.i, CASE WHEN m.s - f.s + m.size > 64 THEN m.i ELSE lr.a END FROM lr JOIN lm m ON m.doc_id = lr.doc_id AND m.section = lr.section AND m.first = lr.first AND m.i = lr.i + 1
          JOIN lm f ON f.doc_id = lr.doc_id AND f.section = lr.section AND f.first = lr.first AND f.i = lr.a),
        lc AS (SELECT lr.doc_id, lr.section, lr.first, a, min(b + lb) AS b, string_agg(line, chr(10) ORDER BY lr.i) AS text FROM lr JOIN lm ON lm.doc_id = lr.doc_id AND lm.section = lr.section AND lm.first = lr.first AND lm.i = lr.i GROUP BY ALL),
        every AS (SELECT doc_id, section, 0 AS first, 0 AS a, text, 0 AS b, strlen(text) AS e, 'section' AS kind FROM z WHERE size <= 64
          UNION ALL SELECT c.doc_id, c.section, first, 0, c.text, b, CASE WHEN last = paras THEN strlen(z.text) ELSE b + strlen(c.text) END, CASE WHEN last = paras THEN 'section' ELSE 'partial' END FROM c JOIN z ON z.doc_id = c.doc_id AND z.section = c.section WHERE NOT over
          UNION ALL SELECT doc_id, section, first, a, text, b, b + strlen(text), 'partial' FROM lc)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id, section ORDER BY first, a) - 1 AS INTEGER) AS ordinal, sha256(doc_id || '/' || CAST(section AS BIGINT) || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT)) AS chunk_id,
        CAST(b AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", kind, '' AS name, sha256(text) AS text_sha256 FROM every""",
    ),
    "sibling_chunks": (
        sibling_chunks,
        f"""{_SECTIONS.replace("WITH ", "WITH RECURSIVE ", 1)}, z AS (SELECT doc_id, CAST(section AS INTEGER) AS section, text, {tokens_sql('text')} AS size, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS i FROM sec),
        r(doc_id, i, total, part) AS (SELECT doc_id, i, size, 0 FROM z WHERE i = 1
          UNION ALL SELECT z.doc_id, z.i, CASE WHEN total + size > 128 THEN size ELSE total + size END, CASE WHEN total + size > 128 THEN part + 1 ELSE part END FROM r JOIN z ON z.doc_id = r.doc_id AND z.i = r.i + 1)
        SELECT doc_id, part AS ordinal, min(section) AS first, max(section) AS last, CAST(sum(size) AS BIGINT) AS n_tokens, sha256(string_agg(text, chr(10) ORDER BY section)) AS text_sha256 FROM r JOIN z USING (doc_id, i) GROUP BY ALL""",
    ),
    "thread_format": (
        thread_format,
        """WITH m AS (SELECT 'slack://' || conv_id AS uri, CASE WHEN turn % 3 = 2 THEN 'side' ELSE 'main' END AS thread, turn, role,
          CASE WHEN turn > 0 THEN '[' || strftime(make_timestamp(CAST((1704067200 + conv_id * 60 + turn) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '] ' ELSE '' END || role || ': ' || text AS line FROM conversations)
        SELECT uri, thread, sha256(string_agg(line, chr(10) ORDER BY turn)) AS text_sha256, count(*) AS n, array_to_string(list_sort(list_distinct(list(role))), ',') AS speakers FROM m GROUP BY ALL""",
    ),
    "thread_split": (
        thread_split,
        f"""WITH RECURSIVE l AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role || ': ' || text AS line FROM conversations),
        m AS (SELECT *, {tokens_sql('line')} AS size FROM l),
        r(doc_id, i, first, total, ordinal) AS (SELECT doc_id, i, i, size, 0 FROM m WHERE i = 0
          UNION ALL SELECT m.doc_id, m.i, CASE WHEN total + m.size > 128 THEN r.i ELSE first END, CASE WHEN total + m.size > 128 THEN o.size ELSE total END + m.size, CASE WHEN total + m.size > 128 THEN ordinal + 1 ELSE ordinal END
          FROM r JOIN m ON m.doc_id = r.doc_id AND m.i = r.i + 1 JOIN m o ON o.doc_id = r.doc_id AND o.i = r.i),
        c AS (SELECT doc_id, ordinal, min(first) AS first, max(i) AS last FROM r GROUP BY ALL)
        SELECT c.doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, sha256(string_agg(line, chr(10) ORDER BY i)) AS text_sha256
        FROM c JOIN m ON m.doc_id = c.doc_id AND m.i BETWEEN c.first AND c.last GROUP BY ALL""",
    ),
    "chat_source": (
        chat_source,
        f"""WITH RECURSIVE l AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role || ': ' || text AS line FROM conversations WHERE conv_id % 7 IN (1, 3)),
        m AS (SELECT *, {tokens_sql('line')} AS size FROM l),
        r(doc_id, i, first, total, ordinal) AS (SELECT doc_id, i, i, size, 0 FROM m WHERE i = 0
          UNION ALL SELECT m.doc_id, m.i, CASE WHEN total + m.size > 128 THEN r.i ELSE first END, CASE WHEN total + m.size > 128 THEN o.size ELSE total END + m.size, CASE WHEN total + m.size > 128 THEN ordinal + 1 ELSE ordinal END
          FROM r JOIN m ON m.doc_id = r.doc_id AND m.i = r.i + 1 JOIN m o ON o.doc_id = r.doc_id AND o.i = r.i),
        c AS (SELECT doc_id, ordinal, min(first) AS first, max(i) AS last FROM r GROUP BY ALL)
        SELECT c.doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, sha256(string_agg(line, chr(10) ORDER BY i)) AS text_sha256
        FROM c JOIN m ON m.doc_id = c.doc_id AND m.i BETWEEN c.first AND c.last GROUP BY ALL""",
    ),
    "word_windows": (
        word_windows,
        r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
        k AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 100) / 90.0)) AS BIGINT) + 1)) AS k FROM w)
        SELECT doc_id, CAST(k AS INTEGER) AS "window", sha256(coalesce(array_to_string(w[k * 90 + 1 : k * 90 + 100], ' '), '')) AS text_sha256 FROM k""",
    ),
    "token_windows": (
        token_windows,
        rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS l FROM documents),
        l AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i FROM d), t AS (SELECT *, {tokens_sql('word')} AS size FROM l),
        s AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY i) - size AS s FROM t),
        m AS (SELECT *, min(i) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN 16 PRECEDING AND CURRENT ROW) AS back FROM s),
        r(doc_id, i, first, s, ordinal) AS (SELECT doc_id, i, i, s, 0 FROM m WHERE i = 0
          UNION ALL SELECT m.doc_id, m.i, CASE WHEN m.s - r.s + m.size > 160 THEN m.back ELSE r.first END, CASE WHEN m.s - r.s + m.size > 160 THEN b.s ELSE r.s END, CASE WHEN m.s - r.s + m.size > 160 THEN ordinal + 1 ELSE ordinal END
          FROM r JOIN m ON m.doc_id = r.doc_id AND m.i = r.i + 1 JOIN m b ON b.doc_id = m.doc_id AND b.i = m.back),
        c AS (SELECT doc_id, ordinal, min(first) AS first, max(i) AS last FROM r GROUP BY ALL)
        SELECT c.doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, sha256(string_agg(word, ' ' ORDER BY i)) AS text_sha256
        FROM c JOIN m ON m.doc_id = c.doc_id AND m.i BETWEEN c.first AND c.last GROUP BY ALL""",
    ),
    "extract_calls": (
        extract_calls,
        f"""WITH p AS (SELECT 'src/f' || page_id AS source_file, CASE WHEN page_id % 4 < 2 THEN 5 ELSE 4 END AS line, (['GET', 'POST', 'DELETE'])[page_id % 3 + 1] AS method, url, page_id % 4 AS k, ascii(md5(url)) % 6 AS way FROM pages)
        SELECT source_file, line, method, CASE way WHEN 2 THEN url || (['/{{x}}', '/%d', '/${{k}}', '/{{k}}'])[k + 1] ELSE url END AS url, CASE WHEN way IN (2, 4) THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM p WHERE way IN (0, 2, 3, 5) OR way = 4 AND k = 1
        UNION ALL SELECT source_file, line, 'GET', '{OTHER}', 0.9::DOUBLE FROM p WHERE way = 5""",
    ),
    "extract_imports": (
        extract_imports,
        """WITH m AS (SELECT unnest(CASE page_id % 4 WHEN 0 THEN ['os', 'http_tools.client'] WHEN 1 THEN ['net/http'] WHEN 2 THEN ['axios'] ELSE ['System.Net'] END) AS module FROM pages) SELECT module, count(*) AS n FROM m GROUP BY 1""",
    ),
    "code_chunks": (code_chunks, None),
    "python_chunks": (python_chunks, None),
    "code_pieces": (code_pieces, None),
    "talk_messages": (
        talk_messages,
        r"""WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '[\n:]', ' ', 'g') AS text FROM conversations),
        j AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CAST(turn AS BIGINT) AS ts, role, text FROM t WHERE conv_id % 4 < 2 AND turn <> 1),
        l AS (SELECT conv_id, turn, role, trim(text) AS text FROM t WHERE conv_id % 4 = 2 AND regexp_matches(text, '\S')),
        w AS (SELECT conv_id, arg_min(text, turn) AS text FROM t WHERE conv_id % 4 = 3 GROUP BY 1)
        SELECT conv_id AS doc_id, CAST(pos AS INTEGER) AS pos, ts, role AS speaker, text FROM j UNION ALL
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER), NULL, role, text FROM l UNION ALL
        SELECT conv_id, 0, NULL, 'unknown', regexp_replace(text, '^\s+|\s+$', '', 'g') FROM w WHERE regexp_matches(text, '\S')""".replace("\\\\", "\\"),
    ),
    "confidences": (
        confidences,
        """SELECT page_id, CASE WHEN page_id % 4 = 0 AND page_id % 3 <> 0 THEN 0.9::DOUBLE WHEN page_id % 4 IN (1, 2) THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM pages""",
    ),
    "extract_routes": (extract_routes, "SELECT CASE WHEN l_linenumber = 1 THEN 'GET' ELSE 'POST' END AS method, '/parts/{id}/' || l_suppkey AS route, count(*) AS n FROM lineitem GROUP BY ALL"),
    "extract_names": (
        extract_names,
        """WITH e AS (SELECT event_id, unnest([{'t': 'SERVICE', 'n': event_type || '-service'}, {'t': 'INCIDENT', 'n': 'inc-' || user_id}, {'t': 'PERSON', 'n': 'user' || user_id}]) AS x FROM events)
        SELECT x.t AS type, x.n AS name, count(*) AS n FROM e WHERE x.t <> 'INCIDENT' OR length(x.n) >= 6 GROUP BY ALL""",
    ),
    "queue_topics": (
        queue_topics,
        """WITH e AS (SELECT unnest([{'k': 'publish', 't': event_type}, {'k': 'subscribe', 't': 'u.' || user_id % 5}, {'k': 'grpc', 't': 'svc-' || user_id % 3}]) AS x FROM events) SELECT x.k AS kind, x.t AS target, count(*) AS n FROM e GROUP BY ALL""",
    ),
}
