"""Exploration of code symbols through lenses: filters, joins with details, staleness of generated pages, reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import SYMBOL_KINDS
from granary.operators.numbering import numbered

MAX_REFERENCES, MAX_SYMBOLS, MAX_OUTPUT = 20, 50, 500

# Lenses with their agent, output folder, operations and symbol kinds (none: all), and agents' lenses.
LENSES = (
    ("interfaces", "architect", "contracts", ("documentSymbol", "hover"), ("interface", "type", "class", "enum", "module", "namespace")),
    ("flows", "product", "flows", ("findReferences", "goToDefinition"), ()),
    ("boundaries", "architect", "boundaries", ("documentSymbol", "findReferences"), ("module", "namespace")),
    ("contracts", "qa", "contracts", ("hover", "getDiagnostics"), ("interface", "type", "enum", "class")),
    ("trust-zones", "security", "trust-zones", ("findReferences", "goToDefinition"), ()),
)
AGENT_LENSES = {"architect": ("interfaces", "boundaries"), "product": ("flows",), "qa": ("contracts",), "security": ("trust-zones", "contracts")}
# Symbol kinds of lenses as kinds of the language server protocol.
KIND_NUMBERS = {"interface": 11, "type": 26, "class": 5, "function": 12, "method": 6, "property": 7, "variable": 13, "constant": 14, "enum": 10, "module": 2, "namespace": 3}


def lens_table(spark: SparkSession, patterns: dict[str, tuple[Sequence[str], Sequence[str]]] | None = None) -> DataFrame:
    """(lens, agent, folder, operations, kinds, extract, ignore): the lenses as a table. kinds are numbers of the
    protocol; patterns: a project's own extract and ignore patterns by lens."""
    own = patterns or {}
    safe = lambda n, k: [safe_pattern(p) for p in own.get(n, ((), ()))[k]]
    rows = [(n, a, d, list(o), [KIND_NUMBERS[k] for k in kinds], safe(n, 0), safe(n, 1)) for n, a, d, o, kinds in LENSES]
    return spark.createDataFrame(rows, "lens string, agent string, folder string, operations array<string>, kinds array<int>, extract array<string>, ignore array<string>")


def agent_lenses(requests: DataFrame) -> DataFrame:
    """Requests (agent) with a row for each of the agent's lenses; an unknown agent fails the query."""
    known = F.create_map(*[x for a, names in AGENT_LENSES.items() for x in (F.lit(a), F.array(*map(F.lit, names)))])
    names = F.try_element_at(known, F.col("agent"))
    said = F.when(names.isNotNull(), names).otherwise(F.raise_error(F.concat(F.lit("unknown agent: "), F.coalesce("agent", F.lit("null")))))
    return requests.withColumn("lens", F.explode(said))


def with_lens(requests: DataFrame, lenses: DataFrame) -> DataFrame:
    """Requests (lens) with their lens's row; an unknown lens fails the query. Lenses are few and broadcast, so that a lens's
    requests need not meet in one task."""
    joined = requests.join(F.broadcast(lenses.withColumn("__known", F.lit(True))), "lens", "left")
    checked = F.when(F.col("__known"), F.col("lens")).otherwise(F.raise_error(F.concat(F.lit("unknown lens: "), F.coalesce("lens", F.lit("null")))))
    return joined.withColumn("lens", checked).drop("__known")


def safe_pattern(pattern: str) -> str:
    """A pattern as an expression; one that is none means itself."""
    try:
        re.compile(pattern)
    except re.error:
        return re.escape(pattern)
    return pattern


#: Lenses that lens_symbols takes at once: their patterns become one expression.
MAX_LENSES = 200


def lens_symbols(symbols: DataFrame, lenses: DataFrame) -> DataFrame:
    """(lens, and the columns of symbols: uri, name, kind as number ...) of all lenses at once: the kind is among the
    lens's, if it has any; some extract pattern is in the name, if there are any; no ignore pattern in name or uri. A
    symbol's row is read once; each lens's patterns are one literal expression. More than MAX_LENSES lenses are an error."""
    own = [c for c in symbols.columns if c not in ("lens", "kinds", "extract", "ignore")]
    rows = lenses.select("lens", "kinds", "extract", "ignore").limit(MAX_LENSES + 1).collect()
    if len(rows) > MAX_LENSES:
        raise ValueError(f"more than {MAX_LENSES} lenses")
    hit = lambda text, patterns: F.col(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    tests = []
    for r in rows:
        fits = F.col("kind").isin(*r["kinds"]) if r["kinds"] else F.col("kind").between(1, len(SYMBOL_KINDS))
        named = hit("name", r["extract"]) if r["extract"] else F.lit(True)
        tests.append(F.when(fits & named & ~hit("name", r["ignore"]) & ~hit("uri", r["ignore"]), F.lit(r["lens"])))
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return symbols.select(F.explode(found).alias("lens"), *own)


def plan_definitions(symbols: DataFrame, order: Sequence[str], most: int = MAX_SYMBOLS) -> DataFrame:
    """(lens, uri, line, column, operation): goToDefinition calls for the first symbols of each lens."""
    nth = F.row_number().over(Window.partitionBy("lens").orderBy(*order))
    return symbols.withColumn("__n", nth).filter(F.col("__n") <= most).select("lens", "uri", "line", "column", F.lit("goToDefinition").alias("operation"))


def pattern_set(patterns: DataFrame, language: Column) -> Column:
    """The patterns of a language, then the generic ones, of a map of arrays by language in the column patterns."""
    own = lambda key: F.coalesce(F.try_element_at(F.col("patterns"), key), F.array().cast("array<string>"))
    return F.concat(own(language), own(F.lit("generic")))


def report_groups(lens: Column, kind: Column, name: Column, description: Column, trusted: Column) -> Column:
    """The sections of its lens's report that an entry goes into. Those of trust zones overlap."""
    low, said = F.lower(name), F.lower(F.coalesce(description, F.lit("")))
    has = lambda text, *words: text.rlike("|".join(words))
    auth = has(low, "auth") | has(said, "auth", "jwt", "token")
    authz = F.coalesce(trusted, F.lit(False)) | has(low, "role", "permission", "require")
    zones = F.array_compact(F.array(F.when(auth, F.lit("Authentication")), F.when(authz, F.lit("Authorization")), F.when(~auth & ~authz, F.lit("Other"))))
    flows = F.when(kind.isin("handler", "route"), "Entry Points").when(kind.isin("function", "method"), "Functions").otherwise("Other")
    parts = F.when(kind == "module", "Modules").when(kind == "class", "Classes").otherwise("Other")
    return F.when(lens == "flows", F.array(flows)).when(lens == "boundaries", F.array(parts)).when(lens == "trust-zones", zones).otherwise(F.array(F.concat(F.initcap(kind), F.lit("s"))))


def structural_search(files: DataFrame, patterns: Sequence[str], most: int) -> DataFrame:
    """(path, line, column, pattern): lines of files (path, content) that match a pattern, once for each place with the
    first pattern that does, in the first files by path."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    at = lambda p: F.regexp_instr("text", F.lit(safe_pattern(p)))
    each = F.array_compact(F.array(*(F.when(at(p) > 0, F.struct(at(p).alias("column"), F.lit(k).alias("k"), F.lit(p).alias("pattern"))) for k, p in enumerate(patterns))))
    hits = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(each).alias("m"))
    once = hits.groupBy("path", "line", "m.column").agg(F.min_by("m.pattern", "m.k").alias("pattern"))
    first = once.select("path").distinct().orderBy("path").limit(most)
    return once.join(first, "path", "left_semi")


def focus_patterns(focus: str, entry: Sequence[str] = (), globs: Sequence[str] = ()) -> list[str]:
    """Globs of the files that a focus may mean, and a lens's own."""
    kinds = "*.{ts,tsx,js,jsx,py,go,rs,java}"
    made = [f"**/{focus}/**/{kinds}", f"**/*{focus}*/**/{kinds}", f"**/*{focus}*{kinds}", f"src/**/{focus}/**/{kinds}"]
    return [*made, *entry, *(f"**/{g}" for g in globs)]


def glob_expression(glob: str) -> str:
    """A glob as an expression for a whole path: ** for folders, * inside a name, {a,b} for either."""
    parts = re.split(r"(\*\*/|\*\*|\*|\{[^}]*\})", glob)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}
    return "^" + "".join(known.get(p) or ("(?:" + "|".join(map(re.escape, p[1:-1].split(","))) + ")" if p.startswith("{") else re.escape(p)) for p in parts) + "$"


def index_order() -> list[Column]:
    """How an index is sorted: by lens, then by focus, whatever the case."""
    return [F.lower("lens"), F.lower("focus"), F.col("focus")]


def alternation(patterns: Sequence[str]) -> str:
    """One case-insensitive expression for any of the patterns; one that is no expression means itself."""
    return "(?i)(" + "|".join(map(safe_pattern, patterns)) + ")"


def lens_filter(kind: Column, name: Column, path: Column, kinds: Sequence[str], extract: Sequence[str], ignore: Sequence[str]) -> Column:
    """Kind is wanted (or all are), some extract pattern is in the name, no ignore pattern in name or path."""
    ok = kind.isin(*kinds) if kinds else F.lit(True)
    if extract:
        ok = ok & name.rlike(alternation(extract))
    if ignore:
        ok = ok & ~name.rlike(alternation(ignore)) & ~path.rlike(alternation(ignore))
    return ok


#: References that one task sorts, about, and turns that a symbol's references are dealt to before the first are known.
REFERENCES, TURNS = 1 << 21, 16


def with_details(symbols: DataFrame, hovers: DataFrame, references: DataFrame, most: int = MAX_REFERENCES, key: Sequence[str] = ("path", "name")) -> DataFrame:
    """Symbols with signature by place and their first references (key, ref), each once, most at the most.

    The number of tasks grows with the references, so that what a task sorts does not; they are counted first. A symbol
    with very many of them is dealt to TURNS tasks, which leave most each.
    """
    tasks = max(1, -(-references.count() // REFERENCES))
    sorted_by = lambda *by: Window.partitionBy(*by).orderBy("ref")
    turn = sorted_by(*key, "__turn")
    dealt = references.select(*key, "ref", F.pmod(F.xxhash64("ref"), F.lit(TURNS)).cast("int").alias("__turn")).repartition(tasks, *key, "__turn")
    ranked = dealt.select("*", F.dense_rank().over(turn).alias("n"), F.row_number().over(turn).alias("k"), F.lag("ref").over(turn).alias("before"))
    few = ranked.filter((F.col("n") <= most) & ((F.col("k") == 1) | ~F.col("ref").eqNullSafe(F.col("before")))).select(*key, "ref").repartition(tasks, *key)
    first = few.withColumn("n", F.row_number().over(sorted_by(*key))).filter(F.col("n") <= most)
    listed = first.groupBy(*key).agg(F.sort_array(F.collect_list("ref")).alias("references"))
    return symbols.join(hovers, ["path", "line", "column"], "left").join(listed, [*key], "left")


def plan_calls(files: DataFrame, lenses: DataFrame) -> DataFrame:
    """A documentSymbol call for each file and lens whose operations have it."""
    return files.join(F.broadcast(lenses.filter(F.array_contains("operations", "documentSymbol"))), "lens").select("lens", "path", F.lit("documentSymbol").alias("operation"))


def plan_details(symbols: DataFrame, order: Sequence[str], most: int = MAX_SYMBOLS) -> DataFrame:
    """findReferences and hover calls for the first symbols."""
    first = symbols.orderBy(*order).limit(most)
    return first.select("path", "name", F.explode(F.array(F.lit("findReferences"), F.lit("hover"))).alias("operation"))


def overview(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


def buckets(symbols: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(bucket, names): a symbol goes into each bucket whose pattern its name matches, or into others."""
    hit = F.filter(F.array(*(F.when(F.col("name").rlike(alternation([p])), F.lit(n)) for n, p in rules)), lambda x: x.isNotNull())
    rows = symbols.withColumn("bucket", F.explode(F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("others")))))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("name").alias("first"))


def staleness(pages: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, status) of pages (doc) on disk, index rows (doc, source, hash) and current files (source, hash).

    ORPHANED: on disk but not in the index. MISSING: in the index but not on disk. STALE: some source is gone or
    has another hash. Else FRESH.
    """
    now = index.join(files.select("source", F.col("hash").alias("now")), "source", "left")
    known = now.groupBy("doc").agg(F.max(~F.col("hash").eqNullSafe(F.col("now"))).alias("changed"))
    both = pages.select("doc", F.lit(True).alias("here")).join(known, "doc", "full")
    status = F.when(F.col("here").isNull(), "MISSING").when(F.col("changed").isNull(), "ORPHANED").when(F.col("changed"), "STALE").otherwise("FRESH")
    return both.select("doc", status.alias("status"))


def index_stats(statuses: DataFrame) -> DataFrame:
    """(status, n, percent), percent rounded half up."""
    total = statuses.agg(F.count("*").alias("total")).scalar()
    counts = statuses.groupBy("status").agg(F.count("*").alias("n"))
    return counts.select("status", "n", F.floor(F.col("n") * 100 / total + 0.5).cast("long").alias("percent"))


def index_rows(statuses: DataFrame, order: Sequence[str]) -> DataFrame:
    """(lens, pos, n, line): the rows of an index page's tables, of docs (lens, doc, status, generated), lenses in the given
    order, rows by their text from 1; a lens without docs has the row (empty). The date is what stands before the T."""
    lenses = statuses.sparkSession.createDataFrame([(n, k) for k, n in enumerate(order)], "lens string, pos int")
    line = F.concat_ws(" | ", "doc", "status", F.split_part("generated", F.lit("T"), F.lit(1)))
    rows = lenses.join(statuses, "lens", "left").select("lens", "pos", F.when(F.col("doc").isNull(), "(empty)").otherwise(line).alias("line"))
    return numbered(rows, ["lens", "pos"], ["line"], "n").select("lens", "pos", "n", "line")


def write_index(rows: DataFrame, folder: str) -> None:
    """Writes index_rows as text, in a folder for each lens; files of a lens are in order of their names."""
    rows.repartitionByRange("pos", "n").sortWithinPartitions("lens", "n").select("lens", "line").write.mode("overwrite").partitionBy("lens").text(folder)


def index_lines(statuses: DataFrame, order: Sequence[str]) -> DataFrame:
    """(lens, pos, lines): index_rows of a lens in one text, for lenses with few docs."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x.line)
    return index_rows(statuses, order).groupBy("lens", "pos").agg(F.array_join(ordered, "\n").alias("lines"))


def lenses_for(agents: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each request (agent, lens) with its own lens, or its agent's default (agent, default_lens)."""
    joined = agents.join(defaults, "agent", "left")
    return joined.withColumn("lens", F.coalesce("lens", "default_lens")).drop("default_lens")


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc, text): pages (doc, lens, focus, generated, body) as files with their front matter, ready to be written."""
    head = F.concat(F.lit("---\nlens: "), "lens", F.lit("\nfocus: "), "focus", F.lit("\ngenerated: "), "generated", F.lit("\n---\n"))
    return pages.select("doc", F.concat(head, F.coalesce("body", F.lit(""))).alias("text"))


def first_matching_files(files: DataFrame, patterns: Sequence[str], ignore: str, most: int) -> DataFrame:
    """(path, pattern): files by the first pattern that they match, in the patterns' order, then by path."""
    first = F.coalesce(*(F.when(F.col("path").rlike(p), k) for k, p in enumerate(patterns)))
    return files.select("path").distinct().withColumn("pattern", first).filter(F.col("pattern").isNotNull() & ~F.col("path").rlike(ignore)).orderBy("pattern", "path").limit(most)


#: Fields that a manifest must have, and each of its leaves.
MANIFEST_FIELDS, LEAF_FIELDS = ("stack_name", "source_branch", "target_branch", "leaves"), ("id", "title", "files")


def manifest_error(manifest: Column, stack: Column) -> Column:
    """What is first wrong with a manifest (JSON): no JSON, a missing field, another stack's name, no leaf, or a leaf without
    a field; null if nothing is. A field that is null or false counts as missing."""
    v = F.try_parse_json(manifest)
    there = lambda value, field: F.coalesce(F.try_variant_get(value, f"$.{field}", "string").isNotNull() & ~F.coalesce(F.try_variant_get(value, f"$.{field}", "string") == "false", F.lit(False)), F.lit(False))
    leaves = F.coalesce(F.try_variant_get(v, "$.leaves", "array<variant>"), F.array().cast("array<variant>"))
    lacking = lambda value, fields, said: F.coalesce(*(F.when(~there(value, f), F.format_string(said, F.lit(f))) for f in fields))
    of_leaf = F.filter(F.transform(leaves, lambda x, i: F.coalesce(*(F.when(~there(x, f), F.concat(F.lit("leaf "), i.cast("string"), F.lit(f" lacks {f}"))) for f in LEAF_FIELDS))), lambda e: e.isNotNull())
    name = F.try_variant_get(v, "$.stack_name", "string")
    return (
        F.when(manifest.isNull() | v.isNull(), "no JSON")
        .when(lacking(v, MANIFEST_FIELDS, "missing %s").isNotNull(), lacking(v, MANIFEST_FIELDS, "missing %s"))
        .when(name != stack, "another stack")
        .when(F.size(leaves) == 0, "no leaf")
        .otherwise(F.get(of_leaf, 0))
    )
