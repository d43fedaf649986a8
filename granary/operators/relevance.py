"""Which verification cycles a set of changed files calls for, and cycle files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories of files by patterns on the lower-case path.
FILE_PATTERNS = {
    "documentation": r"readme|\.md$|^docs/|changelog|license",
    "homepage": r"index\.(tsx?|jsx?|html)$|landing|home|^public/index|pages/index",
    "styles": r"\.css$|\.scss$|\.sass$|\.less$|style|\.module\.css$",
    "typescript": r"\.tsx?$|\.jsx?$",
    "javascript": r"\.jsx?$",
    "auth": r"auth|login|logout|session|token|credential",
    "config": r"\.gitignore$|\.env|\.editorconfig$",
    "build": r"package\.json$|webpack|vite|tsconfig|babel",
    "components": r"components?/|\.tsx$|\.jsx$",
    "utils": r"utils?/|lib/|helpers?/|shared/",
}

# Words of a cycle's condition.
WHEN_WORDS = {
    "homepage": ("homepage", "landing", "index", "landing page", "home page"),
    "styles": ("css", "style", "styling", "stylesheet", "visual", "layout"),
    "typescript": ("typescript", "ts", "javascript", "js"),
    "auth": ("auth", "login", "logout", "session", "authentication", "authorization"),
}

STYLE_FILE = r"\.(css|scss|sass|less)$"
CHROME_FILE = r"(^|/)(footer|header|sidebar|nav|menu|logo|icon)\.[^/]*$"


def categories(path: Column) -> Column:
    low = F.lower(path)
    return F.filter(F.array(*(F.when(low.rlike(p), F.lit(n)) for n, p in FILE_PATTERNS.items())), lambda c: c.isNotNull())


def mentions(condition: Column, topic: str) -> Column:
    hit = F.lit(False)
    for word in WHEN_WORDS[topic]:
        hit = hit | F.lower(condition).contains(word)
    return hit


#: Patterns that a decision looks at, by the names of their flags.
FLAGS = {n: FILE_PATTERNS[n] for n in ("documentation", "homepage", "styles", "typescript", "auth", "config", "utils", "build")} | {"style_file": STYLE_FILE, "chrome_file": CHROME_FILE}


def file_flags(changes: DataFrame, group: str) -> DataFrame:
    """(group, n, some, every): of each group's changed files (path), how many, and of which patterns some or all are.

    Flags are combined on the map side, so a group may have any number of files.
    """
    low = F.lower("path")
    some = F.struct(*(F.bool_or(low.rlike(p)).alias(n) for n, p in FLAGS.items()))
    every = F.struct(*(F.bool_and(low.rlike(p)).alias(n) for n, p in FLAGS.items()))
    return changes.groupBy(group).agg(F.count("path").alias("n"), some.alias("some"), every.alias("every"))


def decision(n: Column, some: Column, every: Column, condition: Column) -> Column:
    """struct<run, reason> for the flags of changed files and a cycle's condition.

    No file: skip. A file of the condition's topic: run. Files that cannot matter to it: skip. Else run.
    """
    answer = lambda run, reason: F.struct(F.lit(run).alias("run"), F.lit(reason).alias("reason"))
    low = F.lower(condition)
    about_docs = low.contains("documentation") | low.contains("docs")
    out = F.when(n == 0, answer(False, "no files"))
    for topic in ("homepage", "styles", "typescript", "auth"):
        out = out.when(mentions(condition, topic) & some[topic], answer(True, topic))
    out = out.when(every["documentation"] & ~about_docs, answer(False, "documentation only"))
    out = out.when(every["config"] & (mentions(condition, "styles") | mentions(condition, "homepage")), answer(False, "configuration only"))
    out = out.when(every["style_file"] & mentions(condition, "typescript"), answer(False, "styles only"))
    aside = ~some["utils"] & ~some["build"] & every["chrome_file"]
    return out.when(mentions(condition, "auth") & aside, answer(False, "unrelated components")).otherwise(answer(True, "unclear"))


def parse_cycle(text: Column, filename: Column) -> Column:
    """struct<name, type, run, when, description, error> of a cycle file.

    The name is the first line that begins with #, without its signs; else the first plain line, else the file's name.
    The first `run:` and `when:` lines count, in any case. With a run line that says something the cycle is automated,
    else manual. The description is all other lines. A file that is empty, or has no when line, has an error.
    """
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.split(bare(text), "\n")
    of = lambda p: F.filter(lines, lambda x: bare(x).rlike(p))
    header, plain = F.get(of("^#"), 0), F.get(of(r"(?i)^(?!#|run:|when:)\S"), 0)
    name = F.coalesce(bare(F.regexp_replace(header, r"^#+\s*", "")), bare(plain), F.regexp_replace(filename, r"\.md$", ""))
    value = lambda word: bare(F.regexp_replace(F.get(of(f"(?i)^{word}:"), 0), rf"(?i)^{word}:\s*", ""))
    run, when = value("run"), value("when")
    error = F.when(~text.rlike(r"\S"), "empty file").when(when.isNull(), "no condition")
    kind = F.when(F.coalesce(run, F.lit("")) != "", "automated").otherwise("manual")
    description = bare(F.array_join(F.filter(lines, lambda x: ~bare(x).rlike("(?i)^(#|run:|when:)")), "\n"))
    return F.struct(name.alias("name"), kind.alias("type"), run.alias("run"), when.alias("when"), description.alias("description"), error.alias("error"))


def valid_cycles(files: DataFrame) -> DataFrame:
    """(path, name, type, run, when, description) of the cycle files (path, content) of a folder, in order of their
    paths when written; files with an error are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    parsed = files.filter(F.lower("path").endswith(".md")).select("path", parse_cycle(F.col("content"), name).alias("c"))
    return parsed.filter("c.error is null").select("path", "c.*").drop("error")
