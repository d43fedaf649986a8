"""Readers of files, chat exports and request streams, each a DataFrame of documents."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import language_of
from granary.sources import yaml

SKIPPED = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv", "target", ".tox", ".mypy_cache")
CODE, DOCS = ("py", "ts", "tsx", "js", "go", "cs", "java", "rs", "rb", "php"), ("md", "mdx", "rst", "txt")


def files(spark: SparkSession, folder: str, extensions: Sequence[str]) -> DataFrame:
    """(path, language, content, is_readme) of the files under a folder with these extensions, skipped folders left out.

    Contents that are no UTF-8 have their bad bytes replaced.
    """
    names = "*.{" + ",".join(extensions) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    inside = F.regexp_replace("path", "^.*?" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    kept = rows.filter(~F.arrays_overlap(F.split(inside, "/"), F.array(*map(F.lit, SKIPPED))))
    name = F.element_at(F.split("path", "/"), -1)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))
    return kept.select("path", language_of(F.col("path")).alias("language"), text.alias("content"), F.upper(name).startswith("README").alias("is_readme"))


def tracked_files(spark: SparkSession, folder: str, tracked: DataFrame, extensions: Sequence[str] = CODE) -> DataFrame:
    """Those files whose path below the folder is listed in tracked (path)."""
    rows = files(spark, folder, extensions)
    below = F.regexp_replace("path", "^.*?" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return rows.withColumn("below", below).join(tracked.select(F.col("path").alias("below")), "below", "left_semi").drop("below")


def chat_export(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, messages) of each channel of an export: a folder of daily JSON arrays for each channel, joined by day."""
    schema = "type string, user string, username string, text string, ts string, thread_ts string"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    parts = F.split(F.input_file_name(), "/")
    placed = rows.withColumn("channel", F.element_at(parts, -2)).withColumn("day", F.element_at(parts, -1)).filter("type = 'message'")
    message = F.struct("day", "ts", F.coalesce("user", "username", F.lit("unknown")).alias("speaker"), F.coalesce("thread_ts", F.lit("main")).alias("thread"), "text")
    return placed.groupBy(F.concat(F.lit("slack://"), "channel").alias("uri")).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def fan_out(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """(source, kind, uri, pos, content): the contents of all sources (kind, folder), each by the reader of its kind:
    code, docs, or talk."""
    parts = []
    for kind, folder in sources:
        if kind == "talk":
            rows = conversations(spark, folder).select("uri", "pos", F.concat_ws(": ", "speaker", "text").alias("content"))
        else:
            rows = files(spark, folder, {"code": CODE, "docs": DOCS}[kind]).select(F.col("path").alias("uri"), F.lit(0).alias("pos"), "content")
        parts.append(rows.select(F.lit(folder).alias("source"), F.lit(kind).alias("kind"), "uri", "pos", "content"))
    return functools.reduce(DataFrame.unionByName, parts)


def is_chat_export(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is a chat export: it has a list of channels or users, or some JSON array of typed items."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    listed = names.filter(F.col("path").rlike("/(channels|users)[.]json$")).select("path")
    typed = names.filter(F.col("content").cast("string").rlike(r"(?s)^\s*\[\s*\{[^{}]*\"type\"")).select("path")
    return not listed.unionByName(typed).isEmpty()


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Chat exports and transcripts of a folder in one form: (uri, pos, speaker, text)."""
    if not is_chat_export(spark, folder):
        return transcripts(spark, folder)
    return chat_export(spark, folder).select("uri", F.posexplode("messages").alias("pos", "m")).select("uri", "pos", "m.speaker", "m.text")


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, pos, speaker, text): lines `Name: text` of text files; a line without a name belongs to unknown."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder).withColumn("uri", F.input_file_name())
    lines = rows.select("uri", F.posexplode(F.split("value", "\n")).alias("pos", "line")).filter("trim(line) <> ''")
    named = F.col("line").rlike(r"^[^:]+: ")
    return lines.select("uri", "pos", F.when(named, F.regexp_extract("line", "^([^:]+): ", 1)).otherwise("unknown").alias("speaker"), F.when(named, F.regexp_replace("line", "^[^:]+: ", "")).otherwise(F.col("line")).alias("text"))


def yaml_resources(docs: DataFrame) -> DataFrame:
    """(path, ordinal, kind, name, ports): the documents of YAML files (path, content) that name a kind."""
    return yaml.resources(docs).select("path", "ordinal", "kind", "name", "ports")


def requests(lines: DataFrame) -> DataFrame:
    """(id, tool, params, error) of request lines (value): one JSON object each, blank ones skipped; a line that is no
    such object has an error. Works on streams and tables alike."""
    parsed = lines.filter("trim(value) <> ''").withColumn("r", F.from_json("value", "id string, tool string, params map<string,string>"))
    error = F.when(F.col("r.tool").isNull(), "bad request")
    return parsed.select("r.id", "r.tool", "r.params", error.alias("error"))
