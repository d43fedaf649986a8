"""The corpus pipeline: language identification, near-duplicate removal, repeated-passage removal, benchmark
decontamination, and encoding. Each stage takes the documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, jaccard_join, language_id, sentencepieces, suffix_dedup
from granary.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: shingles of so many words, at least this similarity in percent.
SHINGLE, SIMILARITY = 5, 80
#: Words of a passage that counts as repeated.
PASSAGE = 51


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter: a language is recognised in each, unless no row has a label. Labels come from the lang column."""
    parser = language_id.train(docs)
    if not parser.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language_id.identify(docs, parser, keep=COLUMNS)
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id. Of repeated rows one stays; a row without doc_id stays."""
    groups = jaccard_join.components(docs, SHINGLE, SIMILARITY)
    heads = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    met = docs.select(*COLUMNS).join(heads, "doc_id", "left").filter("doc_id is null or rows is not null")
    once = met.filter("rows > 1").drop("rows").dropDuplicates(["doc_id", "text"])
    return met.filter("rows is null or rows = 1").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that also stand elsewhere, at every place; a document that had
    text and has none left goes."""
    rest = suffix_dedup.dedup(docs, keep=("doc_id", "lang", "source", "n_chars"), as_text=True, words=PASSAGE, by_words=True)
    size = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept"))
    cut = rest.withColumn("text", F.col("kept")).withColumn("n_chars", size.cast("long"))
    return cut.filter("n_removed = 0 or trim(text) <> ''").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a test item. Texts are judged, whatever their doc_id: rows with null or shared ids
    stay or go by their own text, repeated rows alike; null and empty texts stay; long texts are searched whole."""
    key = F.concat_ws(":", F.xxhash64("text"), F.hash("text"))
    keyed = docs.select(*COLUMNS, key.alias("text_key"))
    leaks = decontaminate.contaminated(keyed.select(F.col("text_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(leaks.select(F.col("doc_id").alias("text_key")).distinct(), "text_key", "left_anti").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces, lossless) of each document; lossless: the pieces decode to the very text. A null text is
    encoded as the empty one; repeated rows give equal rows; a long text is encoded whole."""
    return sentencepieces.round_trip(docs).select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "lossless")


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Learned automata, tokenizer files and alignments have no SQL form; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
