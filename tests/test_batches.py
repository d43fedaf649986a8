"""Rows through Python in bounded batches."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import batches as B
from granary.operators import chunking, keyword_index, scrub
from granary.sources import yaml


def test_made_batches_are_bounded():
    """A text's pieces leave while it is read, so what is held is no batch's whole output."""
    kinds = pa.schema([("k", pa.int64()), ("text", pa.string())])
    given = pa.RecordBatch.from_pylist([{"k": k, "text": "x" * 1000} for k in range(300)] + [{"k": 300, "text": None}])
    out = list(B.through([given, given.slice(0, 0)], lambda k, text: ((k, (text or "none")[n:]) for n in range(100)), kinds))
    assert sum(b.num_rows for b in out) == 301 * 100
    assert len(out) > 10 and max(b.nbytes for b in out) < 2 * B.MADE_BYTES
    assert list(B.through([given.slice(0, 0)], lambda k, text: [(k, text)], kinds)) == []


@pytest.mark.parametrize("made", [
    lambda d: chunking.line_chunks(d), lambda d: chunking.tree_chunks(d), lambda d: chunking.code_chunks(d), lambda d: chunking.token_windows(d),
    lambda d: chunking.merged_siblings(d.filter("text is not null").withColumn("ordinal", F.lit(0))), lambda d: scrub.scrub(d), lambda d: yaml.documents(d.select(F.col("uri").alias("path"), F.col("text").alias("content"))),
    lambda d: keyword_index.term_counts(d.withColumn("corpus", F.lit("x")), T.code_words(F.col("text"))),
])
def test_operators_use_them(spark, made):
    docs = spark.createDataFrame([(1, "a", "x y\n- 1", "go"), (2, None, None, None)], "doc_id long, uri string, text string, language string")
    found = made(docs)
    found.collect()
    assert "MapInArrow" in found._jdf.queryExecution().toString() and B.BATCH_SIZE in spark.conf.getAll
