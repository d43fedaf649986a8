"""Awkward tables for all operators."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOC, words


@pytest.fixture(scope="session")
def awkward():
    """Nulls everywhere, empty, blank, tiny, long, repeated and odd texts."""
    rng = random.Random(5)
    long = words(rng, 30_000, 5000)
    texts = [None, "", "   ", "one", "one two", "one two three", "one two three", "ONE two three", long, long, long[:-500], "<|endoftext|> <s> ▁x\x00 \\b <|im_end|>", "é日本語🙂 ½ ﬁ", "a" * 3000, "ab" * 1500, words(rng, 80), "!!! ??? 123"]
    rows = [(k, t, None if k % 3 == 0 else ("aa", "bb")[k % 2], None, None) for k, t in enumerate(texts)]
    return [*rows, rows[4], (None, "one two three", "aa", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    clashing = {c: F.lit(7) for c in ("component", "rep", "n", "h", "k", "token", "rk", "left", "low", "score", "pieces", "media", "pattern", "kept", "item_id", "x", "a", "b")}
    return spark.createDataFrame(awkward, DOC).withColumns(clashing)
