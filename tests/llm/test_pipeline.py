"""The pipeline's stages against plain versions of what they decide."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402
from tests.llm.helpers import DOC, plain_components, plain_passages  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs.collect()]
    for _, stage in P.STAGES:
        rows = stage(spark, docs, data).collect()
        out.append(rows)
        if stage is not P.encoding:
            docs = spark.createDataFrame(rows, DOC)
    return out


def test_columns(stages):
    for rows in stages[1:-1]:
        assert rows and set(rows[0].asDict()) == set(P.COLUMNS)


def test_languages(stages):
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r in stages[0] if any(c.isalpha() for c in r.text)}


def test_near_duplicates(stages):
    heads = plain_components([(r.doc_id, r.text) for r in stages[1]], P.SHINGLE, P.SIMILARITY)
    assert sorted(r.doc_id for r in stages[2]) == sorted(k for k, v in heads.items() if k == v)


def test_repeated_passages(stages):
    plain = plain_passages([r.text for r in stages[2]], P.PASSAGE)
    expected = {r.doc_id: kept for r, (_, kept) in zip(stages[2], plain)}
    had = {r.doc_id: r.text for r in stages[2]}
    assert {r.doc_id: r.text for r in stages[3]} == {k: t for k, t in expected.items() if t.strip(" ") or t == had[k]}


def test_decontamination(spark, data, stages):
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in stages[3] if any(t in r.text for t in items)}
    kept = {r.doc_id for r in stages[4]}
    assert not kept & leaks and {r.doc_id for r in stages[3]} - kept >= leaks
    assert len(stages[4]) >= len(stages[3]) - 2 * len(leaks) - 3


def test_encoding(stages):
    assert len(stages[5]) == len(stages[4]) and all(r.lossless and r.n_pieces == len(r.pieces) for r in stages[5])


def test_repeated_and_null_rows(spark, data):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11), (3, None, None, None, None), (4, "...", "en", "s", 3)]
    docs = spark.createDataFrame(rows, DOC)
    assert sorted(str(r.doc_id) for r in P.languages(spark, docs, data).collect()) == ["1", "1", "2", "None"]
    assert sorted(str(r.doc_id) for r in P.near_duplicates(spark, docs, data).collect()) == ["1", "3", "4", "None"]
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_languages_without_labels(spark, data):
    texts = ["a b", "é", "x²", "12 3", "...", "", None, "日本", "²"]
    docs = spark.createDataFrame([(k, t, None, "s", 1) for k, t in enumerate(texts)], DOC)
    assert sorted(r.doc_id for r in P.languages(spark, docs, data).collect()) == [0, 1, 2, 7]


def test_decontamination_judges_texts_and_not_ids(spark, data):
    item = max((r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()), key=len)
    rows = [(None, item), (1, item), (1, "a clean text of some words"), (None, "another clean text"), (2, None), (2, None), (3, ""), (4, "word " * 200_000), (4, "word " * 200_000 + item)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOC).withColumns({c: F.lit(9) for c in ("text_key", "rk", "gram", "item_id", "score")})
    kept = P.decontamination(spark, docs, data).collect()
    key = lambda r: (str(r[0]), r[1] is not None, len(r[1] or ""))
    assert sorted(((r.doc_id, r.text) for r in kept), key=key) == sorted(((k, t) for k, t in rows if not t or item not in t), key=key)


def test_languages_of_one_repeated_text(spark, data):
    rows = spark.range(20_000).selectExpr("id as doc_id", "'lorem ipsum dolor' as text", "'aa' as lang", "'s' as source", "17L as n_chars")
    assert P.languages(spark, rows, data).count() == 20_000
