"""Decontamination against exhaustive alignment."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import decontaminate
from tests.llm.helpers import words, plain_alignment


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(6)
    items = [rng.integers(2, 9, rng.integers(1, 20)).astype(np.uint64) for _ in range(40)]
    windows = [rng.integers(2, 9, rng.integers(1, 40)).astype(np.uint64) for _ in range(40)]
    got = decontaminate.align(items, windows)
    assert np.allclose(got, [plain_alignment(a.tolist(), b.tolist()) for a, b in zip(items, windows)])


def test_decontamination_finds_edited_copies(spark, awkward_docs):
    rng = random.Random(8)
    items = [(k, words(rng, 30, 4000)) for k in range(6)] + [(6, None), (7, ""), (8, "too short"), (0, words(rng, 25, 4000))]
    docs, expected = [], set()
    for k in range(80):
        text = words(rng, rng.randrange(20, 300), 4000).split()
        if k % 4 == 0:
            item = items[k // 4 % 6]
            edited = item[1].upper().split() if k % 8 else item[1].split()
            for at in rng.sample(range(len(edited)), 4):
                edited[at] = "other" if at % 2 else "two words"
            text[10:10] = edited
            expected.add((k, item[0]))
        docs.append((k, ", ".join(text)))
    docs += [(100, None), (101, ""), (102, items[2][1]), (102, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == expected | {(102, 2)}
    assert [r.score for r in out if r.doc_id == 102] == [1.0, 1.0]
    assert decontaminate.contaminated(awkward_docs, bench).count() == 0
    assert decontaminate.contaminated(awkward_docs, bench.limit(0)).count() == 0


def test_decontamination_against_exhaustive_alignment(spark):
    """All texts aligned with all items, whatever they share: hardly a passage that counts is without a seed."""
    rng = random.Random(18)
    items = [(k, words(rng, rng.randrange(8, 40), 600)) for k in range(12)]
    docs = []
    for k in range(150):
        text = words(rng, rng.randrange(0, 120), 600).split()
        if k % 2:
            edited = items[k % 12][1].split()
            for at in rng.sample(range(len(edited)), len(edited) * (k % 9) // 10):
                edited[at] = f"w{rng.randrange(600)}"
            text[len(text) // 2 : len(text) // 2] = edited
        docs.append((k, " ".join(text)))
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(table(docs, "doc_id"), table(items, "item_id")).collect()}
    plain = {(k, i): s for k, t in docs for i, a in items if (s := plain_alignment(a.split(), t.split())) >= decontaminate.THRESHOLD}
    assert set(got) <= set(plain) and len(got) >= 0.9 * len(plain)
    assert sum(abs(got[key] - plain[key]) < 1e-9 for key in got) >= 0.97 * len(got)


@pytest.mark.parametrize("base, most", [(12, 60), (40, 20)])
def test_common_phrases_get_longer_seeds(spark, monkeypatch, base, most):
    """A corpus of few words, whose short n-grams are all frequent: recall against all alignments, and bounded hits."""
    monkeypatch.setattr(decontaminate, "RARE_COUNT", most)
    rng = random.Random(base)
    items = [(k, words(rng, rng.randrange(15, 40), base)) for k in range(10)]
    docs = [(k, words(rng, rng.randrange(20, 200), base)) for k in range(400)]
    for k in range(0, 400, 4):
        text, edited = docs[k][1].split(), items[k % 10][1].split()
        for at in rng.sample(range(len(edited)), len(edited) * (k % 3) // 12):
            edited[at] = f"w{rng.randrange(base)}"
        docs[k] = (k, " ".join(text[:5] + edited + text[5:]))
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(docs, "doc_id"), table(items, "item_id")).collect()}
    plain = {(k, i) for k, t in docs for i, a in items if plain_alignment(a.split(), t.split()) >= (0.65 if base < 20 else decontaminate.THRESHOLD)}
    assert len(got & plain) >= 0.9 * len(plain) > 50
    grams = decontaminate.item_grams(table(items, "ik"))
    counts = decontaminate.gram_counts(table(docs, "doc_id"), spark.sparkContext.broadcast(decontaminate.Wanted(grams)))
    seeds = decontaminate.chosen_seeds(grams, counts).join(counts, "gram").join(grams.select("ik", F.col("place").alias("offset"), "gram", "size"), ["ik", "offset", "gram"])
    met = seeds.select("n", "size").collect()
    assert all(r.n <= most or r.size >= 4 for r in met) and max(r.size for r in met) > 3
    assert sum(r.n for r in met) <= 1.5 * most * len(met)


def test_short_items_match_exact_copies(spark):
    items = [(1, "Alpha beta gamma delta"), (2, "go now"), (3, "one two three four five six seven"), (4, "one two three four five six seven eight")]
    docs = [(1, "x alpha, BETA gamma delta y"), (2, "alpha beta other gamma delta"), (3, "Go now!"), (4, "they go now"), (5, "zero one two three four five six seven eight nine"), (6, "one two three four six seven")]
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(docs, "doc_id"), table(items, "item_id")).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (5, 4), (6, 4)}
