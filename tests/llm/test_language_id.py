"""Language identification against plain cross parsing and held-out labels."""

import random

import numpy as np
from pyspark.sql import functions as F

from granary.llm import language_id


def test_cross_parser_counts_greedy_phrases():
    rng = random.Random(4)
    train = {"a": bytes(rng.choice(b"abcd ") for _ in range(400)), "b": bytes(rng.choice(b"cdef ") for _ in range(300))}
    parser = language_id.CrossParser(train)

    def plain(text, sample):
        at = n = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            at, n = at + size, n + 1
        return n

    train["c"] = bytes(rng.choice(b"ab") for _ in range(3000))  # with phrases longer than a lane, in copies of it
    parser = language_id.CrossParser(train)
    texts = [bytes(rng.choice(b"abcdefg ") for _ in range(k)) for k in (1, 5, 100, 1023, 1024, 1025, 2048, 5000)]
    texts += [train["c"], b"a" + train["c"][5:] + b"x" + train["c"][100:], b"a" * 5000, train["a"] * 20]
    got = parser.phrases(texts)
    for text, row in zip(texts, got.tolist()):
        assert row == [plain(text, train[lang]) for lang in "abc"]


def test_packed_transitions():
    train = {"a": b"abracadabra alakazam", "b": bytes(range(256)) * 2}
    parser = language_id.CrossParser(train)
    moves = [m for lang in "ab" for m in language_id.suffix_automaton(train[lang])]
    bases = [1, 1 + len(language_id.suffix_automaton(train["a"]))]
    for s, own in enumerate(moves, 1):
        base = bases[s >= bases[1]]
        got = parser.step(np.full(256, s, np.int32), parser.column)
        assert {c: t - base for c, t in enumerate(got.tolist()) if t} == own


def test_language_with_little_text_can_win():
    rng = random.Random(3)
    text = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    parser = language_id.CrossParser({"much": text(b"abcdefgh", 40_000), "little": text(b"efghijkl", 1500), "none": b""})
    assert parser.predict([text(b"efghijkl", 300).decode(), text(b"abcdefgh", 300).decode()])[0] == ["little", "much"]


def test_language_accuracy_and_awkward(spark, data, awkward_docs, awkward):
    out = language_id.query(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    tested = out.filter("held_out").join(docs, "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score").collect()
    assert np.mean([r.ok for r in tested]) > 0.9 and all(0 <= r.score <= 1 for r in tested)
    rows = language_id.identify(awkward_docs, language_id.train(awkward_docs), keep=("doc_id",)).collect()
    assert len(rows) == len(awkward) and {r.lang_pred for r in rows} <= {"aa", "bb", "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (0, 1, 2, 16))


def test_language_of_repeated_texts(spark):
    texts = {"aa": "lorem ipsum dolor sit amet", "bb": "colourless green ideas sleep", "cc": "quick brown foxes jump", "dd": "seventeen zebras hum"}
    rows = spark.createDataFrame(list(texts.items()), "lang string, text string").join(spark.range(20_000))
    parser = language_id.train(rows)
    assert parser.languages == sorted(texts)
    assert parser.predict(list(texts.values()))[0] == list(texts)
