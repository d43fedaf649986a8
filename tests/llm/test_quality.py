"""The quality classifier against plain versions and given labels."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from granary.llm import quality


def test_label_model_and_scorer(spark, data, awkward_docs, awkward):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    scorer = quality.train(docs)
    assert all(a > 0.6 for a in scorer.accuracy)
    rows = quality.classify(docs, scorer).join(labels, "doc_id").collect()
    good, junk = [[r.keep for r in rows if r.quality == q] for q in (1, 0)]
    assert np.mean(good) > 0.95 and np.mean(junk) < 0.4
    out = quality.classify(awkward_docs, quality.train(awkward_docs)).collect()
    assert len(out) == len(awkward) and all(not r.keep and r.posterior is None for r in out if r.doc_id in (0, 1, 2))


def test_scorer_of_repeated_texts(spark, monkeypatch):
    for k in range(4):  # one text many times is a sample of one text, not none
        scorer = quality.train(spark.range(20_000).select(F.lit(f"The number {k} is said here, and again.").alias("text")))
        assert np.any(scorer.weights)
    samples = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda row, dim, value, label: samples.append((len(label), list(row), list(dim))) or fit(row, dim, value, label))
    varied = spark.range(500).selectExpr("concat('A sentence of the number ', id, ' stands here.') as text")
    hot = varied.orderBy(F.xxhash64("text")).limit(1).join(spark.range(5_000)).select("text")
    for docs in (varied, varied.union(hot)):
        quality.train(docs, sample=100)
    assert samples[0] == samples[1] and samples[0][0] == 100


def test_signals_and_features_against_plain_versions():
    texts = ["Hello WORLD. the the cat!", "", "   ", "日本語のテキスト。 中文 文本", "a|b | c; x? #tag $5 {y}", "один два три четыре", "aaa", "ab", "The The the"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    rows = []
    for t in raw:
        w = t.split()
        n, letters = max(1, len(w)), re.findall(b"[A-Za-z]", t)
        latin = len(letters) >= quality.LATIN * max(1, sum(map(len, w)))
        again = sum(a.lower() == b.lower() for a, b in zip(w, w[1:]))
        rows.append([len(re.findall(b"[A-Z]", t)) / max(1, len(letters)), len(re.findall(rb"[#$%&*+<=>@\[\]^_`{|}~\\/]", t)) / max(1, len(t)), t.count(b"!") / n, t.count(b"|") / n, again / n, sum(len(x) <= 3 for x in w) / n if latin else np.nan, len(re.findall(b"[.?;:]", t)) / n if latin else np.nan])
    found = quality.signals(data, offsets)
    assert np.allclose(found, rows, equal_nan=True)
    for row, code in zip(rows, quality.patterns(found).tolist()):
        votes = [1 if np.isnan(x) else (2 if up else 0) if x <= low else (0 if up else 2) if x >= high else 1 for x, (_, low, high, up) in zip(row, quality.LABELLERS)]
        assert code == sum(v * 3**k for k, v in enumerate(votes))
    row, dim, value = quality.hashed(data, offsets)
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    scores = quality.Scorer(np.zeros(1), np.zeros(1), weights).score(data, offsets)
    for k, t in enumerate(raw):
        grams = Counter(int(quality.mix(np.array([int.from_bytes(t[p : p + 3], "big")], np.uint64))[0] >> np.uint64(64 - quality.BITS)) for p in range(len(t) - 2))
        norm = np.sqrt(sum(grams.values()))
        got = dict(zip(dim[row == k].tolist(), value[row == k].tolist()))
        assert got.keys() == grams.keys() and all(abs(got[d] - np.sqrt(n) / norm) < 1e-9 for d, n in grams.items())
        assert abs(scores[k] - 1 / (1 + np.exp(-sum(weights[d] * v for d, v in got.items()) - weights[-1]))) < 1e-9


def test_fit_is_logistic_regression():
    """Against many plain gradient steps on a dense matrix."""
    rng = np.random.default_rng(2)
    dense = rng.random((60, 5)) * (rng.random((60, 5)) < 0.6)
    label = 1 / (1 + np.exp(-(dense @ [2, -3, 1, 0, 2] - 0.5)))
    row, dim = np.nonzero(dense)
    got = quality.fit(row, dim, dense[row, dim], label, steps=3000)
    balance = np.where(label >= 0.5, 0.5 / (label >= 0.5).mean(), 0.5 / (label < 0.5).mean())
    full, plain = np.hstack([dense, np.ones((60, 1))]), np.zeros(6)
    for _ in range(60_000):
        plain -= 1.0 * (full.T @ ((1 / (1 + np.exp(-full @ plain)) - label) * balance) / 60 + 1e-5 * plain)
    assert np.allclose(got[[0, 1, 2, 3, 4, -1]], plain, atol=0.02) and not got[5:-1].any()


def test_em_recovers_accuracies():
    rng = np.random.default_rng(7)
    n, kinds = 40_000, len(quality.LABELLERS)
    truth = rng.random(n) < 0.8
    right = np.linspace(0.7, 0.95, kinds)
    said = rng.random((n, kinds)) < right
    votes = np.where(said == truth[:, None], 2, 0)
    votes = np.where(rng.random((n, kinds)) < 0.3, 1, votes)
    codes = (votes * 3 ** np.arange(kinds)).sum(axis=1)
    posterior, accuracy = quality.em(np.bincount(codes, minlength=3**kinds).astype(float))
    assert np.abs(accuracy - right).max() < 0.05 and ((posterior[codes] > 0.5) == truth).mean() > 0.95
