"""Quality classifier from weak labels.

Overlapping heuristics vote on each text: good, junk, or nothing. Expectation-maximisation over the counts of
all vote patterns estimates the share of good texts and how each heuristic votes on good and on junk texts,
without any given label. The posterior of a text's pattern is its label, and the labels of a bounded sample
train a linear scorer on hashed byte trigrams, which also sees what no heuristic asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import SPACES, mapped, mix, table, utf8_blocks, word_hashes

#: Distinct texts that the scorer is trained on, at most: those of least hash.
SAMPLE = 4000
#: Dimensions of the scorer.
BITS = 14
ROUNDS = 200

#: Heuristics: name, and the bounds of its signal. Up to the first it votes one way, from the second the other way.
#: A True last field says that high values are junk. A signal that says nothing about a text is not a number, and is no
#: vote: word sizes and stops count in texts of which LATIN or more of the bytes of words are ASCII letters.
LATIN = 0.5
LABELLERS = (
    ("upper_share", 0.15, 0.4, True),
    ("odd_share", 0.01, 0.04, True),
    ("bang_rate", 0.02, 0.2, True),
    ("bar_rate", 0.01, 0.2, True),
    ("repeat_rate", 0.05, 0.2, True),
    ("short_rate", 0.08, 0.2, False),
    ("stop_rate", 0.015, 0.03, False),
)

_UPPER, _LETTER, _ODD, _BANG, _BAR, _STOP = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_ODD[[ord(c) for c in "#$%&*+<=>@[]^_`{|}~\\/"]] = True
_BANG[33] = True
_BAR[124] = True
_STOP[[ord(c) for c in ".?;:"]] = True


def signals(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The heuristics' signals, a row for each text; a text without words has zeros, and none of the last two."""

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[data])])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    hashes, starts, ends, first = word_hashes(data, offsets, SPACES)
    words = np.maximum(np.diff(first), 1)
    of_words = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[first])
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(hashes)]] = False
    size = np.maximum(np.diff(offsets), 1)
    latin = count(_LETTER) >= LATIN * np.maximum(of_words(ends - starts), 1)
    short, stops = (np.where(latin, x / words, np.nan) for x in (of_words(ends - starts <= 3), count(_STOP)))
    return np.stack([count(_UPPER) / np.maximum(count(_LETTER), 1), count(_ODD) / size, count(_BANG) / words, count(_BAR) / words, of_words(again) / words, short, stops], axis=1)


def patterns(found: np.ndarray) -> np.ndarray:
    """Votes as one number to base 3, a digit for each heuristic: 0 junk, 1 nothing, 2 good."""
    total = np.zeros(len(found), np.int64)
    for k, (_, low, high, junk_high) in enumerate(LABELLERS):
        vote = np.where(found[:, k] <= low, 2, np.where(found[:, k] >= high, 0, 1))
        total += (vote if junk_high else 2 - vote) * 3**k
    return total


def em(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of being good for each vote pattern, and each heuristic's accuracy where it votes.

    The start is the majority's vote. A text is good or junk; votes depend on that alone.
    """
    codes = np.arange(len(counts))
    votes = np.stack([codes // 3**k % 3 for k in range(len(LABELLERS))], axis=1)
    for_good = (votes - 1).sum(axis=1)
    good = np.where(for_good > 0, 0.9, np.where(for_good < 0, 0.1, 0.5))
    good = np.where((votes == 0).sum(axis=1) >= 2, 0.1, good)  # heuristics for junk seldom agree by accident
    shares = np.zeros((2, len(LABELLERS), 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        for v in range(3):
            shares[:, :, v] = weight @ (votes == v) + 0.5
        shares /= shares.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        log = np.log(prior)[:, None] + np.stack([np.log(shares[c][np.arange(len(LABELLERS)), votes]).sum(axis=1) for c in range(2)])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    right = shares[1, :, 2] * prior[1] + shares[0, :, 0] * prior[0]
    wrong = shares[1, :, 0] * prior[1] + shares[0, :, 2] * prior[0]
    return good, right / np.maximum(right + wrong, 1e-12)


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, value) of each text's hashed byte trigrams, scaled to length 1."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    wide = data.astype(np.uint64)
    gram = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:-2] == row[2:]
    key = row[:-2][inside] << BITS | (mix(gram[inside]) >> np.uint64(64 - BITS)).astype(np.int64)
    if len(offsets) - 1 <= 64:
        n = np.bincount(key)
        at = np.flatnonzero(n)
        n = n[at]
    else:
        at, n = np.unique(key, return_counts=True)
    row, value = at >> BITS, np.sqrt(n)
    length = np.sqrt(np.bincount(row, value**2, minlength=len(offsets) - 1))
    return row, at & ((1 << BITS) - 1), value / length[row]


def fit(row: np.ndarray, dim: np.ndarray, value: np.ndarray, label: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; the last weight is the bias."""
    weights = np.zeros((1 << BITS) + 1)
    before = weights.copy()
    balance = np.where(label >= 0.5, 0.5 / max((label >= 0.5).mean(), 1e-3), 0.5 / max((label < 0.5).mean(), 1e-3))
    for t in range(steps):
        ahead = weights + t / (t + 3) * (weights - before)
        z = np.bincount(row, ahead[dim] * value, minlength=len(label)) + ahead[-1]
        error = (1 / (1 + np.exp(-z)) - label) * balance
        slope = np.append(np.bincount(dim, error[row] * value, minlength=1 << BITS), error.sum()) / len(label) + 1e-5 * ahead
        before, weights = weights, ahead - 2.0 * slope
    return weights


class Scorer:
    """What scoring needs: posteriors by pattern, accuracies of the heuristics, weights."""

    def __init__(self, posterior: np.ndarray, accuracy: np.ndarray, weights: np.ndarray):
        self.posterior, self.accuracy, self.weights = posterior, accuracy, weights

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, dim, value = hashed(data, offsets)
        z = np.bincount(row, self.weights[dim] * value, minlength=len(offsets) - 1) + self.weights[-1]
        return 1 / (1 + np.exp(-z))


def train(texts: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Counts the vote patterns of all texts with words, estimates the label model, and fits the scorer to the sample.

    Copies count in the label model. In the sample a text stands once, however often it occurs: by its number, one
    large group of copies would outweigh all other texts.
    """
    said = texts.select("text").filter(F.col("text").rlike(r"\S"))
    hashed_texts = said.withColumn("h", F.xxhash64("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, data, offsets in utf8_blocks(batch.column(0)):
                own += np.bincount(patterns(signals(data, offsets)), minlength=len(own))
        seen = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(own[seen])], names=["pattern", "n"])

    counts = np.zeros(3 ** len(LABELLERS))
    for r in said.transform(mapped, vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect():  # 3**7 rows at most
        counts[r["pattern"]] = r["n"]
    posterior, accuracy = em(counts)
    total = hashed_texts.select("h").distinct().count()
    if not total:
        return Scorer(posterior, accuracy, np.zeros((1 << BITS) + 1))
    keyed = hashed_texts.filter((F.col("h").cast("double") / float(2**64) + 0.5) <= min(1.0, 1.3 * sample / total + 20 / total))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # little over sample
        for batch in batches:
            own = batch.column(1).to_pylist()
            fresh = [k for k, h in enumerate(own) if h not in seen and not seen.add(h)]
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            for lo, hi, data, offsets in utf8_blocks(batch.column(0)):
                row, dim, value = hashed(data, offsets)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                parts = [(dim[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes()) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, hi - lo), pa.array(patterns(signals(data, offsets))), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["h", "pattern", "dims", "vals"]
                )

    made = keyed.select("text", "h").transform(mapped, features, "h long, pattern long, dims binary, vals binary")
    rows = made.groupBy("h").agg(F.min(F.struct("pattern", "dims", "vals")).alias("f")).select("h", "f.*").orderBy("h").limit(sample).collect()
    if not rows:
        return Scorer(posterior, accuracy, np.zeros((1 << BITS) + 1))
    dims = [np.frombuffer(r["dims"], np.int32) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(d) for d in dims])
    value = np.concatenate([np.frombuffer(r["vals"], np.float32) for r in rows])
    return Scorer(posterior, accuracy, fit(row, np.concatenate(dims), value.astype(np.float64), posterior[[r["pattern"] for r in rows]]))


def classify(texts: DataFrame, scorer: Scorer, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, posterior, score, keep) of each whole text: the label model's view, the scorer's, and whether their mean
    is 0.5 or more. A null text, or one without words, has null posterior, score 0, and is not kept."""
    shared = texts.sparkSession.sparkContext.broadcast(scorer)  # 150 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            for lo, hi, data, offsets in utf8_blocks(batch.column(1), 1 << 18):
                found = signals(data, offsets)
                bare = np.diff(word_hashes(data, offsets, SPACES)[3]) == 0
                score = np.where(bare, 0.0, np.round(s.score(data, offsets), 6))
                posterior = np.round(s.posterior[patterns(found)], 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(posterior, mask=bare), pa.array(score), pa.array(~bare & (posterior + score >= 1.0))], names=[id_column, "posterior", "score", "keep"])

    kind = texts.schema[id_column].dataType.simpleString()
    return texts.select(id_column, text_column).transform(mapped, run, f"{id_column} {kind}, posterior double, score double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs))
