"""Suffix-array dedup against counting of all strings."""

import random

import pytest

from granary.llm import suffix_dedup
from tests.llm.helpers import words, plain_dedup, plain_passages


@pytest.mark.parametrize("group", [256, 2])
def test_suffix_dedup_is_exact(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(11)
    shared = [words(rng, 90), words(rng, 70), "é" * 250]
    texts = []
    for k in range(60):
        parts = [words(rng, rng.randrange(5, 60)) for _ in range(3)]
        if k % 2:
            parts.insert(1, shared[k % 3])
        if k % 7 == 0:
            parts += [shared[0]] * 2
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3][:500], "z" * 2000, "zz" * 150, "", None, "x" * 399]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == plain_dedup(texts, 400)


def test_repeat_groups_have_all_occurrences(spark):
    rng = random.Random(21)
    shared = [words(rng, 90), words(rng, 120), "é" * 250]
    texts = [" ".join([words(rng, rng.randrange(5, 40)), shared[k % 3], words(rng, 30)]) for k in range(12)] + ["z" * 900, "", None, shared[1] + "!", words(rng, 200)]
    rows = suffix_dedup.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    raw = [(t or "").encode() for t in texts]
    groups = {}
    for r in rows:
        groups.setdefault((r.gid, r.n_bytes), set()).add((r.doc_id, r.first))
    covered = [bytearray(len(t)) for t in raw]
    extended = 0
    for (_, n), places in groups.items():
        said = {raw[d][p : p + n] for d, p in places}
        assert n >= 400 and len(said) == 1
        text = said.pop()
        assert places == {(d, p) for d, t in enumerate(raw) for p in range(len(t) - n + 1) if t[p : p + n] == text} and len(places) > 1
        extended += len({raw[d][p - 1 : p] for d, p in places}) > 1 and len({raw[d][p + n : p + n + 1] for d, p in places}) > 1
        for d, p in places:
            covered[d][p : p + n] = b"\1" * n
    assert extended  # repeats that end inside a block cannot be extended on either side
    assert [sum(c) for c in covered] == [removed for _, removed, _, _ in plain_dedup(texts, 400)]


def test_repeated_passages_of_words(spark):
    rng = random.Random(12)
    shared = [words(rng, 51), words(rng, 50), words(rng, 80, 2000), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(70))]
    texts = []
    for k in range(60):
        parts = [words(rng, rng.randrange(5, 60)) for _ in range(3)]
        if k % 2:
            parts.insert(1, shared[k % 4] if k % 3 else shared[2].title().replace(" ", "\n "))
        if k % 7 == 0:
            parts += [shared[3]] * 2
        texts.append(" ".join(parts))
    texts += ["de " * 200, "日本語" * 60, "", None, texts[1], texts[1], "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_passages, r.kept) for r in suffix_dedup.dedup(docs, as_text=True, words=51, by_words=True).collect()}
    assert [got[k] for k in range(len(texts))] == plain_passages(texts, 51)
    both = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n_passages) for r in suffix_dedup.dedup(docs, words=51).collect()}
    assert [both[k] for k in range(len(texts))] == [(*a, b[0]) for a, b in zip(plain_dedup(texts, 400), plain_passages(texts, 51))]


def test_suffix_dedup_awkward(awkward_docs, awkward):
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(awkward_docs).collect())
    small = [r[1] for r in awkward]
    long = [t for t in small if t and len(t) > 10_000]
    assert len(got) == len(awkward)
    assert got == sorted([*plain_dedup([t for t in small if t not in long], 400), *((len(t), len(t), 1, b"") for t in long)])


def test_intervals_are_all_common_prefix_intervals():
    rng = random.Random(2)
    for _ in range(50):
        common = [rng.randrange(5) for _ in range(rng.randrange(1, 12))]
        plain = set()
        for a in range(len(common)):
            for b in range(a, len(common)):
                least = min(common[a : b + 1])
                if (a == 0 or common[a - 1] < least) and (b == len(common) - 1 or common[b + 1] < least):
                    plain.add((a, b + 1, least))
        assert set(suffix_dedup.intervals(common)) == plain
