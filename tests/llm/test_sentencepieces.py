"""SentencePiece encoding against the library and plain merge-dropout."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from granary.llm import sentencepieces, token_counts
from tests.llm.helpers import words


def test_sentencepiece_agrees_and_is_lossless(spark, awkward_docs, awkward):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepieces.MODEL))
    plain = {r.doc_id: r for r in sentencepieces.encode(awkward_docs, dropout=0.0).collect()}
    for r in awkward:
        if r[0] is not None and "▁" not in (r[1] or ""):
            assert list(plain[r[0]].pieces) == library.encode(r[1] or "")
    seen = set()
    for dropout in (0.0, 0.1, 0.9):
        coded = sentencepieces.encode(awkward_docs, dropout=dropout)
        out = sentencepieces.decode(coded.withColumnRenamed("text", "original"), keep=("doc_id", "original")).collect()
        assert len(out) == len(awkward) and all(r.decoded == (r.original or "") for r in out)
        both = sentencepieces.round_trip(awkward_docs, dropout=dropout).collect()
        assert all(r.lossless for r in both) and sorted(map(str, (list(r.pieces) for r in both))) == sorted(map(str, (list(r.pieces) for r in out)))
        assert sorted(r.decoded_sha256 for r in both) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in awkward)
        seen.add(sum(len(r.pieces) for r in out))
    assert len(seen) == 3
    again = [sorted((str(r.doc_id), list(r.pieces)) for r in sentencepieces.encode(awkward_docs, seed=s).collect()) for s in (1, 1, 2)]
    assert again[0] == again[1] != again[2]


def test_sentencepiece_streams_vary_repeated_words():
    import public_tokenizers

    model = sentencepieces.PieceModel(public_tokenizers.path(sentencepieces.MODEL))
    pieces = model.encode(["international " * 200], 0.3, 9)[0]
    forms = set(" ".join(map(str, pieces.tolist())).split(str(pieces[0])))
    assert len(forms) > 2


def test_sentencepiece_draws_anew_at_each_place():
    import public_tokenizers

    model = sentencepieces.PieceModel(public_tokenizers.path(sentencepieces.MODEL))

    size = 40_000
    starts = [r.startswith(b" ") for r in sentencepieces.PieceBytes(public_tokenizers.path(sentencepieces.MODEL)).raw]
    flat = model.encode([" ".join(["international"] * size)], 0.3, 9)[0]
    at = np.flatnonzero(np.array(starts)[flat])
    found = Counter(tuple(p.tolist()) for p in np.split(flat, at[1:]))
    assert len(at) == size and len(found) > 20
    pieces, sizes, _ = model.merge([" international"] * size, None, np.arange(size, dtype=np.uint64), 0.3)  # nothing remembered
    plain = Counter(tuple(p.tolist()) for p in np.split(pieces, np.cumsum(sizes)[:-1]))
    assert all(abs(n - found[form]) < 0.02 * size for form, n in plain.most_common(10))
    model.forget()
    assert len(model.encode(["x" * 50], 0.3, 9)[0]) and not model.known  # too long to be remembered


def plain_merges(model, segment, key, dropout):
    """The steps of one segment on a list: best candidate first, then leftmost, or skipped when its number comes up."""
    row = model.symbols([segment])[0].tolist()
    dead, skips, step = set(), 0, 0  # candidates are known by their symbols' marks
    marks = list(range(len(row)))
    fresh = len(row)
    gap = lambda n: int(sentencepieces.gaps(np.array([key], np.uint64), n, dropout)[0])
    skip = gap(0)
    while True:
        options = []
        for at in range(len(row) - 1):
            order, made = model.candidates(np.array([row[at]]), np.array([row[at + 1]]))
            if order[0] < 1 << 40 and (marks[at], marks[at + 1]) not in dead:
                options.append((int(order[0]), at, int(made[0])))
        if not options:
            return row
        _, at, made = min(options)
        if step == skip:
            dead.add((marks[at], marks[at + 1]))
            skips += 1
            skip = step + 1 + gap(skips)
        else:
            row[at : at + 2], marks[at : at + 2] = [made], [fresh]
            fresh += 1
        step += 1


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_merge_dropout_against_a_plain_version(dropout):
    import public_tokenizers

    model = sentencepieces.PieceModel(public_tokenizers.path(sentencepieces.MODEL))
    rng = random.Random(8)
    said = [" internationalisation", "aaaaaaaaaaaaa", " the", "x", "été日本", " " + "".join(rng.choice("thenatior") for _ in range(60))]
    keys = np.array([rng.randrange(1 << 63) for _ in said], np.uint64)
    flat, sizes, _ = model.merge(said, None, keys, dropout)
    for segment, key, got in zip(said, keys, np.split(flat, np.cumsum(sizes)[:-1])):
        expected = plain_merges(model, segment, key, dropout)
        assert got.tolist() == expected and model.merge_long(segment, key, dropout).tolist() == expected


def test_long_segments_and_words(monkeypatch):
    """A megabyte without a space takes seconds, and rounds on long words give the library's counts."""
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(9)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(300_000))
    model = sentencepieces.PieceModel(public_tokenizers.path(sentencepieces.MODEL))
    merger = token_counts.merger(public_tokenizers.path(token_counts.VOCABULARY), public_tokenizers.PATTERN)
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    began = time.time()
    pieces = model.encode([word], 0.1, 1)[0]
    assert sentencepieces.PieceBytes(public_tokenizers.path(sentencepieces.MODEL)).decode(pieces.tolist()).decode() == word
    assert merger.counts([word]) == [len(library.encode(word, add_special_tokens=False).ids)]
    assert time.time() - began < 30
    monkeypatch.setattr(token_counts, "LONG", 3)
    said = ["aaaaaaaaaa", "abababab", "internationalisation", "thethethethe" * 9, "a" * 999, word[:2000]]
    merger.known.clear()
    assert merger.counts(said) == [len(library.encode(t, add_special_tokens=False).ids) for t in said]
    merger.known.clear()
