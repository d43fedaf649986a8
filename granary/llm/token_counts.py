"""Token counts of a byte-level BPE tokenizer file, by rank-synchronous merging of ragged numpy arrays.

A batch's distinct pre-tokens lie as one flat array of symbols with row borders. In each round every row merges
all occurrences of its lowest-rank pair at once (from the left where they overlap), rows without a pair leave,
and the symbols that survive are counted. Counts of frequent pre-tokens are kept in a bounded table per task.

A pre-token of over LONG bytes is a round's only row: its places are kept by rank, so that a round touches only the
places of its pair and their neighbours, and the time grows in proportion to the length.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import mapped, slices, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Pre-tokens remembered in a task; the table is emptied when full.
REMEMBERED = 400_000
#: Pre-tokens of more bytes are merged one by one.
LONG = 1024
NO_RANK = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class RankMerger:
    """Merge ranks of a byte-level BPE vocabulary file, and the merging."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        order = np.argsort(left << 32 | right)
        self.keys = (left << 32 | right)[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)  # by rank
        self.of_byte = np.array([vocabulary[c] for c in byte_alphabet()], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def long_size(self, word: bytes) -> int:
        """Symbols left of a long word, by the same rounds."""
        n = len(word)
        symbols = self.of_byte[np.frombuffer(word, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # neighbours; n is the end
        rank = np.append(self.pair_ranks(symbols[:-1], symbols[1:]), NO_RANK)
        places: dict[int, list[np.ndarray]] = {}
        agenda: list[int] = []

        def note(at: np.ndarray) -> None:
            """Files places by the rank of the pair that begins there."""
            at = at[rank[at] != NO_RANK]
            at = at[np.argsort(rank[at], kind="stable")]
            cut = np.flatnonzero(np.diff(rank[at])) + 1
            for part, r in zip(np.split(at, cut), rank[at[np.append(0, cut)]].tolist() if len(at) else []):
                if r not in places:
                    places[r] = []
                    heapq.heappush(agenda, r)
                places[r].append(part)

        note(np.arange(n))
        while agenda:
            r = heapq.heappop(agenda)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            fresh = np.append(True, after[at[:-1]] != at[1:])  # in a run of overlapping pairs, every second one merges
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            symbols[at] = self.made[r]
            rank[gone] = NO_RANK
            after[at] = after[gone]
            before[after[at]] = at
            n -= len(at)
            near = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            rank[near] = NO_RANK
            near = near[after[near] < len(symbols)]
            rank[near] = self.pair_ranks(symbols[near], symbols[after[near]])
            note(near)
        return n

    def merged_sizes(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty word."""
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        if long:
            out = np.zeros(len(words), np.int64)
            out[long] = [self.long_size(words[k]) for k in long]
            short = np.flatnonzero(out == 0)
            if len(short):
                out[short] = self.merged_sizes([words[k] for k in short.tolist()])
            return out
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        out, rows = sizes.copy(), np.arange(len(words))
        while len(rows):
            row = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.full(len(symbols), NO_RANK)
            if len(symbols) > 1:
                inside = row[1:] == row[:-1]
                rank[:-1][inside] = self.pair_ranks(symbols[:-1][inside], symbols[1:][inside])
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            live = best != NO_RANK
            if not live.all():  # rows that are done leave
                out[rows[~live]] = sizes[~live]
                stay = live[row]
                symbols, rank, row = symbols[stay], rank[stay], (np.cumsum(live) - 1)[row[stay]]
                rows, sizes, best = rows[live], sizes[live], best[live]
                if not len(rows):
                    break
            hit = rank == best[row]
            at = np.flatnonzero(hit)
            fresh = np.ones(len(at), bool)  # in a run of overlapping pairs, every second one merges
            fresh[1:] = np.diff(at) > 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            sizes = sizes - np.bincount(row[at], minlength=len(sizes))
            symbols = symbols[keep]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings inside it count as one token each, as the library has it."""
        specials, split = [0] * len(texts), []
        for k, text in enumerate(texts):
            if self.cut_special and any(s in text for s in self.special):
                parts = self.cut_special.split(text)
                specials[k] = len(parts) - 1
                split.append([w for p in parts for w in self.split.findall(p)])
            else:
                split.append(self.split.findall(text))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list(set().union(*split) - known.keys())
        for lo in range(0, len(new), 200_000):
            some = new[lo : lo + 200_000]
            known.update(zip(some, self.merged_sizes([w.encode() for w in some]).tolist()))
        return [n + sum(map(known.__getitem__, words)) for n, words in zip(specials, split)]


_mergers: dict[tuple, RankMerger] = {}


def merger(path: str, pattern: str) -> RankMerger:
    """A worker reads a vocabulary once."""
    if (path, pattern) not in _mergers:
        _mergers[path, pattern] = RankMerger(path, pattern)
    return _mergers[path, pattern]


def count_tokens(texts: DataFrame, path: str | None = None, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each whole text; null counts as empty, with no tokens.

    path: a byte-level BPE vocabulary file that every executor can open; by default the installed package's.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        m = merger(path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
        try:
            for batch in batches:
                for some in slices(batch, 1, 2 << 20):
                    found = [t or "" for t in some.column(1).to_pylist()]
                    tokens = m.counts(found)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), pa.array([len(t.encode()) for t in found], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                        names=[id_column, "n_bytes", "n_tokens", "over_limit"],
                    )
        finally:
            m.known.clear()

    kind = texts.schema[id_column].dataType.simpleString()
    return texts.select(id_column, text_column).transform(mapped, count, f"{id_column} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
