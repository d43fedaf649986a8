"""Which of many names stand in which texts: an Aho-Corasick automaton with failure links, over parts of the names.

A text is read once for each part of PART names, whatever their number; one automaton serves 100,000 names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of an automaton: what one broadcast holds.
PART = 100_000


class Automaton:
    """States of all prefixes of names; step by step the longest prefix that ends at a place is known."""

    def __init__(self, names: list[str]) -> None:
        self.moves: list[dict[str, int]] = [{}]
        self.name: list[str | None] = [None]
        for name in names:
            state = 0
            for c in name:
                state = self.moves[state].setdefault(c, len(self.moves))
                if state == len(self.moves):
                    self.moves.append({})
                    self.name.append(None)
            self.name[state] = name
        self.fail, self.next_name = [0] * len(self.moves), [0] * len(self.moves)  # longest suffix that is a state; that is a name
        level = list(self.moves[0].values())
        while level:
            below = []
            for state in level:
                for c, child in self.moves[state].items():
                    below.append(child)
                    f = self.fail[state]
                    while f and c not in self.moves[f]:
                        f = self.fail[f]
                    self.fail[child] = f = self.moves[f].get(c, 0)
                    self.next_name[child] = f if self.name[f] is not None else self.next_name[f]
            level = below

    def within(self, text: str) -> set[str]:
        """The names that stand anywhere in a text."""
        moves, fail, state, seen = self.moves, self.fail, 0, set()
        for c in text:
            while state and c not in moves[state]:
                state = fail[state]
            state = moves[state].get(c, 0)
            at = state if self.name[state] is not None else self.next_name[state]
            while at and at not in seen:
                seen.add(at)
                at = self.next_name[at]
        return {self.name[s] for s in seen}


@functools.lru_cache(1)
def _built(names: tuple[str, ...]) -> Automaton:
    return Automaton(list(names))


def contained(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, name): each name (name) that stands in the text of a row, once for each row. Case counts; empty names and null
    texts find nothing."""
    kind = texts.schema[key].dataType.simpleString()
    known = names.select("name").filter("name <> ''").distinct()
    parts = max(1, -(-known.count() // PART))
    found = []
    for part in range(parts):
        own = tuple(sorted(r[0] for r in known.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).collect()))  # about PART names
        shared = texts.sparkSession.sparkContext.broadcast(own)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton = _built(shared.value)
            for frame in frames:
                rows = [(k, name) for k, t in zip(frame["k"], frame["t"], strict=True) if isinstance(t, str) for name in sorted(automaton.within(t))]
                yield pd.DataFrame(rows, columns=["k", "name"])

        found.append(texts.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").mapInPandas(run, f"k {kind}, name string"))
    return functools.reduce(DataFrame.unionByName, found).withColumnRenamed("k", key)
