"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language recognises every substring of that text. A new text is parsed
from left to right into longest matches: each phrase runs on while the automaton has a transition. Phrases are
normalised by the size of the language's text: each costs the bits that name a place in it. The language that needs
the fewest bits wins. Parsing runs in lock step over many texts and all languages at once, as numpy gathers in one
packed table of transitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import mapped, slices, table

#: Bytes of labelled text per language that an automaton is built from, and texts per language sampled for it.
TRAIN_BYTES, TRAIN_TEXTS = 49_152, 400
#: Bytes of a text that are parsed beside others at once; phrases run on over the border.
LANE = 1024
#: Bytes of text by languages that are held parsed at once.
BLOCK = 8 << 20
UNKNOWN = "und"
_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower case UTF-8, with a space for each other ASCII character than a letter."""
    return text.lower().encode().translate(_SPACED)


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings, state 0 first (the public online construction)."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def packed(state: np.ndarray, column: np.ndarray, target: np.ndarray, states: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, owner, target) of transitions, at most one for each state and column.

    States of most transitions come first; their places are drawn until they are free. Most states have one
    transition, and take what slots are left.
    """
    degree = np.bincount(state, minlength=states)
    room = width + max(len(state), int(2.2 * degree[degree > 1].sum())) + width
    slot, owner, to = np.zeros(states, np.int32), np.full(room + width, -1, np.int32), np.zeros(room + width, np.int32)
    by_state = np.argsort(state, kind="stable")
    begin = np.cumsum(degree) - degree
    rng = np.random.default_rng(1)
    for d in np.unique(degree[degree > 1])[::-1]:
        waiting = np.flatnonzero(degree == d)
        while len(waiting):
            some = waiting[:4096]
            own = by_state[begin[some][:, None] + np.arange(d)]
            place = rng.integers(width, room, len(some)).astype(np.int32)
            at = place[:, None] + column[own]
            good = np.zeros(at.size, bool)
            good[np.unique(at, return_index=True)[1]] = True  # of those that ask for one slot, the first gets it
            placed = (good.reshape(at.shape) & (owner[at] < 0)).all(axis=1)
            slot[some[placed]] = place[placed]
            owner[at[placed]], to[at[placed]] = some[placed][:, None], target[own[placed]]
            waiting = np.concatenate([some[~placed], waiting[4096:]])
    single = np.flatnonzero(degree == 1)
    own = by_state[begin[single]]
    at = width + np.flatnonzero(owner[width:] < 0)[: len(single)]
    slot[single], owner[at], to[at] = at - column[own], single, target[own]
    return slot, owner, to


class CrossParser:
    """The automata of all languages as one packed table of transitions.

    State s has its transition on a byte of column c, if any, at slot[s] + c: there owner is s, and target is the
    next state; it is -1 where there is none. Rows of slots overlap where their transitions do not meet. State 0 has
    none: a phrase that is in it has ended. Bytes that occur in no training text share column 0, which leads nowhere.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        used = sorted(set(b"".join(samples.values())))
        self.column = np.zeros(256, np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        states, columns, targets, roots, base = [], [], [], [], 1
        for lang in self.languages:
            moves = suffix_automaton(samples[lang])
            states.append(np.repeat(np.arange(len(moves)), [len(m) for m in moves]) + base)
            columns.append(self.column[np.fromiter((c for m in moves for c in m), np.int64)])
            targets.append(np.fromiter((t for m in moves for t in m.values()), np.int64) + base)
            roots.append(base)
            base += len(moves)
        none = [np.zeros(0, np.int64)]
        self.slot, self.owner, self.target = packed(*(np.concatenate(x or none) for x in (states, columns, targets)), base, len(used) + 1)
        #: Where a phrase that begins with a byte goes; after an unknown byte, which is a phrase by itself, nothing goes on.
        every = np.arange(len(used) + 1)
        self.first = self.step(np.repeat(np.array(roots, np.int32)[:, None], len(every), axis=1), every)
        #: Bits that a phrase costs: a place in the language's text, and no less than the byte by which it ends.
        self.bits = np.array([max(8.0, np.log2(len(samples[lang]) + 1)) for lang in self.languages])

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        at = self.slot.take(state) + column
        return np.where(self.owner.take(at) == state, self.target.take(at), 0)

    def advance(self, state: np.ndarray, column: np.ndarray, lang: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after a byte, and whether it began a phrase. lang: of each state, if they are not a row for each."""
        at = self.slot.take(state) + column
        on = self.owner.take(at) == state
        start = self.first.take(column, axis=1) if lang is None else self.first[lang, column]
        return np.where(on, self.target.take(at), start), ~on

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text by each language, as a matrix.

        Texts are parsed in lanes of LANE bytes at once, each from its own beginning. Then the last phrase of each
        lane is carried on into the next one, until it ends where a phrase of that lane begins: from there on that
        lane's parse is the text's. The phrases before that place are replaced by those carried on. Where a parse never
        falls in with a lane's, as in copies of a language's own text, that text is parsed from its beginning.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        data = self.column[np.frombuffer(b"".join(texts), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        total, rest = self._in_lanes(data, starts, sizes)
        for text, lang in rest:
            total[text, lang] = self._one_by_one(data[starts[text] : starts[text] + sizes[text]], lang)
        return total

    def _one_by_one(self, columns: np.ndarray, lang: int) -> int:
        """Phrases of one text by one language."""
        slot, owner, target, first = (memoryview(x) for x in (self.slot, self.owner, self.target, np.ascontiguousarray(self.first[lang])))
        state = n = 0
        for c in columns.tolist():
            at = slot[state] + c
            if owner[at] == state:
                state = target[at]
            else:
                n += 1
                state = first[c]
        return n

    def _in_lanes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Phrases of each text by each language, and the pairs of text and language that cannot be parsed in lanes."""
        lane = LANE
        n_lang = len(self.first)
        lanes = (sizes + lane - 1) // lane
        owner = np.repeat(np.arange(len(sizes)), lanes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = starts[owner] + within * lane
        size = np.minimum(lane, sizes[owner] - within * lane)
        follows = np.flatnonzero(within[1:] > 0)  # lanes that have a next one in their text, whole ones all
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(1, lane + 1), "right") if len(size) else np.zeros(0, np.int64)  # lanes of at least so many bytes
        state = np.zeros((n_lang, len(at)), np.int32)
        count = np.zeros(state.shape, np.int32)
        begins = np.zeros((lane if len(follows) else 0, n_lang, len(at)), bool)
        for k in range(int(size.max()) if len(size) else 0):
            n = alive[k]
            state[:, :n], began = self.advance(state[:, :n], data[at[order[:n]] + k])
            count[:, :n] += began
            if len(follows):
                begins[k, :, :n] = began
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        count = count[:, place].astype(np.int64)
        odd: set[tuple[int, int]] = set()
        if len(follows):
            lang = np.repeat(np.arange(n_lang), len(follows))
            into = np.tile(follows + 1, n_lang)
            now = state[lang, place[into - 1]]
            for k in range(lane):
                ends = size[into] == k  # the text ends while the phrase is carried on: its last lane is replaced as a whole
                now, began = self.advance(now[~ends], data[at[into[~ends]] + k], lang[~ends])
                lang, into = lang[~ends], into[~ends]
                own = begins[k, lang, place[into]]
                np.add.at(count, (lang, into), began.astype(np.int64) - own)
                met = began & own
                now, lang, into = now[~met], lang[~met], into[~met]
                if not len(now):
                    break
            full = size[into] == lane  # the next lane's parse was never the text's
            odd.update(zip(owner[into[full]].tolist(), lang[full].tolist()))
        total = np.zeros((len(sizes), n_lang), np.int64)
        for j in range(n_lang):
            total[:, j] = np.bincount(owner, count[j], minlength=len(sizes))
        return total, sorted(odd)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language that needs fewest bits for its phrases, ties by name, and its share of the inverse costs."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        has = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if has and self.languages:
            found = self.phrases([normal(texts[k]) for k in has]) * self.bits
            best = found.argmin(axis=1)
            share = (1 / found.min(axis=1)) / (1 / found).sum(axis=1)
            for k, b, s in zip(has, best, share):
                names[k], scores[k] = self.languages[b], float(s)
        return names, scores


def train(labelled: DataFrame, train_bytes: int = TRAIN_BYTES, train_texts: int = TRAIN_TEXTS) -> CrossParser:
    """Automata from (text, lang): per language the texts of least hash, train_texts of them at most, read in that
    order and cut at train_bytes in all, and of each at most the first sixteenth of train_bytes characters: a bound of
    what is learned from, so that 16 texts or more teach each language. Rows with null text or lang teach nothing.

    The hash bound that gives the sample is set per language from its distinct texts, counted over all rows: copies
    of a text have one hash, so they count once here as they do in the sample.
    """
    piece = max(512, train_bytes // 16)  # of a text at most
    rows = labelled.select("text", "lang").filter("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return CrossParser({})
    bound = F.lit(None).cast("double")
    for lang, n in counts.items():  # a little over train_texts distinct texts stay, whatever the size of the input
        bound = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * max(train_texts, 100) / n))).otherwise(bound)
    near = rows.filter((F.col("h").cast("double") / float(2**64) + 0.5) <= bound)
    short = near.select("lang", "h", F.substring("text", 1, piece).alias("text")).dropDuplicates(["lang", "h"])
    ranked = short.selectExpr("*", "row_number() over (partition by lang order by h) as k").filter(F.col("k") <= train_texts)
    samples: dict[str, list[bytes]] = {}
    for r in ranked.orderBy("lang", "k").toLocalIterator():
        texts = samples.setdefault(r["lang"], [])
        if sum(map(len, texts)) < train_bytes:
            texts.append(normal(r["text"])[:piece])
    return CrossParser({lang: b" ".join(texts)[:train_bytes] for lang, texts in samples.items() if texts})


def identify(texts: DataFrame, parser: CrossParser, keep: tuple[str, ...] = (), text_column: str = "text") -> DataFrame:
    """The columns of keep, lang_pred and score (0 to 1) of each whole text; `und` and 0 if it is null or has no letter
    (a character of a category L). Repeated rows get equal results; an empty table gives no rows."""
    shared: Broadcast = texts.sparkSession.sparkContext.broadcast(parser)  # bounded by train_bytes and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for some in slices(batch, batch.num_columns - 1, BLOCK // max(4, len(p.languages))):
                names, scores = p.predict(some.column(some.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in keep)
    return texts.select(*keep, F.col(text_column).alias("__text")).transform(mapped, run, fields + "lang_pred string, score double")


def held_out() -> F.Column:
    """Rows that nothing is learned from: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    parser = train(docs.filter(~held_out()))
    marked = docs.withColumn("held_out", held_out())
    return identify(marked, parser, keep=("doc_id", "held_out"))
