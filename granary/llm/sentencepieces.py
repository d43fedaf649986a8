"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding merges neighbouring symbols of a BPE model. In each step a segment takes its best candidate merge (best
score, then leftmost) from its agenda. With dropout, the step skips it instead with that probability. A skipped
candidate never returns, as other merges may bring about new ones. Many segments take their steps at once, as
ragged numpy arrays.

A long segment takes its steps by itself, with its agenda as a heap, in time in proportion to its length.

Pieces never cross from a word to a following space or line end, so a segment is a run of spaces with the word
after it. The draws of each occurrence of a segment are its own: a hash of seed, the text, the segment's place in it
and the number of skips so far gives how many steps go well before the next skip. What is remembered is what a segment
becomes by the steps that skip, none, one or two of them; which of them hold is drawn anew for each occurrence.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import mapped, mix, table, utf8_blocks

MODEL = "piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20240501
#: Outcomes of segments in a worker's table; when it is full it begins anew.
REMEMBERED = 300_000
#: Segments of up to so many characters are remembered, with up to so many skips.
SHORT, SKIPS = 40, 2
#: Segments of more symbols take their steps by themselves.
LONG = 512
#: A step that is never reached.
NEVER = 1 << 40
SPACE = "▁"
NONE = -1
_SEGMENT = re.compile(r" *[^ \n]+| +|\n")


def gaps(keys: np.ndarray, number: np.ndarray | int, dropout: float) -> np.ndarray:
    """Steps that go well before each key's skip of that number (geometric, from a keyed hash)."""
    if dropout <= 0:
        return np.full(len(keys), NEVER)
    if dropout >= 1:
        return np.zeros(len(keys), np.int64)
    draw = mix(keys + (np.zeros(len(keys), np.int64) + number + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.minimum(np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / np.log1p(-dropout), NEVER).astype(np.int64)


class PieceModel:
    """Pieces and scores of a BPE model file, and encoding by their order."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usual = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        text = {k: model.id_to_piece(k) for k in usual}
        number = {t: k for k, t in text.items()}
        self.byte = np.zeros(256, np.int64)
        for k in range(size):
            if model.is_byte(k):
                self.byte[int(model.id_to_piece(k)[3:5], 16)] = k
        #: Of a pair of symbols: the piece it makes and the order of its score, best first.
        order = {k: n for n, k in enumerate(sorted(usual, key=lambda k: (-model.get_score(k), k)))}
        self.char = {t: k for t, k in number.items() if len(t) == 1}
        pairs = [(number.get(t[:c], NONE), number.get(t[c:], NONE), k) for k, t in text.items() for c in range(1, len(t))]
        pairs = [p for p in pairs if p[0] != NONE and p[1] != NONE]
        left, right, made = (np.array([p[c] for p in pairs], np.int64) for c in range(3))
        by_key = np.argsort(left << 32 | right)
        self.keys, self.made = (left << 32 | right)[by_key], made[by_key]
        self.order = np.array([order[k] for k in self.made.tolist()], np.int64)
        #: Pieces of characters by code point, below 65536; none for those that go by bytes.
        self.of_point = np.full(1 << 16, NONE, np.int64)
        for t, k in self.char.items():
            if ord(t) < 1 << 16 and t != SPACE:
                self.of_point[ord(t)] = k
        self.of_point[32] = self.char.get(SPACE, NONE)
        self.forget()

    def forget(self) -> None:
        """Outcomes by segment, and by outcome and next skip; of each, its steps and where its pieces are. The first
        one is of no segment."""
        self.known: dict[str, int] = {}
        self.after: dict[int, int] = {}
        self.steps, self.first, self.size = (np.zeros(1, np.int64) for _ in range(3))
        self.pieces = np.zeros(0, np.int32)

    def candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of each pair's merge (large if there is none) and the piece it makes."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.order[at], 1 << 40), self.made[at]

    def symbols(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters as pieces, and how many of each segment; one that is no piece as its bytes. A written U+2581
        goes by bytes, so it stays itself."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        out = np.where(points < 1 << 16, self.of_point[np.minimum(points, 0xFFFF)], NONE)
        odd = np.flatnonzero(out == NONE)
        if len(odd):
            parts, width, last = [], np.ones(len(out), np.int64), 0
            for at in odd.tolist():
                c = chr(points[at])
                k = self.char.get(c, NONE) if c != SPACE else NONE
                own = np.array([k], np.int64) if k != NONE else self.byte[np.frombuffer(c.encode(), np.uint8)]
                parts += [out[last:at], own]
                width[at], last = len(own), at + 1
            row = np.repeat(np.arange(len(segments)), sizes)
            return np.concatenate([*parts, out[last:]]), np.bincount(row, width, minlength=len(segments)).astype(np.int64)
        return out, sizes

    def merge(self, segments: list[str], planned: np.ndarray | None, keys: np.ndarray | None = None, dropout: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces, how many each segment has, and how many steps it took. The steps that skip are planned (a row
        for each segment, ascending, NEVER at the end), or drawn from the keys."""
        symbols, sizes = self.symbols(segments)
        none = 1 << 40
        skips = np.zeros(len(segments), np.int64)
        skip = gaps(keys, 0, dropout) if planned is None else planned[:, 0].copy()
        steps, step = np.zeros(len(segments), np.int64), 0

        def ranked(at: np.ndarray) -> np.ndarray:
            """Orders of the candidates that begin at symbols at."""
            order, made[at] = self.candidates(symbols[at], symbols[at + 1])
            return order

        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # segments, their sizes, and all their pieces
        rows = np.arange(len(segments))
        row = np.repeat(rows, sizes)
        made = np.zeros(len(symbols), np.int64)
        order = np.full(len(symbols), none)
        at = np.flatnonzero(row[1:] == row[:-1])
        order[at] = ranked(at)
        while len(rows):
            first = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(order, first)
            live = best < none
            if not live.all():
                stay = live[row]
                done.append((rows[~live], sizes[~live], symbols[~stay]))
                steps[rows[~live]] = step
                row = (np.cumsum(live) - 1)[row[stay]]
                symbols, order, made = (x[stay] for x in (symbols, order, made))
                rows, sizes, best = rows[live], sizes[live], best[live]
                if not len(rows):
                    break
            hit = np.flatnonzero(order == best[row])
            hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]  # the leftmost of each segment
            skipped = skip[rows] == step  # each segment has one hit, in order
            if skipped.any():
                order[hit[skipped]] = none
                who = rows[skipped]
                skips[who] += 1
                if planned is None:
                    skip[who] = step + 1 + gaps(keys[who], skips[who], dropout)
                else:
                    skip[who] = np.where(skips[who] < planned.shape[1], planned[who, np.minimum(skips[who], planned.shape[1] - 1)], NEVER)
                hit = hit[~skipped]
            step += 1
            if not len(hit):
                continue
            symbols[hit] = made[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            sizes = sizes - ~skipped
            moved = hit - np.arange(len(hit))
            symbols, order, made, row = (x[keep] for x in (symbols, order, made, row))
            order[moved] = none
            order[moved[moved > 0] - 1] = none  # a row's last symbol begins no candidate
            near = np.zeros(len(row), bool)
            near[moved] = near[moved[moved > 0] - 1] = True
            fresh = np.flatnonzero(near[:-1] & (row[:-1] == row[1:]))
            order[fresh] = ranked(fresh)
        which, size, flat = (np.concatenate(x) for x in zip(*done))
        start = np.zeros(len(segments), np.int64)
        count = np.zeros(len(segments), np.int64)
        start[which], count[which] = np.cumsum(size) - size, size
        return spans(flat.astype(np.int32), start, count), count, steps

    def merge_long(self, segment: str, key: np.uint64, dropout: float) -> np.ndarray:
        """The pieces of one segment, by the same steps: a heap holds the candidates by order and place."""
        symbols = self.symbols([segment])[0].tolist()
        n, none = len(symbols), 1 << 40
        after, before = list(range(1, n + 1)), list(range(-1, n))
        keys = np.array([key], np.uint64)
        seen: dict[int, tuple[int, int]] = {}

        def candidate(at: int) -> tuple[int, int]:
            """Order and piece of the pair that begins there."""
            pair = symbols[at] << 32 | symbols[after[at]]
            if pair not in seen:
                order, made = self.candidates(*(np.array([x]) for x in (symbols[at], symbols[after[at]])))
                seen[pair] = int(order[0]), int(made[0])
            return seen[pair]

        order, made = self.candidates(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        seen.update(zip((np.array(symbols[:-1], np.int64) << 32 | np.array(symbols[1:], np.int64)).tolist(), zip(order.tolist(), made.tolist())))
        agenda = [(o, at, 0) for at, o in enumerate(order.tolist()) if o < none]
        heapq.heapify(agenda)
        turn = [0] * n  # of a place's candidate; earlier ones no longer hold
        skips = step = 0
        skip = int(gaps(keys, 0, dropout)[0])
        while agenda:
            _, at, its = heapq.heappop(agenda)
            if its != turn[at]:
                continue
            step += 1
            if step - 1 == skip:
                turn[at] += 1
                skips += 1
                skip = step + int(gaps(keys, skips, dropout)[0])
                continue
            gone = after[at]
            symbols[at] = candidate(at)[1]
            turn[gone] = -1
            after[at] = after[gone]
            before[after[at]] = at
            for k in (before[at], at):
                if k >= 0:
                    turn[k] += 1
                    if after[k] < n and (o := candidate(k)[0]) < none:
                        heapq.heappush(agenda, (o, k, turn[k]))
        return np.array([s for s, t in zip(symbols, turn) if t >= 0], np.int32)

    def remember(self, segments: list[str], planned: np.ndarray) -> np.ndarray:
        """Numbers of the new outcomes of segments with those skips."""
        began = len(self.steps)
        for lo in range(0, len(segments), 8_000):
            flat, size, steps = self.merge(segments[lo : lo + 8_000], planned[lo : lo + 8_000])
            self.first = np.append(self.first, len(self.pieces) + np.cumsum(size) - size)
            self.size, self.steps, self.pieces = np.append(self.size, size), np.append(self.steps, steps), np.append(self.pieces, flat)
        return np.arange(began, len(self.steps))

    def encode(self, texts: list[str], dropout: float, seed: int) -> list[np.ndarray]:
        """Pieces of each text, 32 bits a piece."""
        if len(self.steps) > REMEMBERED:
            self.forget()
        own = [_SEGMENT.findall(" " + text) if text else [] for text in texts]
        count = np.fromiter(map(len, own), np.int64, len(own))
        segments = [s for found in own for s in found]
        if not segments:
            return [np.zeros(0, np.int32) for _ in texts]
        place = np.arange(len(segments)) - np.repeat(np.cumsum(count) - count, count)
        text_keys = np.array([xxhash.xxh3_64_intdigest(t.encode(), seed) for t in texts], np.uint64)
        keys = mix(np.repeat(text_keys, count) + place.astype(np.uint64))

        new = [s for s in dict.fromkeys(segments) if s not in self.known and len(s) <= SHORT]
        if new:
            self.known.update(zip(new, self.remember(new, np.full((len(new), 1), NEVER)).tolist()))
        at = np.fromiter((self.known.get(s, NONE) for s in segments), np.int64, len(segments))
        drawn = at == NONE  # those that are too long or skip too often to be remembered
        open_ = np.flatnonzero(~drawn)
        skips = np.full((len(segments), SKIPS), NEVER)
        last = np.full(len(segments), -1)
        for number in range(SKIPS + 1):
            last[open_] += 1 + gaps(keys[open_], number, dropout)
            open_ = open_[last[open_] < self.steps[at[open_]]]
            if number == SKIPS or not len(open_):
                break
            skips[open_, number] = last[open_]
            wanted, one, which = np.unique(at[open_] << 20 | last[open_], return_index=True, return_inverse=True)
            found = np.fromiter((self.after.get(k, NONE) for k in wanted.tolist()), np.int64, len(wanted))
            fresh = np.flatnonzero(found == NONE)
            if len(fresh):
                who = open_[one[fresh]]
                found[fresh] = self.remember([segments[k] for k in who.tolist()], skips[who])
                self.after.update(zip(wanted[fresh].tolist(), found[fresh].tolist()))
            at[open_] = found[which]
        drawn[open_] = True

        start, size, pool = self.first[at], self.size[at], [self.pieces]
        who = np.flatnonzero(drawn)
        base = len(self.pieces)
        long = np.fromiter((len(segments[k]) > LONG for k in who.tolist()), bool, len(who))
        for k in who[long].tolist():
            pool.append(self.merge_long(segments[k], keys[k], dropout))
            start[k], size[k] = base, len(pool[-1])
            base += len(pool[-1])
        who = who[~long]
        for lo in range(0, len(who), 8_000):
            some = who[lo : lo + 8_000]
            flat, size[some], _ = self.merge([segments[k] for k in some.tolist()], None, keys[some], dropout)
            start[some] = base + np.cumsum(size[some]) - size[some]
            pool.append(flat)
            base += len(flat)
        flat = spans(np.concatenate(pool), start, size)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


def spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans data[start : start + size], one after the other."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class PieceBytes:
    """What each piece of a model file stands for."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw = [b""] * model.get_piece_size()
        for k in range(len(self.raw)):
            if model.is_byte(k):
                self.raw[k] = bytes([int(model.id_to_piece(k)[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.raw[k] = model.id_to_piece(k).replace(SPACE, " ").encode()

        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(self.raw), np.uint8)

    def decode(self, pieces: list[int]) -> bytes:
        """The text's bytes; the space put before the text when encoding goes."""
        return b"".join(map(self.raw.__getitem__, pieces))[1:]

    def decode_all(self, pieces: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The same for many texts, whose pieces follow each other and end at ends (the first is 0)."""
        size = self.size[pieces]
        at = np.concatenate([[0], np.cumsum(size)])
        raw = self.all[np.repeat(self.first[pieces] - at[:-1], size) + np.arange(at[-1])].tobytes()
        return [raw[a + 1 : b] for a, b in zip(at[ends[:-1]].tolist(), at[ends[1:]].tolist())]


_models: dict[tuple, object] = {}


def model_of(path: str | None, kind: type):
    """A worker reads a model once."""
    import public_tokenizers

    path = path or public_tokenizers.path(MODEL)
    if (path, kind) not in _models:
        _models[path, kind] = kind(path)
    return _models[path, kind]


def encode(texts: DataFrame, dropout: float = DROPOUT, seed: int = SEED, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, pieces) of each whole text. Null and empty texts have no pieces.

    dropout 0 gives the library's own segmentation. Equal texts, seeds and dropout give equal pieces.
    path: a BPE model file that every executor can open; by default the installed package's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found, _ in encoded(batches, path, dropout, seed):
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), piece_lists(found)], names=[id_column, text_column, "pieces"])

    kind = texts.schema[id_column].dataType.simpleString()
    return texts.select(id_column, text_column).transform(mapped, run, f"{id_column} {kind}, {text_column} string, pieces array<int>")


def round_trip(texts: DataFrame, dropout: float = DROPOUT, seed: int = SEED, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, pieces, n_bytes, decoded_sha256, lossless): encodes each whole text, decodes the pieces, and compares.

    n_bytes and the digest are those of the decoded text. As encode() and decode() one after the other, in one worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model_of(path, PieceBytes)
        for some, found, said in encoded(batches, path, dropout, seed):
            ends = np.cumsum([0, *map(len, found)])
            back = reader.decode_all(np.concatenate(found), ends)
            digests = [hashlib.sha256(t).hexdigest() for t in back]
            same = [t == s.encode() for t, s in zip(back, said)]
            made = [pa.array(map(len, back), pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([some.column(0), piece_lists(found), *made], names=[id_column, "pieces", "n_bytes", "decoded_sha256", "lossless"])

    kind = texts.schema[id_column].dataType.simpleString()
    return texts.select(id_column, text_column).transform(mapped, run, f"{id_column} {kind}, pieces array<int>, n_bytes long, decoded_sha256 string, lossless boolean")


def encoded(batches: Iterator[pa.RecordBatch], path: str | None, dropout: float, seed: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[str]]]:
    """About 1 MB of text at a time: the rows (id, text), their pieces, and their texts. What was remembered for a
    task goes with it, so that idle workers hold little."""
    model = model_of(path, PieceModel)
    try:
        for batch in batches:
            for lo, hi, _, _ in utf8_blocks(batch.column(1), 1 << 20):
                some = batch.slice(lo, hi - lo)
                said = [t or "" for t in some.column(1).to_pylist()]
                yield some, model.encode(said, dropout, seed), said
    finally:
        model.forget()


def piece_lists(found: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))


def decode(pieces: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns of keep, pieces and decoded text. Null pieces count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path, PieceBytes)
        for batch in batches:
            column = pc.fill_null(batch.column(batch.num_columns - 1), pa.scalar([], pa.list_(pa.int32())))
            bounds, lo = column.offsets.to_numpy(), 0
            while lo < batch.num_rows:  # about a million pieces at a time
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + (1 << 20), "right")) - 1)
                some, found = batch.slice(lo, hi - lo), column.slice(lo, hi - lo)
                ends, lo = bounds[lo : hi + 1], hi
                texts = pa.array(model.decode_all(found.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns, texts], names=[*keep, "pieces", "decoded"])

    fields = "".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}, " for c in keep)
    return pieces.select(*keep, "pieces").transform(mapped, run, fields + "pieces array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "decoded_sha256", "lossless")
