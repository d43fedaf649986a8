"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of all test items, of several sizes, are counted over the whole corpus. At each place of an item the
shortest n-gram that is rare there is a seed: rare means a fixed number of times, whatever the size of the corpus, or no
more than its longest n-gram explains. Seeds are joined with the n-grams of all texts, by a shuffle. Where a text has
seeds of an item, the passages around them are aligned with it, word by word, so that edited and paraphrased copies
score by what they keep.

Of a text's n-grams only those go into a shuffle whose bit is set in a bitmap of fixed size, which has the bits of all
n-grams asked for. Neither items nor texts pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import NOT_WORD, discard, mapped, mix, stored, table, utf8_blocks, word_hashes

GRAM = 3
#: Words of the n-grams that are tried at a place, from the shortest.
GRAMS = (GRAM, 4, 5, 6, 8, 12)
#: An n-gram is rare if it occurs at most so often, or at most so many times as often as the place's longest n-gram: then
#: most of its occurrences are in longer copies. Of an item's places whose n-gram occurs oftener than RARE_COUNT, the
#: rarest half are seeds, and FEWEST at least.
RARE_COUNT, EXPLAINED, FEWEST = 2000, 2, 8
#: Multiplier of the hash that grows with a run of words.
GROWTH = 0x9E3779B97F4A7C15
#: Points for an equal word, another word, and a word left out or put in.
MATCH, DIFFER, GAP = 2, -1, 1
#: Share of the points of an exact copy from which on a passage counts as one.
THRESHOLD = 0.5
#: Items of fewer words have no n-grams as seeds: all their words in a row are their one seed, and only an exact copy
#: counts. Those of fewer than GRAM words match only texts of the very same words.
MIN_WORDS = 8
#: Bits of the bitmap, as a power of two, and of its parts.
BITS, PART = 22, 1 << 15
#: Alignments made at once, and those that wait for it.
BATCH, WAITING = 256, 4096


def text_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Block by block: rows [lo, hi), hashes of their words in lower case, and each row's first word."""
    for lo, hi, data, offsets in utf8_blocks(pc.utf8_lower(pc.fill_null(column, ""))):
        words, _, _, first = word_hashes(data, offsets, NOT_WORD)
        yield lo, hi, words, first


def grams_of(words: np.ndarray, first: np.ndarray, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the runs of so many words inside a row, and the place of their first word. A size under GRAM
    means rows of exactly so many words."""
    own = np.diff(first)
    ends = np.repeat(first[1:], own)
    rows = np.repeat(own, own)
    grams = np.zeros(len(words), np.uint64)
    for n in range(1, max(sizes, default=0) + 1):
        grams = grams[: max(0, len(words) - n + 1)] * np.uint64(GROWTH) + words[n - 1 :]
        if n in sizes:
            place = np.arange(len(grams))
            inside = place + n <= ends[: len(grams)] if n >= GRAM else rows[: len(grams)] == n
            yield mix(grams[inside]), place[inside]


def item_grams(items: DataFrame) -> DataFrame:
    """(ik, n_words, size, gram, place) of items (ik, text), of all sizes; of a short item, one run with all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, first in text_words(batch.column(1)):
                own = np.diff(first)
                sizes = sorted({*GRAMS, *(n for n in range(1, MIN_WORDS) if (own == n).any())})
                found = []
                for n, (grams, place) in zip(sizes, grams_of(words, first, sizes), strict=True):
                    row = np.searchsorted(first, place, "right") - 1
                    good = (own[row] >= MIN_WORDS) & (n in GRAMS) | (own[row] == n) & (own[row] < MIN_WORDS)
                    found.append((row[good], np.full(good.sum(), n), grams[good], (place - first[row])[good]))
                row, size, gram, place = (np.concatenate(x) for x in zip(*found))
                key = batch.column(0).slice(lo, hi - lo).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row]), pa.array(size), pa.array(gram.view(np.int64)), pa.array(place)], names=["ik", "n_words", "size", "gram", "place"])

    return items.select("ik", "text").transform(mapped, run, "ik long, n_words long, size long, gram long, place long")


class Wanted:
    """The bits of wanted n-grams, and the sizes in words that they have."""

    def __init__(self, grams: DataFrame):
        """grams: (n_words, gram). What is read are 128 parts of the bitmap and a row for each size of short items."""
        bit = F.shiftrightunsigned("gram", 64 - BITS).cast("long")
        parts = grams.groupBy(F.floor(bit / PART).alias("part")).agg(F.bitmap_construct_agg(bit % PART).alias("bits")).collect()
        self.bits = np.zeros(1 << BITS, bool)
        for r in parts:
            self.bits[r["part"] * PART : (r["part"] + 1) * PART] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")[:PART]
        short = grams.filter(F.col("n_words") < MIN_WORDS).select("n_words").distinct().collect()
        self.sizes = sorted({*GRAMS, *(r["n_words"] for r in short)})

    def __getstate__(self) -> dict:
        return {"sizes": self.sizes, "bits": np.packbits(self.bits)}

    def __setstate__(self, state: dict) -> None:
        self.sizes, self.bits = state["sizes"], np.unpackbits(state["bits"]).astype(bool)

    def among(self, grams: np.ndarray) -> np.ndarray:
        return self.bits[grams >> np.uint64(64 - BITS)]


def gram_counts(texts: DataFrame, wanted: Broadcast) -> DataFrame:
    """(gram, n): how often each n-gram whose bit is wanted occurs in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = wanted.value
        for batch in batches:
            for _, _, words, first in text_words(batch.column(0)):
                found = [grams[w.among(grams)] for grams, _ in grams_of(words, first, w.sizes)]
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return texts.select("text").transform(mapped, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def chosen_seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(ik, n_words, gram, offset): of each place the shortest n-gram that is rare; of short items, their one run."""
    here = Window.partitionBy("ik", "place")  # a row for each size
    known = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = known.withColumn("whole", F.max_by("n", "size").over(here)).filter(F.col("n") <= F.greatest(F.lit(RARE_COUNT), EXPLAINED * F.col("whole")))
    places = rare.groupBy("ik", "n_words", "place").agg(F.min(F.struct("size", "gram", "n")).alias("seed")).select("ik", "n_words", "place", "seed.gram", "seed.n").filter("n > 0")
    rarest = Window.partitionBy("ik").orderBy("n", "gram", "place")  # over one item's places
    ranked = places.withColumns({"nth": F.row_number().over(rarest), "places": F.count("*").over(Window.partitionBy("ik"))})
    return ranked.filter((F.col("n") <= RARE_COUNT) | (F.col("nth") <= F.greatest(F.lit(FEWEST), F.col("places") / 2))).select("ik", "n_words", "gram", F.col("place").alias("offset"))


def gram_places(texts: DataFrame, wanted: Broadcast) -> DataFrame:
    """(gram, rk, rk2, place) of the n-grams in texts (rk, rk2, text) whose bit is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = wanted.value
        for batch in batches:
            keys, more = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, words, first in text_words(batch.column(2)):
                for grams, place in grams_of(words, first, w.sizes):
                    hit = w.among(grams)
                    gram, place = grams[hit], place[hit]
                    row = np.searchsorted(first, place, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(keys[lo + row]), pa.array(more[lo + row]), pa.array(place - first[row])], names=["gram", "rk", "rk2", "place"])

    return texts.select("rk", "rk2", "text").transform(mapped, run, "gram long, rk long, rk2 int, place long")


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word lists, as shares of the item's own, in lock step."""
    if not items:
        return np.zeros(0)
    tall, wide = max(map(len, items)), max(map(len, windows))
    item = np.zeros((len(items), tall), np.uint64)
    window = np.ones((len(items), wide), np.uint64)
    real = np.zeros((len(items), tall), bool)
    for k, (a, b) in enumerate(zip(items, windows)):
        item[k, : len(a)], window[k, : len(b)], real[k, : len(a)] = a, b, True
    slope = GAP * np.arange(wide + 1, dtype=np.int32)
    row = np.zeros((len(items), wide + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    for i in range(tall):
        points = np.where((item[:, i : i + 1] == window) & real[:, i : i + 1], MATCH, DIFFER)
        new = np.maximum(row - GAP, 0)
        np.maximum(new[:, 1:], row[:, :-1] + points, out=new[:, 1:])
        row = np.maximum.accumulate(new + slope, axis=1) - slope  # words put in, any number of them
        np.maximum(best, row.max(axis=1), out=best)
    return best / (MATCH * np.array([len(a) for a in items]))


def windows(diagonals: list[int], size: int, n: int) -> Iterator[tuple[int, int]]:
    """Passages of a text of n words to be aligned with an item of size words: each holds hits whose diagonals (places in
    the text if the item begins there) are at most half an item apart."""
    head = None
    for d in sorted(diagonals):
        if head is None or d - head > size // 2:
            head = d
            yield max(0, d - size // 4 - 2), min(n, d + size + size // 2 + size // 4 + 2)


def aligned(texts: DataFrame, threshold: float, id_kind: str) -> DataFrame:
    """(doc_id, item_id, score, seeds) of rows (doc_id, text, found: item_id, its text, diagonals, seeds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], list] = {}  # row and number of the item: item_id, best score, seeds
            waiting: list[tuple[tuple[int, int], np.ndarray, np.ndarray]] = []

            def settle() -> None:
                waiting.sort(key=lambda w: (len(w[2]), len(w[1])))
                for lo in range(0, len(waiting), BATCH):
                    some = waiting[lo : lo + BATCH]
                    for (key, item, _), score in zip(some, align([w[1] for w in some], [w[2] for w in some])):
                        if len(item) >= MIN_WORDS or score == 1:  # a short item counts as a whole only
                            found[key][1] = max(found[key][1], float(score))
                waiting.clear()

            for lo, hi, words, first in text_words(batch.column(1)):
                for k in range(lo, hi):
                    own = words[first[k - lo] : first[k - lo + 1]]
                    rows = batch.column(2)[k].as_py()
                    said = pa.array([r["item"] for r in rows], pa.string())
                    items = [w[f[j] : f[j + 1]] for a, b, w, f in text_words(said) for j in range(b - a)]
                    for j, (r, item) in enumerate(zip(rows, items)):
                        found[k, j] = [r["item_id"], 0.0, r["seeds"]]
                        waiting.extend(((k, j), item, own[a:b]) for a, b in windows(r["diagonals"], len(item), len(own)))
                        if len(waiting) >= WAITING:
                            settle()
            settle()
            good = [(k, *v) for (k, _), v in sorted(found.items()) if v[1] >= threshold]
            columns = list(zip(*good)) if good else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.float64(), pa.int64())))], names=["doc_id", "item_id", "score", "seeds"])

    return texts.select("doc_id", "text", "found").transform(mapped, run, f"doc_id {id_kind}, item_id long, score double, seeds long")


def contaminated(texts: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, seeds) for each text and test item with a passage that scores threshold or more.

    score: of the best passage, 1 for an exact copy. seeds: hits of the item's seeds in the text. Null and empty
    texts and items match nothing; an item under MIN_WORDS words matches exact copies of all its words only. An
    empty benchmark gives an empty result. Repeated rows of the texts are judged one by one; repeated rows of the
    benchmark count once.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).withColumn("ik", F.xxhash64("item_id", "item")).filter("item is not null").distinct()
    keyed = texts.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"), F.hash("doc_id", "text").alias("rk2"))
    grams = stored(item_grams(items.select("ik", F.col("item").alias("text"))), "leaks-grams")
    shared: Broadcast = texts.sparkSession.sparkContext.broadcast(Wanted(grams))
    counts = stored(gram_counts(keyed, shared), "leaks-counts")
    seeds = stored(chosen_seeds(grams, counts), "leaks-seeds")
    shared = texts.sparkSession.sparkContext.broadcast(Wanted(seeds))
    met = gram_places(keyed, shared).join(seeds, "gram").groupBy("rk", "rk2", "ik").agg(F.collect_set(F.col("place") - F.col("offset")).alias("diagonals"), F.count("*").alias("seeds"))
    per_text = met.join(items, "ik").groupBy("rk", "rk2").agg(F.collect_list(F.struct("item_id", "item", "diagonals", "seeds")).alias("found"))  # at most what a text's own n-grams hit
    found = stored(per_text, "leaks-found")
    discard(grams, counts, seeds)
    return aligned(keyed.join(found, ["rk", "rk2"]), threshold, texts.schema["doc_id"].dataType.simpleString())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
