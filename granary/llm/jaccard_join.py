"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct n-word shingles, hashed to 64 bits. Shingles are ordered from rare to
frequent; two sets that are similar enough share a number of shingles among their first ones (the prefix). Documents of
equal sets collapse into one, sets of equal prefix and size into one group. Groups that share a prefix shingle
are paired, filtered by size and by a parity bitmap, expanded to their members, and the members are compared on
their texts.

Pairs inside a family of copies would grow with its square, so pairing runs in two rounds. The first compares
each member of a shingle's list with the list's first group only. The second pairs members across different
components of the links found so far, and of sizes that can be similar: no link between components is lost, and
members already connected need no further comparison. Bitmaps are fetched only for the lists that hold several
components, and pairs are made only where they allow it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import SPACES, discard, mapped, mix, shingle_hashes, stored, table, utf8_blocks, word_hashes
from granary.llm.components import connected

#: Counters of the frequency sketch. It only orders shingles: any counts give the same links.
SKETCH_BITS, SKETCH_CHUNK = 20, 1 << 14
#: Bits of a set's parity bitmap.
PARITY_BITS = 1024


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in utf8_blocks(batch.column(0)):
                words, _, _, _ = word_hashes(data, offsets, SPACES)
                counts += np.bincount(shingle_hashes(words, n) >> np.uint64(64 - SKETCH_BITS), minlength=len(counts))
        if counts.any():
            parts = [c.astype("<u4").tobytes() for c in counts.reshape(-1, SKETCH_CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])

    return run


def _sum_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One chunk's counters from all tasks, read in batches."""
    total, chunk = np.zeros(SKETCH_CHUNK, np.int64), None
    for frame in frames:
        for chunk, counts in zip(frame["chunk"], frame["counts"]):
            total += np.frombuffer(counts, "<u4")
    yield pd.DataFrame({"chunk": [chunk], "counts": [total.astype("<i8").tobytes()]})


def frequency_classes(texts: DataFrame, n: int) -> np.ndarray:
    """A class from 0 (rare) to 255 for each counter of a one-row count sketch of all shingles of all texts.

    Classes step by an eighth of a doubling of the count. The result has a fixed size of 1 MB.
    """
    parts = texts.select("text").transform(mapped, _sketch(n), "chunk int, counts binary")

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _sum_counts(frames)

    summed = parts.groupBy("chunk").applyInPandas(total, "chunk int, counts binary").collect()  # 64 rows of 128 KB
    counts = np.zeros((1 << SKETCH_BITS) // SKETCH_CHUNK * SKETCH_CHUNK, np.int64).reshape(-1, SKETCH_CHUNK)
    for row in summed:
        counts[row["chunk"]] = np.frombuffer(row["counts"], "<i8")
    return np.minimum(np.log2(counts.ravel() + 1) * 8, 255).astype(np.uint8)


def prefix_size(size: int, percent: int) -> int:
    """The first elements of a set, in any order, of which a set of at least this similarity shares as many with
    its own first ones as shared_least says for the smaller set."""
    base = size - -(-percent * size // 100) + 1
    return min(size, base + base // 4)


def shared_least(size: str, percent: int) -> str:
    """SQL: prefix elements that a set of this size shares with a similar set that is not smaller."""
    return f"(1 + ({size} - ({percent} * {size} + 99) div 100 + 1) div 4)"


def set_features(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, p1, p2, prefix, parity) of each text: s1, s2 are a signature of the set, p1, p2 of the prefix."""
    classes = texts.sparkSession.sparkContext.broadcast(frequency_classes(texts, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = classes.value
        for batch in batches:
            for lo, hi, data, offsets in utf8_blocks(batch.column(1)):
                words, _, _, first = word_hashes(data, offsets, SPACES)
                runs = shingle_hashes(words, n)
                sizes, signs, prefixes, parities = [], [], [], []
                for d in range(hi - lo):
                    a, b = int(first[d]), int(first[d + 1])
                    if b - a >= n:
                        own = np.unique(runs[a : b - n + 1])
                    elif b > a:
                        own = mix(np.array([np.bitwise_xor.reduce(mix(words[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)))]))
                    else:
                        own = runs[:0]
                    cut = prefix_size(len(own), percent) if len(own) else 0
                    order = np.argsort(rank[own >> np.uint64(64 - SKETCH_BITS)], kind="stable")[:cut]
                    sizes.append(len(own))
                    start = own[order]
                    signs.append([f(x) for x in (own, start) for f in (lambda x: x.sum(dtype=np.uint64), lambda x: mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))])
                    prefixes.append(start.view(np.int64))
                    odd = np.bincount((own & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
                    parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                sign = np.array(signs, np.uint64).reshape(-1, 4).view(np.int64)
                lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32()), pa.array(np.concatenate(parts), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), *(pa.array(sign[:, c]) for c in range(4)), lists(prefixes), lists(parities)],
                    names=["doc_id", "n_shingles", "s1", "s2", "p1", "p2", "prefix", "parity"],
                )

    return texts.select("doc_id", "text").transform(mapped, run, "doc_id long, n_shingles long, s1 long, s2 long, p1 long, p2 long, prefix array<long>, parity array<long>")


def similar_texts(a: bytes, b: bytes, n: int, percent: int) -> bool:
    """The definition, on two texts."""
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    both = len(sets[0] & sets[1])
    return bool(both) and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both)


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).cast(pa.binary()) for k in (2, 3))
            good = pa.array([similar_texts(x[k].as_py() or b"", y[k].as_py() or b"", n, percent) for k in range(len(x))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    met = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return met.transform(mapped, run, "a long, b long").distinct()


def _sizes_allow(percent: int, x: str, y: str) -> str:
    """SQL: sets of these sizes can be similar."""
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def _parities_allow(percent: int, x: str, y: str) -> str:
    """SQL: the parities' difference, which bounds the sets' difference from below, allows it."""
    differ = " + ".join(f"bit_count({x}.parity[{k}] ^ {y}.parity[{k}])" for k in range(PARITY_BITS // 64))
    return f"{100 + percent} * ({differ}) <= {100 - percent} * ({x}.n_shingles + {y}.n_shingles)"


def _candidates(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of reps that sizes, shared prefix elements (common) and parities allow."""
    side = lambda id_, name: sets.selectExpr(f"rep as {id_}", f"struct(n_shingles, parity) as {name}")
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    least = "least(x.n_shingles, y.n_shingles)"
    return met.filter(f"common >= {shared_least(least, percent)}").filter(_sizes_allow(percent, "x.n_shingles", "y.n_shingles")).filter(_parities_allow(percent, "x", "y")).select("a", "b")


def components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach. Null and empty texts have no shingles and no links. A
    text of fewer than n words has one shingle, all its words. Rows that share a doc_id count as one vertex. A
    row without doc_id takes no part and has no component.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = stored(set_features(texts, n, percent), "jaccard-features")
    linked = full.filter("n_shingles > 0 and doc_id is not null")
    reps = linked.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("p1", "p2", "parity")))
    reps = stored(reps, "jaccard-reps")
    groups = stored(reps.groupBy("p1", "p2", "n_shingles").agg(F.min("rep").alias("gid"), F.count("*").alias("members")), "jaccard-groups")
    member = reps.join(groups, ["p1", "p2", "n_shingles"]).select("gid", "rep", "n_shingles", "members")
    sets = reps.select("rep", "n_shingles", "parity")
    prefixes = stored(linked.select(F.col("doc_id").alias("gid"), "prefix").join(groups.select("gid").distinct(), "gid", "left_semi"), "jaccard-prefixes")
    base = stored(full.select("doc_id", "n_shingles", "s1", "s2"), "jaccard-sets")
    discard(full)
    posted = prefixes.select("gid", F.explode("prefix").alias("token"))
    shared = posted.groupBy("token").agg(F.min("gid").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("token", "hub")
    # stored, so that the join has a shuffle on both sides, which Spark can split where a shingle is very frequent
    shared = stored(shared, "jaccard-shared")
    postings = stored(posted.join(shared, "token"), "jaccard-postings")  # only shingles that two groups share
    discard(prefixes, shared)

    stars = postings.filter("gid <> hub").groupBy(F.col("hub").alias("a"), F.col("gid").alias("b")).agg(F.count("*").alias("common"))
    inside = member.filter("members > 1 and gid <> rep").selectExpr("gid as a", "rep as b")
    star_links = stored(verified(_candidates(stars, sets, percent).unionByName(inside).distinct(), texts, n, percent), "jaccard-stars")

    labels = connected(star_links)  # (node, component) of linked nodes
    size_class = F.floor(F.log("n_shingles") / math.log(max(100 / percent, 1.02) * 1.0001)).cast("int")  # similar sets are one class apart at most
    node = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("gid", "rep", "n_shingles", size_class.alias("class"), F.coalesce("component", "rep").alias("component"))
    alike = member.filter("members > 1").select(F.xxhash64(F.lit("group"), "gid").alias("token"), "gid").distinct()
    lists = postings.select("token", "gid", F.lit(1).alias("weight")).unionByName(alike.withColumn("weight", F.lit(1 << 20)))  # a group shares its prefix
    entries = lists.join(node, "gid").select("token", "rep", "n_shingles", "class", "component", "weight")
    per = entries.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("component", "n").alias("main"), F.count("*").alias("parts"))
    open_slim = stored(entries.join(per.filter("parts > 1").select("token", "main"), "token"), "jaccard-lists")
    discard(postings)
    open_lists = stored(open_slim.join(sets.select("rep", "parity"), "rep"), "jaccard-open")
    discard(open_slim)
    x = F.struct("rep", "n_shingles", "component", "parity")
    near = F.explode(F.array(*(F.col("class") + d for d in (-1, 0, 1)))).alias("class")
    minor = open_lists.filter("component <> main").select("token", near, x.alias("y"))
    pairs = (
        minor.join(open_lists.select("token", "class", "main", "weight", x.alias("x")), ["token", "class"])
        .filter("x.component <> y.component AND (x.component = main OR x.rep < y.rep)")
        .filter(_sizes_allow(percent, "x.n_shingles", "y.n_shingles"))
        .filter(_parities_allow(percent, "x", "y"))
        .groupBy(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        .agg(F.sum("weight").alias("common"), F.min(F.least("x.n_shingles", "y.n_shingles")).alias("size"))
        .filter(f"common >= {shared_least('size', percent)}")
        .select("a", "b")
    )
    more_links = stored(verified(pairs, texts, n, percent), "jaccard-links")
    discard(open_lists)
    final = connected(more_links.unionByName(star_links)).withColumnRenamed("node", "rep")
    same = reps.select("s1", "s2", "n_shingles", "rep")
    out = base.join(same, ["s1", "s2", "n_shingles"], "left").join(final, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")
    done = stored(out.select("doc_id", "n_shingles", component), "jaccard-components")
    discard(base, reps, groups, star_links, more_links)
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), n=3, percent=90)
