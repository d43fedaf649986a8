"""Suffix-array dedup of long repeated byte strings, over all texts.

A start is a position where LENGTH bytes of a text begin. A start repeats if the same bytes also start anywhere
else. The suffix array is dealt out by content, so that no task holds more than a share of it:

1. Each start has an anchor, the K-gram of least hash in its window: equal windows have it at the same place.
   Starts of one anchor form blocks of BLOCK neighbours, whose windows share a core. Cores are counted by hash;
   only those that occur twice go on.
2. A block that goes on becomes an occurrence: its core's hash and the bytes left and right of the core that its
   windows use. Equal occurrences collapse into one class. Classes of one core, in order of the bytes that follow
   it, are an interval of the suffix array.
3. A stack scan over the common prefixes of neighbours gives the tree of common-prefix intervals. In each
   interval the members' left contexts are compared: where they differ, the interval cannot be extended to the
   left as a whole, and each member's longest left match in it gives the starts that repeat. A member is matched
   with all others of the interval, not just with its neighbours.
4. A core with more classes than GROUP is split into smaller blocks with longer cores, and at last into single
   starts, which only need counting.

Strings of so many words, in place of bytes, are found in the same way in texts that have CODE bytes of its hash for
each word: there, starts between two words do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import NO_SPACES, SPACES, discard, mapped, mix, partitions, powers, prefix_sums, slices, stored, table, utf8_blocks, word_hashes

LENGTH = 400
#: Words of a passage that counts as repeated, and bytes that stand for a word.
WORDS, CODE = 51, 4
GRAM = 32
BLOCK = 128
#: Blocks of the second level; the third has single starts.
SMALL = 16
#: Classes of one core that are compared in one task.
GROUP = 256


def block_rows(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, block: int) -> tuple[np.ndarray, ...]:
    """(row, hash of core and block, core's place in the row, block, least and greatest shift) of all blocks.

    A block's starts are core's place minus shift.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    n = len(data)
    if n < length:
        return none
    sums, inverse = prefix_sums(data), powers(n + 1)[1]
    value = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    bits = np.uint64(max(1, int(n).bit_length()))
    best = (value >> bits << bits) | np.arange(len(value), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(len(best))
    inside = row[: len(best)] == row[length - 1 : length - 1 + len(best)]
    start = start[inside]
    if not len(start):
        return none
    anchor = (best[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    part = (anchor - start) // block
    key = anchor * (width // block + 2) + part
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    core = anchor[first] - part[first] * block
    end = core - block + 1 + length
    h = mix((sums[end] - sums[core]) * inverse[core] + part[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    own = row[start[first]]
    return own, h.view(np.int64), core - offsets[own], part[first], core - start[last], core - start[first]


def pack(core: np.ndarray, part: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A block's place in its row: core's first byte, number of the block, least and greatest shift."""
    return core << 24 | part << 16 | low << 8 | high


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with CODE bytes of its hash in place of each word. A-Z count as lower case; a character of a script without
    spaces is a word."""
    hashes, _, _, first = word_hashes(data, offsets, SPACES, NO_SPACES)
    return (hashes >> np.uint64(32)).astype("<u4").view(np.uint8), first * CODE


def all_blocks(texts: DataFrame, length: int, by_words: bool) -> DataFrame:
    """(h, f, rk, rk2, place) of each block: h for its core, f for all bytes that its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, more = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in utf8_blocks(batch.column(2)):
                data, offsets = coded(data, offsets) if by_words else (data, offsets)
                row, h, core, part, low, high = block_rows(data, offsets, length, GRAM, BLOCK)
                raw, at = memoryview(np.ascontiguousarray(data)), core + offsets[row]
                seeds = part << 16 | low << 8 | high
                spans = zip((at - high).tolist(), (at - low + length).tolist(), seeds.tolist())
                f = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b, seed in spans), np.uint64, len(row))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(f.view(np.int64)), pa.array(keys[lo:hi][row]), pa.array(more[lo:hi][row]), pa.array(pack(core, part, low, high))], names=["h", "f", "rk", "rk2", "place"])

    return texts.select("rk", "rk2", "text").transform(mapped, run, "h long, f long, rk long, rk2 int, place long")


CONTEXT = "h long, k long, f long, n long, low int, high int, left binary, right binary"


def contexts(classes: DataFrame, texts: DataFrame, length: int, by_words: bool) -> DataFrame:
    """CONTEXT rows for classes (h, f, n, rk, rk2, place): k is a second hash of the core; left and right are the
    bytes beside the core that the block's windows use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
                raw = text.as_py() or b""
                if by_words:
                    raw = coded(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes()
                for c in found.as_py():
                    core, part, low, high = c["place"] >> 24, c["place"] >> 16 & 255, c["place"] >> 8 & 255, c["place"] & 255
                    end = core - BLOCK + 1 + length
                    k = xxhash.xxh3_64_intdigest(raw[core:end], part)
                    rows.append((c["h"], k - (k >> 63 << 64), c["f"], c["n"], low, high, raw[core - high : core], raw[end : end + BLOCK - 1 - low]))
                if len(rows) >= 20_000:
                    yield context_batch(rows)
                    rows = []
            yield context_batch(rows)

    per_row = classes.groupBy("rk", "rk2").agg(F.collect_list(F.struct("h", "f", "n", "place")).alias("found"))  # at most a text's own blocks
    return texts.select("rk", "rk2", "text").join(per_row, ["rk", "rk2"]).select("text", "found").transform(mapped, run, CONTEXT)


def context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()] * 2
    columns = list(zip(*rows)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h", "k", "f", "n", "low", "high", "left", "right"])


def common_sizes(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes that rows of a and b have in common from the start, up to size."""
    equal = (a == b) & (np.arange(a.shape[1]) < size[:, None])
    return np.where(equal.all(axis=1), size, equal.argmin(axis=1)) if a.shape[1] else np.zeros(len(a), np.int64)


def padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, prefix) of each common-prefix interval of a sorted list, by a stack scan over the prefixes
    that neighbours have in common."""
    stack: list[tuple[int, int]] = []
    for k, c in enumerate([*common, -1]):
        first = k
        while stack and stack[-1][1] > c:
            first, prefix = stack.pop()
            yield first, k, prefix
        if c >= 0 and (not stack or stack[-1][1] < c):
            stack.append((first, c))


def repeats_in_group(right_common: np.ndarray, left: np.ndarray, left_size: np.ndarray, order: np.ndarray, block: int) -> np.ndarray:
    """Which shifts repeat, for each class of a group sorted by right context: a matrix of classes by block.

    left: reversed left contexts; order: each class's rank by them.
    """
    marks = np.zeros((len(left), block), bool)
    shifts = np.arange(block)
    for first, last, prefix in intervals(right_common.tolist()):
        members = first + np.argsort(order[first : last + 1], kind="stable")
        near = common_sizes(left[members[:-1]], left[members[1:]], np.minimum(left_size[members[:-1]], left_size[members[1:]]))
        if near.max() + prefix < block - 1:  # no two members agree over a whole window
            continue
        longest = np.zeros(len(members), np.int64)  # where left contexts differ, each member's longest match counts
        longest[:-1] = near
        longest[1:] = np.maximum(longest[1:], near)
        marks[members] |= (shifts >= block - 1 - prefix) & (shifts <= longest[:, None])
    return marks


def maximal_repeats(right_common: np.ndarray, left: np.ndarray, left_size: np.ndarray, order: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(members, left, right) of each maximal repeat among a group's classes sorted by right context: all classes that
    have the same bytes left and right of the core, and not all one byte more on either side.

    In each interval of right contexts, the intervals of the members' left contexts are those sets that cannot be
    extended to the left as a whole; such a set counts unless it lies inside a smaller interval of right contexts.
    """
    for first, last, prefix in intervals(right_common.tolist()):
        members = first + np.argsort(order[first : last + 1], kind="stable")
        near = common_sizes(left[members[:-1]], left[members[1:]], np.minimum(left_size[members[:-1]], left_size[members[1:]]))
        if near.max() + prefix < block - 1:  # no two members agree over a whole window
            continue
        for a, b, size in intervals(near.tolist()):
            some = members[a : b + 1]
            if size + prefix >= block - 1 and right_common[some.min() : some.max()].min() == prefix:
                yield some, size, prefix


def group_results(rows: list[tuple], block: int) -> list[tuple]:
    """(h, k, f, low, high): shifts that repeat in whole groups of CONTEXT rows sorted by (h, k, right).

    Only classes that occur once are reported: of others, every shift repeats.
    """
    width = block - 1
    left_raw = [r[6][::-1] for r in rows]
    left, right = padded(left_raw, width), padded([r[7] for r in rows], width)
    left_size, right_size = np.array([len(r[6]) for r in rows]), np.array([len(r[7]) for r in rows])
    common = common_sizes(right[:-1], right[1:], np.minimum(right_size[:-1], right_size[1:]))
    new = np.array([True] + [rows[k][:2] != rows[k - 1][:2] for k in range(1, len(rows))])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(rows)))
    out = []
    two = first[size == 2]
    if len(two):
        beside = common_sizes(left[two], left[two + 1], np.minimum(left_size[two], left_size[two + 1]))
        low = width - common[two]
        for k in np.flatnonzero(low <= beside):
            out += [(*rows[r][:3], int(low[k]), int(beside[k])) for r in (two[k], two[k] + 1) if rows[r][3] == 1]
    for a, n in zip(first[size > 2], size[size > 2]):
        order = np.empty(n, np.int64)
        order[sorted(range(n), key=left_raw[a : a + n].__getitem__)] = np.arange(n)
        marks = repeats_in_group(common[a : a + n - 1], left[a : a + n], left_size[a : a + n], order, block)
        edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        starts, ends = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
        out += [(*rows[a + m][:3], int(lo), int(hi) - 1) for m, lo, hi in zip(*starts, ends) if rows[a + m][3] == 1]
    return out


GROUPS = "h long, f long, gid long, before int, after int"


def repeat_groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(gid, n_bytes, doc_id, first): maximal repeats of length bytes or more with all their occurrences: each is a string
    of n_bytes that starts at byte first of each of the rows with its gid, and that not all of them extend to the left or
    right by one and the same byte. A repeat that reaches further than a block of starts is given block by block.

    A core's classes are one task's work here, whatever their number: for reports on what repeats, not for removal.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("rk"), F.hash("doc_id", "text").alias("rk2"))
    blocks = stored(all_blocks(texts, length, False), "repeats-blocks")
    twice = stored(blocks.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeats-twice")
    kept = stored(blocks.join(twice, "h", "left_semi"), "repeats-kept")
    first = F.min(F.struct("rk", "rk2", "place")).alias("first")
    classes = kept.groupBy("h", "f").agg(F.count("*").alias("n"), first).select("h", "f", "n", "first.*")
    rows = stored(contexts(classes, texts, length, False), "repeats-contexts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def groups() -> pa.RecordBatch:
            made = []
            if held:
                raw = [r[6][::-1] for r in held]
                left, right = padded(raw, BLOCK - 1), padded([r[7] for r in held], BLOCK - 1)
                left_size, right_size = np.array([len(r[6]) for r in held]), np.array([len(r[7]) for r in held])
                common = common_sizes(right[:-1], right[1:], np.minimum(right_size[:-1], right_size[1:]))
                order = np.empty(len(held), np.int64)
                order[sorted(range(len(held)), key=raw.__getitem__)] = np.arange(len(held))
                found = list(maximal_repeats(common, left, left_size, order, BLOCK)) if len(held) > 1 else []
                found += [(np.array([k]), len(r[6]), len(r[7])) for k, r in enumerate(held) if r[3] > 1]
                for members, before, after in found:
                    text = held[members[0]][6][len(held[members[0]][6]) - before :] + b"|" + held[members[0]][7][:after]
                    gid = xxhash.xxh3_64_intdigest(b"%d %d " % held[0][:2] + text)
                    made += [(held[m][0], held[m][2], gid - (gid >> 63 << 64), before, after) for m in members]
            columns = list(zip(*dict.fromkeys(made))) if made else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.int32()] * 2)], names=["h", "f", "gid", "before", "after"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] == held[-1][:3]:
                    continue  # the same class, from a repeated row
                if held and row[:2] != held[-1][:2]:
                    yield groups()
                    held = []
                held.append(row)
        yield groups()

    dealt = rows.repartition(partitions(rows), "h", "k").sortWithinPartitions("h", "k", "right", "f")
    found = stored(dealt.transform(mapped, run, GROUPS), "repeats-groups")
    core = F.shiftright("place", 24)
    places = kept.join(found, ["h", "f"]).select("gid", (F.col("before") + F.col("after") + length - BLOCK + 1).cast("long").alias("n_bytes"), "rk", "rk2", (core - F.col("before")).alias("first"))
    discard(blocks, twice, rows)
    return places.join(texts.select("rk", "rk2", "doc_id"), ["rk", "rk2"]).select("gid", "n_bytes", "doc_id", "first")


RANGES = "h long, k long, f long, low int, high int"


def grouped_ranges(sorted_rows: DataFrame, block: int) -> DataFrame:
    """RANGES of CONTEXT rows that are dealt out by (h, k) and sorted by (h, k, right, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: list[tuple]) -> pa.RecordBatch:
            found = group_results(rows, block) if rows else []
            columns = list(zip(*found)) if found else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.int32()] * 2)], names=["h", "k", "f", "low", "high"])

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:3] == rows[-1][:3]:
                    continue  # the same class, from a repeated row
                if len(rows) >= 8192 and row[:2] != rows[-1][:2]:
                    yield result(rows)
                    rows = []
                rows.append(row)
        yield result(rows)

    return sorted_rows.transform(mapped, run, RANGES)


CHILD = "h0 long, k0 long, f0 long, base int, " + CONTEXT


def children(rows: DataFrame, block: int, small: int) -> DataFrame:
    """CHILD rows: each block cut into blocks of small starts, whose cores are longer by what all their windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            origin: list[tuple] = []
            for h, k, f, n, low, high, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                for base in range(low // small * small, high + 1, small):
                    lo, hi, top = max(low, base), min(high, base + small - 1), base + small - 1
                    shared = b"%d %d %d %d " % (h, k, base, len(right[: block - 1 - top])) + left[len(left) - base :] + right[: block - 1 - top]
                    l2, r2 = left[len(left) - hi : len(left) - base], right[block - 1 - top : block - 1 - lo]
                    own = b"%d %d %d " % (lo - base, hi - base, len(l2)) + l2 + r2
                    ids = [xxhash.xxh3_64_intdigest(shared, 1), xxhash.xxh3_64_intdigest(shared, 2), xxhash.xxh3_64_intdigest(own, 3)]
                    made.append((*(x - (x >> 63 << 64) for x in ids), n, lo - base, hi - base, l2, r2))
                    origin.append((h, k, f, base))
            columns = list(zip(*origin)) if origin else [()] * 4
            first = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.int32()])]
            rest = context_batch(made)
            yield pa.RecordBatch.from_arrays([*first, *rest.columns], names=["h0", "k0", "f0", "base", *rest.schema.names])

    return rows.select("h", "k", "f", "n", "low", "high", "left", "right").transform(mapped, run, CHILD)


def resolve(rows: DataFrame, block: int, scratch: list[DataFrame]) -> DataFrame:
    """RANGES of the classes in CONTEXT rows that occur once. Groups of over GROUP classes are cut into children first.
    Tables that the result reads are added to scratch."""
    large = stored(rows.groupBy("h", "k").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP).select("h", "k"), "suffix-large")
    order = [c.split()[0] for c in CONTEXT.split(", ")]
    usual = rows.join(large, ["h", "k"], "left_anti").select(order).repartition(partitions(rows), "h", "k").sortWithinPartitions("h", "k", "right", "f")
    out = stored(grouped_ranges(usual, block), "suffix-ranges")
    hot = stored(rows.join(large, ["h", "k"], "left_semi").select(order), "suffix-hot")
    discard(large)
    scratch += [out, hot]
    if hot.isEmpty() or block == 1:
        return out
    small = SMALL if block > SMALL else 1
    cut = stored(children(hot, block, small), "suffix-children")
    joined = cut.groupBy("h", "k", "f").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("low", "high", "left", "right"))).select(order)
    joined = stored(joined, "suffix-joined")
    scratch += [cut, joined]
    whole = joined.filter("n > 1").select("h", "k", "f", "low", "high")
    found = whole.unionByName(resolve(joined, small, scratch))
    back = cut.filter("n = 1").select("h0", "k0", "f0", "base", "h", "k", "f").join(found, ["h", "k", "f"])
    return out.unionByName(back.selectExpr("h0 as h", "k0 as k", "f0 as f", "low + base as low", "high + base as high"))


def repeated_starts(texts: DataFrame, length: int, by_words: bool = False) -> DataFrame:
    """(rk, rk2, first, last): runs of starts that repeat, for texts (rk, rk2, text). Written in the shared folder.
    by_words: length and starts count words."""
    length = length * CODE if by_words else length
    blocks = stored(all_blocks(texts, length, by_words), "suffix-blocks")
    # stored, so that the join has a shuffle on both sides, which Spark can split where a core is very frequent
    twice = stored(blocks.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "suffix-twice")
    kept = stored(blocks.join(twice, "h", "left_semi"), "suffix-kept")
    discard(blocks, twice)
    first = F.min(F.struct("rk", "rk2", "place")).alias("first")
    classes = stored(kept.groupBy("h", "f").agg(F.count("*").alias("n"), first).select("h", "f", "n", "first.*"), "suffix-classes")
    several = stored(classes.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "suffix-several")
    unclear = classes.join(several, "h", "left_semi")
    rows = stored(contexts(unclear, texts, length, by_words), "suffix-contexts")
    scratch: list[DataFrame] = []
    ranges = resolve(rows, BLOCK, scratch).select("h", "f", "low", "high")
    low, high = F.shiftright("place", 8).bitwiseAND(255).cast("int"), F.col("place").bitwiseAND(255).cast("int")
    parts = stored(ranges.unionByName(classes.filter("n > 1").select("h", "f", low.alias("low"), high.alias("high"))), "suffix-parts")
    discard(classes, several, rows, *scratch)
    core = F.shiftright("place", 24)
    runs = kept.join(parts, ["h", "f"]).select("rk", "rk2", (core - F.col("high")).alias("first"), (core - F.col("low")).alias("last"))
    if by_words:
        runs = runs.selectExpr("rk", "rk2", f"(first + {CODE - 1}) div {CODE} as first", f"last div {CODE} as last").filter("first <= last")
    done = stored(runs, "suffix-runs")
    discard(kept, parts)
    return done


def merged(runs: list[dict] | None, length: int) -> list[list[int]]:
    """Disjoint spans of what the runs of starts cover."""
    out: list[list[int]] = []
    for first, end in sorted((r["first"], r["last"] + length) for r in runs or []):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def dedup(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), as_text: bool = False, words: int = 0, by_words: bool = False) -> DataFrame:
    """The columns of keep, and (n_bytes, n_removed, n_spans, spans, kept, n_passages) of each row of docs (doc_id, text).

    kept is binary; with as_text a string, without the characters that lost a byte.

    A byte goes if a string of length bytes that covers it also starts anywhere else, in the same text too;
    every occurrence goes. Texts are UTF-8 bytes; a null text counts as empty; one shorter than length stays.
    Equal rows count as different texts.

    n_passages: maximal runs of words that strings of so many words cover that also start elsewhere (words; 0 leaves
    them out). With by_words, these passages go, from first to last word, in place of the strings of length bytes.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), *keep).withColumn("rk", F.xxhash64(docs["doc_id"], "text")).withColumn("rk2", F.hash(docs["doc_id"], "text"))
    joined = texts
    for name, found in (("runs", None if by_words else repeated_starts(texts, length)), ("passages", repeated_starts(texts, words, by_words=True) if words else None)):
        if found is None:
            joined = joined.withColumn(name, F.lit(None).cast("array<struct<first: long, last: long>>"))
        else:
            per_row = found.groupBy("rk", "rk2").agg(F.collect_set(F.struct("first", "last")).alias(name))  # at most a text's own blocks
            joined = joined.join(per_row, ["rk", "rk2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 0, 4 << 20):
                sizes, removed, spans, kept, passages = [], [], [], [], []
                for text, found, said in zip(some.column(0).cast(pa.binary()), some.column(1), some.column(2)):
                    raw, cut, own = text.as_py(), merged(found.as_py(), length), merged(said.as_py(), words)
                    if by_words and own:
                        _, starts, ends, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACES, NO_SPACES)
                        cut = [[int(starts[a]), int(ends[b - 1])] for a, b in own]
                    edges = [0, *(x for pair in cut for x in pair), len(raw)]
                    sizes.append(len(raw))
                    removed.append(sum(b - a for a, b in cut))
                    spans.append([{"first": a, "end": b} for a, b in cut])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    passages.append(len(own))
                span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                text_or_bytes = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                made = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, span), text_or_bytes, pa.array(passages, pa.int64())]
                yield pa.RecordBatch.from_arrays([*some.columns[3:], *made], names=[*keep, "n_bytes", "n_removed", "n_spans", "spans", "kept", "n_passages"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    kind = "string" if as_text else "binary"
    return joined.select("text", "runs", "passages", *keep).transform(mapped, run, fields + f"n_bytes long, n_removed long, n_spans long, spans array<struct<first: long, end: long>>, kept {kind}, n_passages long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"), words=WORDS)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", (F.col("n_passages") > 0).alias("has_passage"))
