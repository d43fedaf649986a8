"""An approximate vector index: inverted lists of product-quantised codes, and search by lookup tables with exact refining.

Coarse centres and code books are learned from a sample of bounded size. Each vector belongs to its nearest centre's
cell, and what it differs by from that centre is coded, a byte for each group of components. Lists are written by cell,
in blocks of codes, so that a search reads the probed cells only, and of those the codes only. Cells are dealt to parts,
and a share of the queries meets a part's blocks in one task, which keeps for each query its best rows by distances
summed up from lookup tables; the best of all parts are measured exactly.

Rows with a null id or vector are not indexed, and such queries find nothing. Vectors of another size than the sample's
fail the task. Of equal distances the smaller id is first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.vectors import distance

#: Rows of least hash that centres and books are learned from, and queries among them that the number of probes is set by.
SAMPLE, PROBERS = 16_384, 256
#: Groups of components, codes of a group, rounds of k-means.
GROUPS, CODES, ROUNDS = 16, 256, 12
#: Rows of a block of a list, queries of a pack, rows that a task that writes lists holds.
BLOCK, PACK, HELD = 4096, 256, 1 << 18
#: Distances from centres that are in memory at once.
GAPS = 1 << 20
#: Queries of a share; parts that cells are dealt to, at least; coded rows of a part, about and at most.
SHARE, PARTS, PART, MOST = 1024, 16, 1 << 16, 1 << 20
#: Share of the sample's true neighbours whose cells are probed.
SURE = 0.97


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of x by Lloyd's rounds, from k rows spread evenly; a centre without rows moves to the worst-placed row."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far)[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its squared distance. Few rows are compared at once, whatever their number."""
    near, far = np.zeros(len(x), int), np.zeros(len(x))
    norms, step = (centres * centres).sum(1), max(1, GAPS // len(centres))
    for lo in range(0, len(x), step):
        some = x[lo : lo + step]
        gaps = (some * some).sum(1)[:, None] - 2 * (some @ centres.T) + norms
        at = gaps.argmin(1)
        near[lo : lo + step], far[lo : lo + step] = at, gaps[np.arange(len(some)), at]
    return near, far


@dataclass
class Books:
    """Centres (cells x size), code books (groups, codes, components of a group), and the cells that a query probes."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of each row."""
        cell, _ = nearest(x, self.centres)
        codes = [nearest(part, book)[0] for part, book in zip(self.split(x - self.centres[cell]), self.books, strict=True)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def about(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances of queries from coded rows of a cell."""
        out = np.zeros((len(queries), len(codes)))
        for k, (part, book) in enumerate(zip(self.split(queries - self.centres[cell]), self.books, strict=True)):
            tables = (part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1)
            out += tables[:, codes[:, k]]
        return out

    def probed(self, queries: np.ndarray) -> np.ndarray:
        norms, step = (self.centres * self.centres).sum(1), max(1, GAPS // len(self.centres))
        own = [np.argsort(norms - 2 * (queries[lo : lo + step] @ self.centres.T), axis=1, kind="stable")[:, : self.probes] for lo in range(0, len(queries), step)]
        return np.concatenate(own) if own else np.zeros((0, self.probes), int)


def fit(store: DataFrame, cells: int | None = None, groups: int = GROUPS, k: int = 10) -> Books | None:
    """Books for store (vec_id, embedding); None if it has no rows. cells: by default the root of the number of rows, to
    4096. The number of probes is such that the cells of SURE of the sample's k nearest are among them."""
    rows = store.filter("vec_id is not null and embedding is not null")
    sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return None
    x = np.array([r["embedding"] for r in sample], np.float64)
    centres = kmeans(x, cells or int(min(4096, max(1, rows.count() ** 0.5))))
    near, _ = nearest(x, centres)
    books = [kmeans(part, CODES) for part in np.array_split(x - centres[near], min(groups, x.shape[1]), axis=1)]
    asked = x[:PROBERS]
    gaps = (x * x).sum(1) - 2 * (asked @ x.T)
    true = np.argsort(gaps, axis=1)[:, : k + 1]
    order = np.argsort((centres * centres).sum(1) - 2 * (asked @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], near[true]]
    return Books(centres, books, int(np.quantile(place, SURE, method="higher")) + 1)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def write(store: DataFrame, books: Books, path: str) -> None:
    """Writes the lists of store (vec_id, embedding) by cell, in blocks (ids, codes). A cell with many rows is dealt to
    several tasks."""
    shared, size = store.sparkSession.sparkContext.broadcast(books), books.centres.shape[1]  # bounded by cells and codes

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, codes = shared.value.encode(_vectors(batch.column(1), size)) if batch.num_rows else (np.zeros(0), np.zeros((0, 1), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0).cast(pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "vec_id", "code"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        n = 0

        def made(cell: int) -> pa.RecordBatch:
            ids, codes = held.pop(cell)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(codes)], pa.binary())], names=["cell", "ids", "codes"])

        for batch in batches:
            for cell, vec_id, code in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids, codes = held.setdefault(cell, ([], []))
                ids.append(vec_id)
                codes.append(code)
                n += 1
                if len(ids) == BLOCK:
                    n -= BLOCK
                    yield made(cell)
            if n >= HELD:
                n = 0
                for cell in [*held]:
                    yield made(cell)
        for cell in [*held]:
            yield made(cell)

    rows = store.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding").mapInArrow(encode, "cell int, vec_id long, code binary")
    rows.hint("rebalance", "cell").mapInArrow(pack, "cell int, ids binary, codes binary").write.mode("overwrite").partitionBy("cell").parquet(path)


def best(about: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The least most of about in each row with their ids, in no order."""
    if about.shape[1] <= most:
        return about, ids
    at = np.argpartition(about, most - 1, axis=1)[:, :most]
    return np.take_along_axis(about, at, axis=1), np.take_along_axis(ids, at, axis=1)


def search(store: DataFrame, books: Books, path: str, queries: DataFrame, k: int = 10, refine: int = 20) -> DataFrame:
    """(query_id, vec_id, distance, rank) of about the k nearest rows for each query (query_id, embedding), by squared
    distance. refine times k rows by codes are measured exactly, from store.

    A task holds a share of the queries (SHARE about), a part of the lists (MOST rows about) and refine times k rows for
    each of its queries, whatever the number of rows and queries; between tasks go those rows, packed.
    """
    spark, size, keep = store.sparkSession, books.centres.shape[1], k * refine
    shared = spark.sparkContext.broadcast(books)
    asked = queries.filter("query_id is not null and embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(0, int)
        for batch in batches:
            found = np.union1d(found, shared.value.probed(_vectors(batch.column(0), size)))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["cell"])

    wanted = [r[0] for r in asked.select("embedding").mapInArrow(cells, "cell int").distinct().collect()]  # at most the number of cells: prunes the scan
    lists = spark.read.schema("ids binary, codes binary, cell int").parquet(path).filter(F.col("cell").isin(wanted))
    held = dict(lists.groupBy("cell").agg((F.sum(F.octet_length("ids")) / 8).cast("long")).collect())
    shares, parts = max(1, -(-asked.count() // SHARE)), max(PARTS, -(-sum(held.values()) // PART))
    sizes = np.bincount(np.array([c % parts for c in held], int), weights=np.array([*held.values()], float), minlength=parts)
    turns = max(1, int(-(-sizes.max() // MOST)))  # of a part with too many rows, as of a cell of copies

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PACK):
                some = batch.slice(lo, PACK)
                vectors, rows = _vectors(some.column(1), size), []
                for query_id, share, vector, own in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), vectors, shared.value.probed(vectors), strict=True):
                    part = own % parts
                    rows += [(share, p, query_id, vector.tobytes(), own[part == p].astype("<i4").tobytes()) for p in np.unique(part).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["share", "part", "query_id", "vector", "cells"])

    def scan(some: pa.Table, blocks: pa.Table) -> pa.Table:
        names = some["query_id"].to_numpy()
        vectors = np.array([np.frombuffer(v.as_py(), "<f8") for v in some["vector"]]).reshape(len(names), size)
        own = [np.frombuffer(c.as_py(), "<i4") for c in some["cells"]]
        asks, who = np.concatenate([*own, np.zeros(0, int)]), np.repeat(np.arange(len(names)), np.array([len(c) for c in own], int))
        least, found = np.full((len(names), keep), np.inf), np.full((len(names), keep), -1)
        for cell, ids, codes in zip(*(blocks[c] for c in ("cell", "ids", "codes")), strict=True):
            cell, ids = cell.as_py(), np.frombuffer(ids.as_py(), "<i8")
            codes = np.frombuffer(codes.as_py(), np.uint8).reshape(len(ids), -1)
            every = who[asks == cell]
            for lo in range(0, len(every), PACK):
                q = every[lo : lo + PACK]
                about, near = best(shared.value.about(vectors[q], cell, codes), np.broadcast_to(ids, (len(q), len(ids))), keep)
                least[q], found[q] = best(np.hstack([least[q], about]), np.hstack([found[q], near]), keep)
        there = np.isfinite(least)
        packed = lambda values, kind: pa.array([v[t].astype(kind).tobytes() for v, t in zip(values, there, strict=True)], pa.binary())
        return pa.Table.from_arrays([pa.array(names, pa.int64()), packed(found, "<i8"), packed(least, "<f8")], names=["query_id", "ids", "about"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for query_id, ids, about in zip(*batch.columns, strict=True):
                was = top.get(query_id.as_py(), (np.zeros(0), np.zeros(0, int)))
                about, ids = np.append(was[0], np.frombuffer(about.as_py(), "<f8")), np.append(was[1], np.frombuffer(ids.as_py(), "<i8"))
                order = np.lexsort((ids, about))[:keep]
                top[query_id.as_py()] = about[order], ids[order]
        for query_id, (_, ids) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query_id)), pa.array(ids)], names=["query_id", "vec_id"])

    share, turn = F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packs = asked.select("query_id", "embedding", share.alias("share")).mapInArrow(probe, "share int, part int, query_id long, vector binary, cells binary").withColumn("turn", turn(turns))
    dealt = lists.select("cell", "ids", "codes", (F.col("cell") % parts).alias("part"), F.pmod(F.xxhash64("ids"), F.lit(turns)).cast("int").alias("turn")).withColumn("share", turn(shares))
    met = [df.groupBy("share", "part", "turn") for df in (packs, dealt)]
    rough = met[0].cogroup(met[1]).applyInArrow(scan, "query_id long, ids binary, about binary")
    chosen = rough.repartition(shares, "query_id").mapInArrow(merge, "query_id long, vec_id long")
    vectors = store.select("vec_id", F.col("embedding").alias("v"))
    measured = chosen.join(vectors, "vec_id").join(asked, "query_id").select("query_id", "vec_id", distance(F.col("embedding"), F.col("v")).alias("distance"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return measured.withColumn("rank", nth).filter(F.col("rank") <= k)
