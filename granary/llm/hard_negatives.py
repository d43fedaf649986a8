"""Hard-negative mining: for each anchor its best rows of its own label, and just below those the best rows of others.

Vectors are whole numbers, scores their inner products. Candidates are dealt into blocks near one of CELLS centres, and
each block is a cover tree over its vectors, to each of which one component is added that gives all of a block the same
norm M: sqrt(M^2 - |x|^2). Distances of such vectors bound products: what lies within r of a centre c has a product with
q of <q,c> - |q|r to <q,c> + |q|r. Packs of anchors meet each tree best node first; a node is opened for the anchors
whose windows its bounds can still reach, and every row of an opened node is scored exactly. The anchors' own blocks
give a first bound for the others. No row is left out but by such a bound, so results are exact; where vectors have no
neighbours, as random ones of many dimensions, all nodes are opened, as matrix products.

Rows without vec_id, label or vector, or with a null or non-finite component, take no part; nor do rows with a component
of LARGEST or more, whose products need not fit a long. Exact repeats of a row count once; copies under other ids are
rows of their own. Vectors meet those of their own size only. Of equal scores the smaller vec_id is first. Other columns
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import mapped, stored, table

#: Bound of a whole-number component; with up to 256 components products fit a long.
LARGEST = 1 << 27
#: Centres for dealing out candidates, and rows of least hash that they are chosen from.
CELLS, SAMPLE = 64, 2048
#: Rows of a tree, anchors of a pack, members of a node that is not divided, packs of a task.
BLOCK, PACK, LEAF, GROUP = 8192, 256, 128, 4
#: A child's covering radius is this part of its parent's.
SHRINK = 1 / 1.5
#: Sums of products below this are exact in doubles.
EXACT = 1 << 53

_ROW = "cell int, h long, vec_id long, label long, v binary"
_TREES = "kind int, size int, ids binary, labels binary, points binary, centres binary, radii binary, starts binary, child_points binary, child_nodes binary"
_NEVER = -(1 << 62)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows, never too small by rounding."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0) + 1e-9 * ((a * a).sum(1)[:, None] + 1))


def _cover(points: np.ndarray, members: np.ndarray, radius: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Leaders among members so that each member is within radius of its leader; the first member leads.
    Gives leaders, and each member's leader and distance from it."""
    leaders = [int(members[0])]
    of, far = np.zeros(len(members), np.int64), np.zeros(len(members))
    for lo in range(1, len(members), 256):
        some = members[lo : lo + 256]
        gaps = _gaps(points[some], points[leaders])
        near = gaps.argmin(1)
        of[lo : lo + 256], far[lo : lo + 256] = near, gaps[np.arange(len(some)), near]
        alone = np.flatnonzero(far[lo : lo + 256] > radius)
        if not len(alone):
            continue
        own, first = _gaps(points[some[alone]], points[some[alone]]), len(leaders)
        best, place = far[lo + alone], of[lo + alone]
        for k in range(len(alone)):
            if best[k] > radius:
                nearer = own[k] < best
                best[nearer], place[nearer] = own[k][nearer], len(leaders)
                best[k], place[k] = 0.0, len(leaders)
                leaders.append(int(some[alone[k]]))
        of[lo + alone], far[lo + alone] = place, best
        assert first < len(leaders)
    return leaders, of, far


class Tree:
    """A cover tree over the rows of a block; node 0 is the root. A node's children are points, and nodes around them."""

    FIELDS = (("ids", "<i8"), ("labels", "<i8"), ("points", "<i4"), ("centres", "<i8"), ("radii", "<f8"), ("starts", "<i8"), ("child_points", "<i8"), ("child_nodes", "<i8"))

    def __init__(self, size: int, *fields: np.ndarray) -> None:
        self.size = size
        for (name, _), value in zip(self.FIELDS, fields, strict=True):
            setattr(self, name, value)
        self.points = self.points.reshape(len(self.ids), size)

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> Tree:
        x = points.astype(np.float64)
        norms = (x * x).sum(1)
        x = np.column_stack([x, np.sqrt(norms.max() - norms)])
        centres, radii, children = [0], [0.0], []
        work = [np.arange(len(ids))]  # members of each node, its centre first
        while len(children) < len(work):
            members = work[len(children)]
            here = len(children)
            work[here] = None
            far = _gaps(x[members], x[members[:1]])[:, 0]
            far[0] = 0.0
            radii[here] = float(far.max())
            if len(members) <= LEAF or radii[here] <= 1e-3:
                children.append([(int(p), -1) for p in members[1:]])
                continue
            leaders, of, _ = _cover(x, members, radii[here] * SHRINK)
            order = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[order], np.arange(len(leaders) + 1))
            own = []
            for k, leader in enumerate(leaders):
                group = members[order[edges[k] : edges[k + 1]]]
                if len(group) == 1:
                    if leader != members[0]:
                        own.append((leader, -1))
                    continue
                own.append((leader, len(work)))
                centres.append(leader)
                radii.append(0.0)
                work.append(np.concatenate([[leader], group[group != leader]]))
            children.append(own)
        starts = np.cumsum([0, *map(len, children)])
        flat = np.array([c for own in children for c in own], np.int64).reshape(-1, 2)
        return cls(points.shape[1], ids, labels, points, np.array(centres), np.array(radii), starts, flat[:, 0], flat[:, 1])

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, n)).astype(t).tobytes() for n, t in self.FIELDS]

    @classmethod
    def unpacked(cls, size: int, fields: list[bytes]) -> Tree:
        return cls(size, *(np.frombuffer(f, t) for f, (_, t) in zip(fields, cls.FIELDS, strict=True)))

    def descend(self, wanted: Wanted) -> None:
        """Offers to wanted the rows that can matter, node by node, the node of the highest bound first."""
        everyone = np.arange(len(wanted.vectors))
        top = self.centres[:1]
        small = float(np.abs(wanted.vectors).max(initial=0)) * float(np.abs(self.points).max(initial=0)) * max(self.size, 1) < EXACT
        x, y = (wanted.vectors.astype(np.float64), self.points.astype(np.float64)) if small else (wanted.vectors, self.points)  # once, not for each node

        def scores(who: np.ndarray, points: np.ndarray) -> np.ndarray:
            return np.rint(x[who] @ y[points].T).astype(np.int64) if small else products(x[who], y[points])

        score = scores(everyone, top)
        wanted.offer(everyone, self, top, score)
        heap = [(0.0, 0, 0, everyone, score[:, 0])]
        pushed = 0
        while heap:
            _, _, node, who, at = heapq.heappop(heap)
            reach = wanted.norms[who] * self.radii[node] * (1 + 1e-9) + 1
            open_ = wanted.open(who, at - reach, at + reach)
            if not open_.any():
                continue
            who = who[open_]
            span = slice(self.starts[node], self.starts[node + 1])
            points, nodes = self.child_points[span], self.child_nodes[span]
            if not len(points):
                continue
            score = scores(who, points)
            fresh = points != self.centres[node]
            wanted.offer(who, self, points[fresh], score[:, fresh])
            for k in np.flatnonzero(nodes >= 0):
                high = score[:, k] + wanted.norms[who] * self.radii[nodes[k]]
                pushed += 1
                heapq.heappush(heap, (-float(high.max()), pushed, int(nodes[k]), who, score[:, k]))


class Wanted:
    """What a pack of anchors looks for: the k best for each line, of which an anchor has one or more."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        """low, high: least and greatest score that counts, by anchor and line; same: of the anchor's label, or of others."""
        self.ids, self.labels, self.vectors, self.k, self.same = ids, labels, vectors, k, same
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.low, self.high = low.copy(), high
        self.found: list[list[list[tuple[int, int]]]] = [[[] for _ in range(low.shape[1])] for _ in ids]

    def open(self, who: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether products from least to most can still matter to these anchors."""
        return ((most[:, None] >= self.low[who]) & (least[:, None] <= self.high[who])).any(1)

    def offer(self, who: np.ndarray, tree: Tree, points: np.ndarray, score: np.ndarray) -> None:
        if not len(points):
            return
        fits = (tree.labels[points] == self.labels[who][:, None]) == self.same
        fits &= (score >= self.low[who].min(1)[:, None]) & (score <= self.high[who].max(1)[:, None])
        rows, own = np.flatnonzero(fits.any(1)), np.flatnonzero(fits.any(0))  # mostly few: the rest is done for them only
        if not len(rows):
            return
        who, points, score, fits = who[rows], points[own], score[np.ix_(rows, own)], fits[np.ix_(rows, own)]
        if self.same:
            for a, p in zip(*np.nonzero(fits & (tree.ids[points] == self.ids[who][:, None]))):
                fits[a, p] = not np.array_equal(tree.points[points[p]], self.vectors[who[a]])
        ids = tree.ids[points]
        for line in range(self.low.shape[1]):
            usable = fits & (score >= self.low[who, line][:, None]) & (score <= self.high[who, line][:, None])
            if not usable.any():
                continue
            if len(points) > self.k:  # only what is not behind the k-th best can stay
                kth = np.partition(np.where(usable, score, _NEVER), len(points) - self.k, axis=1)[:, len(points) - self.k]
                usable &= score >= kth[:, None]
            a, p = np.nonzero(usable)
            order = np.lexsort((ids[p], -score[a, p], a))
            a, p = a[order], p[order]
            first = np.arange(len(a)) - np.searchsorted(a, a) < self.k
            for k, s, i in zip(who[a[first]].tolist(), score[a[first], p[first]].tolist(), ids[p[first]].tolist(), strict=True):
                best = self.found[k][line]
                if len(best) < self.k or (-s, i) < best[-1]:
                    best.append((-s, i))
                    best.sort()
                    del best[self.k :]
                    if len(best) == self.k:
                        self.low[k, line] = max(self.low[k, line], -best[-1][0])


def whole_numbers(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): floor(256 x) of each component of embedding; rows that take no part go."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * 256 >= float(LARGEST)))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter("vec_id is not null and label is not null and embedding is not null")
    return own.filter(~bad).select("vec_id", "label", F.transform(v, lambda x: x.cast("int")).alias("v"))


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Up to CELLS centres for each size of vectors, each the farthest from those before, from the SAMPLE rows of least hash."""
    sample = rows.select(F.xxhash64("vec_id").alias("h"), "vec_id", "v").orderBy("h", "vec_id").limit(SAMPLE).collect()
    out = {}
    for size in sorted({len(r.v) for r in sample}):
        own = [r.v for r in sample if len(r.v) == size]
        x = np.array(own, np.float64).reshape(len(own), size)
        chosen, near = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < CELLS and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[size] = x[chosen]
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with their vector as bytes, by range of (cell, hash): a cell with many rows has many partitions."""
    centres = _centres(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(np.asarray(lists.offsets))
            values, offsets = lists.values.to_numpy(), np.asarray(lists.offsets)
            cell = np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                if size in centres and size:
                    x = values[offsets[own][:, None] + np.arange(size)].astype(np.float64)
                    c = centres[size]
                    cell[own] = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
            packed = [values[offsets[k] : offsets[k + 1]].astype("<i4").tobytes() for k in range(len(sizes))]
            cells = (sizes * CELLS + cell).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cells), batch.column("h"), batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary())], names=["cell", "h", "vec_id", "label", "v"])

    dealt = mapped(rows.select(F.xxhash64("vec_id").alias("h"), "vec_id", "label", "v"), run, _ROW)
    return dealt.repartitionByRange("cell", "h").sortWithinPartitions("cell", "h", "vec_id", "label", "v")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, ids, labels, points) of each block: rows of one cell, without exact repeats."""
    rows: list[tuple] = []
    last = None

    def made():
        size = rows[0][0] // CELLS
        points = np.frombuffer(b"".join(r[3] for r in rows), "<i4").reshape(len(rows), size)
        return size, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), points

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "vec_id", "label", "v")), strict=True):
            if row == last:
                continue
            if rows and (row[0] != rows[0][0] or len(rows) >= BLOCK):
                yield made()
                rows = []
            rows.append(row)
            last = row
    if rows:
        yield made()


def _thinned(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, copies: int) -> np.ndarray:
    """Rows to keep: of those with equal label and vector the first by id; further ones can't be among the best."""
    _, same = np.unique(points, axis=0, return_inverse=True) if points.shape[1] else (None, np.zeros(len(ids), np.int64))
    order = np.lexsort((ids, labels, same.ravel()))
    key = np.column_stack([same.ravel()[order], labels[order]])
    new = np.r_[True, (key[1:] != key[:-1]).any(1)]
    nth = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[nth < copies]


def index(rows: DataFrame, every: int, positives: int, copies: int) -> DataFrame:
    """Trees of all rows (kind 0), and packs of the anchors among them (kind 1: ids, labels, points, and in radii the
    score that a positive must reach). Anchors are the rows whose vec_id is divisible by every."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, ids, labels, points in _blocks(batches):
            kept = _thinned(ids, labels, points, copies)
            tree = Tree.build(ids[kept], labels[kept], points[kept])
            lines = [(0, size, *tree.packed())]
            anchors = np.flatnonzero(ids % every == 0)
            for lo in range(0, len(anchors), PACK):
                own = anchors[lo : lo + PACK]
                n = len(own)
                wanted = Wanted(ids[own], labels[own], points[own], np.full((n, 1), _NEVER), np.full((n, 1), -_NEVER), positives, True)
                tree.descend(wanted)
                lines.append((1, size, ids[own].astype("<i8").tobytes(), labels[own].astype("<i8").tobytes(), points[own].tobytes(), b"", wanted.low[:, 0].astype("<i8").tobytes(), b"", b"", b""))
            for line in lines:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(line, [pa.int32(), pa.int32()] + [pa.binary()] * 8, strict=True)], names=[c.split()[0] for c in _TREES.split(", ")])

    return mapped(_dealt(rows), run, _TREES)


def _anchors(found: DataFrame) -> DataFrame:
    """(anchor, vec_id, label, size, v, low): one row for each anchor; anchor is a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for size, ids, labels, points, low in zip(*(batch.column(c).to_pylist() for c in ("size", "ids", "labels", "points", "radii")), strict=True):
                ids, labels, low = (np.frombuffer(x, "<i8") for x in (ids, labels, low))
                each = [points[k * 4 * size : (k + 1) * 4 * size] for k in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(ids))), pa.array(ids), pa.array(labels), pa.array([size] * len(ids), pa.int32()), pa.array(each, pa.binary()), pa.array(low)], names=["anchor", "vec_id", "label", "size", "v", "low"])
                number += len(ids)

    return mapped(found.filter("kind = 1").select("size", "ids", "labels", "points", "radii"), run, "anchor long, vec_id long, label long, size int, v binary, low long")


def _met(anchors: DataFrame, trees: DataFrame, lines: int, k: int, same: bool) -> DataFrame:
    """(anchor, line, vec_id, score) of the best of each task's trees, for anchors (anchor, vec_id, label, size, v, low, high)
    whose low and high are arrays of lines numbers. Blocks of anchors meet blocks of rows; no pairs of rows are made."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def made(size):
            rows = held.pop(size)
            cols = [np.array([r[c] for r in rows], "<i8").tobytes() for c in (0, 1, 2, 5, 6)]
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *(pa.array([x], pa.binary()) for x in (*cols, b"".join(r[4] for r in rows)))], names=["p_size", "p_anchors", "p_ids", "p_labels", "p_low", "p_high", "p_points"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "vec_id", "label", "size", "v", "low", "high")), strict=True):
                held.setdefault(row[3], []).append(row)
                if len(held[row[3]]) >= PACK:
                    yield made(row[3])
        for size in [*held]:
            yield made(size)

    packs = mapped(anchors.select("anchor", "vec_id", "label", "size", "v", "low", "high"), pack, "p_size int, p_anchors binary, p_ids binary, p_labels binary, p_low binary, p_high binary, p_points binary")
    # every part of the trees' table is read beside every group of packs: nothing is broadcast, and only packs are shuffled
    groups = max(1, -(-anchors.count() // (PACK * GROUP)))
    pairs = trees.filter("kind = 0").drop("kind").hint("shuffle_replicate_nl").join(packs.repartition(groups), F.col("size") == F.col("p_size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, Wanted]] = {}  # a task's packs: what one tree gave is a bound for the next
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                tree = Tree.unpacked(one["size"], [one[n] for n, _ in Tree.FIELDS])
                if one["p_anchors"] not in held:
                    names, ids, labels, low, high = (np.frombuffer(one[f"p_{n}"], "<i8") for n in ("anchors", "ids", "labels", "low", "high"))
                    vectors = np.frombuffer(one["p_points"], "<i4").reshape(len(ids), tree.size)
                    held[one["p_anchors"]] = names, Wanted(ids, labels, vectors, low.reshape(-1, lines), high.reshape(-1, lines), k, same)
                tree.descend(held[one["p_anchors"]][1])
        for names, wanted in held.values():
            out = [(names[a], line, i, -s) for a, own in enumerate(wanted.found) for line, best in enumerate(own) for s, i in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["anchor", "line", "found_id", "score"])

    return mapped(pairs, run, "anchor long, line long, found_id long, score long")


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, v) of whole numbers.

    An anchor's positives are its best rows of its label; for each, the best rows of other labels whose score is least to
    most percent of the positive's are given, from rank 1.
    """
    found = stored(index(rows, every, positives, max(positives + 1, negatives)), "hard-negatives-trees")
    anchors = stored(_anchors(found), "hard-negatives-anchors")
    any_score = F.array(F.lit(-_NEVER).cast("long"))
    own = _met(anchors.withColumns({"low": F.array("low"), "high": any_score}), found, 1, positives, True)
    place = Window.partitionBy("anchor").orderBy(F.desc("score"), "found_id")
    best = own.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= positives)
    lists = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "found_id", "score"))).alias("best"))
    known = stored(anchors.drop("low").join(lists, "anchor"), "hard-negatives-positives")
    # windows in whole numbers; a line without a positive has an empty one
    line = lambda f, none: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda k: F.coalesce(f(F.get("best", k - 1)["score"]), F.lit(none).cast("long")))
    windows = known.withColumns({"low": line(lambda s: F.ceil(s * F.lit(least).cast("decimal(9,0)") / 100).cast("long"), -_NEVER), "high": line(lambda s: F.floor(s * F.lit(most).cast("decimal(9,0)") / 100).cast("long"), _NEVER)})
    others = _met(windows, found, positives, negatives, False)
    order = Window.partitionBy("anchor", "line").orderBy(F.desc("score"), "found_id")
    ranked = others.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    met = ranked.join(known.select("anchor", F.col("vec_id").alias("anchor_id"), "best"), "anchor")
    positive = F.get("best", F.col("line").cast("int"))
    return met.select("anchor_id", positive["found_id"].alias("positive_id"), "rank", F.col("found_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label))
