"""A property graph as two tables: entities (id, type, name) and edges (src, dst, type)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.batches import bounded, release
from granary.sources.tables import cut_lineage, shared_folder, upsert

#: Pairs of a join that one task of a search makes, about; nodes of a packed list at most.
ROWS, LIST = 1 << 20, 4096
#: Frees the shuffle files that made a table once it is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def upsert_entities(rows: DataFrame, order: Column) -> DataFrame:
    return upsert(rows, ["type", "name"], order)


def upsert_edges(rows: DataFrame, order: Column) -> DataFrame:
    return upsert(rows, ["src", "dst", "type"], order)


def search(entities: DataFrame, text: str, kinds: Sequence[str], limit: int) -> DataFrame:
    """Entities whose name contains the text in any case, of these types if any are given, the first by name."""
    hit = entities.filter(F.lower("name").contains(text.lower()))
    hit = hit.filter(F.col("type").isin(*kinds)) if kinds else hit
    return hit.orderBy("name", "id").limit(limit)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, type): steps that may be taken."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def sized(front: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, f, d, parts, wide): for each node of front (start, node) that steps (a, b) leave, its rows on both sides, in how
    many parts of about ROWS its pairs are dealt, and whether steps are the longer side, which is split."""
    f, d = front.groupBy("node").agg(F.count("*").alias("f")), steps.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d"))
    return f.join(d, "node").select("node", "f", "d", F.ceil(F.col("f") * F.col("d") / ROWS).cast("int").alias("parts"), (F.col("d") >= F.col("f")).alias("wide"))


def taken(front: DataFrame, steps: DataFrame, sizes: DataFrame, tasks: int) -> DataFrame:
    """(start, node, a, type): each step from a node of front (start, node), dealt to so many tasks by their numbers of rows in
    sizes. A node with more than ROWS pairs is dealt in parts: its longer side is split, the other one comes to each part."""
    hot = F.broadcast(sizes.filter("parts > 1").select(F.col("node").alias("__node"), "parts", "wide"))  # at most one for each ROWS pairs

    def placed(rows: DataFrame, node: str, other: str, split: Column) -> DataFrame:
        one = F.array(F.pmod(F.xxhash64(other), F.col("parts")).cast("int"))
        part = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(split, one).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        return rows.join(hot, F.col(node) == F.col("__node"), "left").select(*rows.columns, F.explode(part).alias(f"__{node}")).repartition(tasks, node, f"__{node}")

    left, right = placed(front, "node", "start", ~F.col("wide")), placed(steps, "a", "b", F.col("wide"))
    return left.join(right, (F.col("node") == F.col("a")) & (F.col("__node") == F.col("__a"))).select("start", F.col("b").alias("node"), "a", "type")


def packed(nodes: np.ndarray) -> bytes:
    """Ascending whole numbers as the first one and the gaps between them, in as few bytes as the widest gap needs."""
    gaps = np.diff(nodes.view("<u8"))
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(gaps.max(initial=0)) <= np.iinfo(k).max)
    return nodes[:1].tobytes() + kind[2:].encode() + gaps.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    nodes = np.frombuffer(data, f"<u{data[8:9].decode()}", offset=9).astype("<u8")
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1), nodes])).view("<i8")


def lists(rows: DataFrame, tasks: int) -> DataFrame:
    """(a, type, b): the numbers b of rows (a, type, b) for each a and type, packed in order, LIST at most in each list. Rows are
    dealt by range, so that a node with many numbers is dealt to many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                a, b, kind = batch.column("a"), batch.column("b").to_numpy().astype("<i8"), batch.column("type").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new = np.r_[True, (np.diff(a.to_numpy()) != 0) | (np.diff(kind) != 0)]
                place = np.arange(len(b)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                starts = np.flatnonzero(place % LIST == 0)
                made = [packed(own) for own in np.split(b, starts[1:])]
                yield pa.RecordBatch.from_arrays([a.take(pa.array(starts)), batch.column("type").take(pa.array(starts)).cast(pa.string()), pa.array(made, pa.binary())], names=["a", "type", "b"])
        finally:
            release()

    dealt = rows.select("a", "type", "b").repartitionByRange(tasks, "a", "type", "b").sortWithinPartitions("a", "type", "b")
    return bounded(dealt).mapInArrow(run, "a long, type string, b binary")


def merged(met: DataFrame, tasks: int) -> DataFrame:
    """(start, node, via) of lists met (start, node, a, type), node being packed: each node once for a start, with the least a
    and type, but for those in a list without an a, which have been seen. A start's lists meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            seen = [unpacked(r[1]) for r in held if r[2] is None]
            rows = sorted((r for r in held if r[2] is not None), key=lambda r: (r[2], r[3] is not None, r[3] or ""))
            own = [unpacked(r[1]) for r in rows]
            nodes, at = np.unique(np.concatenate([np.zeros(0, "<i8"), *own]), return_index=True)  # the first place is in the least list
            new = ~np.isin(nodes, np.concatenate([np.zeros(0, "<i8"), *seen]))
            of = np.searchsorted(np.cumsum([len(n) for n in own]), at[new], "right")
            via = pa.array([f"{r[2]}" if r[3] is None else f"{r[2]}:{r[3]}" for r in rows], pa.string()).take(pa.array(of, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(of), held[0][0], "<i8")), pa.array(nodes[new]), via], names=["start", "node", "via"])

        held: list[tuple] = []
        try:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("start", "node", "a", "type")), strict=True):
                    if held and row[0] != held[0][0]:
                        yield made()
                        held = []
                    held.append(row)
            if held:
                yield made()
        finally:
            release()

    dealt = met.select("start", "node", "a", "type").repartition(tasks, "start").sortWithinPartitions("start")
    return bounded(dealt).mapInArrow(run, "start long, node long, via string")


def neighbours(edges: DataFrame, starts: DataFrame, hops: int, direction: str = "out", kinds: Sequence[str] = ()) -> DataFrame:
    """(start, node, hop, via): nodes reached from each start (start) in up to hops steps, start left out.

    A node comes once for each start, with the fewest steps and the least node and type that discovered it.
    Steps, and what each hop but the last finds, are tables in the shared folder. A hop is one join, with an anti-join on
    what has been seen; the rows that it reads and gives are counted first, and its tasks are as many as keep each at about ROWS.
    Where a hop gives many more pairs than there are steps, packed lists of a node's steps take the place of single ones, so
    that pairs exist only in the task that merges a start's lists; starts of more than ROWS pairs go by single steps.
    The number of hops is bounded by hops, and the search ends when one finds nothing.
    """
    spark, folder = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/neighbours-{uuid.uuid4().hex}"

    def stored(rows: DataFrame, name: str) -> DataFrame:
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            rows.write.parquet(f"{folder}/{name}")
        finally:
            spark.conf.set(CLEANUP, before)
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    def single(front: DataFrame, seen: DataFrame, sizes: DataFrame, tasks: int, first: bool) -> DataFrame:
        most = 1 if first else front.groupBy("start").count().agg(F.max("count")).first()[0]
        met = taken(front, steps, sizes, tasks).filter("start <> node").withColumn("x", F.struct("a", "type"))
        if most > ROWS:  # a node may be met from so many others that its rows are first taken in parts
            part = F.pmod(F.xxhash64("a"), F.lit(-(-most // ROWS)))
            met = met.withColumn("part", part).repartition(tasks, "start", "node", "part").groupBy("start", "node", "part").agg(F.min("x").alias("x"))
        new = met.select("start", "node", "x").repartition(tasks, "start", "node").groupBy("start", "node").agg(F.min("x").alias("x"))
        new = new.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        return new.select("start", "node", F.concat_ws(":", F.col("x.a").cast("string"), "x.type").alias("via"))

    def by_lists(front: DataFrame, seen: DataFrame, left: DataFrame, sizes: DataFrame, tasks: int) -> DataFrame:
        known = lists(seen.select(F.col("start").alias("a"), F.lit(None).cast("string").alias("type"), F.col("node").alias("b")), tasks)
        known = known.select(F.col("a").alias("start"), F.col("b").alias("node"), F.lit(None).cast("long").alias("a"), "type")
        return merged(taken(front, left, sizes, tasks).unionByName(known), tasks)

    steps = stored(directed(edges.filter(F.col("type").isin(*kinds)) if kinds else edges, direction).filter("a <> b").distinct(), "steps")
    n = steps.count()
    front = starts.select("start", F.col("start").alias("node"))
    whole = {dict(steps.dtypes)[c] for c in "ab"} | {dict(front.dtypes)["start"]} == {"bigint"}
    seen = front.select("start", "node", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"))
    for hop in range(1, hops + 1):
        sizes = stored(sized(front, steps), f"sizes-{hop}")
        pairs = sizes.agg(F.sum(F.col("f") * F.col("d"))).first()[0]
        if not pairs:
            break
        tasks = max(spark.sparkContext.defaultParallelism, -(-(pairs + n) // ROWS))
        if whole and pairs > 2 * n:
            left = lists(steps.join(sizes.select(F.col("node").alias("a")), "a", "left_semi"), max(spark.sparkContext.defaultParallelism, -(-n // ROWS)))
            met = front.join(sizes.select("node", "d"), "node").groupBy("start").agg(F.sum("d").alias("pairs"))
            many = stored(met.filter(F.col("pairs") > ROWS).select("start"), f"many-{hop}")
            few = lambda rows: rows.join(F.broadcast(many), "start", "left_anti")  # noqa: B023, E731
            new = by_lists(few(front), few(seen), stored(left, f"lists-{hop}"), sizes, tasks)
            if not many.isEmpty():  # at most one for each ROWS pairs
                own = lambda rows: rows.join(F.broadcast(many), "start", "left_semi")  # noqa: B023, E731
                new = new.unionByName(single(own(front), own(seen), sizes, tasks, hop == 1))
        else:
            new = single(front, seen, sizes, tasks, hop == 1)
        new = new.select("start", "node", F.lit(hop).alias("hop"), "via")
        new = stored(new, f"hop-{hop}") if hop < hops else new
        seen = seen.unionByName(new)
        front = new.select("start", "node")
    return seen.filter("hop > 0")


def dependents(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, hop): all that depends on each start, directly or not, with the fewest steps; starts are left out.

    Each step's nodes are a table in the shared folder. A step reads the last one's table and joins it once; what has
    been seen is the tables of all steps, so plans stay as small as they are at first. As many jobs run as the longest
    way has steps.
    """
    spark, folder = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/dependents-{uuid.uuid4().hex}"
    steps = cut_lineage(directed(edges, "in").select("a", "b").distinct())
    front = starts.select("start", F.col("start").alias("node")).distinct()
    schema, hop = front.schema, 0
    front.write.parquet(f"{folder}/hop=0")
    while True:
        front, seen = spark.read.schema(schema).parquet(f"{folder}/hop={hop}"), spark.read.schema(schema).parquet(folder)
        met = front.join(steps, front["node"] == steps["a"]).select("start", F.col("b").alias("node")).distinct()
        hop += 1
        met.join(seen.select("start", "node"), ["start", "node"], "left_anti").write.parquet(f"{folder}/hop={hop}")
        if spark.read.schema(schema).parquet(f"{folder}/hop={hop}").isEmpty():
            break
    every = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, hop int").parquet(folder)
    return every.filter("hop > 0").select("start", "node", "hop")


def called_by(calls: DataFrame) -> DataFrame:
    """(target, n, first, last): how many sources call each target of calls (source, target), the least and the greatest."""
    pairs = calls.select("source", "target").distinct()
    return pairs.groupBy("target").agg(F.count("source").alias("n"), F.min("source").alias("first"), F.max("source").alias("last"))


def service_graph(evidence: DataFrame) -> DataFrame:
    """(src, dst, type, n, first): edges with how many rows speak for each."""
    return evidence.groupBy("src", "dst", "type").agg(F.count("*").alias("n"), F.min("evidence_id").alias("first"))


def relation_graph(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (type, name) and edges (src, dst, type, properties) of relations between files (source_file, target_file,
    relation_type, route_path, source_line): each file once, and a CALLS edge for each distinct relation."""
    ends = relations.select(F.explode(F.array("source_file", "target_file")).alias("name")).distinct()
    properties = F.struct(F.col("relation_type").alias("call_type"), "route_path", "source_line")
    edges = relations.select(F.col("source_file").alias("src"), F.col("target_file").alias("dst"), F.lit("CALLS").alias("type"), properties.alias("properties")).distinct()
    return ends.select(F.lit("FILE").alias("type"), "name"), edges
