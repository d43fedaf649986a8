"""Structured Streaming jobs: lives of tasks, windows, sessions, and incremental ingest."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from granary.sources.tables import shared_folder, table

#: Seconds after which a worker that is executing counts as lost and its task goes back to the queue.
TASK_TIMEOUT = 1800


def task_lives(requests: DataFrame) -> DataFrame:
    """(pool, task, submitted, failed, state, worker, since) of each task, for a stream or table of requests (pool,
    seq, at, tool, worker, task).

    The last of a task's submit, start, done and failed requests says its state: queued, executing, done, and queued
    again after a failure. State is kept by pool and task, so it spreads over the cluster and grows with the tasks only.
    """
    return timed_lives(requests).drop("seen")


def timed_lives(requests: DataFrame) -> DataFrame:
    """task_lives with the time (seen) of a task's latest request."""
    own = requests.filter(F.col("tool").isin("submit", "start", "done", "failed"))
    last = F.max_by(F.struct("tool", "worker", "at"), "seq").alias("last")
    lives = own.groupBy("pool", "task").agg(F.count_if(F.col("tool") == "submit").alias("submitted"), F.count_if(F.col("tool") == "failed").alias("failed"), last, F.max("at").alias("seen"))
    state = F.when(F.col("last.tool") == "start", "executing").when(F.col("last.tool") == "done", "done").otherwise("queued")
    return lives.select("pool", "task", "submitted", "failed", state.alias("state"), F.col("last.worker").alias("worker"), F.col("last.at").alias("since"), "seen")


def requeued(lives: DataFrame, now: Column, timeout: int = TASK_TIMEOUT) -> DataFrame:
    """Task lives with those that execute for longer than timeout seconds back in the queue, without a worker."""
    lost = (F.col("state") == "executing") & (now - F.col("since") > timeout)
    return lives.withColumn("worker", F.when(~lost, F.col("worker"))).withColumn("state", F.when(lost, "queued").otherwise(F.col("state")))


def routed(requests: DataFrame, tools: dict[str, list[str]]) -> DataFrame:
    """Requests (tool, params map) with the error that each gets: unknown_tool, missing_param or none."""
    needs = F.create_map(*[x for tool, names in tools.items() for x in (F.lit(tool), F.array(*map(F.lit, names)).cast("array<string>"))])
    wanted = F.try_element_at(needs, F.col("tool"))
    has = F.coalesce(F.map_keys("params"), F.array().cast("array<string>"))
    missing = F.size(F.array_except(wanted, has)) > 0
    return requests.withColumn("error", F.when(wanted.isNull(), "unknown_tool").when(missing, "missing_param"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a stream's progress, state and results, in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_upserts(stream: DataFrame, folder: str) -> list[int]:
    """Runs a stream over what is there now and was not read before, in update mode; gives the rows read by each batch.

    A batch's rows are written as the partition of its id, in place of what an earlier try of the batch has left, so a
    batch that is repeated changes nothing. Progress and state are in the folder too: a lost executor or driver costs a
    batch, and the next run goes on from there.
    """
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/table/batch={n}")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress]


def latest(spark: SparkSession, folder: str, schema: StructType, key: Sequence[str]) -> DataFrame:
    """What the batches of run_upserts have made of each key: its last batch's row, and that batch's number."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/table")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))
    return rows.withColumn("__n", nth).filter("__n = 1").drop("__n")


def finish(stream: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """Runs a stream over what is there now, and returns the last row of each key."""
    folder = new_folder(stream.sparkSession, name)
    run_upserts(stream, folder)
    return latest(stream.sparkSession, folder, stream.schema, key).drop("batch")


LIFE = "submitted long, failed long, seq long, tool string, worker string, at long, lost boolean"
LIVES = "pool string, task string, submitted long, failed long, state string, worker string, since long"


class TaskLife(StatefulProcessor):
    """The life of one task of a pool: what its requests say, and back to the queue when it executes for too long.

    State is one value for each task. A start sets a timer of event time; when it fires and the task still executes
    since then, the task is queued again, without a worker. Rows of a batch are taken by seq; an older request than the
    last known one only counts.
    """

    def __init__(self, timeout: int | None) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE)

    def _row(self, key: tuple, life: tuple) -> Row:
        submitted, failed, _, tool, worker, at, lost = life
        state = "queued" if lost else {"start": "executing", "done": "done"}.get(tool, "queued")
        return Row(pool=key[0], task=key[1], submitted=submitted, failed=failed, state=state, worker=None if lost else worker, since=at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        submitted, failed, seq, tool, worker, at, lost = (self.life.get() if self.life.exists() else None) or (0, 0, None, None, None, None, False)
        was = (tool, at)
        for r in sorted(rows, key=lambda r: r.seq):
            submitted, failed = submitted + (r.tool == "submit"), failed + (r.tool == "failed")
            if seq is None or r.seq > seq:
                seq, tool, worker, at, lost = r.seq, r.tool, r.worker, r.at, False
        if self.timeout is not None and (tool, at) != was:
            if was[0] == "start":
                self.handle.deleteTimer(self._due(was[1]))
            if tool == "start":
                self.handle.registerTimer(self._due(at))
        life = (submitted, failed, seq, tool, worker, at, lost)
        self.life.update(life)
        yield self._row(key, life)

    def _due(self, at: int) -> int:
        return (at + self.timeout) * 1000 + 1

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        submitted, failed, seq, tool, worker, at, _ = self.life.get()
        if tool == "start" and self._due(at) <= expiredTimerInfo.getExpiryTimeInMs():
            life = (submitted, failed, seq, tool, worker, at, True)
            self.life.update(life)
            yield self._row(key, life)

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """A stream that is started here keeps its state in RocksDB, as timers and typed state need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def watched_lives(requests: DataFrame, timeout: int | None = TASK_TIMEOUT, late: str = "0 seconds") -> DataFrame:
    """The lives of tasks for a stream of requests as task_lives reads them, each with its own timeout; a request with the
    tool `clock` only moves time on. Rows come when a life changes."""
    own = requests.filter(F.col("tool").isin("submit", "start", "done", "failed", "clock")).withColumn("time", F.timestamp_seconds("at")).withWatermark("time", late)
    keyed = own.groupBy("pool", "task")
    mode = "EventTime" if timeout is not None else "None"
    return keyed.transformWithState(TaskLife(timeout), LIVES, "Update", mode)


def overdue(spark: SparkSession, folder: str, timeout: int = TASK_TIMEOUT, late: int = 0) -> DataFrame:
    """The lives that runs of timed_lives have made, swept at the stream's time, which is late seconds before the latest
    request: a task that executes for longer than timeout goes back to the queue. A request counts however late it comes.

    State is kept by Spark's aggregates. watched_lives has a timer for each task instead, whose rows come when it fires;
    each life then goes through several calls between Python and the state server in every batch.
    """
    lives = latest(spark, folder, StructType.fromDDL(f"{LIVES}, seen long"), ["pool", "task"])
    now = spark.read.schema("seen long").parquet(f"{folder}/table").agg(F.max("seen") - late).scalar()
    return requeued(lives, now, timeout).drop("seen")


def life_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The lives that a finished run of watched_lives has in its state, read from its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "life").load(f"{folder}/progress")
    v = F.col("value")
    said = F.when(v["lost"], "queued").when(v["tool"] == "start", "executing").when(v["tool"] == "done", "done").otherwise("queued")
    key = F.col("key")
    return state.select(key["pool"].alias("pool"), key["task"].alias("task"), v["submitted"].alias("submitted"), v["failed"].alias("failed"), said.alias("state"), F.when(~v["lost"], v["worker"]).alias("worker"), v["at"].alias("since"))


def aggregate_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The lives that a finished run of task_lives has in its state, read from its checkpoint: the counts of its aggregates
    and the last request, in the order in which task_lives asks for them."""
    state = spark.read.format("statestore").load(f"{folder}/progress")
    fields = [StructField(f"f{k}", f.dataType) for k, f in enumerate(state.schema["value"].dataType.fields)]
    v = F.col("value").cast(StructType(fields))  # both counts have one name
    submitted, failed, last = "f0", "f1", "f2"
    tool = v[last]["tool"]
    said = F.when(tool == "start", "executing").when(tool == "done", "done").otherwise("queued")
    return state.select("key.pool", "key.task", v[submitted].alias("submitted"), v[failed].alias("failed"), said.alias("state"), v[last]["worker"].alias("worker"), v[last]["at"].alias("since"))


def replayed(rows: DataFrame, order: str, parts: int, folder: str, stream: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Runs a stream over rows that come in parts, the first by order first: after each part the stream is run anew and
    goes on where it stopped. Gives the rows read by each batch."""
    shares = ", ".join(str(k / parts) for k in range(1, parts))
    edges = rows.agg(F.expr(f"approx_percentile({order}, array({shares}))").alias("e")).first()[0] if parts > 1 else []
    part = sum(((F.col(order) > e).cast("int") for e in edges or []), F.lit(0))
    read = []
    for k in range(parts):
        rows.filter(part == k).write.mode("append").parquet(f"{folder}/incoming")
        read += run_upserts(stream(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/incoming")), folder)
    return read


def ingested(sources: DataFrame) -> DataFrame:
    """(source, hash, n_chars) of a stream of sources (source, text): what run_upserts keeps of each, once for each change."""
    return sources.select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, read as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame) -> DataFrame:
    """Events and value by hour and type, an hour's lateness allowed. An extension."""
    w = F.window("ts", "1 hour")
    return events.withWatermark("ts", "1 hour").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("window.start").cast("string").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users by gaps. An extension."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


def new_sources(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source, state): new, stale (another hash) or fresh, against what was ingested before; sources that are gone are `gone`."""
    old = manifest.select("source", F.col("hash").alias("old"))
    both = current.join(old, "source", "full")
    state = F.when(F.col("old").isNull(), "new").when(F.col("hash").isNull(), "gone").when(F.col("hash") != F.col("old"), "stale").otherwise("fresh")
    return both.select("source", state.alias("state"))
