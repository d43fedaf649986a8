"""Workers and tasks: who takes the next task, queue places, status summaries, dependents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.numbering import numbered


def next_workers(workers: DataFrame, group: str) -> DataFrame:
    """For each group the free worker to take: a polling one before an idle one, then the longest inactive, then the first registered."""
    order = F.struct(F.when(F.col("status") == "polling", 0).otherwise(1), "last_activity", "seq")
    free = workers.filter(F.col("status").isin("polling", "idle"))
    return free.groupBy(group).agg(F.min_by("name", order).alias("name"))


def queue_places(tasks: DataFrame, queue: str) -> DataFrame:
    """Place of each waiting task in its queue, from 1, by arrival."""
    return numbered(tasks, [queue], ["ts", "event_id"], "place").withColumn("place", F.col("place").cast("int"))


def worker_states(workers: DataFrame, pending: DataFrame, now) -> DataFrame:
    """(name, status, current_task, idle_seconds, pending_task): workers with the task that waits for each in pending
    (name, task), if any; idle seconds of idle and polling ones only."""
    idle = F.floor(F.unix_timestamp(now) - F.unix_timestamp(F.col("last_activity").cast("timestamp"))).cast("long")
    free = F.col("status").isin("idle", "polling")
    joined = workers.join(pending.select("name", F.col("task").alias("pending_task")), "name", "left")
    return joined.select("name", "status", "current_task", F.when(free, idle).alias("idle_seconds"), "pending_task")


def bus_counts(workers: DataFrame, pending: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: tasks that wait in the queue, workers that poll, and workers with a task that waits for them."""
    rows = queue.select(F.lit("queued_tasks").alias("what")).unionByName(pending.select(F.lit("pending_workers").alias("what")))
    rows = rows.unionByName(workers.filter("status = 'polling'").select(F.lit("polling_workers").alias("what")))
    return rows.agg(*(F.count_if(F.col("what") == w).alias(w) for w in ("queued_tasks", "polling_workers", "pending_workers")))


def with_status(tasks: DataFrame, wanted: str) -> DataFrame:
    """Tasks of a status; `all` means all of them."""
    return tasks if wanted == "all" else tasks.filter(F.col("status") == wanted)


def status(workers: DataFrame, now) -> DataFrame:
    """Counts by status, and the idle seconds of the longest inactive."""
    idle = F.floor(F.unix_timestamp(now) - F.unix_timestamp(F.col("last_activity").cast("timestamp")))
    return workers.groupBy("status").agg(F.count("*").alias("n"), F.max(idle).cast("long").alias("idle_seconds"))


def summary(tasks: DataFrame) -> DataFrame:
    """One row: open, in progress, and done or closed tasks."""
    s = F.col("status")
    return tasks.agg(F.count_if(s == "open").alias("open"), F.count_if(s == "in_progress").alias("in_progress"), F.count_if(s.isin("done", "closed")).alias("done"), F.count("*").alias("total"))


def dependents(tasks: DataFrame) -> DataFrame:
    """(id, waiting): how many tasks are blocked by each, from tasks (id, blocked_by array)."""
    pairs = tasks.select(F.col("id").alias("waits"), F.explode("blocked_by").alias("id"))
    return pairs.groupBy("id").agg(F.countDistinct("waits").alias("waiting"))


def task_size(lines, split_over: int = 500, must_split_over: int = 1000, merge_under: int = 50):
    """What to do with a task of so many lines."""
    return F.when(lines > must_split_over, "must split").when(lines > split_over, "split").when(lines < merge_under, "merge").otherwise("keep")
