"""Streams in several runs: timers, state, and batches that are repeated."""

import glob
import os

import duckdb
from pyspark.sql import functions as F

from granary.plans import streams as S
from granary.streaming import jobs as J

REQUESTS = "pool string, seq long, at long, tool string, worker string, task string"


def run(spark, folder, parts, timeout=100, late="0 seconds"):
    lives = lambda stream: J.watched_lives(stream, timeout, late)
    with J.rocks(spark):
        return [J.replayed(spark.createDataFrame(p, REQUESTS), "seq", 1, folder, lives) for p in parts]


def lives(spark, folder):
    rows = J.latest(spark, folder, S.StructType.fromDDL(J.LIVES), ["pool", "task"]).filter("pool <> ''").collect()
    return {(r.pool, r.task): (r.submitted, r.failed, r.state, r.worker, r.since) for r in rows}


def test_timers_of_each_task(spark, tmp_path):
    folder = "file://" + str(tmp_path)
    first = [("p", 1, 1000, "submit", None, "a"), ("p", 2, 1010, "start", "w1", "a"), ("p", 3, 1010, "start", "w2", "b"), ("q", 4, 1010, "start", "w3", "a"), ("p", 5, 1020, "poll", "w9", "a")]
    second = [("p", 6, 1100, "done", "w2", "b"), ("q", 7, 1105, "start", "w4", "a"), ("p", 8, 1109, "submit", None, "c")]
    assert all(sum(n) for n in run(spark, folder, [first, second]))
    assert lives(spark, folder) == {("p", "a"): (1, 0, "executing", "w1", 1010), ("p", "b"): (0, 0, "done", "w2", 1100), ("q", "a"): (0, 0, "executing", "w4", 1105), ("p", "c"): (1, 0, "queued", None, 1109)}
    run(spark, folder, [[("", 9, 1111, "clock", None, "")]])
    assert lives(spark, folder)["p", "a"] == (1, 0, "queued", None, 1010) and lives(spark, folder)["q", "a"][2] == "executing"
    run(spark, folder, [[("p", 10, 1300, "failed", "w1", "a"), ("p", 11, 1300, "failed", "w1", "a")], [("", 12, 1400, "clock", None, "")]])
    assert lives(spark, folder) == {("p", "a"): (1, 2, "queued", "w1", 1300), ("p", "b"): (0, 0, "done", "w2", 1100), ("q", "a"): (0, 0, "queued", None, 1105), ("p", "c"): (1, 0, "queued", None, 1109)}
    snapshot = {(r.pool, r.task): (r.submitted, r.failed, r.state, r.worker, r.since) for r in J.life_snapshot(spark, folder).filter("pool <> ''").collect()}
    assert snapshot == lives(spark, folder)


def test_increments_read_new_files_only_and_repeat_safely(spark, tmp_path):
    folder = "file://" + str(tmp_path)
    kind = "source long, text string"
    read = [J.replayed(spark.createDataFrame(rows, kind), "source", 1, folder, J.ingested) for rows in ([(1, "a"), (2, "b"), (3, None)], [(2, "c"), (4, "d")])]
    assert [sum(r) for r in read] == [3, 2]
    stream = J.ingested(spark.readStream.schema(kind).parquet(f"{folder}/incoming"))
    assert sum(J.run_upserts(stream, folder)) == 0
    now = lambda: {r.source: (r.n_chars, r.batch) for r in J.latest(spark, folder, stream.schema, ["source"]).collect()}
    before = now()
    assert before == {1: (1, 0), 2: (1, 1), 3: (0, 0), 4: (1, 1)}
    for path in glob.glob(str(tmp_path / "progress/commits/*1*")) + glob.glob(str(tmp_path / "progress/commits/.1*")):
        os.remove(path)  # as if the driver had been lost before the batch was done
    assert sum(J.run_upserts(stream, folder)) == 2 and now() == before


def test_windows_keep_no_old_state(spark, tmp_path):
    folder = "file://" + str(tmp_path)
    rows = lambda hours: spark.createDataFrame([(h, "a", 1.0) for h in hours], "h long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    for hours in ([0, 0, 1], [9, 9], [20], [21]):
        J.replayed(rows(hours), "h", 1, folder, J.hourly)
    state = spark.read.format("statestore").load(f"{folder}/progress").count()
    table = J.latest(spark, folder, J.hourly(rows([0])).schema, ["start", "event_type"]).collect()
    assert sorted(r.n for r in table) == [1, 1, 1, 2, 2] and state < 5


def test_snapshot_without_timers_is_read_from_built_in_state(spark, tmp_path, monkeypatch):
    folder = "file://" + str(tmp_path)
    parts = [[("p", 1, 10, "submit", "w1", "a"), ("p", 2, 11, "start", "w2", "a"), ("q", 3, 12, "failed", "w3", "a"), ("p", 4, 13, "poll", "w9", "b")], [("q", 5, 14, "done", None, "a"), ("q", 6, 15, "submit", "w4", None)]]
    with J.rocks(spark):
        for part in parts:
            J.replayed(spark.createDataFrame(part, REQUESTS), "seq", 1, folder, J.task_lives)
    got = {(r.pool, r.task): tuple(r)[2:] for r in J.aggregate_snapshot(spark, folder).collect()}
    assert got == {("p", "a"): (1, 0, "executing", "w2", 11), ("q", "a"): (0, 1, "done", None, 14), ("q", None): (1, 0, "queued", "w4", 15)}
    monkeypatch.setattr(J, "TaskLife", None)  # no state in Python
    rows = spark.createDataFrame([(k, f"2024-01-01 00:00:{k:02}", k % 5, "click", 1.0, None) for k in range(30)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{folder}/sf/events.parquet")
    assert S.task_state_snapshot(spark, f"{folder}/sf").count() == 5


def test_timeouts_without_timers_count_late_requests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "TaskLife", None)  # no state in Python
    day = lambda k: f"2024-01-{1 + k % 10:02} 00:00:00"  # noqa: E731  # days begin anew: most requests of the later parts are late
    rows = spark.createDataFrame([(k, day(k // 7), k % 11 + 11 * (k // 35), "click" if k % 2 else "view", 1.0, None) for k in range(210)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/sf/events.parquet")
    got = sorted(tuple(r[c] for c in ("pool", "state", "n", "with_worker")) for r in S.task_timeouts(spark, f"file://{tmp_path}/sf").collect())
    sql = S.QUERIES["task_timeouts"][1].replace("FROM events", f"FROM '{tmp_path}/sf/events.parquet/*.parquet'")
    names = "pool, state, n, with_worker"
    assert got == sorted(duckdb.sql(f"SELECT {names} FROM ({sql})").fetchall()) and sum(n > w for _, _, n, w in got)


def test_overdue_tasks_by_the_streams_own_time(spark, tmp_path):
    folder = "file://" + str(tmp_path)
    first = [("p", 1, 1000, "submit", None, "a"), ("p", 2, 1010, "start", "w1", "a"), ("p", 3, 1010, "start", "w2", "b"), ("p", 4, 1120, "poll", "w9", "a")]
    second = [("p", 5, 1115, "done", "w2", "b"), ("p", 6, 900, "failed", "w3", "c"), ("p", 7, 1000, "start", "w4", "d")]
    seen = []
    with J.rocks(spark):
        for part in (first, second, [("p", 8, 1116, "submit", None, "c")]):
            J.replayed(spark.createDataFrame(part, REQUESTS), "seq", 1, folder, J.timed_lives)
            seen.append({r.task: (r.state, r.worker, r.since) for r in J.overdue(spark, folder, 100, 5).collect()})
    assert seen[0] == {"a": ("executing", "w1", 1010), "b": ("executing", "w2", 1010)}
    assert seen[1] == {"a": ("executing", "w1", 1010), "b": ("done", "w2", 1115), "c": ("queued", "w3", 900), "d": ("queued", None, 1000)}
    assert seen[2] == {"a": ("queued", None, 1010), "b": ("done", "w2", 1115), "c": ("queued", None, 1116), "d": ("queued", None, 1000)}
