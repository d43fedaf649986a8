"""The data source of chat exports and the table function of chunks."""

import json

from granary.operators import chunking
from granary.sources import datasource as D


def test_files_are_left_out_by_filters(spark, tmp_path):
    D.register(spark)
    days = {"general/1.json": [{"type": "message", "user": "u", "text": "a", "ts": "1", "thread_ts": "t"}, {"type": "join"}, 3, {"type": "message", "username": "b", "text": None}], "general/2.json": [{"type": "message", "text": "é"}], "other/1.json": [], "other/_SUCCESS": 5}
    for path, items in days.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(json.dumps(items, indent=1))
    (tmp_path / "other/3.json").write_text('[{"type": "message", "user": "x", "text": "l1"}]\n[{"type": "message", "user": "y", "text": "l2"}]\n')
    read = spark.read.format("chat_export").load(str(tmp_path))
    got = sorted(tuple(r) for r in read.collect())
    assert [r[:5] for r in got] == [("general", "1.json", 0, "u", "a"), ("general", "1.json", 3, "b", ""), ("general", "2.json", 0, "unknown", "é"), ("other", "3.json", 0, "x", "l1"), ("other", "3.json", 0, "y", "l2")]
    some = read.filter("channel = 'general' and day in ('1.json', '9.json') and pos > 0")
    assert some.rdd.getNumPartitions() == 1 and [r.speaker for r in some.collect()] == ["b"]
    assert read.filter("channel = 'none'").count() == 0


def test_table_function_cuts_each_partition(spark):
    D.register(spark)
    rows = [(d, p, " ".join(["w"] * (p * d % 5))) for d in range(6) for p in range(d * 3)] + [(9, 0, None), (None, 1, "x")]
    lines = spark.createDataFrame(rows, "doc_id long, pos int, line string").repartition(3)
    lines.createOrReplaceTempView("lines_of_talk")
    got = {tuple(r) for r in spark.sql("SELECT * FROM chunk_messages(TABLE(lines_of_talk) PARTITION BY doc_id ORDER BY (pos), 6)").collect()}
    plain = chunking.thread_chunks(lines.na.fill("", "line").filter("doc_id is not null"), 6).collect()
    assert got == {tuple(r) for r in plain} | {(None, 0, 0, 0, "x")} and len(plain) > 10
