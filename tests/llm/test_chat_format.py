"""Chat formatting: folding of events and round trips."""

from pyspark.sql import functions as F

from granary.llm import chat_format


def test_chat_folds_events(spark):
    events = [(1, 1, 8, "open", "user", None), (1, 1, 9, "delta", None, "helo"), (1, 1, 10, "edit", None, "hello"), (1, 1, 11, "delta", None, "!"), (1, 2, 16, "open", "assistant", None),
              (1, 2, 17, "delta", None, "draft"), (1, 2, 18, "regenerate", None, None), (1, 2, 20, "delta", None, "b"), (1, 2, 19, "delta", None, "a"), (2, 1, 9, "delta", None, "no start")]
    got = {(r.conv_id, r.msg): (r.role, r.text) for r in chat_format.fold(spark.createDataFrame(events, "conv_id long, msg long, seq long, kind string, role string, text string")).collect()}
    assert got == {(1, 1): ("user", "hello!"), (1, 2): ("assistant", "ab"), (2, 1): ("", "no start")}


def test_chat_round_trip(spark):
    nasty = ["", None, chat_format.INJECTION, "\\b\\p\\\\", "<|<|im_end|>", "a\n\nb", "<", "|", "<\\|", "é🙂"]
    rows = [(c, t, ("user", "assistant", "system", "a\nb<|", None)[(c + t) % 5], nasty[(c * 3 + t) % len(nasty)]) for c in range(7) for t in range(12)]
    rows += [rows[5], (None, 0, "assistant", "x"), (9, None, "assistant", "<|im_end|>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(1))
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.render(chat_format.fold(chat_format.log_of(turns)))).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        assert [(t.role, t.text) for t in out[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert list(out[conv].loss) == [r[3] or "" for r in own if r[2] == "assistant"]
