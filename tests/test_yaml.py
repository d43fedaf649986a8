"""YAML: values of documents, and errors for what is none."""

import pytest

from granary.sources import yaml

SERVICE = """
kind: Service
metadata:
  name: "a b"   # comment
  labels: {app: web, "x": 'y''s', n: [1, 2.5, {q: ~}]}
spec:
  ports:
  - port: 80
    targetPort: 8080
  - {port: 443, name: https}
  sel:
    - - 1
      - 2
    -
      k: v
      z:
        - q
  text: |
    line one
      two # no comment

    three
  fold: >-
    a
    b

    c
  url: http://x:80/a#b
  empty:
  t: true
  s: 'a: b'
  multi: some
    more words
  list2:
  - a
  - b: 1
    c: 2
last: -5
"""


def test_nested_listed_and_block_forms():
    assert yaml.document(SERVICE) == {
        "kind": "Service",
        "metadata": {"name": "a b", "labels": {"app": "web", "x": "y's", "n": [1, 2.5, {"q": None}]}},
        "spec": {
            "ports": [{"port": 80, "targetPort": 8080}, {"port": 443, "name": "https"}], "sel": [[1, 2], {"k": "v", "z": ["q"]}],
            "text": "line one\n  two # no comment\n\nthree\n", "fold": "a b\nc", "url": "http://x:80/a#b", "empty": None, "t": True, "s": "a: b",
            "multi": "some more words", "list2": ["a", {"b": 1, "c": 2}],
        },
        "last": -5,
    }


@pytest.mark.parametrize(
    "text,value",
    [
        ("- 1\n- a: 2\n  b:\n    - x\n- [a,\n   b]\n", [1, {"a": 2, "b": ["x"]}, ["a", "b"]]), ("plain", "plain"), ("{a: 1, b: [x, 'y']}", {"a": 1, "b": ["x", "y"]}), ("", None), ("# only\n", None),
        ('k: "a\\"b # x\\n\\u00e9"', {"k": 'a"b # x\né'}), ("a:\n- b\nc: d\n", {"a": ["b"], "c": "d"}), ("a: 'x'\n# c\n\nb:   2", {"a": "x", "b": 2}), ("b: 007\n-x: 1\n", {"b": "007", "-x": 1}),
    ],
)
def test_values(text, value):
    assert yaml.document(text) == value


@pytest.mark.parametrize("text", ["a: b: c", "  a: 1\n b: 2", "x:\n\ty: 1", "a: [1, 2", "a: 1\n  b: 2", "- a\nb: 1", "a: {b: ]}"])
def test_errors(text):
    with pytest.raises(ValueError):
        yaml.document(text)


def test_documents_and_errors_in_files(spark):
    files = [("a", "---\nkind: X\n---\n...\n--- # c\nbad: [\n"), ("b", None), ("c", ""), ("d", "kind: [1]\n"), ("e", "kind: Pod\r\nspec:\r\n  note: '\"port\": 5'\r\n  port: 70\r\n"), ("f", "a:\n" + "".join("  " * k + "b:\n" for k in range(1, 3000)))]
    made = spark.createDataFrame(files, "path string, content string")
    got = {(r.path, r.ordinal): (r.json is not None, r.error is not None) for r in yaml.documents(made).collect()}
    assert got[("a", 1)] == (True, False) and got[("a", 3)] == (False, True) and ("b", 0) not in got and ("c", 0) not in got and ("f", 0) in got
    assert {(r.path, r.kind, tuple(r.ports)) for r in yaml.resources(made).collect()} == {("a", "X", ()), ("d", "[1]", ()), ("e", "Pod", (70,))}


def test_signals_parse_each_file_once_in_many_tasks(spark, data, monkeypatch):
    from granary.plans import streams

    monkeypatch.setattr(streams, "PARSED", 100)
    df = streams.yaml_signals(spark, data)
    orders = spark.read.parquet(f"{data}/orders.parquet").count()
    assert "MapInArrow" not in df._jdf.queryExecution().toString() and df.select("path").distinct().count() == orders
    assert streams.dealt(spark.range(1000), 100).rdd.getNumPartitions() == 10
