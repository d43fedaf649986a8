"""Details of symbols: first references of each, however many there are."""

from granary.operators import lens as L


def test_first_references_each_once_in_tasks_that_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(L, "REFERENCES", 500)
    symbols = spark.createDataFrame([("a", "f", 1, 0), ("a", "g", 2, 0), ("b", "f", 1, 0), ("b", None, 3, 0)], "path string, name string, line int, column int")
    hovers = spark.createDataFrame([("a", 1, 0, "f()"), ("b", 1, 0, "f(x)")], "path string, line int, column int, signature string")
    hot = [("a", "f", f"r{k:05}") for k in range(3000)]
    refs = spark.createDataFrame([*hot[::-1], *[("b", "f", f"r{k % 7}") for k in range(100)], *[("a", "f", "r00001")] * 50, ("b", None, "r1")], "path string, name string, ref string")
    got = L.with_details(symbols, hovers, refs)
    assert got.columns == ["path", "name", "line", "column", "signature", "references"]
    assert {(r.path, r.name): (r.signature, r.references) for r in got.collect()} == {
        ("a", "f"): ("f()", [f"r{k:05}" for k in range(20)]),
        ("a", "g"): (None, None),
        ("b", "f"): ("f(x)", [f"r{k}" for k in range(7)]),
        ("b", None): (None, None),
    }
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("7), REPARTITION_BY_NUM") >= 2  # of 3,151 references
    own = L.with_details(symbols.withColumn("id", L.F.concat("path", L.F.coalesce("name", L.F.lit("")))), hovers, refs.select(L.F.concat("path", "name").alias("id"), "ref"), 2, ["id"])
    assert {r.id: r.references for r in own.collect()} == {"af": ["r00000", "r00001"], "ag": None, "bf": ["r0", "r1"], "b": None}
