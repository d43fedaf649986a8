"""Joins of names, spans and numbers against plain loops, on hot groups and long texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from granary.operators import automaton, chunking, graph, lens, linking, scrub
from granary.operators.numbering import numbered


def test_automaton_finds_what_stands_in_a_text():
    rng = random.Random(1)
    names = list({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(40)}) + ["é🙂", "a.b"]
    machine = automaton.Automaton(names)
    for _ in range(300):
        text = "".join(rng.choice("abc.é🙂") for _ in range(rng.randrange(0, 40)))
        assert machine.within(text) == {n for n in names if n in text}


def test_a_large_registry_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(automaton, "PART", 60_000)
    names = spark.range(100_000).select(F.concat(F.lit("svc-"), F.col("id")).alias("name")).unionByName(spark.createDataFrame([("",), (None,)], "name string"))
    texts = spark.createDataFrame([(1, "x svc-99999 y svc-123" * 3), (2, "word " * 200_000 + "svc-7"), (3, None), (4, "svc")], "id long, t string")
    began = time.time()
    got = {}
    for r in automaton.contained(texts, "id", "t", names).collect():
        got.setdefault(r.id, []).append(r.name)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["svc-1", "svc-12", "svc-123", "svc-9", "svc-99", "svc-999", "svc-9999", "svc-99999"], 2: ["svc-7"]}
    assert time.time() - began < 120


def test_a_host_of_many_signs_is_resolved(spark):
    services = spark.createDataFrame([("billing", 1), ("b" * 5000, 2)], "name string, seq int")
    names = spark.createDataFrame([("a" * 10_000 + "billing" + "c" * 10_000,), ("b" * 4000,)], "name string")
    assert sorted(r.service for r in linking.resolve_services(names, services).collect()) == ["b" * 5000, "billing"]


def test_numbers_in_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if k % 3 else f"g{k % 50}" if k % 7 else None, rng.randrange(50), k) for k in range(4000)]
    made = spark.createDataFrame(rows, "g string, t long, k long").repartition(7)
    out = numbered(made, ["g"], ["t", "k"], "n")
    got = {r.k: r.n for r in out.collect()}
    plain, seen = {}, {}
    for g, _, k in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        plain[k] = seen[g] = seen.get(g, 0) + 1
    assert got == plain and numbered(made.limit(0), ["g"], ["t", "k"], "n").count() == 0


def test_routes_of_a_hot_service_against_each_template(spark):
    rng = random.Random(3)
    piece = lambda: rng.choice(["a", "b", "{id}", "{x}", "{}", "c"])
    routes = {(f"s{k % 2}", "GET", "/" + "/".join(piece() for _ in range(rng.randrange(1, 5)))) for k in range(120)}
    routes = [(s, m, p, f"h{k}", k) for k, (s, m, p) in enumerate(sorted(routes))]
    calls = [(k, f"s{k % 2}", "http", "GET", "/" + "/".join(rng.choice(["a", "b", "c", "z", "", "{}", "0"]) for _ in range(rng.randrange(1, 5)))) for k in range(300)]
    got = {r.call_id: r.handler for r in linking.link(spark.createDataFrame(calls, "call_id long, target_service string, call_type string, method string, url_path string"), spark.createDataFrame(routes, "service string, method string, path string, handler string, seq int")).collect()}

    def normal(path):
        return path.rstrip("/") or "/"

    for k, service, _, _, path in calls:
        parts, best = normal(path).split("/"), None
        for s, _, template, handler, seq in routes:
            own = normal(template).split("/")
            wild = [t.startswith("{") and t.endswith("}") for t in own]
            if s == service and len(own) == len(parts) and all(p != "" if w else p == t for w, t, p in zip(wild, own, parts)):
                best = min(best or (9, 9, 9, ""), (-wild.count(False), -len(own), seq, handler))
        assert got[k] == (best[3] if best else None), path


def test_windows_of_a_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000), (2, "a b c"), (3, " "), (4, None)], "doc_id long, text string")
    began = time.time()
    rows = chunking.windows(docs, 100, 10).collect()
    assert sum(r.doc_id == 1 for r in rows) == 2223 and [r.text for r in rows if r.doc_id == 2] == ["a b c"] and time.time() - began < 60


def test_sections_cut_in_their_rows(spark):
    texts = ["# \nno\n#x\n\r# y\n## B\n\n\n###### c\n####### d", "\n\n# A", "# A\n", " # a\n# b c", "", "x\n# y\n#\tz", None]
    rows = chunking.markdown_sections(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "section").collect()
    got = [(r.doc_id, r.section, r.heading, r.level) for r in rows]
    preamble = lambda k: (k, 0, "(preamble)", 0)
    assert got == [preamble(0), (0, 1, "B", 2), (0, 2, "c", 6), (1, 1, "A", 1), (2, 1, "A", 1), preamble(3), (3, 1, "b c", 1), (4, 0, "", 0), preamble(5), (5, 1, "y", 1), (5, 2, "z", 1)]


def test_index_is_written_in_order(spark, tmp_path):
    rows = [("b", f"d{k:03}", "FRESH", "2024-01-02T03") for k in range(300)] + [("c", "x", None, None)]
    made = lens.index_rows(spark.createDataFrame(rows, "lens string, doc string, status string, generated string").repartition(5), ["a", "b", "c"])
    lens.write_index(made, str(tmp_path / "index"))
    said = lambda n: [line for f in sorted((tmp_path / "index" / f"lens={n}").glob("part-*")) for line in f.read_text().splitlines()]
    assert said("a") == ["(empty)"] and said("c") == ["x"] and said("b") == [f"d{k:03} | FRESH | 2024-01-02" for k in range(300)]


@pytest.mark.parametrize("bucket", [4, 256])
def test_span_evaluation_against_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(scrub, "BUCKET", bucket)
    rng = random.Random(5)

    def spans():
        return [(rng.randrange(4), a, a + rng.choice([0, 1, 3, 9, 40]), rng.choice(["x", "y", None])) for a in (rng.randrange(300) for _ in range(120))]

    p, t = spans(), spans()
    kind = "doc_id long, start long, end long, group string"
    rows = scrub.span_evaluation(spark.createDataFrame([*p, (None, 1, 2, "x")], kind), spark.createDataFrame([*t, t[0]], kind), "group").collect()
    p, t = {s for s in p if s[2] > s[1]}, {s for s in t if s[2] > s[1]}
    touch = lambda a, b: a[0] == b[0] and a[3] == b[3] and a[1] < b[2] and b[1] < a[2]
    for r in rows:
        own = lambda d: [s for s in d if s[3] == r.group]  # noqa: B023, E731
        hit, right = sum(any(touch(s, o) for o in p) for s in own(t)), sum(any(touch(s, o) for o in t) for s in own(p))
        assert (r.hit, r.right, r.truth, r.predicted) == (hit, right, len(own(t)), len(own(p)))
        assert r.f2 == pytest.approx(5 * (right / len(own(p))) * (hit / len(own(t))) / (4 * right / len(own(p)) + hit / len(own(t))))
    assert len(rows) == 3


def test_context_raises_scores(spark):
    docs = spark.createDataFrame([(1, "é MRN 1234567 of a Patient"), (2, "MRN-123456789 " + "x" * 60), (3, "my member id ABC123456789, ABC123456789"), (4, "remembers ABC123456789"), (5, None), (6, "a.corp.b")], "doc_id long, text string")
    got = sorted((r.doc_id, r.entity[:3], r.start, round(r.score, 6)) for r in scrub.in_context(docs).collect())
    assert got == [(1, "MED", 2, 1.0), (2, "MED", 0, 0.7), (3, "HEA", 13, 0.65), (3, "HEA", 27, 0.65), (4, "HEA", 10, 0.3), (6, "INT", 0, 0.8)]


def test_few_rules_are_broadcast(spark):
    """Rule tables of unknown size to Spark: a corpus's texts, or a lens's requests, must not meet in one task."""
    docs = spark.createDataFrame([(1, "xx", "a@b.co"), (2, None, "a@b.co"), (3, "en", "a@b.co")], "doc_id long, lang string, text string")
    gated = scrub.gate(docs, spark.createDataFrame([("en", "clean")], "lang string, tier string"), "lang")
    asked = lens.with_lens(docs.select(F.when(F.col("doc_id") == 1, "flows").otherwise("contracts").alias("lens"), "doc_id"), lens.lens_table(spark).drop("agent"))
    for found in (gated, asked):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert {(r.doc_id, r.tier, r.clean) for r in gated.collect()} == {(1, "sensitive", "[EMAIL]"), (2, "sensitive", "[EMAIL]"), (3, "clean", "a@b.co")}
    assert asked.count() == 3


def test_neighbours_deal_hot_nodes_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 150)
    rng = random.Random(4)
    pairs = [(1, k) for k in range(100, 400)] + [(k, 2) for k in range(100, 400)] + [(k, 3) for k in range(100, 130)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(120)]
    rows = [(a, b, "CM"[(a + b) % 2]) for a, b in pairs] + [(5, None, "C"), (None, 5, "C"), (1, 100, "A")]
    edges = spark.createDataFrame(rows, "src long, dst long, type string")
    starts = spark.createDataFrame([(k,) for k in (1, 2, 3, 7, 100, 999)], "start long")
    steps = {(a, b, t) for a, b, t in rows if None not in (a, b)} | {(b, a, t) for a, b, t in rows if None not in (a, b)}
    expected = {}
    for start in (1, 2, 3, 7, 100, 999):
        seen, front = {start}, {start}
        for hop in (1, 2):
            met = {}
            for a, b, t in steps:
                if a in front and b not in seen:
                    met[b] = min(met.get(b, (a, t)), (a, t))
            expected |= {(start, b): (hop, f"{a}:{t}") for b, (a, t) in met.items()}
            seen, front = seen | set(met), set(met)
    got = [((r.start, r.node), (r.hop, r.via)) for r in graph.neighbours(edges, starts, 2, "both").collect()]
    assert len(got) == len(expected) and dict(got) == expected
    steps = graph.directed(edges, "both").filter("a <> b").distinct()
    front = starts.select("start", F.col("start").alias("node"))
    sizes = graph.sized(front, steps)
    assert {r.node: r.parts for r in sizes.filter("parts > 1").collect()} == {1: 3, 2: 3}
    dealt = graph.taken(front, steps, sizes, 16).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in dealt) < 280 and sum(r["count"] for r in dealt) == sizes.agg(F.sum(F.col("f") * F.col("d"))).first()[0]


def test_neighbours_by_packed_lists(spark, monkeypatch):
    """Pairs of a hop are not shuffled one by one, whatever the numbers of nodes are; hot starts and nodes are whole too."""
    monkeypatch.setattr(graph, "ROWS", 2500)
    monkeypatch.setattr(graph, "LIST", 40, raising=False)
    rng = random.Random(6)
    far = [rng.choice([k, -k * 300, k * 70_000, k * 2**45]) for k in range(1, 500)]
    pairs = [(10**6 + k, 10**7 + rng.randrange(16)) for k in range(60) for _ in range(5)] + [(7, 10**7 + k) for k in range(16)] + [(10**7 + k, n) for k in range(16) for n in rng.sample(far, 170)]
    rows = [(a, b, rng.choice(["C", "M", None])) for a, b in pairs]
    edges = spark.createDataFrame([*rows, *rows[:50], (None, 3, "C"), (3, 3, "C")], "src long, dst long, type string").repartition(5)
    steps = {(a, b, t) for a, b, t in rows}
    least = lambda a, t: (a, t is not None, t or "")
    for starts, hot in (([10**6 + k for k in range(60)] + [7, 999], True), ([10**6 + k for k in range(60)] + [far[0]], False)):
        expected = {}
        for start in starts:
            seen, front = {start}, {start}
            for hop in (1, 2, 3):
                met = {}
                for a, b, t in steps | {(b, a, t) for a, b, t in steps}:
                    if a in front and b not in seen:
                        met[b] = min(met.get(b, least(a, t)), least(a, t))
                expected |= {(start, b): (hop, f"{a}:{t}" if there else f"{a}") for b, (a, there, t) in met.items() if hop < 3 or not hot}
                seen, front = seen | set(met), set(met)
        found = graph.neighbours(edges, spark.createDataFrame([(k,) for k in starts], "start long"), 2 if hot else 3, "both")
        got = [((r.start, r.node), (r.hop, r.via)) for r in found.collect()]
        assert len(got) == len(expected) and dict(got) == expected
    found = graph.neighbours(edges, spark.createDataFrame([(10**6 + k,) for k in range(60)], "start long"), 2, "both")
    assert "hashpartitioning(start#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and not re.search(r"hashpartitioning\(start#\d+L, node#\d+L", plan)
