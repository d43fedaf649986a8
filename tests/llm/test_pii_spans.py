"""Personal data: base spans against their definition, and what the learned part adds."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from granary.llm import pii_spans as P
from tests.llm.helpers import DOC, words

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOC)


def base_of(found):
    return {r.doc_id: [(P.KINDS[s.kind], s.start, s.end) for s in r.base] for r in found.collect()}


def test_base_spans(spark):
    rng = random.Random(8)
    alphabet = ["a", "Z", "0", "1", "5", "9", "4" * 4, "25", "255", "256", ".", "..", "@", "-", " ", "+", "(", ")", "%", "_", "é", "🙂", "\n", "x@y.z", "+1 ", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "00", "١"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@e.f", "🙂é a@b.co 🙂 +1 (555) 123-4567.", "1.2.3.4.5.6.7.8.9", "0001.002.3.255", "12 -34", "4111-1111-1111-1111-", "+1" + "2" * 30, "1" * 20_000, "a" * 100_000 + "@b" + ".c" * 20_000, "1." * 10_000, "+" * 50_000, "1 " * 50_000, "a@b.cd " * 8000]
    assert base_of(P.spans(docs_of(spark, texts))) == {k: plain(t) for k, t in enumerate(texts)}


def test_query_columns(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = P.query(spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain(docs[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in P.KINDS]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        every = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in every} >= set(base) and len(every) == len(base) + r.n_added
        assert every == sorted(every, key=lambda s: (P.KINDS.index(s[0]), int(s[1])))


@pytest.fixture(scope="module")
def corpus():
    """Texts of words with base spans, relaxed forms of such, and numbers that are none."""
    rng = random.Random(1)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        head = d(15)
        return next(head + str(k) for k in range(10) if plain_luhn(head + str(k)))

    made = {
        "base": lambda: rng.choice([f"{rng.choice(['bob', 'al', 'x'])}{d(rng.randrange(4))}@mail{d(rng.randrange(2))}.{rng.choice(['example.com', 'org'])}", f"+1 ({d(3)}) 555-{d(4)}", ".".join(str(rng.randrange(256)) for _ in range(4)), card()]),
        "relaxed": lambda: rng.choice([f"x{d(2)} (at) host{d(1)}.example.org", f"bob{d(1)} at mail dot org", f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}"]),
        "none": lambda: rng.choice([next(x for x in (d(16) for _ in range(99)) if not plain_luhn(x)), f'token = "{rng.getrandbits(128):032x}"', f"order {d(8)}", d(3), f"20{d(2)}-0{rng.randrange(1, 10)}-1{d(1)}", "300.400.500.600", "look at it. Then go", "was at home.The end", "or at noon. A dot. B"]),
    }
    out = []
    for k in range(1200):
        kind = ("base", "relaxed", "none", "none", "clean")[k % 5] if k % 50 else "base"
        left, right = words(rng, 12), words(rng, 12)
        inner = made[kind]() if kind != "clean" else ""
        out.append((kind, f"{left} {inner} {right}", len(left) + 1, len(left) + 1 + len(inner)))
    return out


def test_relaxed_forms_are_added(spark, corpus):
    clashing = {c: F.lit(3) for c in ("row", "kind", "start", "end", "hits", "fold", "match", "score", "of", "all", "generator")}
    docs = docs_of(spark, [t for _, t, _, _ in corpus]).withColumns(clashing).repartition(4)
    got = {r.doc_id: r for r in P.spans(docs).collect()}
    caught, wanted, wrong = 0, 0, 0
    for k, (kind, text, start, end) in enumerate(corpus):
        assert [(P.KINDS[s.kind], s.start, s.end) for s in got[k].base] == plain(text)
        if kind == "relaxed":
            wanted += 1
            caught += any(s.start <= start and s.end >= end for s in got[k].added)
        else:
            wrong += len(got[k].added)
    assert caught >= 0.9 * wanted and wrong <= 0.01 * len(corpus)


def test_all_patterns_count(spark, corpus, monkeypatch):
    docs = docs_of(spark, [t for _, t, _, _ in corpus])
    base, proposed = P.candidates(P.placed(P.matches(docs)))
    trees, least = P.learned(base, proposed)
    monkeypatch.setattr(P, "PATTERNS", 3)
    many, bars = P.learned(base, proposed)
    score = lambda forest, row: sum(P._leaf(t, row) for t in forest)
    rows = [tuple(r) for r in P._labelled(base, proposed).select(*P.FEATURES).distinct().collect()]
    assert least and len(many) == len(trees) and len(rows) > 3
    assert all(score(many, r) == pytest.approx(score(trees, r), abs=1e-6) for r in rows)
    assert bars == {k: pytest.approx(v, abs=1e-6) for k, v in least.items()}


def test_thresholds_and_trees():
    f = lambda kind, cue: (kind, 10, 0, 0, 0, 1, 1, cue, 0, 4)
    examples = [(f(3, 0), 90.0, 5.0), (f(3, 5), 1.0, 200.0), (f(2, 0), 0.0, 30.0)]
    trees = P.boosted(examples)
    score = lambda r: sum(P._leaf(t, r) for t in trees)
    assert score(f(3, 0)) > 1 > -1 > score(f(3, 5)) and score(f(2, 0)) < 0
    least = P.thresholds(trees, examples)
    assert set(least) == {3} and score(f(3, 5)) < least[3] <= score(f(3, 0)) + 1e-6
    assert P.thresholds(trees, []) == {}


def test_awkward_rows(spark, awkward_docs):
    got = P.spans(awkward_docs)
    assert got.count() == awkward_docs.count() and got.filter("size(base) + size(added) > 0").count() == 0
    assert P.spans(awkward_docs.limit(0)).count() == 0


def test_plan_is_native(spark, data):
    plan = P.query(spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
