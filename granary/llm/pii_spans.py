r"""Personal data: exact base spans, and further ones that boosted trees accept among candidates.

Generators are regular expressions. Those of the base kinds are the contract's, written so that no text makes them
slow or deep (possessive, and started at the head of a run only), and checked afterwards: octets, digits, Luhn. Relaxed
ones propose spans, which may overlap, with much recall: addresses spelled ``a (at) b dot org``, quads with odd dots or
IPv6, other card groupings, phone numbers without ``+``. Each candidate has features of its format and of the context
around it. Base spans, rewritten in the relaxed forms where they stand, are the positive examples; candidates that break
a rule of their kind, or are part of a longer token, are the negative ones; all others count as negative with a small
weight. Gradient boosting fits trees to the counts of feature patterns, which the whole corpus gives; a held-out quarter
of the texts sets for each kind the score from which on precision is TARGET. Accepted candidates that overlap become one span,
of the kind that scored best; base spans always stay, and what overlaps one is not added.

All of it is DataFrame functions. Texts are read once; what leaves that scan are the matches with 32 characters
before and 16 after them. Null texts are empty: no spans. Texts of any length are read whole. Repeated rows give equal
rows. Other columns are ignored, whatever their names. An empty table gives no rows; with no base span in the corpus
nothing is learned and nothing added.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Of each kind, the contract's pattern without backtracking. A match starts a run, or follows the match before it.
BASE = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT, _DOT = r"\x20?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?", r"\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?"
#: Of each kind, the pattern of candidates; repetitions are bounded.
RELAXED = (
    rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,63}}+){{1,4}}",
    r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|[0-9]{1,3}(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,3}){3})(?![0-9A-Za-z:])",
    r"(?<![0-9A-Za-z])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}(?![0-9])",
    r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}(?![0-9])",
)
#: What a text must hold for a kind's patterns to be tried at all.
_NEEDS = (r"(?i)@|[\x20(\[{]at[\x20)\]}]", r"[0-9]", r"[0-9]", r"[0-9]")
#: Words before a match, by what they speak of.
CUES = (
    ("mail", r"e-?mail|mailto|contact|write to|reach"),
    ("phone", r"phone|tel\b|tel\.|call|fax|mobile|cell|sms|whatsapp"),
    ("card", r"card|visa|master|amex|credit|debit|payment"),
    ("net", r"\bip\b|ipv|host|server|address|ping|dns|gateway"),
    ("count", r"order|invoice|version|isbn|issn|\bid\b|serial|\bno\.|#|\$|€|£|date|token|key"),
)
FEATURES = ("kind", "digits", "luhn", "shape", "lead", "left", "right", "cue", "octets", "last")
#: Trees, their depth, the step of each, and the regulariser of leaves.
TREES, DEPTH, RATE, RIDGE = 16, 3, 0.4, 1.0
#: Feature patterns that are fitted on the driver; of more, the sums of each level of a tree are made by Spark.
PATTERNS = 20_000
#: Weight of an unlabelled candidate as a negative one.
DOUBT = 0.05
#: Calibrated precision that each score from a kind's threshold on has on the held-out texts.
TARGET = 0.9


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    each = lambda i: F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + each(i)) % 10 == 0


def _octets(match: Column) -> Column:
    """Whether all numbers of a dotted quad are at most 255, however many zeros lead."""
    return F.forall(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0)), lambda n: F.regexp_replace(n, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _hits(number: int) -> Column:
    """The array of (generator, place, gap, match, before, after) of a generator, from its matches and what is around them."""
    found, around = F.col(f"_m{number}"), F.col(f"_s{number}")
    beside = F.arrays_zip(found.alias("m"), F.slice(around, F.lit(1), F.size(found)).alias("s"), F.slice(around, F.lit(2), F.size(found)).alias("t"))
    return F.transform(
        beside,
        lambda x, i: F.struct(
            F.lit(number).alias("generator"), i.alias("place"), F.length(x.s).cast("long").alias("gap"), x.m.alias("match"),
            F.right(x.s, F.lit(32)).alias("before"), F.left(x.t, F.lit(16)).alias("after"),
        ),
    )


def matches(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(row, *keep, fold, hits): all generators' matches in each text, and a number of the row's own once it is stored."""
    text = F.col("_text")
    own = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    generators = [*zip((*BASE, *RELAXED), (*_NEEDS, *_NEEDS), strict=True)]
    found = own.withColumns({f"_m{k}": F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, (p, needs) in enumerate(generators)})
    around = found.withColumns({f"_s{k}": F.when(F.size(f"_m{k}") > 0, F.split(text, p, -1)) for k, (p, _) in enumerate(generators)})
    none = "array<struct<generator:int,place:int,gap:bigint,match:string,before:string,after:string>>"
    every = F.concat(*(F.coalesce(_hits(k), F.array().cast(none)) for k in range(len(generators))))
    fold = F.pmod(F.xxhash64("_text"), F.lit(4)).cast("int")
    return around.select(F.monotonically_increasing_id().alias("row"), *keep, fold.alias("fold"), every.alias("hits"))


def placed(found: DataFrame) -> DataFrame:
    """(row, fold, generator, start, end, match, before, after): one row for each match, in code points."""
    each = found.select("row", "fold", F.explode("hits").alias("h")).select("row", "fold", "h.*")
    size = F.length("match").cast("long")
    upto = Window.partitionBy("row", "generator").orderBy("place")
    end = F.sum(F.col("gap") + size).over(upto)
    return each.select("row", "fold", "generator", (end - size).alias("start"), end.alias("end"), "match", "before", "after")


def valid(generator: Column, match: Column) -> Column:
    """Whether a base match passes the check of its kind."""
    digits = _digits(match)
    return (
        F.when(generator == 0, True)
        .when(generator == 1, _octets(match))
        .when(generator == 2, luhn(digits))
        .otherwise(F.length(digits).between(8, 15))
    )


def features(rows: DataFrame) -> DataFrame:
    """rows (kind, match, before, after) with the FEATURES of their format and context, each a small number."""
    digits = _digits(F.col("match"))
    n = F.least(F.length(digits), F.lit(20))
    beside = lambda c: F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^[0-9]$"), 3).when(c.rlike(r"^[\p{L}]$"), 2).otherwise(4)
    cue = F.lit(0)
    for k, (_, words) in reversed([*enumerate(CUES, 1)]):
        cue = F.when(F.lower("before").rlike(words), k).otherwise(cue)
    m = F.col("match")
    at, dot, loose = m.rlike(r"(?i)\x20at\x20"), m.rlike(r"(?i)\x20dot\x20"), m.rlike(r"\x20\.|\.\x20")
    written = F.when(loose, 11).when(m.rlike(r"(?i)[(\[{](?:at|dot)[)\]}]"), 8).when(at & dot, 9).when(at | dot, 10).when(m.rlike(r"\x20@|@\x20"), 7).otherwise(6)
    shape = (
        F.when(F.col("kind") == 0, written)
        .when(m.contains(":"), 5)
        .when(m.rlike(r"[()]"), 4)
        .when(m.rlike(r"\."), 3)
        .when(m.contains("-"), 2)
        .when(m.contains(" "), 1)
        .otherwise(0)
    )
    lead = F.when(m.startswith("+"), 3).when(m.startswith("00"), 2).when(m.startswith("("), 1).otherwise(0)
    last = F.least(F.length(F.regexp_extract("match", "([0-9]*)[^0-9]*$", 1)), F.lit(6))
    return rows.withColumns({
        "digits": n, "luhn": F.when((n >= 13) & (n < 20) & luhn(digits), 1).otherwise(0), "shape": shape, "lead": lead,
        "left": beside(F.right("before", F.lit(1))), "right": beside(F.left("after", F.lit(1))), "cue": cue,
        "octets": F.when((F.col("kind") == 1) & _octets(m), 1).otherwise(0), "last": last,
    })


def _variants(kind: Column, match: Column) -> Column:
    """A base match as it is, and written in relaxed forms."""
    digits = _digits(match)
    dotted = lambda text, at, dot: F.replace(F.replace(text, F.lit("@"), F.lit(at)), F.lit("."), F.lit(dot))
    grouped = lambda sep: F.concat_ws(sep, F.regexp_extract_all(digits, F.lit("[0-9]{1,4}"), F.lit(0)))
    tail = F.right(digits, F.lit(10))
    national = lambda a, b: F.concat(F.substring(tail, 1, 3), F.lit(a), F.substring(tail, 4, 3), F.lit(b), F.substring(tail, 7, 4))
    return (
        F.when(kind == 0, F.array(match, dotted(match, " (at) ", "."), dotted(match, " at ", " dot "), dotted(match, "[at]", "[dot]"), F.replace(match, F.lit("@"), F.lit(" @ "))))
        .when(kind == 1, F.array(match, dotted(match, "", "[.]"), dotted(match, "", " . ")))
        .when(kind == 2, F.array(match, digits, grouped(" "), grouped("-"), grouped(".")))
        .otherwise(F.array(match, F.concat(F.lit("00"), F.regexp_replace(match, r"^\+", "")), F.concat(F.lit("("), national(") ", "-")), national("-", "-"), national(".", "."), national(" ", " ")))
    )


def candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base spans (row, fold, kind, start, end, match, before, after) and candidates that overlap none of them, with
    features, from placed matches. Overlap is told by the farthest end before a start and the nearest start after it."""
    kind = F.pmod("generator", F.lit(4)).cast("int")
    own = rows.filter((F.col("generator") >= 4) | valid(F.col("generator"), F.col("match"))).withColumn("kind", kind)
    base = F.col("generator") < 4
    order = Window.partitionBy("row").orderBy("start", "end", "generator")
    peers = own.withColumns({
        "reached": F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "next": F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)),
    })
    apart = ~base & (F.coalesce(F.col("reached") <= F.col("start"), F.lit(True))) & (F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    return own.filter(base).drop("generator"), features(peers.filter(apart).drop("generator", "reached", "next"))


def _labelled(base: DataFrame, proposed: DataFrame) -> DataFrame:
    """(*FEATURES, fold, label) of examples: 1 for base spans and their variants, 0 for broken candidates, null for others."""
    texts = base.withColumn("match", F.explode(_variants(F.col("kind"), F.col("match"))))
    broken = (
        F.col("left").isin(2, 3) | F.col("right").isin(2, 3)
        | ((F.col("kind") == 1) & (F.col("shape") != 5) & (F.col("octets") == 0))
        | ((F.col("kind") == 2) & (F.col("luhn") == 0))
        | ((F.col("kind") == 3) & (F.col("cue") == 5))
        | ((F.col("kind") == 3) & F.col("match").rlike(r"^(?:1[89]|20)[0-9]{2}[-./\x20][0-9]{2}[-./\x20][0-9]{2}"))
    )
    names = [*FEATURES, "fold"]
    return features(texts).select(*names, F.lit(1).alias("label")).unionByName(proposed.select(*names, F.when(broken, 0).alias("label")))


def _split(sums: list[dict[int, Sequence[float]]], g: float, h: float):
    """(feature, greatest value that goes left, its sums) of the split that gains most, from each feature's sums by value;
    None if none gains."""
    best = (1e-6, None)
    for f, of in enumerate(sums):
        gl = hl = 0.0
        for value in sorted(of)[:-1]:
            gl, hl = gl + of[value][0], hl + of[value][1]
            gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
            if gain > best[0]:
                best = (gain, (f, value, gl, hl))
    return best[1]


def _tree(rows: list, grads: list[float], hess: list[float], members: list[int], depth: int):
    """A leaf's value, or (feature, greatest value that goes left, left, right), by the gain of its best split."""
    g, h = sum(grads[i] for i in members), sum(hess[i] for i in members)
    found: list[dict[int, list[float]]] = [defaultdict(lambda: [0.0, 0.0]) for _ in range(len(FEATURES) if depth else 0)]
    for f, sums in enumerate(found):
        for i in members:
            s = sums[rows[i][f]]
            s[0] += grads[i]
            s[1] += hess[i]
    best = _split(found, g, h)
    if best is None:
        return -RATE * g / (h + RIDGE)
    f, value, _, _ = best
    sides = [i for i in members if rows[i][f] <= value], [i for i in members if rows[i][f] > value]
    return f, value, *(_tree(rows, grads, hess, side, depth - 1) for side in sides)


def _leaf(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def boosted(examples: list[tuple[tuple[int, ...], float, float]]) -> list:
    """Trees fitted to (features, weight of positives, weight of negatives) by the logistic loss."""
    rows = [e[0] for e in examples]
    total = [p + n for _, p, n in examples]
    scores, trees = [0.0] * len(rows), []
    for _ in range(TREES):
        chance = [1 / (1 + math.exp(-s)) for s in scores]
        grads = [c * t - p for c, t, (_, p, _) in zip(chance, total, examples, strict=True)]
        hess = [c * (1 - c) * t for c, t in zip(chance, total, strict=True)]
        tree = _tree(rows, grads, hess, [*range(len(rows))], DEPTH)
        scores = [s + _leaf(tree, r) for s, r in zip(scores, rows, strict=True)]
        trees.append(tree)
    return trees


def thresholds(trees: list, held: list[tuple[tuple[int, ...], float, float]]) -> dict[int, float]:
    """For each kind the least score whose calibrated precision is TARGET; a kind without such has none.

    Calibration is isotonic over the held-out examples: neighbouring scores are pooled as long as a lower one has the
    higher precision.
    """
    out = {}
    for kind in range(len(KINDS)):
        levels: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for row, p, n in held:
            if row[0] == kind:
                level = levels[round(sum(_leaf(t, row) for t in trees), 9)]
                level[0] += p
                level[1] += n
        pools: list[tuple[float, float, float]] = []  # positives, negatives, least score
        for score in sorted(levels, reverse=True):
            p, n = levels[score]
            while pools and pools[-1][0] * (p + n) < p * (pools[-1][0] + pools[-1][1]):
                p, n = p + pools[-1][0], n + pools[-1][1]
                pools.pop()
            pools.append((p, n, score))
        for p, n, score in pools:
            if p < TARGET * (p + n):
                break
            out[kind] = score
    return out


def _score(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, value, left, right = tree
    return F.when(F.col(FEATURES[f]) <= value, _score(left)).otherwise(_score(right))


def _grown(counts: DataFrame, trees: list):
    """The next tree over all patterns (*FEATURES, p, n): Spark sums a level's nodes by feature and value, which are few
    whatever the number of patterns, and the driver splits them. Sums are decimals, so their order changes nothing."""
    total, chance = F.col("p") + F.col("n"), 1 / (1 + F.exp(-sum((_score(t) for t in trees), F.lit(0.0))))
    exact = lambda c: c.cast("decimal(28,12)")
    rows = counts.filter("p + n > 0").select(*FEATURES, exact(chance * total - F.col("p")).alias("g"), exact(chance * (1 - chance) * total).alias("h"))
    shape, leaves, open_nodes = 0, {}, {0}  # a tree whose leaves are numbers of nodes
    for _ in range(DEPTH):
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f).cast("int").alias("v")) for k, f in enumerate(FEATURES))))
        placed = rows.select(_score(shape).alias("node"), "g", "h", each.alias("x")).filter(F.col("node").isin(*open_nodes))
        sums = {node: [{} for _ in FEATURES] for node in open_nodes}
        for r in placed.groupBy("node", "x.f", "x.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums[r.node][r.f][r.v] = float(r.g), float(r.h)
        splits = {}
        for node in open_nodes:
            g, h = leaves.get(node) or [sum(x[k] for x in sums[node][0].values()) for k in (0, 1)]
            leaves[node] = g, h
            if best := _split(sums[node], g, h):
                f, value, gl, hl = best
                left = max(leaves) + 1
                splits[node] = f, value, left, left + 1
                leaves[left], leaves[left + 1] = (gl, hl), (g - gl, h - hl)
        shape = _replaced(shape, splits)
        open_nodes = {x for split in splits.values() for x in split[2:]}
        if not open_nodes:
            break
    return _replaced(shape, {node: -RATE * g / (h + RIDGE) for node, (g, h) in leaves.items()})


def _replaced(tree, by: dict):
    """A tree with its leaves replaced, as far as they are in by."""
    if not isinstance(tree, tuple):
        return by.get(tree, tree)
    return *tree[:2], _replaced(tree[2], by), _replaced(tree[3], by)


def _least(counts: DataFrame, trees: list) -> dict[int, float]:
    """thresholds() over all held-out patterns (*FEATURES, hp, hn): scores come one by one, the highest first. The pools that
    keep TARGET end where what the precision exceeds it by, summed up so far, is last at its greatest."""
    score = F.round(sum((_score(t) for t in trees), F.lit(0.0)), 9)
    levels = counts.filter("hp + hn > 0").groupBy("kind", score.alias("score")).agg(F.sum("hp").alias("p"), F.sum("hn").alias("n"))
    out: dict[int, float] = {}
    kind, over, most = None, 0.0, 0.0
    for r in levels.orderBy("kind", F.desc("score")).toLocalIterator():
        if r.kind != kind:
            kind, over, most = r.kind, 0.0, 0.0
        over += r.p - TARGET * (r.p + r.n)
        if over >= most - 1e-9:
            most, out[kind] = max(over, most), r.score
    return out


def learned(base: DataFrame, proposed: DataFrame) -> tuple[list, dict[int, float]]:
    """Trees and thresholds from the counts of feature patterns over all texts: on the driver if there are PATTERNS of them
    at most, else by sums that Spark makes. All patterns count either way."""
    label = F.col("label")
    weight = lambda fold: [F.sum(F.when(fold & (label == 1), 1.0).otherwise(0.0)), F.sum(F.when(fold & (label == 0), 1.0).when(fold & label.isNull(), DOUBT).otherwise(0.0))]
    held, rest = weight(F.col("fold") == 0), weight(F.col("fold") != 0)
    counts = _labelled(base, proposed).groupBy(*FEATURES).agg(*(c.alias(n) for c, n in zip((*rest, *held), ("p", "n", "hp", "hn"), strict=True)))
    counts = stored(counts, "pii-patterns")
    found = counts.orderBy(F.desc(F.expr("p + n + hp + hn")), *FEATURES).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        trees: list = []
        if counts.filter("p > 0").isEmpty():
            return trees, {}
        for _ in range(TREES):
            trees.append(_grown(counts, trees))
        return trees, _least(counts, trees)
    fit = [(tuple(r[f] for f in FEATURES), r.p, r.n) for r in found if r.p + r.n]
    calibrate = [(tuple(r[f] for f in FEATURES), r.hp, r.hn) for r in found if r.hp + r.hn]
    if not any(p for _, p, _ in fit):
        return [], {}
    trees = boosted(fit)
    return trees, thresholds(trees, calibrate)


def accepted(proposed: DataFrame, trees: list, least: dict[int, float]) -> DataFrame:
    """(row, kind, start, end, score): candidates over their kind's threshold; those that overlap become one span."""
    score = sum((_score(t) for t in trees), F.lit(0.0))
    bar = F.lit(None).cast("double")
    for kind, value in least.items():
        bar = F.when(F.col("kind") == kind, value).otherwise(bar)
    passed = proposed.select("row", "kind", "start", "end", score.alias("score"), (score >= bar - 1e-9).alias("good")).filter("good")
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = passed.withColumn("fresh", F.coalesce((reached <= F.col("start")).cast("int"), F.lit(1)))
    groups = fresh.withColumn("group", F.sum("fresh").over(order))
    best = F.max(F.struct("score", (-F.col("kind")).alias("least")))
    found = groups.groupBy("row", "group").agg(best.alias("best"), F.min("start").alias("start"), F.max("end").alias("end"))
    return found.select("row", (-F.col("best.least")).alias("kind"), "start", "end", F.col("best.score").alias("score"))


def spans(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(*keep, base, added): arrays of (kind, start, end, score) in order of kind and start; a base span has no score."""
    found = stored(matches(docs, keep), "pii-matches")
    base, proposed = candidates(placed(found))
    proposed = stored(proposed, "pii-candidates")
    trees, least = learned(base, proposed)
    none = F.lit(None).cast("double")
    rows = base.select("row", "kind", "start", "end", none.alias("score"))
    if least:
        rows = rows.unionByName(accepted(proposed, trees, least))
    span = F.struct("kind", "start", "end", "score")
    lists = rows.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all")).withColumnRenamed("row", "of")
    some = lambda test: F.coalesce(F.filter("all", test), F.array().cast("array<struct<kind:int,start:bigint,end:bigint,score:double>>"))
    met = found.select("row", *keep).join(lists, F.col("row") == F.col("of"), "left")
    return met.select(*keep, some(lambda s: s.score.isNull()).alias("base"), some(lambda s: s.score.isNotNull()).alias("added"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # noqa: B023
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
