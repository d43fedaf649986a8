"""Personal data and secrets: detection by patterns, replacement, audit spans, reports."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.batches import flat_map

#: (entity, pattern, replacement, score). Patterns mean the same in Java, RE2 and Python. Longer kinds come first.
ENTITIES: tuple[tuple[str, str, str, float], ...] = (
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]", 1.0),
    ("PHONE_NUMBER", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[PHONE]", 0.8),
    ("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "XXX-XX-XXXX", 0.85),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "XXXX-XXXX-XXXX-XXXX", 0.7),
    ("CREDIT_CARD", r"\b[0-9]{13,16}\b", "XXXX-XXXX-XXXX-XXXX", 0.6),
    ("IP_ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "XXX.XXX.XXX.XXX", 0.6),
    ("CRYPTO", r"\b(?:bc1|[13])[A-HJ-NP-Za-km-z1-9]{25,39}\b", "XXXX...XXXX", 0.5),
    ("US_PASSPORT", r"\b[A-Z][0-9]{8}\b", "XXXXXXXXX", 0.4),
    ("US_DRIVER_LICENSE", r"\b[A-Z][0-9]{7}\b", "DL-XXXXXXXX", 0.3),
    ("US_BANK_NUMBER", r"\b[0-9]{8,12}\b", "XXXX-XXXX", 0.2),
)

#: Entities of hospitals and company networks, beside ENTITIES where wanted.
CUSTOM: tuple[tuple[str, str, str, float], ...] = (
    ("HEALTH_PLAN_ID", r"\b[A-Z]{3}[0-9]{9,12}\b", "[HEALTH_PLAN]", 0.3),
    ("INTERNAL_HOSTNAME", r"\b[A-Za-z0-9_-]+\.(?:internal|corp)\.[A-Za-z0-9_.-]+\b", "[HOST]", 0.8),
)

#: Numbers of records and plans: (entity, pattern, score, words that raise it when they stand near).
CONTEXTS: tuple[tuple[str, str, float, tuple[str, ...]], ...] = (
    ("MEDICAL_RECORD_NUMBER", r"\bMRN[-:]?\s?[0-9]{6,10}\b", 0.7, ("medical", "record", "patient", "chart", "mrn")),
    ("HEALTH_PLAN_ID", r"\b[A-Z]{3}[0-9]{9,12}\b", 0.3, ("insurance", "plan", "beneficiary", "member", "policy")),
    ("INTERNAL_HOSTNAME", r"\b[A-Za-z0-9_-]+\.(?:internal|corp)\.[A-Za-z0-9_.-]+\b", 0.8, ()),
)
#: What any of ENTITIES has.
SIGNS = "[0-9@]"

SECRETS: tuple[tuple[str, str], ...] = (
    ("AWS_KEY", r"\bAKIA[0-9A-Z]{16}\b"),
    ("SK_KEY", r"\bsk-[A-Za-z0-9]{20,}"),
    ("GITHUB_TOKEN", r"\bgh[po]_[A-Za-z0-9]{36}"),
    ("CONNECTION", r"[a-z]+://[^:/ ]+:[^@ ]+@[^ ]+"),
    ("PRIVATE_KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("BEARER", r"[Bb]earer [A-Za-z0-9._-]{20,}"),
    ("JWT", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("PRIVATE_NET", r"\b(?:10\.[0-9]{1,3}|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("ASSIGNED", r"(?:token|key|secret|password) = \"[^\"]+\""),
)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def entity_rows(docs: DataFrame, entities: Sequence = ENTITIES, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *keep, entity, value, score) for each match of each pattern, in built-in functions. Of ENTITIES each has a
    digit or an @, so texts without either are not searched."""
    rows = docs.filter(F.col("text").rlike(SIGNS)) if entities is ENTITIES else docs
    each = F.array(*(F.struct(F.lit(n).alias("entity"), found(F.col("text"), p).alias("values"), F.lit(s).alias("score")) for n, p, _, s in entities))
    return rows.select("doc_id", *keep, F.explode(each).alias("e")).select("doc_id", *keep, "e.entity", F.explode("e.values").alias("value"), "e.score")


#: Signs before and after a match in which context words are looked for, what they add to its score, and what it is then
#: at least.
AROUND, RAISE, RAISED = 40, 0.35, 0.4


def in_context(docs: DataFrame, recognizers: Sequence = CONTEXTS, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *keep, entity, value, start, score) for each match of each recogniser (entity, pattern, score, words): a
    word within AROUND characters raises its score. start counts characters from 0."""
    out = []
    for entity, pattern, score, words in recognizers:
        own = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("__t")).withColumn("__m", F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))).filter(F.size("__m") > 0)
        gaps = own.withColumn("__g", F.split("__t", pattern, -1))
        hits = F.arrays_zip(F.col("__m").alias("m"), F.slice("__g", F.lit(1), F.size("__m")).alias("g"), F.slice("__g", F.lit(2), F.size("__m")).alias("h"))
        rows = gaps.withColumn("__k", F.monotonically_increasing_id()).select("doc_id", *keep, "__k", F.posexplode(hits).alias("__n", "x"))
        order = Window.partitionBy("__k").orderBy("__n")
        end = F.sum(F.length("x.g") + F.length("x.m")).over(order)
        beside = lambda part, lo, hi: F.array_join(F.collect_list(part).over(order.rowsBetween(lo, hi)), "")
        before = F.concat(beside(F.right(F.concat("x.g", "x.m"), F.lit(AROUND)), -AROUND, -1), "x.g")
        after = F.concat(F.col("x.h"), beside(F.left(F.concat("x.m", "x.h"), F.lit(AROUND)), 1, AROUND))
        near = F.concat(F.right(before, F.lit(AROUND)), F.lit(" "), F.left(after, F.lit(AROUND))).rlike(rf"(?i)\b(?:{'|'.join(words)})\b") if words else F.lit(False)
        raised = F.least(F.lit(1.0), F.greatest(F.lit(score) + RAISE, F.lit(RAISED)))
        out.append(rows.select("doc_id", *keep, F.lit(entity).alias("entity"), F.col("x.m").alias("value"), (end - F.length("x.m")).cast("long").alias("start"), F.when(near, raised).otherwise(F.lit(score)).alias("score")))
    return functools.reduce(DataFrame.unionByName, out)


def scrub_constants(text: Column, entities: Sequence = ENTITIES) -> Column:
    """Each entity replaced by its label, kinds in the table's order."""
    for _, pattern, label, _ in entities:
        text = F.regexp_replace(text, pattern, label.replace("$", r"\$"))
    return text


def pseudonym(entity: Column, value: Column, salt: str) -> Column:
    """One and the same made-up value for each entity and value, whatever the order of rows: a keyed hash."""
    return F.concat(F.lower(entity), F.lit("-"), F.substring(F.sha2(F.concat(F.lit(salt), entity, F.lit(":"), F.lower(F.trim(value))), 256), 1, 16))


Detector = Callable[[str], Sequence[tuple[int, int, str]]]


def detections(text: str, entities: Sequence = ENTITIES, model: Detector | None = None) -> list[tuple[int, int, str]]:
    """Spans (start, end, entity) that do not overlap: the longest first, then the earliest, then by the table.

    model: finds further spans, such as names; they come last where all else is equal.
    """
    names = [n for n, _, _, _ in entities]
    spans = [(m.start(), m.end(), k) for k, (_, p, _, _) in enumerate(entities) for m in re.finditer(p, text, re.ASCII)]
    for a, b, name in model(text) if model else ():
        names.append(name)
        spans.append((a, b, len(names) - 1))
    starts: list[int] = []
    taken: list[tuple[int, int, int]] = []  # ordered by start, and so by end
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        at = bisect.bisect_left(starts, s[0])
        if s[0] < s[1] and (at == 0 or taken[at - 1][1] <= s[0]) and (at == len(taken) or s[1] <= taken[at][0]):
            starts.insert(at, s[0])
            taken.insert(at, s)
    return [(a, b, names[k]) for a, b, k in taken]


def scrub(docs: DataFrame, entities: Sequence = ENTITIES, load: Callable[[], Detector] | None = None) -> DataFrame:
    """(doc_id, clean, log, error): texts with labels, and an audit entry for each replacement; offsets are characters of
    the original text, in ascending order. A null text stays null, with an empty log.

    load runs once in each Python worker and gives a model that finds further entities; their label is [entity]. A text
    on which it fails has an error and no clean text, and the other rows go on.
    """
    labels = {n: label for n, _, label, _ in entities}

    def each() -> Callable[[int, str | None], Iterator[tuple]]:
        model = load() if load else None

        def scrubbed(doc_id: int, text: str | None) -> Iterator[tuple]:
            try:
                spans, error = detections(text, entities, model) if text is not None else [], None
            except Exception as e:  # whatever a model raises belongs to its row
                spans, error = [], f"{type(e).__name__}: {e}"
            parts, at = [], 0
            for a, b, n in spans:
                parts += [text[at:a], labels.get(n, f"[{n}]")]
                at = b
            clean = "".join([*parts, text[at:]]) if text is not None and not error else None
            yield doc_id, clean, [{"entity": n, "start": a, "end": b, "replacement": labels.get(n, f"[{n}]")} for a, b, n in spans], error

        return scrubbed

    log = "array<struct<entity: string, start: int, end: int, replacement: string>>"
    return flat_map(docs.select(F.col("doc_id").cast("long"), "text"), each, f"doc_id long, clean string, log {log}, error string", load=True)


def gate(docs: DataFrame, tiers: DataFrame, corpus: str) -> DataFrame:
    """(doc_id, clean, tier): texts of the clean tier pass as they are, others are scrubbed; unknown tiers count as sensitive.
    tiers, a row for each corpus, are few and broadcast, so that a corpus's texts need not meet in one task."""
    tiered = docs.join(F.broadcast(tiers), corpus, "left").withColumn("tier", F.coalesce("tier", F.lit("sensitive")))
    return tiered.select("doc_id", F.when(F.col("tier") == "clean", F.col("text")).otherwise(scrub_constants(F.col("text"))).alias("clean"), "tier")


def over_threshold(rows: DataFrame, corpus: Column, allowed: DataFrame) -> DataFrame:
    """Detections that count: score 0.3 or more in talk, 0.5 elsewhere, 0.7 for persons in code; and the value is not on
    the list of allowed ones, in whatever case."""
    least = F.when(corpus.startswith("CONVO"), 0.3).when((corpus == "CODE_LOGIC") & (F.col("entity") == "PERSON"), 0.7).otherwise(0.5)
    low = allowed.select(F.lower("value").alias("__low")).distinct()
    return rows.filter(F.col("score") >= least).join(low, F.lower("value") == F.col("__low"), "left_anti")


def mention_pseudonyms(text: Column, salt: str) -> Column:
    """Words that begin with @, each replaced by its pseudonym, in one pass."""
    pattern = r"@[A-Za-z0-9_.-]+"
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    replaced = F.transform(names, lambda n: F.concat(F.lit("@"), pseudonym(F.lit("USER"), n, salt)))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), replaced, lambda gap, n: F.concat(gap, F.coalesce(n, F.lit("")))), "")


def thread_pseudonyms(messages: DataFrame, salt: str) -> DataFrame:
    """Messages (speaker, text ...) with their speakers, and the speakers mentioned in them, under the same pseudonyms in
    all threads."""
    author = F.concat(F.lit("@"), pseudonym(F.lit("USER"), F.concat(F.lit("@"), "speaker"), salt))
    return messages.withColumn("text", mention_pseudonyms(F.col("text"), salt)).withColumn("speaker", author)


#: Characters of a bucket in which spans meet.
BUCKET = 256


def span_evaluation(predicted: DataFrame, truth: DataFrame, group: str | None = None) -> DataFrame:
    """(group, hit, right, truth, predicted, recall, precision, f2) of spans (doc_id, start, end, group): a true span is hit,
    and a predicted one right, if it overlaps one of the other kind in its document, in part or whole; each counts once.

    Spans meet in buckets of BUCKET characters, so a document's spans are not all compared; a span of many buckets meets
    another by the first that both are in. Empty spans and rows with nulls take no part. Without group there is one row.
    """
    own = lambda d, n: d.select("doc_id", "start", "end", (F.col(group) if group else F.lit("all")).alias("group")).filter("doc_id is not null and end > start").distinct().withColumn("id", F.struct("doc_id", "start", "end", "group")).withColumn("side", F.lit(n))
    buckets = lambda d: d.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))))
    p, t = own(predicted, "p"), own(truth, "t")
    a, b = buckets(p).alias("a"), buckets(t).alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.bucket") == F.col("b.bucket")) & F.col("a.group").eqNullSafe(F.col("b.group"))
    met = a.join(b, same & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))).select(F.col("a.group").alias("group"), F.explode(F.array(F.struct(F.lit("p").alias("side"), F.col("a.id").alias("id")), F.struct(F.lit("t").alias("side"), F.col("b.id").alias("id")))).alias("x"))
    touched = met.select("group", F.col("x.side").alias("side"), "x.id").distinct().withColumn("met", F.lit(1))
    all_ = p.select("group", "side", F.lit(0).alias("met")).unionByName(t.select("group", "side", F.lit(0).alias("met"))).unionByName(touched.select("group", "side", "met"))
    n = lambda side, met: F.count_if((F.col("side") == side) & (F.col("met") == met))
    counts = all_.groupBy("group").agg(n("t", 1).alias("hit"), n("p", 1).alias("right"), n("t", 0).alias("truth"), n("p", 0).alias("predicted"))
    recall, precision = F.col("hit") / F.nullif("truth", F.lit(0)), F.col("right") / F.nullif("predicted", F.lit(0))
    rated = counts.withColumns({"recall": recall, "precision": precision})
    return rated.withColumn("f2", F.lit(5) * F.col("precision") * F.col("recall") / F.nullif(4 * F.col("precision") + F.col("recall"), F.lit(0.0)))


def evaluation(predicted: DataFrame, truth: DataFrame, key: Sequence[str]) -> DataFrame:
    """recall, precision and F2 of predicted keys against true ones, in one row."""
    p, t = predicted.select(*key).distinct().withColumn("p", F.lit(1)), truth.select(*key).distinct().withColumn("t", F.lit(1))
    both = p.join(t, list(key), "full").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("hit"), F.count("p").alias("p"), F.count("t").alias("t"))
    recall, precision = F.col("hit") / F.nullif("t", F.lit(0)), F.col("hit") / F.nullif("p", F.lit(0))
    return both.select(recall.alias("recall"), precision.alias("precision")).withColumn("f2", F.lit(5) * F.col("precision") * F.col("recall") / F.nullif(4 * F.col("precision") + F.col("recall"), F.lit(0.0)))
