"""Conversation repair against an exhaustive search over edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from granary.llm import conversation_repair as R

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        own += [(turn, role, text)] * (harm != 0) * (2 if harm == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    return out


def plain_faults(own):
    seen, out = set(), []
    for _, role, text in own:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(own):
    """Uniform-cost search by (cost, edits): the first complete state taken is the answer."""
    faults = plain_faults(own)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, initials, turns = heapq.heappop(heap)
        if k == len(own) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, turns
        state = (k, initials[-1:])
        if state in done:
            continue
        done.add(state)
        steps = [("I", 5, 0, w, w, "") for w in ("user", "assistant")]
        if k < len(own):
            _, role, text = own[k]
            steps.append(("D", 2, 1, None, None, None))
            if faults[k] not in ("blank", "duplicate"):
                extra = 5 * (faults[k] == "truncated")
                steps += [("K", extra, 1, role, role, text)] + [("R", 1 + extra, 1, w, w, text) for w in ("user", "assistant")]
        for edit, price, step, role, word, text in steps:
            now = initials + ("" if role is None else role[:1])
            if role is not None and (not role or not re.fullmatch("s?(ua)*u?", now)):
                continue
            heapq.heappush(heap, (cost + price, audit + edit, k + step, now, turns + (() if word is None else ((word, text),))))
    raise AssertionError


def plain(rows):
    out = {}
    for conv, own in plain_damage(rows).items():
        faults, initials = plain_faults(own), [r[1][:1] for r in own]
        known = [r[0] for r in own if r[0] is not None]
        cost, audit, turns = plain_repair(own)
        said = "\n".join(f"{r}:{t}" for r, t in turns)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for conv in range(300):
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(["Yes.", "No!", "and", "", " \t", None, "é🙂?", "Who? ", "a\nb.", "x"]) if conv % 3 else f"t{conv} {turn}."
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "ustad"]) if conv % 3 else ("user", "assistant")[turn % 2]
            out.append((conv, rng.choice([turn, turn, turn * 3, None, 2]), role, text))
    out += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (-7, -(2**62), "user", "a."), (-7, 2**62, "assistant", "b."), (500, 1, "user", "long. " * 100_000), (500, 2, "assistant", "x" * 300_000)]
    return out + out[:40]


def test_query_against_search(spark, rows, monkeypatch):
    monkeypatch.setattr(R, "SPILL", 8)
    turns = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("fault", "said", "conv", "at", "nth", "edit", "dropped_", "harm", "n")}).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in R.repair(R.damaged(turns)).collect()}
    assert got == plain(rows)


def test_repaired_rows(spark, rows):
    found = R.repaired(R.damaged(spark.createDataFrame(rows, TURNS)))
    said = {}
    for r in sorted(found.collect(), key=lambda r: r.position):
        said.setdefault(r.conv_id, []).append((r.position, f"{r.role}:{r.text}"))
    for conv, expected in plain(rows).items():
        own = said.get(conv, [])
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert hashlib.sha256("\n".join(t for _, t in own).encode()).hexdigest() == expected[-1]


def test_given_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in R.query(spark, data).collect()} == plain(rows)


def test_giant_conversation_spills_backpointers(spark, monkeypatch):
    program = R._Repair()
    monkeypatch.setattr(R, "SPILL", 1 << 10)
    for k in range(20_000):
        program.row(("user", "assistant", "user")[k % 3], f"{k}.", R.NONE)
    state, cost, _ = program.end()
    edits = [e for e, _ in program.trace(state)]
    assert program.spilled > 70_000 and len(program.back) < 1 << 10
    assert sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in edits) == cost and sum(e != "I" for e in edits) == 20_000
    program.close()


def test_all_rows_dropped(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = R.repair(R.damaged(spark.createDataFrame([(gone, 0, "user", "a.")], TURNS))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
