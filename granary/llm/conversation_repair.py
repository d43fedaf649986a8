"""Conversation structure repair: the cheapest edits that make a conversation alternate, found in one pass over its rows.

Rows are repartitioned by conversation and sorted by turn; mapInPandas then carries a dynamic program over four
states (nothing said, system said, user said, assistant said) from batch to batch. A state holds its least cost, its
place in the order of edit strings, and the running hash of what it would say, so a conversation's texts go by once
and are not kept. Per row and state one byte says how the state was reached; beyond SPILL bytes these go to a file of
the task, which is read backwards when the conversation ends. A conversation of any length so takes bounded memory,
but for its edit string; it stays in one task, as each state depends on the one before.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (due for blank and duplicate rows), Insert an empty user or
assistant turn 5; a truncated row that is not deleted adds 5. The role initials that are left are ``(s?(ua)+)?``.
Of the cheapest ways the one with the ASCII-least edit string is taken; it fixes all roles.

Null roles and texts count as one space. Rows of one turn go by role and text, null turns first; a null conv_id is a
conversation of its own. Repeated rows are duplicates of the first. Other columns are ignored, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import release, table

SPACES = " \t\n\x0b\f\r"
#: Faults of a row; a dropped row is no row, but its conversation stays.
NONE, BLANK, DUPLICATE, TRUNCATED, DROPPED = range(5)
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Bytes of backpointers of a conversation that stay in memory.
SPILL = 4 << 20
#: Edits of a conversation that are written at once.
EDITS = 10_000

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = 1 << 60
_SPOKEN = {USER: "user", ASSISTANT: "assistant"}
_FOLLOWS = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_LAWFUL = {"su", "ua", "au"}
_ACTIONS = "DKR"
#: Inserts that complete a conversation from each state.
_ENDS = ((EMPTY, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0))


def _ways(initial: str, truncated: bool) -> list[list[tuple[int, str, int]]]:
    """For each state after a row: (state before, edits, cost) of every way there that can be cheapest."""
    ways: list[list[tuple[int, str, int]]] = [[(s, "D", DELETE)] for s in range(4)]
    cut = CUT if truncated else 0
    if initial == "s":
        ways[SYSTEM].append((EMPTY, "K", cut))
    for before in range(4):
        for inserts in (0, 1):
            at = _FOLLOWS[before] if inserts else before
            to = _FOLLOWS[at]
            ways[to].append((before, "I" * inserts + "R", INSERT * inserts + REROLE + cut))
            if initial == _SPOKEN[to][0]:
                ways[to].append((before, "I" * inserts + "K", INSERT * inserts + cut))
    return ways


_WAYS = {(i, t): _ways(i, t) for i in "sua-" for t in (False, True)}


class _Repair:
    """The dynamic program over one conversation."""

    def __init__(self) -> None:
        self.cost = [0, _NEVER, _NEVER, _NEVER]
        self.rank = [0, 1, 2, 3]
        self.said = [hashlib.sha256() for _ in range(4)]
        self.back = bytearray()
        self.file = None
        self.spilled = 0

    def row(self, role: str, text: str | None, fault: int) -> None:
        if fault in (BLANK, DUPLICATE):
            self.cost = [c + DELETE if c < _NEVER else c for c in self.cost]
            self._keep(bytes(range(4)))
            return
        cost, rank, said = self.cost, self.rank, self.said
        initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
        body = ":" + text
        best: list[tuple[int, int, str, int] | None] = []
        for ways in _WAYS[initial, fault == TRUNCATED]:
            best.append(min(((cost[b] + c, rank[b], edits, b) for b, edits, c in ways if cost[b] < _NEVER), default=None))
        order = sorted((w[1], w[2], s) for s, w in enumerate(best) if w)
        back, after = bytearray(4), [said[0]] * 4
        for s, w in enumerate(best):
            if w is None:
                continue
            _, _, edits, b = w
            back[s] = b | (len(edits) - 1) << 2 | _ACTIONS.index(edits[-1]) << 4
            if edits == "D":
                after[s] = said[b]
                continue
            lines, at = [], b
            if edits[0] == "I":
                at = _FOLLOWS[at]
                lines.append(_SPOKEN[at] + ":")
            lines.append((role if edits[-1] == "K" else _SPOKEN[s]) + body)
            after[s] = said[b].copy()
            after[s].update((("\n" if b != EMPTY else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        self.cost = [w[0] if w else _NEVER for w in best]
        self.rank = [3] * 4
        for place, (_, _, s) in enumerate(order):
            self.rank[s] = place
        self.said = after
        self._keep(back)

    def _keep(self, back: bytes) -> None:
        self.back += back
        if len(self.back) >= SPILL:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.back)
            self.spilled += len(self.back)
            self.back = bytearray()

    def end(self) -> tuple[int, int, str]:
        """State, least cost and hash of what is left."""
        cost, _, _, state, inserts = min((self.cost[s] + INSERT * n, self.rank[s], "I" * n, s, n) for s, n in _ENDS)
        said, at = self.said[state].copy(), state
        for _ in range(inserts):
            at = _FOLLOWS[at]
            said.update(f"\n{_SPOKEN[at]}:".encode())
        self.inserts = inserts
        return state, cost, said.hexdigest()

    def _backwards(self) -> Iterator[bytes]:
        """Backpointers of the rows, the last ones first, in blocks."""
        yield self.back
        left = self.spilled
        while left:
            size = min(SPILL, left)
            left -= size
            self.file.seek(left)
            yield self.file.read(size)

    def trace(self, state: int) -> Iterator[tuple[str, int]]:
        """(edit, state after it) from the last edit to the first."""
        at, tail = state, []
        for _ in range(self.inserts):
            at = _FOLLOWS[at]
            tail.append(("I", at))
        yield from reversed(tail)
        for block in self._backwards():
            for k in range(len(block) - 4, -1, -4):
                code = block[k + state]
                yield _ACTIONS[code >> 4], state
                state, inserts = code & 3, code >> 2 & 3
                if inserts:
                    yield "I", _FOLLOWS[state]

    def close(self) -> None:
        if self.file:
            self.file.close()


class _Conversation(_Repair):
    """A conversation's repair and counts."""

    def __init__(self, key: str | None) -> None:
        super().__init__()
        self.key, self.initial, self.rows = key, None, 0
        self.faults = [0] * 5
        self.first = self.last = None
        self.turns = self.illegal = 0

    def add(self, turn: str | None, role: str, text: str | None, fault: int) -> None:
        self.faults[fault] += 1
        if fault == DROPPED:
            return
        self.rows += 1
        if turn is not None and (number := int(turn)) != self.last:
            self.first = number if self.first is None else self.first
            self.last = number
            self.turns += 1
        if self.initial is not None and self.initial + role[:1] not in _LAWFUL:
            self.illegal += 1
        self.initial = role[:1]
        self.row(role, text, fault)

    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[_Conversation]:
    """Each conversation when its last row has gone by."""
    now = None
    for batch in batches:
        for key, turn, role, text, fault in zip(batch["conv"], batch["at"], batch["said_by"], batch["said"], batch["fault"], strict=True):
            if now is None or key != now.key:
                if now is not None:
                    yield now
                    now.close()
                now = _Conversation(key)
            now.add(turn, role, text, fault)
    if now is not None:
        yield now
        now.close()
    release()


_SUMMARY = "conv string, gaps string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_EDITS = "conv string, step long, edit string, n long, spoken string"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    rows = []
    for c in _conversations(batches):
        state, cost, digest = c.end()
        audit = bytearray()
        for edit, _ in c.trace(state):
            audit += edit.encode()
        audit.reverse()
        rows.append((c.key, str(c.gaps()), c.faults[BLANK], c.faults[DUPLICATE], c.faults[TRUNCATED], c.illegal, cost, audit.decode(), digest))
        if len(rows) >= 1000 or len(audit) >= 1 << 20:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def _edit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _EDITS.split(", ")]
    rows = []
    for c in _conversations(batches):
        n, step = c.rows, 0
        for edit, state in c.trace(c.end()[0]):
            rows.append((c.key, step, edit, 0 if edit == "I" else n, _SPOKEN[state] if edit in "IR" else None))
            n, step = n - (edit != "I"), step - 1
            if len(rows) >= EDITS:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) of turns after the damage that each row's key decides."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    rows = turns.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), (F.crc32(key) % 20).cast("int").alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text), where given also dropped, with their first fault; a conversation's rows are
    together and in order. One shuffle, by conversation."""
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    own = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), dropped.alias("dropped")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")
    seen = own.withColumn("nth", F.row_number().over(same))
    bare = F.expr(f"trim(TRAILING '{SPACES}' FROM text)")
    fault = (
        F.when(F.col("dropped"), DROPPED)
        .when(bare == "", BLANK)
        .when(F.col("nth") > 1, DUPLICATE)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(NONE)
    )
    return seen.withColumn("fault", fault).sortWithinPartitions("conv_id", "turn", "role", "text", "nth").select("conv_id", "turn", "role", "text", "nth", "fault")


def _streamed(flagged: DataFrame) -> DataFrame:
    said = F.when(~F.col("fault").isin(BLANK, DUPLICATE, DROPPED), F.col("text"))
    return flagged.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("at"), F.col("role").alias("said_by"), said.alias("said"), "fault")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text): counts of its faults, least cost, edits as a
    string of initials, and the hash of what the edits leave. A number of gaps beyond a long is null."""
    kind = dict(rows.dtypes)["conv_id"]
    found = _streamed(faults(rows)).mapInPandas(_summaries, _SUMMARY)
    return found.withColumns({"conv": F.col("conv").cast(kind), "gaps": F.expr("try_cast(gaps as long)")}).withColumnRenamed("conv", "conv_id")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns that the edits leave, numbered from 1; inserted ones are empty."""
    kind = dict(rows.dtypes)["conv_id"]
    flagged = faults(rows)
    edits = _streamed(flagged).mapInPandas(_edit_rows, _EDITS).filter("edit <> 'D'")
    edits = edits.select(F.col("conv").cast(kind).alias("conv_id"), "edit", "n", "spoken", F.row_number().over(Window.partitionBy("conv").orderBy("step")).cast("long").alias("position"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "nth")
    numbered = flagged.filter(F.col("fault") != DROPPED).select(F.col("conv_id").alias("of"), "role", "text", F.row_number().over(order).cast("long").alias("m"))
    met = edits.join(numbered, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("n") == F.col("m")), "left")
    return met.select("conv_id", "position", "edit", F.coalesce("spoken", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
