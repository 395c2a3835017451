"""Structure repair of conversations as one sorted stream per conversation.

Rows are dealt by conversation and sorted by turn; ``mapInPandas`` walks the stream and carries its state from one Arrow batch to
the next, so a conversation may span any number of batches. Three walks follow one shuffle; each is a local sort, which Spark spills:

1. *Faults.* Rows of one role and text lie together in order of turn; all but the first are duplicates.
2. *Costs.* From the last row to the first, the state is the cheapest cost of finishing from each of four situations (nothing
   written yet, after a system row, after a user row, after an assistant row). Each row gets one byte, two bits per situation,
   that name its edit. These are the backpointers: a column, which the next sort spills with its rows, however long a conversation is.
3. *Edits.* From the first row to the last, the state is the situation; it reads the byte and writes the edits.

The situation fixes what a reroled or inserted row becomes, so equal audits have equal results. Among the cheapest edits the
ASCII-least audit is chosen row by row: delete (D), insert (I), keep (K), rerole (R).

A conversation is one stream, as its digest is sequential. A task holds one batch and a few numbers of it, but for its
own audit, one letter per edit.

Defined results: a null id is a conversation of its own; a null role or text is one space. Rows of one turn are ordered by role, then
text; null turns come first. Fully repeated rows are duplicates. A role counts by its first letter; a role without one, or
with another than s, u and a, can't stay as it is. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearledger.llm.common import WORD

#: Situations: nothing written, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a written row of an initial leads to.
WRITES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Rerole and insert write a user row, after a user row an assistant row.
MADE = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"

# Ids and turns enter Python as text: a column with nulls would become floating point there.
ROW = "conv_id string, turn string, role string, text string, fault string"
EDIT = "conv_id string, place bigint, edit string, turn string, role string, text string, fault string, opens boolean, closes boolean, illegal boolean, new_turn boolean"
SUMMARY = (
    "conv_id string, rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted damage by crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), kind.alias("kind"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    )
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


def _fault(text: Column, turn: Column) -> Column:
    return (
        F.when(~text.rlike(WORD), "blank").when(turn > 1, "duplicate")
        .when(~F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")).rlike(r"[.!?]\z"), "truncated")
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the first fault of each row: blank, duplicate, truncated or null. Dealt by conversation."""
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    # The window asks for rows of one conversation, role and text together: dealt by conversation they are.
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    return rows.repartition("conv_id").withColumn("nth", F.row_number().over(earlier)).select(
        "conv_id", "turn", "role", "text", _fault(F.col("text"), F.col("nth")).alias("fault"))


def _number(value: str | None) -> int | None:
    return int(value) if isinstance(value, str) else None


def _known(value: str | None) -> str | None:
    return value if isinstance(value, str) else None


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _long(rows: DataFrame, kind: str = "bigint") -> DataFrame:
    return rows.withColumns({c: F.col(c).cast(kind) for c in ("conv_id", "turn") if c in rows.columns})


def _step(ahead: list[int], initial: str, fault: str | None) -> tuple[list[int], int]:
    """Cheapest costs from before a row, and its byte, given the costs from behind it."""
    free = fault not in ("blank", "duplicate")
    extra = 3 if fault == "truncated" else 0
    writes = WRITES.get(initial, {})
    plain = []
    for now in range(4):
        best = (4 + ahead[now], DELETE)
        if free:
            if now in writes:
                best = min(best, (extra + ahead[writes[now]], KEEP))
            best = min(best, (3 + extra + ahead[MADE[now]], REROLE))
        plain.append(best)
    # An insert leads to the situation of the made row; two in a row come back to where they were, so one look ahead is enough.
    once = [min(plain[now], (3 + plain[MADE[now]][0], INSERT)) for now in range(4)]
    full = [min(plain[now], (3 + once[MADE[now]][0], INSERT)) for now in range(4)]
    return [cost for cost, _ in full], sum(edit << 2 * now for now, (_, edit) in enumerate(full))


#: Cost and edit of the end of a conversation: it may end empty or after an assistant row; else inserts complete it.
END = [0, 6, 3, 0]


def _priced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows from the last to the first of each conversation, with their byte."""
    open_, conv, ahead = False, None, END
    for frame in batches:
        steps = np.zeros(len(frame), dtype=np.int16)
        for i, (key, role, fault) in enumerate(zip(frame["conv_id"], frame["role"], frame["fault"], strict=True)):
            key = _known(key)
            if not open_ or key != conv:
                open_, conv, ahead = True, key, END
            ahead, steps[i] = _step(ahead, role[:1], _known(fault))
        yield frame.assign(step=steps)


class _Writer:
    """The edits of one conversation after the other; rows come in order of turn."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.open = False

    def add(self, edit: int, turn, role, text, fault, illegal=False, new_turn=False) -> None:
        self.rows.append((self.conv, self.place, LETTERS[edit], turn, role, text, fault, self.place == 0, False, illegal, new_turn))
        self.place += 1

    def start(self, conv) -> None:
        self.open, self.conv, self.place, self.now, self.last, self.turn = True, conv, 0, START, None, None

    def insert(self) -> None:
        self.now = MADE[self.now]
        self.add(INSERT, None, ROLE[self.now], "", None)

    def finish(self) -> None:
        if self.open:
            while self.now not in (START, ASSISTANT):
                self.insert()
            self.rows[-1] = (*self.rows[-1][:8], True, *self.rows[-1][9:])

    def row(self, turn, role, text, fault, step: int) -> None:
        edit = step >> 2 * self.now & 3
        while edit == INSERT:
            self.insert()
            edit = step >> 2 * self.now & 3
        illegal = self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        fresh = turn is not None and turn != self.turn
        if edit != DELETE:
            self.now = WRITES[role[0]][self.now] if edit == KEEP else MADE[self.now]
        self.add(edit, turn, ROLE[self.now] if edit == REROLE else role, text, fault, illegal, fresh)
        self.last, self.turn = role[:1], turn if turn is not None else self.turn

    def taken(self) -> pd.DataFrame:
        """What is written so far, but for the last row, which may yet close its conversation."""
        done, self.rows = self.rows[:-1], self.rows[-1:]
        return _edits(done)


def _edits(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_names(EDIT))


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    writer = _Writer()
    for frame in batches:
        columns = [frame[c] for c in ("conv_id", "turn", "role", "text", "fault", "step")]
        for conv, turn, role, text, fault, step in zip(*columns, strict=True):
            conv, turn, fault = _known(conv), _known(turn), _known(fault)
            if not writer.open or conv != writer.conv:
                writer.finish()
                writer.start(conv)
            writer.row(turn, role, text, fault, int(step))
        yield writer.taken()
    writer.finish()
    yield _edits(writer.rows)


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edits that give every conversation the shape (system)? (user assistant)+, or nothing.

    One row per edit, sorted by conversation and place within each partition: conv_id, place (from 0), edit (K, R, D, I), turn (null for an insert), role
    (the new one where reroled), text, fault, opens and closes (first and last edit of its conversation), illegal (the row follows
    the row before it wrongly, as found), new_turn (the first row of a turn that is known). Rows with edit other than D, in order of place, are the repaired
    conversation. Keep costs 0, rerole 3, delete 4 (and is required for blank and duplicate rows), insert 3; a
    truncated row that stays costs 3 more.
    """
    order = [F.col("turn").cast("bigint"), F.col("role"), F.col("text")]
    down = [F.col("conv_id"), order[0].desc_nulls_last(), *(c.desc() for c in order[1:])]
    up = [F.col("conv_id"), order[0].asc_nulls_first(), *(c.asc() for c in order[1:])]
    # Sorting within partitions keeps the rows of a conversation where they are: there is no second shuffle.
    priced = _long(with_faults(rows), "string").sortWithinPartitions(*down).mapInPandas(_priced, f"{ROW}, step smallint")
    return _long(priced.sortWithinPartitions(*up).mapInPandas(_edited, EDIT))


class _Summary:
    """Counts, cost, audit and digest of one conversation."""

    def __init__(self) -> None:
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.least = self.most = None
        self.audit: list[str] = []
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, edit: str, turn, role: str, text: str, fault: str | None, illegal: bool, new_turn: bool) -> None:
        self.audit.append(edit)
        self.cost += {"K": 0, "R": 3, "D": 4, "I": 3}[edit]
        if edit != "I":
            self.n += 1
            self.illegal += illegal
            if fault is not None:
                setattr(self, fault, getattr(self, fault) + 1)
            if fault == "truncated" and edit != "D":
                self.cost += 3
            if new_turn:
                self.turns += 1
                self.least = turn if self.least is None else self.least
                self.most = turn
        if edit != "D":
            line = f"{role}:{text}".encode("utf-8", "surrogatepass")
            self.sha.update(line if self.empty else b"\n" + line)
            self.empty = False

    def row(self, conv) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return conv, self.n, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now = None
    names = ("conv_id", "edit", "turn", "role", "text", "fault", "opens", "closes", "illegal", "new_turn")
    for frame in batches:
        done = []
        for conv, edit, turn, role, text, fault, opens, closes, illegal, new_turn in zip(*(frame[c] for c in names), strict=True):
            if opens:
                now = _Summary()
            now.add(edit, _number(turn), role, text, _known(fault), illegal, new_turn)
            if closes:
                done.append(now.row(_known(conv)))
        yield pd.DataFrame(done, columns=_names(SUMMARY))


def summarised(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s edits, taken as they lie: rows, gaps (turn numbers missing between the first and the last), faults by kind,
    illegal successions, cost, audit (the edits' letters) and SHA-256 of the repaired lines "role:text"."""
    return _long(_long(edits, "string").mapInPandas(_summed, SUMMARY))


def audited(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A summary of ``rows`` for every conversation named in ``conversations``; without rows: zeros, an empty audit, the digest of nothing."""
    named = conversations.select(F.col("conv_id").cast("bigint").alias("named")).distinct()
    found = summarised(repair(rows))
    joined = named.join(found, named["named"].eqNullSafe(found["conv_id"]), "left").withColumn("conv_id", F.col("named")).drop("named")
    return joined.fillna(0, ["rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
