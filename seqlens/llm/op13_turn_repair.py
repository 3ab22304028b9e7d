"""Repair of conversations: the cheapest edits that leave turns of the roles (s?(ua)+)?, by a DP over the turns that stay.

A turn that stays is kept or takes another role; the turns between two that stay are deleted, so sums of deletions price a gap,
and the two roles around it say what has to be inserted. Read backwards, the cheapest rest after a turn that stays with a role is
a running minimum for each role of the next that stays; less the sum of deletions it needs no positions. Read forwards, each turn
takes the edit least in ASCII of those that still reach the minimum. Per turn, edits are one of D, IK, IR, K, R (an insertion
stands right before the turn that calls for it, after deletions); none begins another, so the least edit at each turn gives the
least audit, in one pass and without comparing audits.

Spark deals conversations to tasks and sorts them, backwards for the first pass and forwards for the second, both of which stream:
a task holds four numbers of a conversation (and its audit in the end), however long it is. A conversation's audit and hash are
single values over its turns in order, so that its turns are read by one task.

Defined results: turns come by turn (nulls first), then role, then text; a null role or text counts as one space; all rows of a
null conversation are one conversation; repeated rows are duplicates of the first; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, partitions

# Costs, roles and blanks.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"

#: State: the last role that stays, or none. What has to be inserted at the end, and before the next role (None: impossible).
STATES = ("", "s", "u", "a")
AT_END = {"": "", "s": "ua", "u": "a", "a": ""}
BETWEEN = {
    "": {"s": "", "u": "", "a": "u"},
    "s": {"u": "", "a": "u"},
    "u": {"u": "a", "a": ""},
    "a": {"u": "", "a": "u"},
}

EDITS = "conv_id {id}, step long, edit string, fault string, turn long, old_role string, role string, text string, cost long"


def stays(initial: str, fault: str) -> list[tuple[str, str, int]]:
    """(edit, role, cost) by which a turn can stay."""
    if fault in ("blank", "duplicate"):
        return []
    extra = TRUNCATED if fault == "truncated" else 0
    kept = [("K", initial, extra)] if initial in ROLES else []
    return kept + [("R", r, extra + REROLE) for r in ("u", "a") if r != initial]


class Rest:
    """Costs of the cheapest rest by the last role that stays, less what deleting all of the rest costs."""

    def __init__(self):
        self.next = {}  # the running minimum for each role of the next turn that stays

    def costs(self) -> dict[str, int]:
        """Of the rest after each state."""
        out = {}
        for q in STATES:
            ways = [self.next[r] + INSERT * len(put) for r, put in BETWEEN[q].items() if r in self.next]
            out[q] = min([INSERT * len(AT_END[q]), *ways])
        return out

    def add(self, options: list[tuple[str, str, int]], after: dict[str, int]) -> None:
        """One more turn in front, with the costs of the rest after it."""
        for _, r, cost in options:
            total = cost - DELETE + after[r]
            self.next[r] = min(total, self.next.get(r, total))


def choose(state: str, options: list[tuple[str, str, int]], after: dict[str, int]) -> tuple[str, str, int]:
    """(edits, role or state, cost): the least edits of the cheapest at a turn, D first."""
    ways = [(after[state], "D", state, DELETE)]
    for letter, r, cost in options:
        if r in BETWEEN[state]:
            put = BETWEEN[state][r]
            total = cost + INSERT * len(put)
            ways.append((total - DELETE + after[r], "I" * len(put) + letter, r, total))
    return min(ways)[1:]


def prepared(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, first, fault of turns (conv_id, turn, role, text and perhaps copies: how often the row
    stands there; with 0 it only names its conversation)."""
    copies = turns["copies"].cast("int") if "copies" in turns.columns else F.lit(1)
    there = copies > 0
    df = turns.select(
        turns["conv_id"], turns["turn"].cast("long").alias("turn"), F.when(there, F.coalesce(turns["role"], F.lit(" "))).alias("role"),
        F.when(there, F.coalesce(turns["text"], F.lit(" "))).alias("text"), copies.alias("copies"),
    )
    again = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    df = df.withColumn("first", F.row_number().over(again) == 1)
    fault = (
        F.when(end == "", "blank")
        .when(~F.col("first"), "duplicate")
        .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    return df.withColumn("fault", fault)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _each(row: tuple) -> Iterator[tuple[str, str]]:
    """(role initial, fault) of a row's copies in order."""
    _, _, role, _, copies, _, fault = row[:7]
    for i in range(copies):
        yield role[:1], "duplicate" if i and fault != "blank" else fault


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the costs of the rest after its first copy."""
    conv, rest = object(), Rest()
    for batch in batches:
        costs = []
        for row in _rows(batch):
            if row[0] != conv:
                conv, rest = row[0], Rest()
            after = rest.costs()  # copies are deleted, which leaves it
            costs.append([after[q] for q in STATES])
            if row[4]:
                rest.add(stays(row[2][:1], row[6]), after)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64()))], names=[*batch.schema.names, "rest"])


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each conversation in order."""
    conv, state, step, met = object(), "", 0, False
    for batch in batches:
        out: list[tuple] = []

        def put(edit, fault, turn, old, role, text, cost):
            nonlocal step
            step += 1
            out.append((conv, step, edit, fault, turn, old, role, text, cost))  # noqa: B023

        def end():
            for r in AT_END[state]:
                put("I", None, None, None, ROLES[r], "", INSERT)
            if met and not step:
                out.append((conv, 0, None, None, None, None, None, None, 0))  # noqa: B023

        for row in _rows(batch):
            if not met or row[0] != conv:
                end()
                conv, state, step, met = row[0], "", 0, True
            after = dict(zip(STATES, row[7], strict=True))
            for initial, fault in _each(row):
                edits, to, cost = choose(state, stays(initial, fault), after)
                if edits == "D":
                    put("D", fault, row[1], row[2], None, row[3], DELETE)
                    continue
                for r in BETWEEN[state][to]:
                    put("I", None, None, None, ROLES[r], "", INSERT)
                    cost -= INSERT
                put(edits[-1], fault, row[1], row[2], row[2] if edits[-1] == "K" else ROLES[to], row[3], cost)
                state = to
        yield _edits(out, batch.schema.field(0).type)
    out = []
    if met:
        end()
        yield _edits(out, batch.schema.field(0).type)


def _edits(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    types = (id_type, number, text, text, number, text, text, text, number)
    names = [x.split()[0] for x in EDITS.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def edits(turns: DataFrame) -> DataFrame:
    """The edits that repair each conversation, in order (step): what happens (K, R, D or I), the turn's fault, turn, old_role,
    the role it ends with and its text. A conversation without turns has one row of step 0. Rows of a conversation lie in one
    partition in order."""
    df = prepared(turns)
    id_type = df.schema["conv_id"].dataType.simpleString()
    order = ("turn", "role", "text")
    dealt = df.repartition(partitions(turns), "conv_id")
    back = dealt.sortWithinPartitions(F.asc("conv_id"), *[F.desc_nulls_last(c) for c in order], F.asc("first"))
    fields = f"conv_id {id_type}, turn long, role string, text string, copies int, first boolean, fault string, rest array<bigint>"
    priced = back.mapInArrow(lean(_backwards), fields)
    ahead = priced.sortWithinPartitions(F.asc("conv_id"), *[F.asc_nulls_first(c) for c in order], F.desc("first"))
    return ahead.mapInArrow(lean(_forwards), EDITS.format(id=id_type))


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, step, role, text."""
    return edits(turns).filter("edit in ('K', 'R', 'I')").select("conv_id", "step", "role", "text")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, now = object(), None
    for batch in batches:
        done = []
        for conv_id, _, edit, fault, turn, old, role, text, cost in _rows(batch):
            if now is None or conv_id != conv:
                if now:
                    done.append(now.result(conv))
                conv, now = conv_id, Summary()
            if edit:
                now.add(edit, fault, turn, old, role, text, cost)
        yield _summaries(done, batch.schema.field(0).type)
    if now:
        yield _summaries([now.result(conv)], batch.schema.field(0).type)


SUMMARY = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summaries(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = (id_type, *[pa.int64()] * 6, pa.string(), pa.string())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SUMMARY.split(", ")])


class Summary:
    def __init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.distinct = 0
        self.before = self.low = self.high = None
        self.audit: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def add(self, edit, fault, turn, old, role, text, cost):
        self.cost += cost
        self.audit.append(edit)
        if len(self.audit) > 100_000:
            self.audit = ["".join(self.audit)]
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if self.before is not None:
                self.illegal += self.before + old[:1] not in LEGAL
            self.before = old[:1]
            if turn is not None and turn != self.high:  # turns come in order
                self.low = turn if self.low is None else self.low
                self.high, self.distinct = turn, self.distinct + 1
        if edit != "D":
            self.hash.update((("" if self.empty else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.empty = False

    def result(self, conv) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def audits(turns: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, illegal pairs of roles, cost, audit and hash of the repaired turns."""
    df = edits(turns)
    return df.mapInArrow(lean(_summed), SUMMARY.format(id=df.schema["conv_id"].dataType.simpleString()))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows damaged by a hash of conversation and turn: dropped, emptied, without marks, repeated, or of role user."""
    spaced = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    how = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    return conversations.select(
        conversations["conv_id"], conversations["turn"],
        F.when(how == 4, "user").otherwise(spaced("role")).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text")).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"),
    )
