"""Translation of an unbounded stream of events, trajectory by trajectory, with bounded state.

Each trajectory keeps the fold's state and the events that the watermark has not passed. Events are folded in order once it has, by a
timer; one that comes for a step already folded is late, and goes to a side output with its trajectory's count. When the watermark
has passed the last event by `idle`, the trajectory ends: its state goes, and a closing row tells its counts.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import fold
from ..operators.translate import constraints_of, readable, worked_out

#: What a stream gives: folded events, late ones (with how many were late before), and one row at a trajectory's end.
SIDES = ("event", "late", "end")
_EVENT = ("step", "type", "outcome", "from_phase", "to_phase", "trigger", "name", "tokens_used", "tokens_max")
_ADDED = [f.split()[0] for f in fold.ADDED.split(", ")]
#: Events in one stored piece of what waits, and in one row that the worker gives.
_PIECE = 10_000


class Trajectories(StatefulProcessor):
    """A trajectory has one timer: for the first event that waits, else for its end. What comes in is stored in pieces, unread, until
    the timer goes off: calls to the state store are a few for each trajectory and batch, not for each event. Events come and go as
    JSON texts, as a frame of many columns for each trajectory costs more than the fold."""

    def __init__(self, idle_ms: int, wait_ms: int):
        self.idle_ms, self.wait_ms = idle_ms, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "body string, last_step long, last_ms long, folded long, late long, first_ms long, timer long")
        self.waiting = handle.getListState("waiting", "events string")

    def close(self) -> None:
        pass

    def _keep(self, body: str, rest: list, first: int | None, timer: int | None) -> None:
        """first: time of the first event that waits, if one does; timer: when the trajectory's timer goes off so far."""
        at = rest[1] + self.wait_ms + self.idle_ms if first is None else first + self.wait_ms
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.state.update((body, *rest, first, at))

    def _rows(self, key, side: str, rows: list[dict]) -> pd.DataFrame:
        pieces = [json.dumps(rows[at : at + _PIECE]) for at in range(0, len(rows), _PIECE)]
        return pd.DataFrame({"task_id": [key[0]] * len(pieces), "side": side, "rows": pieces})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        body, *rest, first, timer = self.state.get() or (json.dumps(dataclasses.asdict(fold.State())), -1, 0, 0, 0, None, None)
        late = []
        for frame in rows:
            fresh = []
            for step, ms, event in zip(frame["step"].tolist(), frame["ms"].tolist(), frame["event"].tolist(), strict=True):
                if step <= rest[0]:
                    rest[3] += 1
                    late.append({**json.loads(event), "step": step, "late": rest[3]})
                    continue
                fresh.append((step, ms, event))
                rest[1] = max(rest[1], ms)
                first = ms if first is None else min(first, ms)
            for at in range(0, len(fresh), _PIECE):
                self.waiting.appendValue((json.dumps(fresh[at : at + _PIECE]),))
        self._keep(body, rest, first, timer)
        if late:
            yield self._rows(key, "late", late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        if not known:
            return
        passed = timerValues.getCurrentWatermarkInMs()
        body, *rest, first, _ = known
        if first is not None:
            # of events with the same step and time the last that came counts
            waits = {(e[0], e[1]): e for (piece,) in self.waiting.get() for e in json.loads(piece)}
            events = [waits.pop(at) for at in sorted(at for at in waits if at[1] + self.wait_ms <= passed)]
            left = list(waits.values())
            if events:
                state = fold.State(**json.loads(body))
                made = [{**json.loads(event), "step": step, "late": 0} for step, _, event in events]
                for row, added in zip(made, fold.walk(state, iter([tuple(map(row.get, fold.READS)) for row in made])), strict=True):
                    row.update(zip(_ADDED, added, strict=True))
                rest[0], rest[2] = max(rest[0], events[-1][0]), rest[2] + len(events)
                body = json.dumps(dataclasses.asdict(state))
                yield self._rows(key, "event", made)
                if left:
                    self.waiting.put([(json.dumps(left[at : at + _PIECE]),) for at in range(0, len(left), _PIECE)])
                else:
                    self.waiting.clear()
            first = min((e[1] for e in left), default=None)
        if first is None and passed >= rest[1] + self.wait_ms + self.idle_ms:
            self.state.clear()
            yield self._rows(key, "end", [{"step": rest[2], "late": rest[3]}])
        else:
            self._keep(body, rest, first, None)  # the timer that went off is Spark's to take away


def folded_stream(events: DataFrame, time: str = "ts", late: str = "10 minutes", idle_ms: int = 3_600_000, wait_ms: int = 0) -> DataFrame:
    """task_id, side, late and the events with what the fold adds. An event is folded when the watermark is wait_ms past it."""
    timed = events.withColumn("ms", F.unix_millis(time)).withWatermark(time, late)
    df = readable(timed, "ms")
    kinds = [T.StructField(c, df.schema[c].dataType if c != "step" else T.LongType()) for c in _EVENT]
    given = T.StructType([T.StructField("late", T.LongType()), *kinds, *T.StructType.fromDDL(fold.ADDED).fields])
    out = T.StructType([T.StructField("task_id", df.schema["task_id"].dataType), *T.StructType.fromDDL("side string, rows string").fields])
    df = df.select("task_id", F.col("step").cast("long").alias("step"), "ms", F.to_json(F.struct(*_EVENT[1:])).alias("event"))
    done = df.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=Trajectories(idle_ms, wait_ms), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )
    return done.select("task_id", "side", F.explode(F.from_json("rows", T.ArrayType(given))).alias("r")).select("task_id", "side", "r.*")


def constraints(folded: DataFrame) -> DataFrame:
    """The constraints of the folded events, as the batch translation gives them."""
    return constraints_of(worked_out(folded.filter("side = 'event'")))


def late_events(folded: DataFrame) -> DataFrame:
    """(task_id, step, type, late): events that came after their step was folded; late numbers them by trajectory."""
    return folded.filter("side = 'late'").select("task_id", "step", "type", "late")


def ended(folded: DataFrame) -> DataFrame:
    """(task_id, events, late) of each trajectory that has ended."""
    return folded.filter("side = 'end'").select("task_id", F.col("step").alias("events"), "late")
