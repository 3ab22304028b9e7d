"""Streamed translation: late events, ended trajectories, bounded state and restarts give what the batch plan gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seqlens.operators import translate as T
from seqlens.streaming import translation as S
from tests.test_sequences import SCHEMA, made

START = dt.datetime(2024, 1, 1)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def event(e, minute):
    return (*[e.get(f) for f in FIELDS], START + dt.timedelta(minutes=minute))


@pytest.fixture(scope="module")
def arrivals():
    """Three batches of a few trajectories, a minute a step; some events of the first come with the last, out of order otherwise."""
    tracks = {t: made(t, 40, t) for t in range(4)}
    rows = [[], [], []]
    late = []
    for t, evs in tracks.items():
        for e in evs:
            row = event(e, e["step"])
            if t < 2 and e["step"] in (3, 7):
                late.append(row)
            else:
                rows[0 if e["step"] < 15 else 1 if e["step"] < 30 else 2].append(row)
    rows[2] += late
    rows[2].append(event({"task_id": 9, "step": 0, "type": "file_read", "path": "p"}, 60 * 24))  # moves the watermark on
    return [r[::-1] for r in rows], late


def run(spark, arrivals, top):
    source, out, check = f"{top}/in", f"{top}/out", f"{top}/check"
    schema = f"{SCHEMA}, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for rows in arrivals:  # each run resumes from the checkpoint
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        folded = S.folded_stream(stream, late="2 minutes", idle_ms=3_600_000)
        q = folded.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out), q


def test_stream_against_batch(spark, arrivals, tmp_path):
    batches, late = arrivals
    folded, query = run(spark, batches, tmp_path)
    on_time = [r for rows in batches for r in rows if r not in late and r[0] != 9]
    want = T.translate(spark.createDataFrame(on_time, SCHEMA + ", ts timestamp"))
    key = lambda df: sorted(map(str, df.select("task_id", "idx", "type", "timestamp", "amount", "tool", "observable_added", "uncertainty", "to_phase", "phase", "cmd_label").collect()))
    assert key(S.constraints(folded).filter("task_id <> 9")) == key(want)
    got = {(r.task_id, r.step) for r in S.late_events(folded).collect()}
    assert got == {(r[0], r[1]) for r in late}
    ends = {r.task_id: (r.events, r.late) for r in S.ended(folded).collect()}
    assert ends == {0: (38, 2), 1: (38, 2), 2: (40, 0), 3: (40, 0)}
    rows = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert rows and rows[-1]["customMetrics"].get("rocksdbNumKeys", 0) is not None


def test_one_timer_a_trajectory(spark, arrivals, tmp_path):
    """Calls to the state store grow with trajectories and batches, not with events."""
    _, query = run(spark, arrivals[0], tmp_path)
    timers = [p["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) for p in query.recentProgress if p["stateOperators"]]
    assert timers and max(timers) <= 5
