"""Queries that read the events table as a stream, to its end, with oracle SQL over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop_at_exit, shared_dir, stored
from ..streaming import events as E
from .adapters import table, user_events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: How far behind the newest event the watermark stays.
LATE = "6 hours"
#: Events arrive in three parts by time; of the first, some come with the last.
_PARTS = "case when epoch_us(ts) % 20 = 7 and day(ts) <= 10 then 3 when day(ts) <= 10 then 1 when day(ts) <= 20 then 2 else 3 end"
#: What the oracle knows of the watermark: before the third part, and at the end.
_ARRIVED = f"""ev as (select *, {_PARTS} as part from events),
  wm as (select max(ts) filter (where part < 3) - interval 6 hour as before, max(ts) - interval 6 hour as last from ev)"""


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def arriving(spark, d) -> tuple[DataFrame, list]:
    """The table's rows (times read as those of UTC, whatever the session's zone) and the condition of each part that arrives."""
    rows = table(spark, d, "events")
    rows = rows.withColumn("ts", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))))
    day = F.dayofmonth(F.to_utc_timestamp("ts", F.current_timezone()))
    late = (F.pmod(F.unix_micros("ts"), F.lit(20)) == 7) & (day <= 10)
    return rows, [(day <= 10) & ~late, (day > 10) & (day <= 20), (day > 20) | late]


def finished(spark, d, work, name: str, adapt=lambda rows: rows) -> DataFrame:
    """work over a stream of the events: each part arrives, and the stream resumes from its checkpoint; rows are appended once, when
    the watermark has passed them."""
    rows, parts = arriving(spark, d)
    rows = adapt(rows)
    source, place, state = (shared_dir(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    for path in (source, place, state):
        drop_at_exit(spark, path)
    for part in parts:
        rows.filter(part).write.mode("append").parquet(source)
        out = work(spark.readStream.schema(rows.schema).parquet(source))
        E.appended(out, place, state).awaitTermination()
    return spark.read.schema(out.schema).parquet(place)


def micros(c: str, name: str):
    return F.unix_micros(c).alias(name)


_WINDOWS = """with {arrived}, w as (select part, s, s + interval 6 hour as e, event_type from {source})
  select epoch_us(s) as start, {stop} event_type, count(*) as n from w, wm where e <= last and not (part = 3 and e <= before) group by all"""


@query("stream_windows", _WINDOWS.format(arrived=_ARRIVED, stop="epoch_us(e) as stop,", source="(select part, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as s, event_type from ev)"))
def stream_windows(spark, d):
    """Counts of windows that the watermark has passed, without rows that came after it."""
    out = finished(spark, d, lambda events: E.windowed_counts(events, size="6 hours", late=LATE), "windows")
    return out.select(micros("start", "start"), micros("end", "stop"), "event_type", "n")


@query("stream_sliding", _WINDOWS.format(arrived=_ARRIVED, stop="", source="(select part, time_bucket(interval '2 hours', ts, timestamp '1970-01-01') - k * interval 2 hour as s, event_type from ev, range(3) t(k))"))
def stream_sliding(spark, d):
    out = finished(spark, d, lambda events: E.windowed_counts(events, size="6 hours", slide="2 hours", late=LATE), "sliding")
    return out.select(micros("start", "start"), "event_type", "n")


@query("stream_sessions", f"""with {_ARRIVED}, e as (select user_id, ts from ev, wm where not (part = 3 and ts + interval 12 hour <= before)),
  a as (select user_id, ts, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 12 hour, true) as fresh from e),
  b as (select *, sum(cast(fresh as int)) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from a),
  s as (select user_id, min(ts) as start, max(ts) + interval 12 hour as stop, count(*) as n from b group by user_id, k)
  select user_id, epoch_us(start) as start, epoch_us(stop) as stop, n from s, wm where stop <= last""")  # fmt: skip
def stream_sessions(spark, d):
    out = finished(spark, d, lambda events: E.sessions(events, gap="12 hours", late=LATE), "sessions")
    return out.select("user_id", micros("start", "start"), micros("end", "stop"), "n")


@query("stream_translation", f"""with {_ARRIVED}, n as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as step from ev),
  f as (select user_id, max(step) as folded from n, wm where part < 3 and epoch_ms(ts) < epoch_ms(before) group by user_id),
  s as (select n.*, coalesce(part = 3 and step <= folded, false) as late from n left join f using (user_id))
  select user_id as task_id, step, case when late then 'late' else 'event' end as side,
    case when late then 0 else row_number() over (partition by user_id, late order by step) end as seq,
    case when late then row_number() over (partition by user_id, late order by step) else 0 end as nth from s, wm where late or epoch_ms(ts) < epoch_ms(last)""")  # fmt: skip
def stream_translation(spark, d):
    """Every event of a stream: folded in order once the watermark has passed it, or late."""
    from ..streaming.translation import folded_stream

    def adapt(rows):
        return stored(user_events(rows, "ts"), "translation-events")  # numbered once for all three parts

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    work = lambda events: folded_stream(events, late=LATE, idle_ms=90 * 86_400_000)
    out = finished(spark, d, work, "translation", adapt)
    late = F.col("side") == "late"
    nth = F.row_number().over(Window.partitionBy("task_id", "side").orderBy("step")).cast("bigint")
    return out.select("task_id", "step", "side", F.when(late, 0).otherwise(F.col("seq")).alias("seq"), F.when(late, nth).otherwise(0).alias("nth"))
