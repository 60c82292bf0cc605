"""Queries over the events table: arriving scores, their windows and changes, and scores joined as of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.asof import asof_join
from ..sources.staging import work_path
from ..streaming.changes import track_changes
from ..streaming.windows import session_alerts, sliding_alerts, write_windows
from .registry import query

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
# The table has times without a zone; they count as UTC whatever the session's zone is.
TIME = "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)) as ts"
PRED = "case when value >= 80 then 0 when value >= 30 then 1 else 2 end as pred"
DELAY_MS = 3_600_000


def _scored(events: DataFrame) -> DataFrame:
    """Each event is a record of its user, whose class follows from the value."""
    return events.selectExpr("event_id", "user_id", TIME, "event_type", "value", PRED)


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark.readStream.schema(EVENTS).parquet(f"{d}/events.parque[t]"))


def _finished(spark: SparkSession, start) -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    sink, marks = work_path(spark, "stream"), work_path(spark, "marks")
    run = start(sink, marks)
    run.awaitTermination()
    return spark.read.parquet(sink)


SCORED_EVENTS_SQL = f"""scored as (select event_id, user_id, epoch_us(ts) as us, event_type, value, {PRED} from events),
mark as (select (max(us) // 1000 - {DELAY_MS}) * 1000 as settled from scored)"""
COUNTS_SQL = "count(*) as n, count(*) filter (where pred = 0) as n_high, count(*) filter (where pred = 1) as n_medium, count(*) filter (where pred = 2) as n_low"


@query("score_stream_changes", f"""with {SCORED_EVENTS_SQL},
ordered as (select *, lag(pred) over (partition by user_id order by us, event_id) as class_before from scored, mark where us <= settled)
select user_id, us as at_us, event_id, class_before, pred as class_after from ordered where class_before is null or class_before <> pred""")
def _changes(spark, d):
    """Class changes of every user, settled up to an hour before the latest event."""
    rows = _finished(spark, lambda sink, marks: track_changes(_arriving(spark, d), "user_id", "ts", "event_id", "1 hour", sink, marks))
    return rows.selectExpr("user_id", "unix_micros(ts) as at_us", "event_id", "class_before", "class_after")


SLIDE_US = 2 * 3600 * 1_000_000


@query("alert_windows", f"""with {SCORED_EVENTS_SQL},
placed as (select (us // {SLIDE_US} - back) * {SLIDE_US} as start_us, pred from scored, range(0, 3) t(back))
select start_us, start_us + 3 * {SLIDE_US} as end_us, {COUNTS_SQL} from placed, mark
where start_us + 3 * {SLIDE_US} <= settled group by start_us""")
def _windows(spark, d):
    """Classes per six hours, every two hours."""
    windows = sliding_alerts(_arriving(spark, d), "ts", "1 hour", "6 hours", "2 hours")
    rows = _finished(spark, lambda sink, marks: write_windows(windows, sink, marks))
    return rows.selectExpr("unix_micros(window_start) as start_us", "unix_micros(window_end) as end_us", "n", "n_high", "n_medium", "n_low")


GAP_US = 3 * 3600 * 1_000_000


@query("alert_sessions", f"""with {SCORED_EVENTS_SQL},
marked as (select *, case when us - lag(us) over (partition by user_id order by us) <= {GAP_US} then 0 else 1 end as first from scored),
numbered as (select *, sum(first) over (partition by user_id order by us, event_id rows unbounded preceding) as nth from marked),
sessions as (select user_id, min(us) as start_us, max(us) + {GAP_US} as end_us, {COUNTS_SQL} from numbered group by user_id, nth)
select sessions.* from sessions, mark where end_us <= settled""")
def _sessions(spark, d):
    """Classes per session of a user; three quiet hours end one."""
    windows = session_alerts(_arriving(spark, d), "user_id", "ts", "1 hour", "3 hours")
    rows = _finished(spark, lambda sink, marks: write_windows(windows, sink, marks))
    return rows.selectExpr("user_id", "unix_micros(window_start) as start_us", "unix_micros(window_end) as end_us", "n", "n_high", "n_medium", "n_low")


@query("score_asof", f"""with {SCORED_EVENTS_SQL}
select e.event_id, e.user_id, e.us as at_us, s.us as score_us, s.value, s.pred
from (select * from scored where event_type in ('purchase', 'error')) e
asof left join (select * from scored where event_type in ('view', 'click')) s on e.user_id = s.user_id and e.us >= s.us""")
def _asof(spark, d):
    """Purchases and errors with the user's latest score, which views and clicks give."""
    rows = _scored(spark.read.schema(EVENTS).parquet(f"{d}/events.parquet"))
    events = rows.filter("event_type in ('purchase', 'error')").select("event_id", "user_id", "ts")
    scores = rows.filter("event_type in ('view', 'click')")
    found = asof_join(events, scores, "user_id", "ts", ["value", "pred"], "event_id")
    return found.selectExpr("event_id", "user_id", "unix_micros(ts) as at_us", "unix_micros(score_ts) as score_us", "value", "pred")
