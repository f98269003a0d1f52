"""Batch forms of the streaming operators over every event. Tests hold the streams to the same rows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.registry import check
from shortlist.streaming import progress

BASE = sql.with_(sql.EVENTS)
JOB = "job_position_id"


def micros(df, *names):
    """Timestamps as microseconds, so that no time zone enters the comparison."""
    return df.withColumns({n: F.unix_micros(n) for n in names})


@check(
    "t2_latest_progress",
    BASE + """SELECT job_position_id, seq, epoch_us(ts) AS ts, stage, processed, total FROM
    (SELECT *, row_number() OVER (PARTITION BY job_position_id ORDER BY ts DESC, seq DESC) AS n FROM progress) WHERE n = 1""",
)
def t2_latest_progress(spark, sf):
    return micros(progress.latest_progress(inputs.progress_events(spark, sf)), "ts")


@check(
    "t3_seeded_progress",
    sql.with_(sql.EVENTS, sql.JOBS) + """SELECT job_position_id, seq, epoch_us(ts) AS ts, stage, processed, total FROM progress
    UNION ALL SELECT job_position_id, -1, epoch_us(updated_at), coalesce(current_stage, 'parsing'), processed_cvs, total_cvs FROM jobs""",
)
def t3_seeded_progress(spark, sf):
    return micros(progress.seeded_progress(inputs.progress_events(spark, sf), inputs.jobs(spark, sf)), "ts")


@check(
    "t4_heartbeat_rows",
    sql.with_(sql.JOBS) + """SELECT job_position_id, epoch_us(TIMESTAMP '2024-01-01') AS ts, 'heartbeat' AS stage, 0 AS processed, 0 AS total
    FROM jobs WHERE status = 'PROCESSING'""",
)
def t4_heartbeat_rows(spark, sf):
    rows = progress.heartbeat_rows(inputs.jobs(spark, sf), datetime(2024, 1, 1, tzinfo=timezone.utc))
    return micros(rows, "ts")


RUNS = """runs AS (SELECT *, coalesce(sum(CASE WHEN stage IN ('completed', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY job_position_id
 ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM progress),
sessions AS (SELECT job_position_id, run, min(ts) AS started, max(ts) AS ended, count(*) AS events, arg_max(stage, (ts, seq)) AS stage,
 arg_max(processed, (ts, seq)) AS processed, arg_max(total, (ts, seq)) AS total FROM runs GROUP BY 1, 2)"""
SESSION_ROWS = """SELECT job_position_id, epoch_us(started) AS started, epoch_us(ended) AS ended, events,
 CASE WHEN stage IN ('completed', 'failed') THEN stage ELSE 'open' END AS outcome,
 CASE WHEN stage = 'failed' THEN 0 ELSE processed END AS processed, CASE WHEN stage = 'failed' THEN 0 ELSE total END AS total FROM sessions"""


@check("t5_progress_sessions", sql.with_(sql.EVENTS, RUNS) + SESSION_ROWS)
def t5_progress_sessions(spark, sf):
    return micros(progress.progress_sessions(inputs.progress_events(spark, sf)), "started", "ended")


@check(
    "t5_sessions_one_hot_job",
    sql.with_(sql.EVENTS.replace("user_id AS job_position_id", "0 AS job_position_id"), RUNS) + SESSION_ROWS,
)
def t5_sessions_one_hot_job(spark, sf):
    """Every event belongs to one job: the running order must still spread over tasks."""
    hot = inputs.progress_events(spark, sf).withColumn(JOB, F.lit(0))
    return micros(progress.progress_sessions(hot), "started", "ended")


@check(
    "t6_stale_runs",
    sql.with_(sql.EVENTS) + """, marked AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 900000000 THEN 0 ELSE 1 END AS opens
      FROM progress WINDOW w AS (PARTITION BY job_position_id ORDER BY ts, seq)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY job_position_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM marked)
    SELECT job_position_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS last_event, epoch_us(max(ts)) + 900000000 AS stale_at,
     count(*) AS events, 'failed' AS stage FROM numbered GROUP BY job_position_id, session
    HAVING arg_max(stage, (ts, seq)) NOT IN ('completed', 'failed')""",
)
def t6_stale_runs(spark, sf):
    return micros(progress.stale_runs(inputs.progress_events(spark, sf)), "started", "last_event", "stale_at")


def op_events(spark, sf, one_job=False):
    """Starts and ends of three operations per job."""
    kind = F.col("event_type")
    phase = F.when(kind.isin("view", "click"), "start").when(kind.isin("purchase", "signup"), "done").otherwise("failed")
    return inputs.table(spark, sf, "events").select(
        F.lit(0).cast("long").alias(JOB) if one_job else F.col("user_id").alias(JOB),
        F.concat(F.lit("op"), (F.col("event_id") % 3).cast("string")).alias("op"),
        phase.alias("phase"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


OPS = """ops AS (SELECT user_id AS job_position_id, 'op' || event_id % 3 AS op, event_id AS seq, ts,
 CASE WHEN event_type IN ('view', 'click') THEN 'start' WHEN event_type IN ('purchase', 'signup') THEN 'done' ELSE 'failed' END AS phase FROM events),
led AS (SELECT *, lead(phase) OVER w AS next_phase, lead(ts) OVER w AS next_ts FROM ops WINDOW w AS (PARTITION BY job_position_id, op ORDER BY ts, seq)),
timed AS (SELECT job_position_id, op, seq, epoch_us(ts) AS started, CASE WHEN next_phase IN ('done', 'failed') THEN next_phase ELSE 'open' END AS outcome,
 CASE WHEN next_phase IN ('done', 'failed') THEN floor((epoch_us(next_ts) - epoch_us(ts)) / 1000 + 0.5)::BIGINT END AS duration_ms FROM led WHERE phase = 'start')"""


@check("t7_stage_timings", sql.with_(OPS) + "SELECT * FROM timed")
def t7_stage_timings(spark, sf):
    return micros(progress.stage_timings(op_events(spark, sf)), "started")


@check("t7_timings_one_hot_job", sql.with_(OPS.replace("user_id AS job_position_id", "0 AS job_position_id")) + "SELECT * FROM timed")
def t7_timings_one_hot_job(spark, sf):
    return micros(progress.stage_timings(op_events(spark, sf, one_job=True)), "started")


@check(
    "t7_timing_totals",
    sql.with_(OPS) + """SELECT job_position_id, op, count(*) FILTER (WHERE outcome = 'done') AS ok, count(*) FILTER (WHERE outcome = 'failed') AS failed,
    count(*) FILTER (WHERE outcome = 'open') AS open, sum(duration_ms)::BIGINT AS total_ms FROM timed GROUP BY 1, 2""",
)
def t7_timing_totals(spark, sf):
    return progress.timing_totals(progress.stage_timings(op_events(spark, sf)))


@check(
    "t7_progress_per_minute",
    BASE + """SELECT job_position_id, stage, epoch_us(date_trunc('minute', ts)) AS minute, count(*) AS events FROM progress GROUP BY ALL""",
)
def t7_progress_per_minute(spark, sf):
    return micros(progress.progress_per_minute(inputs.progress_events(spark, sf)), "minute")
