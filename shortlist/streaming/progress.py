"""Progress events: latest state, seeding, heartbeats, runs, staleness and stage timings.

Functions that take a DataFrame work on batch and streaming input alike unless they say batch.
Runs and timings need an order over a job's events that one hot job must not funnel into one
task, so on a stream they run the batch form inside `foreachBatch` and carry what is still open
from one micro-batch to the next in a table numbered by batch. The forms with keyed state, for
events out of order and without such tables, are in `keyed`.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from shortlist.cluster import distributed_lead, distributed_running_sum
from shortlist.functions import fixed

JOB = "job_position_id"
TERMINAL = ("completed", "failed")


def latest_progress(events: DataFrame) -> DataFrame:
    """Newest event per job, by time then sequence. Partial maxima travel, not events."""
    newest = F.max_by(F.struct("seq", "ts", "stage", "processed", "total"), F.struct("ts", "seq"))
    return events.groupBy(JOB).agg(newest.alias("_e")).select(JOB, "_e.*")


def seeds(jobs: DataFrame) -> DataFrame:
    """Stored snapshots as events that sort before every live one."""
    return jobs.select(
        JOB,
        F.lit(-1).cast("long").alias("seq"),
        F.col("updated_at").cast("timestamp").alias("ts"),
        F.coalesce("current_stage", F.lit("parsing")).alias("stage"),
        F.col("processed_cvs").alias("processed"),
        F.col("total_cvs").alias("total"),
    )


def seeded_progress(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Seed first, then live events. For a live stream read the snapshots as a stream too."""
    return seeds(jobs).unionByName(events.select(JOB, "seq", "ts", "stage", "processed", "total"))


def heartbeat_rows(jobs: DataFrame, now: datetime) -> DataFrame:
    """One heartbeat per job with an open run."""
    return jobs.where(F.col("status") == "PROCESSING").select(
        JOB,
        F.lit(now).cast("timestamp").alias("ts"),
        F.lit("heartbeat").alias("stage"),
        F.lit(0).alias("processed"),
        F.lit(0).alias("total"),
    )


def start_heartbeats(
    spark, read_jobs, emit, checkpoint: str, every: str = f"{fixed.HEARTBEAT_SECONDS} seconds"
) -> StreamingQuery:
    """Every 15 seconds hand the heartbeats of the jobs then open to `emit(df, batch_id)`."""

    def beat(_ticks: DataFrame, batch_id: int) -> None:
        emit(heartbeat_rows(read_jobs(), datetime.now()), batch_id)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.foreachBatch(beat)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )


def _run_parts(events: DataFrame) -> DataFrame:
    """Batch: events summed up per (job, run_no), a run ending with its terminal event."""
    ends = F.col("stage").isin(*TERMINAL).cast("int")
    ordered = distributed_running_sum(
        events.select(JOB, "seq", "ts", "stage", "processed", "total"),
        [JOB], [F.col("ts").asc(), F.col("seq").asc()], ends, "_ended",
    )
    numbered = ordered.withColumn("run_no", F.col("_ended") - ends)
    last = F.max_by(F.struct("ts", "seq", "stage", "processed", "total"), F.struct("ts", "seq"))
    return numbered.groupBy(JOB, "run_no").agg(
        F.min("ts").alias("started"), last.alias("last"), F.count(F.lit(1)).alias("events")
    )


def _finish(parts: DataFrame) -> DataFrame:
    """Run rows; a failed run reports 0 of 0."""
    stage = F.col("last.stage")
    failed = stage == "failed"
    return parts.select(
        JOB,
        "started",
        F.col("last.ts").alias("ended"),
        "events",
        F.when(stage.isin(*TERMINAL), stage).otherwise("open").alias("outcome"),
        F.when(failed, F.lit(0)).otherwise(F.col("last.processed")).alias("processed"),
        F.when(failed, F.lit(0)).otherwise(F.col("last.total")).alias("total"),
    )


def progress_sessions(events: DataFrame) -> DataFrame:
    """Batch: one row per run of each job. The event after a terminal one opens the next run."""
    return _finish(_run_parts(events))


def stream_sessions(
    events: DataFrame, out: str, state: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append runs to `out` as they close; open ones, at most one per job, wait in `state`.

    Each micro-batch reads state n-1 and overwrites its own folders n, so a repeated batch changes
    nothing. A job's events are expected in order across batches.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        parts = _run_parts(batch)
        if batch_id > 0:
            carried = batch.sparkSession.read.parquet(f"{state}/{batch_id - 1}")
            parts = parts.unionByName(carried).groupBy(JOB, "run_no").agg(
                F.min("started").alias("started"),
                F.max_by("last", F.struct("last.ts", "last.seq")).alias("last"),
                F.sum("events").cast("long").alias("events"),
            )
        parts = parts.persist()
        closed = F.col("last.stage").isin(*TERMINAL)
        _finish(parts.where(closed)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        waiting = parts.where(~closed).withColumn("run_no", F.lit(0).cast("long"))
        waiting.write.mode("overwrite").parquet(f"{state}/{batch_id}")
        parts.unpersist()

    return (
        events.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stale_runs(events: DataFrame, minutes: int = fixed.STALE_MINUTES) -> DataFrame:
    """Batch: stretches of activity that went quiet for the cutoff without a terminal event.

    Events first collapse into one row per (job, cutoff-wide slot): inside a slot no gap can reach
    the cutoff, so this loses nothing, and a job's rows are then bounded by elapsed time.
    """
    from pyspark.sql import Window

    gap = minutes * 60_000_000
    micros = F.unix_micros("ts")
    last = F.max_by("stage", F.struct("ts", "seq"))
    slots = (
        events.groupBy(JOB, F.floor(micros / gap).alias("_slot"))
        .agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"),
             last.alias("_stage"), F.count(F.lit(1)).alias("_n"))
    )
    in_order = Window.partitionBy(JOB).orderBy("_slot")
    quiet = F.unix_micros("_from") - F.unix_micros(F.lag("_to").over(in_order)) > gap
    opened = slots.withColumn("_opens", F.coalesce(quiet, F.lit(True)).cast("int"))
    numbered = opened.withColumn("_session", F.sum("_opens").over(in_order))
    sessions = numbered.groupBy(JOB, "_session").agg(
        F.min("_from").alias("started"),
        F.max("_to").alias("last_event"),
        F.sum("_n").cast("long").alias("events"),
        F.max_by("_stage", "_slot").alias("last_stage"),
    )
    return _stale_only(sessions.drop("_session"), minutes)


def _stale_only(sessions: DataFrame, minutes: int) -> DataFrame:
    stale_at = F.col("last_event") + F.make_dt_interval(mins=F.lit(minutes))
    return sessions.where(~F.col("last_stage").isin(*TERMINAL)).select(
        JOB, "started", "last_event", stale_at.alias("stale_at"), "events", F.lit("failed").alias("stage")
    )


def stream_stale_runs(
    events: DataFrame, minutes: int = fixed.STALE_MINUTES, lateness: str = "1 minute"
) -> DataFrame:
    """Stream: the same rows, each emitted once the watermark shows the run went quiet."""
    sessions = (
        events.withWatermark("ts", lateness)
        .groupBy(JOB, F.session_window("ts", f"{minutes} minutes"))
        .agg(
            F.min("ts").alias("started"),
            F.max("ts").alias("last_event"),
            F.count(F.lit(1)).alias("events"),
            F.max_by("stage", F.struct("ts", "seq")).alias("last_stage"),
        )
    )
    return _stale_only(sessions, minutes)


def stage_timings(op_events: DataFrame, within: str | None = None) -> DataFrame:
    """Batch: each `start` of a (job, op) paired with the next event when that is its end, and not
    later than `within` after it; an unfinished start stays with outcome `open`."""
    events = op_events.withColumn("_here", F.struct("ts", "seq", "phase"))
    led = distributed_lead(
        events, [JOB, "op"], [F.col("ts").asc(), F.col("seq").asc()], "_here", "_next"
    )
    ended = F.col("_next.phase").isin("done", "failed")
    if within is not None:
        ended = ended & (F.col("_next.ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    took = (F.unix_micros("_next.ts") - F.unix_micros("ts")) / F.lit(1000.0)
    return led.where(F.col("phase") == "start").select(
        JOB,
        "op",
        "seq",
        F.col("ts").alias("started"),
        F.when(ended, F.col("_next.phase")).otherwise("open").alias("outcome"),
        F.when(ended, F.floor(took + F.lit(0.5))).alias("duration_ms"),
    )


def timing_totals(timings: DataFrame) -> DataFrame:
    return timings.groupBy(JOB, "op").agg(
        F.count_if(F.col("outcome") == "done").alias("ok"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "open").alias("open"),
        F.sum("duration_ms").alias("total_ms"),
    )


def stream_timings(
    op_events: DataFrame, out: str, state: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append finished timings to `out`; a start with nothing after it waits in `state` as the first
    event of its (job, op) in the next batch."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        columns = [JOB, "op", "phase", "ts", "seq"]
        arrived = batch.select(*columns).persist()
        events = arrived
        if batch_id > 0:
            events = arrived.unionByName(batch.sparkSession.read.parquet(f"{state}/{batch_id - 1}"))
        last = events.groupBy(JOB, "op").agg(
            F.max_by(F.struct("phase", "ts", "seq"), F.struct("ts", "seq")).alias("_e")
        )
        waiting = last.where(F.col("_e.phase") == "start").select(JOB, "op", "_e.*").select(*columns)
        waiting.write.mode("overwrite").parquet(f"{state}/{batch_id}")
        kept = batch.sparkSession.read.parquet(f"{state}/{batch_id}")
        done = stage_timings(events).join(kept.select(JOB, "op", "seq"), [JOB, "op", "seq"], "left_anti")
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        arrived.unpersist()

    return (
        op_events.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def progress_per_minute(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """Events per job, stage and tumbling minute."""
    if lateness is not None:
        events = events.withWatermark("ts", lateness)
    minute = F.window("ts", "1 minute")
    return (
        events.groupBy(JOB, "stage", minute)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(JOB, "stage", F.col("window.start").alias("minute"), "events")
    )
