"""Live runs, heartbeats and stalled runs with one state per job, and stage timings by a join of streams.

Events may come out of order within the lateness of the watermark: they wait in the job's state until the
watermark has passed them and are then taken in the order of time and sequence, so each form gives the
rows of its batch twin in `progress`. All state lives in the query's checkpoint, is dropped when it
is no longer needed, and any trigger will do.

Keyed state needs the RocksDB state store, which these functions choose for queries started after them.
A job's events go to one task; for a log with one job far above all others use the forms in `progress`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shortlist.functions import fixed
from shortlist.streaming.progress import JOB, TERMINAL

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "us long, seq long, stage string, processed int, total int"


def _flat(events: DataFrame) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return events.select(JOB, "ts", F.unix_micros("ts").alias("us"), "seq", "stage", "processed", "total")


def _row(out: str, *values) -> Row:
    return Row(**dict(zip([field.split()[0] for field in out.split(", ")], values)))


class _InOrder(StatefulProcessor):
    """Holds a job's events until the watermark has passed them and folds them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.run = handle.getValueState("run", self.RUN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [(r.us, r.seq, r.stage, r.processed, r.total) for r in rows]
        if came:
            self.waiting.appendList(came)
            for at in self.wake_at(came):
                self.handle.registerTimer(at // 1000 + 1)
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, watermark_ms: int) -> Iterator[Row]:
        passed = watermark_ms * 1000
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [e for e in held if e[0] <= passed]
        if due:
            rest = held[len(due) :]
            if rest:
                self.waiting.put([tuple(e) for e in rest])
            else:
                self.waiting.clear()
        run = self.run.get() if self.run.exists() else None
        before = run
        for event in due:
            run, done = self.fold(run, event)
            yield from self.rows(key, done)
        run, done = self.at_rest(run, passed)
        yield from self.rows(key, done)
        if run is None:
            if before is not None:
                self.run.clear()
        elif run != before:
            self.run.update(tuple(run))

    def wake_at(self, came: list) -> set:
        raise NotImplementedError

    def fold(self, run, event):
        raise NotImplementedError

    def at_rest(self, run, passed: int):
        return run, []

    def rows(self, key, done) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Runs(_InOrder):
    """A terminal event closes the run, gives its row and clears the job's state."""

    RUN = "started long, events long"
    OUT = f"{JOB} {{key}}, started_us long, ended_us long, events long, outcome string, processed int, total int"

    def wake_at(self, came):
        return {e[0] for e in came if e[2] in TERMINAL}

    def fold(self, run, event):
        us, _, stage, processed, total = event
        started, events = run if run is not None else (us, 0)
        if stage not in TERMINAL:
            return (started, events + 1), []
        failed = stage == "failed"
        return None, [(started, us, events + 1, stage, 0 if failed else processed, 0 if failed else total)]

    def rows(self, key, done):
        for row in done:
            yield _row(self.OUT, *key, *row)


class _Stale(_InOrder):
    """A job that is quiet for longer than the cutoff without a terminal event gives a row."""

    RUN = "started long, last long, events long, stage string"
    OUT = f"{JOB} {{key}}, started_us long, last_us long, stale_us long, events long, stage string"

    def __init__(self, minutes: int):
        self.gap = minutes * 60_000_000

    def wake_at(self, came):
        return {max(e[0] for e in came) + self.gap}

    def fold(self, run, event):
        us, _, stage, _, _ = event
        if run is not None and us - run[1] <= self.gap:
            return (run[0], us, run[2] + 1, stage), []
        return (us, us, 1, stage), [] if run is None else [run]

    def at_rest(self, run, passed):
        if run is not None and passed - run[1] > self.gap:
            return None, [run]
        return run, []

    def rows(self, key, done):
        for started, last, events, stage in done:
            if stage not in TERMINAL:
                yield _row(self.OUT, *key, started, last, last + self.gap, events, "failed")


class _Heartbeats(StatefulProcessor):
    """While a job's run is open, a row every so often by the clock; its terminal event ends that."""

    OUT = f"{JOB} {{key}}, at_ms long, stage string, processed int, total int"

    def __init__(self, seconds: float):
        self.every = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long, seq long, open boolean")

    def _quiet(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = max((r.us, r.seq, r.stage not in TERMINAL) for r in rows)
        held = self.newest.get() if self.newest.exists() else None
        if held is not None and tuple(held) > last:
            return
        was_open = held is not None and held[2]
        if last[2] and not was_open:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
        if last[2]:
            self.newest.update(last)
        else:
            self._quiet()
            self.newest.clear()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.newest.exists():
            now = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.every)
            yield _row(self.OUT, *key, now, "heartbeat", 0, 0)

    def close(self) -> None:
        pass


def _apply(events: DataFrame, processor, mode: str) -> DataFrame:
    kind = events.schema[JOB].dataType.simpleString()
    return events.groupBy(JOB).transformWithState(processor, processor.OUT.format(key=kind), "Append", mode)


def _times(df: DataFrame, **names: str) -> DataFrame:
    for new, old in names.items():
        df = df.withColumn(new, F.timestamp_micros(old))
    return df.drop(*names.values())


def live_runs(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Stream: the closed rows of `progress_sessions`, each once its terminal event is passed."""
    runs = _apply(_flat(events).withWatermark("ts", lateness), _Runs(), "EventTime")
    return _times(runs, started="started_us", ended="ended_us")


def live_stale_runs(events: DataFrame, minutes: int = fixed.STALE_MINUTES, lateness: str = "1 minute") -> DataFrame:
    """Stream: the rows of `stale_runs`, each once the watermark has passed its cutoff."""
    runs = _apply(_flat(events).withWatermark("ts", lateness), _Stale(minutes), "EventTime")
    return _times(runs, started="started_us", last_event="last_us", stale_at="stale_us")


def heartbeats(events: DataFrame, seconds: float = fixed.HEARTBEAT_SECONDS) -> DataFrame:
    """Stream: a heartbeat per open job every so many seconds from its first event to its terminal one."""
    beats = _apply(_flat(events).drop("ts"), _Heartbeats(seconds), "ProcessingTime")
    return beats.withColumn("ts", F.timestamp_millis("at_ms")).drop("at_ms")


def joined_timings(op_events: DataFrame, within: str = "15 minutes", lateness: str = "1 minute") -> DataFrame:
    """Stream: the rows of `stage_timings(op_events, within)`.

    Starts and all events are two streams joined on (job, op) up to `within` after the start; the join is
    outer, so an unfinished start comes out as open once the bound has passed. Of the events that
    follow a start only the first counts, and it ends the start if it is its done or failed.
    """
    # the test names the time, so it stays above the watermark, which then advances with every event
    is_start = F.when(F.col("started").isNotNull(), F.col("phase") == "start")
    starts = op_events.withColumn("started", F.col("ts")).withWatermark("started", lateness).where(is_start).select(JOB, "op", "seq", "started")
    events = op_events.select(
        F.col(JOB).alias("_job"), F.col("op").alias("_op"), F.col("seq").alias("_seq"), F.col("phase").alias("_phase"), F.col("ts").alias("_ts")
    ).withWatermark("_ts", lateness)
    follows = (F.col("_ts") > F.col("started")) | ((F.col("_ts") == F.col("started")) & (F.col("_seq") > F.col("seq")))
    met = starts.join(
        events,
        (F.col(JOB) == F.col("_job")) & (F.col("op") == F.col("_op")) & (F.col("_ts") >= F.col("started"))
        & (F.col("_ts") <= F.col("started") + F.expr(f"INTERVAL {within}")) & follows,
        "leftOuter",
    )
    first = F.min_by(F.struct("_phase", "_ts"), F.struct("_ts", "_seq"))
    paired = met.groupBy(JOB, "op", "seq", "started").agg(first.alias("_next"))
    ended = F.coalesce(F.col("_next._phase").isin("done", "failed"), F.lit(False))
    took = (F.unix_micros("_next._ts") - F.unix_micros("started")) / F.lit(1000.0)
    return paired.select(
        JOB, "op", "seq", "started",
        F.when(ended, F.col("_next._phase")).otherwise("open").alias("outcome"),
        F.when(ended, F.floor(took + F.lit(0.5))).alias("duration_ms"),
    )
