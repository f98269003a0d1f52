"""Keyed state gives the batch twins' rows for events out of order, over restarts, and clears itself."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shortlist.streaming import keyed, progress

EVENTS = "job_position_id long, seq long, ts timestamp, stage string, processed int, total int"
OPS = "job_position_id long, op string, phase string, ts timestamp, seq long"
T0 = datetime(2024, 5, 1)
LATE = 50  # seconds an event may be late


def shuffled(rows, at):
    """In batches of arrival: each row up to LATE seconds after its time."""
    rng = random.Random(9)
    return sorted(rows, key=lambda r: (r[at] + timedelta(seconds=rng.uniform(0, LATE)), r))


def store(spark, rows, schema, folder, parts=6):
    """Files in order of arrival, one per micro-batch."""
    size = -(-len(rows) // parts)
    for n in range(parts):
        spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def finish(df, sink, check):
    query = df.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def given():
    rng = random.Random(1)
    out, seq = [], 0
    for job in range(6):
        at = T0 + timedelta(seconds=job)
        for _ in range(60):
            at += timedelta(seconds=rng.choice([1, 5, 30, 300, 1200]))
            stage = rng.choices(["parsing", "filtering", "scoring", "completed", "failed"], [4, 4, 4, 2, 1])[0]
            out.append((job, seq, at, stage, rng.randint(0, 9), 9))
            seq += 1
    return out


END = (99, 10**6, T0 + timedelta(days=9), "parsing", 0, 0)  # moves the watermark past all


@pytest.mark.parametrize("live, batch", [
    (keyed.live_runs, lambda e: progress.progress_sessions(e).where("outcome <> 'open'")),
    (keyed.live_stale_runs, progress.stale_runs),
])
def test_late_events_and_restarts_equal_the_batch_twin(spark, given, tmp_path, live, batch):
    arrived = shuffled(given, 2)
    half = len(arrived) // 2
    store(spark, arrived[:half], EVENTS, tmp_path / "in", 3)
    finish(live(stream(spark, EVENTS, tmp_path / "in")), tmp_path / "out", tmp_path / "check")
    before = spark.read.parquet(str(tmp_path / "out")).count()
    store(spark, arrived[half:] + [END], EVENTS, tmp_path / "in", 3)
    finish(live(stream(spark, EVENTS, tmp_path / "in")), tmp_path / "out", tmp_path / "check")
    got = spark.read.parquet(str(tmp_path / "out"))
    want = batch(spark.createDataFrame(given, EVENTS))
    assert 0 < before < got.count()
    assert rows(got) == rows(want.select(*got.columns))


def test_a_terminal_event_clears_the_state(spark, tmp_path):
    done = [(1, 0, T0, "parsing", 0, 3), (1, 1, T0 + timedelta(seconds=9), "completed", 3, 3), END]
    store(spark, done, EVENTS, tmp_path / "in", 1)
    finish(keyed.live_runs(stream(spark, EVENTS, tmp_path / "in")), tmp_path / "out", tmp_path / "check")
    left = spark.read.format("statestore").option("stateVarName", "run").load(str(tmp_path / "check")).collect()
    assert left == [] and spark.read.parquet(str(tmp_path / "out")).first()["events"] == 2


def test_heartbeats_of_open_jobs_by_the_clock(spark, tmp_path):
    now = [(1, 0, T0, "parsing", 0, 3), (2, 1, T0, "parsing", 0, 3)]
    store(spark, now, EVENTS, tmp_path / "in", 1)
    beats = keyed.heartbeats(stream(spark, EVENTS, tmp_path / "in"), 1.0)
    query = beats.writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()

    def until(condition, limit=90):
        deadline = time.time() + limit
        while not condition() and time.time() < deadline:
            assert query.exception() is None
            time.sleep(0.5)
        assert condition()

    def of(job):
        return spark.table("beats").where(f"job_position_id = {job}").count()

    until(lambda: of(1) >= 2 and of(2) >= 2)
    store(spark, [(1, 5, T0 + timedelta(seconds=1), "completed", 3, 3)], EVENTS, tmp_path / "in", 1)
    batches = query.lastProgress["batchId"]
    until(lambda: query.lastProgress["batchId"] > batches + 4)
    ended, open_ = of(1), of(2)
    until(lambda: of(2) >= open_ + 2)
    query.stop()
    assert of(1) == ended
    assert {tuple(r) for r in spark.table("beats").select("stage", "processed", "total").collect()} == {("heartbeat", 0, 0)}


def test_joined_timings_equal_the_batch_twin_out_of_order(spark, tmp_path):
    rng = random.Random(3)
    ops, at = [], T0
    for seq in range(400):
        at += timedelta(seconds=rng.choice([0, 1, 20, 90]))
        ops.append((rng.randrange(3), f"op{rng.randrange(2)}", rng.choice(["start", "start", "done", "failed"]), at, seq))
    end = [(99, "op", "done", T0 + timedelta(days=9), 10**6), (99, "op", "done", T0 + timedelta(days=12), 10**6 + 1)]
    store(spark, shuffled(ops, 3), OPS, tmp_path / "in", 5)
    finish(keyed.joined_timings(stream(spark, OPS, tmp_path / "in"), "2 minutes"), tmp_path / "out", tmp_path / "check")
    store(spark, end[:1], OPS, tmp_path / "in", 1)
    store(spark, end[1:], OPS, tmp_path / "in", 1)
    finish(keyed.joined_timings(stream(spark, OPS, tmp_path / "in"), "2 minutes"), tmp_path / "out", tmp_path / "check")
    got = spark.read.parquet(str(tmp_path / "out"))
    want = progress.stage_timings(spark.createDataFrame(ops, OPS), "2 minutes")
    assert {r["outcome"] for r in want.collect()} == {"done", "failed", "open"}
    assert rows(got) == rows(want.select(*got.columns))
