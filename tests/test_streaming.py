"""Streams run to the end of what is available must give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from checks import inputs
from checks.progress_checks import op_events
from shortlist import schemas
from shortlist.streaming import progress
from shortlist.streaming.ingest import stream_ingest


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def in_parts(spark, sf_dir, tmp_path_factory):
    """Events stored as five files in time order, read one file per micro-batch."""

    def store(df, name):
        path = str(tmp_path_factory.mktemp(name))
        split = df.withColumn("_part", F.floor(F.percent_rank().over(inputs_window()) * 4.999))
        split.persist()
        for part in range(5):
            split.where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        return stream

    def inputs_window():
        from pyspark.sql import Window

        return Window.orderBy("ts", "seq")

    return store


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return inputs.progress_events(spark, sf_dir)


def memory(spark, df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_latest_progress(spark, events, in_parts):
    got = memory(spark, progress.latest_progress(in_parts(events, "latest")), "latest_out", "complete")
    assert rows(got) == rows(progress.latest_progress(events))


def test_seeded_progress(spark, events, in_parts, sf_dir, tmp_path):
    jobs = inputs.jobs(spark, sf_dir)
    jobs.write.parquet(str(tmp_path / "jobs"))
    live_jobs = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "jobs"))
    got = memory(spark, progress.seeded_progress(in_parts(events, "seeded"), live_jobs), "seeded_out", "append")
    assert rows(got) == rows(progress.seeded_progress(events, jobs))


def test_progress_per_minute(spark, events, in_parts):
    got = memory(spark, progress.progress_per_minute(in_parts(events, "minute"), "1 minute"), "minute_out", "complete")
    assert rows(got) == rows(progress.progress_per_minute(events))


def test_sessions(spark, events, in_parts, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = progress.stream_sessions(in_parts(events, "sessions"), out, state, str(tmp_path / "check"))
    query.awaitTermination(240)
    assert query.exception() is None
    batch = progress.progress_sessions(events)
    assert rows(spark.read.parquet(out).drop("batch")) == rows(batch.where("outcome <> 'open'"))
    assert spark.read.parquet(f"{state}/4").count() == batch.where("outcome = 'open'").count()


def test_timings(spark, sf_dir, in_parts, tmp_path):
    ops = op_events(spark, sf_dir)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = progress.stream_timings(in_parts(ops, "ops"), out, state, str(tmp_path / "check"))
    query.awaitTermination(240)
    assert query.exception() is None
    batch = progress.stage_timings(ops)
    got = spark.read.parquet(out).drop("batch")
    waiting = spark.read.parquet(f"{state}/4")
    assert waiting.count() > 0
    keys = ["job_position_id", "op", "seq"]
    assert rows(got) == rows(batch.join(waiting.select(*keys), keys, "left_anti"))


def test_stale_runs(spark, events, in_parts):
    """The stream emits a stretch once the watermark has passed it; the newest ones stay open."""
    stream = progress.stream_stale_runs(in_parts(events, "stale"))
    got = memory(spark, stream, "stale_out", "append")
    newest = events.agg(F.max("ts")).first()[0]
    passed = F.col("stale_at") < F.lit(newest) - F.expr("INTERVAL 1 MINUTE")
    assert rows(got) == rows(progress.stale_runs(events).where(passed))


def test_heartbeats(spark, sf_dir, tmp_path):
    import time

    jobs = inputs.jobs(spark, sf_dir).persist()
    seen = {}
    query = progress.start_heartbeats(
        spark, lambda: jobs, lambda df, batch: seen.__setitem__(batch, df.count()), str(tmp_path / "check"), "1 second"
    )
    deadline = time.time() + 60
    while len(seen) < 2 and time.time() < deadline:
        time.sleep(0.5)
    query.stop()
    assert len(seen) >= 2
    assert set(seen.values()) == {jobs.where("status = 'PROCESSING'").count()}


def test_ingest(spark, tmp_path):
    reqs = spark.createDataFrame(
        [("j", 0, "r1", "Node", "technology", 9, True, ["node.js"], [])], schemas.REQUIREMENT_ROW
    )
    schema = "cv_id bigint, job_position_id string, original_filename string, mime_type string, raw_text string"
    given = [
        [(1, "j", "a.txt", "text/plain", "Built Node.js services. Ran Node.js. More Node.js for all of them.")],
        [(2, "j", "b.png", "image/png", "")],
        [(3, "j", "c.txt", "text/plain", "Nothing that anyone asked for stands in this text at all.")],
    ]
    for part in given:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = str(tmp_path / "sink")

    def start():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stream_ingest(stream, lambda: reqs, sink, str(tmp_path / "check"))
        query.awaitTermination(240)
        assert query.exception() is None

    start()
    got = {r.cv_id: (r.tier, r.parsing_confidence) for r in spark.read.parquet(sink).collect()}
    assert got == {1: ("great", "high"), 2: ("no-match", "failed"), 3: ("no-match", "high")}
    start()
    assert spark.read.parquet(sink).count() == 3
