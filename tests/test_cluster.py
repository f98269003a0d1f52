"""Distributed ordering and intake helpers."""

import os
import random

import pytest
from pyspark.sql import Window, functions as F

from shortlist import cluster, schemas
from shortlist.sources import files, layout, tables


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 10 < 8 else f"g{i % 7}", rng.randint(0, 20)) for i in range(4000)] + [(5000, None, 3), (5001, None, 1)]
    return spark.createDataFrame(rows, "id int, g string, v int").repartition(5)


def test_running_sum_and_row_number(skewed):
    order = [F.col("v").desc(), F.col("id").asc()]
    window = Window.partitionBy("g").orderBy(*order)
    want = skewed.withColumn("n", F.row_number().over(window)).withColumn(
        "s", F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, 0))
    )
    got = cluster.distributed_row_number(skewed, ["g"], order, "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.drop("s").collect()))
    sums = cluster.distributed_running_sum(skewed, ["g"], order, F.col("v"), "s")
    assert sorted(map(str, sums.collect())) == sorted(map(str, want.drop("n").collect()))


def test_lead(skewed):
    order = [F.col("v").asc(), F.col("id").asc()]
    want = skewed.withColumn("nxt", F.lead("id").over(Window.partitionBy("g").orderBy(*order)))
    got = cluster.distributed_lead(skewed, ["g"], order, "id", "nxt")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_group_is_split_over_slices(skewed):
    sliced = cluster._slices(skewed, ["g"], [F.col("v").asc(), F.col("id").asc()])
    assert sliced.where("g = 'hot'").select("_slice").distinct().count() > 1


class Session:
    """Just enough of a session to ask for its shared folder."""

    def __init__(self, master, conf, folder=None):
        self.conf = conf
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda _: folder})()


def test_shared_folder(spark):
    assert cluster.shared_folder(Session("yarn", {"spark.checkpoint.dir": "hdfs:///c"})) == "hdfs:///c"
    assert cluster.shared_folder(Session("yarn", {}, "hdfs:///set")) == "hdfs:///set"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cluster.shared_folder(Session("yarn", {}))
    assert cluster.shared_folder(spark) == cluster.shared_folder(spark)


def test_cut_lineage_reads_only_the_columns_asked_for(spark):
    stored = cluster.cut_lineage(spark.range(5).withColumn("wide", F.lit("x")))
    plan = stored.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan.split("ReadSchema")[1]
    assert stored.count() == 5


def test_read_route_decode(spark, tmp_path):
    (tmp_path / "ok.TXT").write_bytes(b"  \n" + b"plain words " * 6 + b"\xff end \n")
    (tmp_path / "short.txt").write_bytes(b"short")
    (tmp_path / "my cv.pdf").write_bytes(b"%PDF")
    (tmp_path / "photo.png").write_bytes(b"x")
    read = files.read_cv_files(spark, str(tmp_path))
    got = {r.filename: (r.mime_type, r.length) for r in read.collect()}
    assert got["my cv.pdf"] == ("application/pdf", 4) and got["photo.png"][0] == "application/octet-stream"
    routed = files.route_format(read.withColumnRenamed("filename", "original_filename"))
    assert {r.original_filename: r.format for r in routed.collect()} == {
        "ok.TXT": "txt", "short.txt": "txt", "my cv.pdf": "pdf", "photo.png": "unsupported"}
    text = {r.original_filename: (r.raw_text, r.parsing_confidence) for r in files.decode_text(routed.where("format = 'txt'")).collect()}
    assert text["short.txt"] == ("short", "low")
    assert text["ok.TXT"][0].endswith("� end") and text["ok.TXT"][1] == "high"


def test_guard(spark):
    rows = [("big", "f0", 10 * 1024 * 1024 + 1), ("big", "f1", 1), ("fine", "f0", 10 * 1024 * 1024)]
    rows += [("many", f"f{i}", 1) for i in range(501)]
    uploads = spark.createDataFrame(rows, "batch_id string, filename string, length bigint")
    batches = spark.createDataFrame([("big",), ("fine",), ("many",), ("none",)], "batch_id string")
    accepted, rejected = files.guard_uploads(uploads, batches)
    assert [r.batch_id for r in accepted.collect()] == ["fine"]
    reasons = {r.batch_id: r.reason for r in rejected.collect()}
    assert reasons["big"].startswith("One or more files") and reasons["many"].startswith("Too many")
    assert reasons["none"] == "No files uploaded"


def _page(items):
    """The page rule as a plain loop over parts."""
    parts, height = [], 12.0
    for i, (text, y, h, eol) in enumerate(items):
        size = h if h and h > 0 else height
        if i:
            _, old_y, _, old_eol = items[i - 1]
            gap = abs(old_y - y)
            if gap > size * 1.8:
                parts.append("\n\n")
            elif old_eol or gap > size * 0.4:
                parts.append("\n")
            elif parts and parts[-1][-1] not in " \n" and text and text[0] != " ":
                parts.append(" ")
        if text:
            parts.append(text)
        if h and h > 0:
            height = h
    import re

    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(parts)))


def test_layout_equals_plain_loop(spark):
    rng = random.Random(9)
    pages = [
        [(rng.choice(["", "a", "b ", " c", "de", "\n"]), float(rng.choice([0, 3, 5, 20, 40])), rng.choice([None, 0.0, 8.0, 12.0]), rng.random() < 0.3)
         for _ in range(rng.randint(1, 12))]
        for _ in range(200)
    ]
    rows = [(doc, 1, i, *item) for doc, items in enumerate(pages) for i, item in enumerate(items)]
    rng.shuffle(rows)
    got = layout.assemble_pages(spark.createDataFrame(rows, schemas.TEXT_ITEM_ROW))
    assert {r.doc_id: r.text for r in got.collect()} == {doc: _page(items) for doc, items in enumerate(pages)}


def test_write_and_read_back(spark, tmp_path):
    path = str(tmp_path / "cvs")
    rows = [(i, "a" if i % 3 else "b", None if i == 4 else float(i)) for i in range(9)]
    tables.write_cvs(spark.createDataFrame(rows, "cv_id bigint, job_position_id string, final_score double"), path)
    assert sorted(d for d in os.listdir(path) if d.startswith("job")) == ["job_position_id=a", "job_position_id=b"]
    read = tables.read_cvs(spark, path, ["a"])
    assert [r.cv_id for r in read.collect()] == [4, 8, 7, 5, 2, 1]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "job_position_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_write_many_jobs_and_read_some(spark, tmp_path):
    path = str(tmp_path / "cvs")
    rows = [(i, i % 500, None if i == 7 else float(i)) for i in range(1000)]
    tables.write_cvs(spark.createDataFrame(rows, "cv_id bigint, job_position_id int, final_score double"), path, many_jobs=True)
    assert len([d for d in os.listdir(path) if d.startswith("job")]) <= tables.JOB_BUCKETS
    read = tables.read_cvs(spark, path, [7, 8])
    assert [r.cv_id for r in read.collect()] == [7, 508, 507, 8]
    assert "job_bucket" not in read.columns and tables.read_cvs(spark, path).count() == 1000
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "job_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_every_cv_is_read_in_s1(spark):
    from checks.text_checks import s1_read_cvs

    sf = "/root/testdata/sf0.001"
    assert s1_read_cvs(spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_failed_rows_fit_the_stored_schema(spark):
    lost = spark.createDataFrame(
        [(1, "j", "a.pdf", "application/pdf", "why")],
        "cv_id bigint, job_position_id string, original_filename string, mime_type string, failure_reason string",
    )
    row = tables.failed_row(lost)
    stored = spark.createDataFrame([], schemas.CV_ROW)
    types = dict(stored.dtypes)
    assert all(types[name] == kind for name, kind in row.dtypes)


def test_more_uploads_take_more_tasks(spark, monkeypatch):
    rows = [(i % 40, f"f{i}", 20_000_000 if i % 80 == 3 else 1) for i in range(400)]
    uploads = spark.createDataFrame(rows, "batch_id int, filename string, length long")
    batches = spark.createDataFrame([(i,) for i in range(45)], "batch_id int")
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(cluster, "ROWS_A_TASK", 10)
    accepted, rejected = files.guard_uploads(uploads, batches)
    assert "hashpartitioning(batch_id" in (plan := accepted._jdf.queryExecution().executedPlan().toString()) and ", 40)" in plan
    assert accepted.count() == 390
    assert sorted((r.batch_id, r.filename is None) for r in rejected.collect()) == [(3, False)] * 10 + [(i, True) for i in range(40, 45)]
