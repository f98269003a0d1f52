"""Repeats of a key, ranking of hot groups, long rank lists, page assembly in linear time."""

import random
import time

import pytest
from pyspark.sql import Window, functions as F

from shortlist import cluster
from shortlist.operators import lifecycle, views
from shortlist.sources.layout import assemble_pages
from shortlist.sources.tables import insert_absent


def test_new_rows_of_one_key_go_in_once(spark):
    base = spark.createDataFrame([(1, "old", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(1, "x", 1), (2, "a", 1), (2, "b", 2)], "k int, v string, seq int")
    assert sorted((r.k, r.v) for r in insert_absent(base, new, ["k"]).collect()) == [(1, "old"), (2, "b")]


def test_repeated_totals_of_a_job_are_summed(spark):
    jobs = spark.createDataFrame(
        [("a", "PROCESSING", "scoring", 0, 0, 0, 0, 0, 1.0)],
        "job_position_id string, status string, current_stage string, total_cvs int, processed_cvs int, great_match_count int, good_match_count int, no_match_count int, ai_cost_usd double",
    ).withColumn("updated_at", F.current_timestamp())
    cvs = spark.createDataFrame([("c", "a", "good")], "cv_id string, job_position_id string, tier string")
    totals = spark.createDataFrame([("a", 0.5), ("a", 0.25)], "job_position_id string, ai_cost_delta double")
    done = lifecycle.complete_runs(jobs, cvs, totals).collect()
    assert [(r.status, r.ai_cost_usd, r.good_match_count) for r in done] == [("COMPLETED", 1.75, 1)]


def test_unordered_overrides_of_one_cv_are_refused(spark):
    cvs = spark.createDataFrame([(1, "a", "good", None)], "cv_id long, job_position_id string, tier string, elimination_reason string")
    given = spark.createDataFrame([(1, "a", "great"), (1, "a", "no-match")], "cv_id long, job_position_id string, new_tier string")
    with pytest.raises(Exception, match="need seq"):
        lifecycle.override_tiers(cvs, given)[0].collect()
    same = lifecycle.override_tiers(cvs, given.where("new_tier = 'great'").union(given.where("new_tier = 'great'")))[0]
    assert [r.tier for r in same.collect()] == ["great"]


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(6)
    rows = [
        (i, "hot" if i % 3 else f"j{i % 50}", rng.choice(["great", "good", "good", None]), rng.choice([None, 0.0, 1.5, float(rng.randrange(2000))]))
        for i in range(9000)
    ]
    return spark.createDataFrame(rows, "cv_id int, job_position_id string, tier string, final_score double").repartition(6)


def test_rank_by_counting_equals_a_window(spark, scored, monkeypatch):
    monkeypatch.setattr(cluster, "LEAST_ROWS", 50)
    order = [F.coalesce("final_score", F.lit(0.0)).desc(), F.col("cv_id").asc()]
    want = scored.withColumn("bucket", views.tier_bucket(F.col("tier"))).withColumn(
        "rank_in_tier", F.row_number().over(Window.partitionBy("job_position_id", "bucket").orderBy(*order)).cast("long")
    )
    got = views.rank_in_tier(scored)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("n", [3, 1200, 5000])
def test_top_n_of_any_length(spark, scored, n):
    order = [F.col("final_score").desc_nulls_last(), F.col("cv_id").asc()]
    want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("job_position_id").orderBy(*order))).where(F.col("rank") <= n)
    got = views.top_n(scored, n, per_job=True)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_file_names_in_locale_order(spark, direction):
    names = ["a.pdf", "A.pdf", "b.pdf", "É.pdf", "e.pdf", "f.pdf", "Z.pdf", "_x.pdf", "1.pdf", "10.pdf", "2.pdf"]
    want = ["_x.pdf", "1.pdf", "10.pdf", "2.pdf", "a.pdf", "A.pdf", "b.pdf", "e.pdf", "É.pdf", "f.pdf", "Z.pdf"]
    cvs = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "cv_id int, original_filename string")
    got = [r.original_filename for r in views.sort_cvs(cvs, "originalFilename", direction).collect()]
    assert got == (want if direction == "asc" else want[::-1])


def page(spark, items):
    return spark.range(items).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("str"),
        (F.col("id") % 90 * 10.0).alias("y"), F.lit(10.0).alias("height"), (F.col("id") % 7 == 0).alias("has_eol"),
    )


def test_pages_take_time_in_proportion_to_their_items(spark):
    def seconds(items):
        started = time.perf_counter()
        assert len(assemble_pages(page(spark, items)).first().text) > items
        return time.perf_counter() - started

    seconds(1000)
    short, long = min(seconds(8000) for _ in range(3)), min(seconds(64_000) for _ in range(3))
    assert long < 12 * short + 1
