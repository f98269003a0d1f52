"""The token index gives the rows of the term-by-term form."""

import random

import pytest
from pyspark.sql import functions as F

from shortlist import cluster
from shortlist.operators import keyword, token_index

REQS = "job_position_id string, req_pos int, requirement_id string, text string, type string, weight int, is_required boolean, keywords array<string>, synonyms array<string>"


def made(spark, jobs, lists, cvs, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["c++", ".net", "é", "漢字", "#", "🙂", "node.js", "a"]
    reqs = [
        (j, p, f"r{p}", "t", "x", rng.randint(1, 9), p % 2 == 0, [" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3])))], rng.choice([[], ["W-1 "], ["-"], ["w5", "w5 w6"]]))
        for j in jobs
        for p in range(lists)
    ]
    glue = [" ", " ", " ", "-", "_", ".", "é", ""]
    people = [
        (i, rng.choice([*jobs, "none", None]), ["".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 6))])
        for i in range(cvs)
    ]
    return spark.createDataFrame(reqs, REQS), spark.createDataFrame(people, "cv_id int, job_position_id string, sentences array<string>")


def verdicts(cvs, reqs):
    rows = keyword.keyword_filter(cvs, reqs).select("cv_id", "tier", "preliminary_score", "scored", "elimination_reason").collect()
    return {r["cv_id"]: r for r in rows}


def hits(cvs, reqs):
    long = cvs.select("cv_id", "job_position_id", F.posexplode("sentences").alias("pos", "sentence"))
    return sorted(map(str, keyword.match_sentences(long, reqs).collect()))


@pytest.mark.parametrize("limit", [50_000, 10])
def test_index_equals_loop(spark, monkeypatch, limit):
    reqs, cvs = made(spark, ["a", "b"], 60, 150)
    monkeypatch.setattr(token_index, "LONG_LIST", 10**9)
    want, want_hits = verdicts(cvs, reqs), hits(cvs, reqs)
    assert len(want_hits) > 200
    monkeypatch.setattr(token_index, "LONG_LIST", 5)
    monkeypatch.setattr(token_index, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(cluster, "LEAST_ROWS", 3)
    assert verdicts(cvs, reqs) == want
    assert hits(cvs, reqs) == want_hits


def test_five_thousand_terms_a_job(spark, monkeypatch):
    reqs, cvs = made(spark, ["a"], 3800, 20, seed=5)
    assert keyword.needles(reqs).count() > 5000
    got, got_hits = verdicts(cvs, reqs), hits(cvs, reqs)
    monkeypatch.setattr(token_index, "LONG_LIST", 10**9)
    assert got == verdicts(cvs, reqs) and got_hits == hits(cvs, reqs)


def test_long_and_short_lists_side_by_side(spark, monkeypatch):
    one, cvs = made(spark, ["a"], 60, 80)
    two, more = made(spark, ["b"], 3, 80, seed=8)
    both, all_cvs = one.unionByName(two), cvs.unionByName(more.withColumn("cv_id", F.col("cv_id") + 1000))
    monkeypatch.setattr(token_index, "LONG_LIST", 10**9)
    want = verdicts(all_cvs, both)
    monkeypatch.setattr(token_index, "LONG_LIST", 30)
    assert verdicts(all_cvs, both) == want


def test_salts_follow_the_share_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(cluster, "LEAST_ROWS", 10)
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(900)], "k string, i int")
    salts = {r["k"]: r["_salts"] for r in cluster.measured_salts(rows, ["k"]).collect()}
    assert list(salts) == ["hot"] and 4 <= salts["hot"] <= 8
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 1)
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    got = cluster.salted_lookup(rows, table, ["k"], ["i"])
    assert got.groupBy("v").count().orderBy("v").collect()[0]["count"] == 600 and got.count() == 602


@pytest.mark.parametrize("group", [1000, 7])
def test_verdicts_without_sentences(spark, monkeypatch, group):
    reqs, cvs = made(spark, ["a", "b"], 60, 150)
    reqs = reqs.withColumn("weight", F.when(F.col("req_pos") != 7, F.col("weight")))
    wanted = ["cv_id", "job_position_id", "preliminary_score", "missing_required", "total_required", "tier", "elimination_reason"]
    monkeypatch.setattr(token_index, "GROUP_CVS", group)
    monkeypatch.setattr(token_index, "LONG_LIST", 10**9)
    want = sorted(map(str, keyword.keyword_filter(cvs, reqs).select(*wanted).collect()))
    monkeypatch.setattr(token_index, "LONG_LIST", 5)
    got = keyword.keyword_verdicts(cvs, reqs)
    assert "scored" not in got.columns
    assert sorted(map(str, got.select(*wanted).collect())) == want


def test_hits_of_long_lists_do_not_move(spark, monkeypatch):
    reqs, cvs = made(spark, ["a"], 60, 30)
    monkeypatch.setattr(token_index, "LONG_LIST", 5)
    long = cvs.select("cv_id", "job_position_id", F.posexplode("sentences").alias("pos", "sentence"))
    plan = keyword.match_sentences(long, reqs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [cv_id" not in plan
