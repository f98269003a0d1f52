"""Keyword stage, final stage, model stage and whole flows on small hand-made sets."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shortlist import cluster, schemas
from shortlist.operators import corpus, final, inference, keyword, lifecycle, requirements, scoring, views
from shortlist.plans import screening

NODE = ("j", 0, "r1", "Node.js experience", "technology", 9, True, ["node.js", "nodejs"], ["express"])
KUBE = ("j", 1, "r2", "Kubernetes", "technology", 9, True, ["kubernetes", "k8s"], [])
AWS = ("j", 2, "r3", "AWS", "technology", 4, False, ["aws"], [])


@pytest.fixture(scope="module")
def reqs(spark):
    return spark.createDataFrame([NODE, KUBE, AWS], schemas.REQUIREMENT_ROW)


def judged(spark, reqs, sentences):
    cvs = spark.createDataFrame([(1, "j", sentences)], "cv_id bigint, job_position_id string, sentences array<string>")
    return keyword.keyword_filter(cvs, reqs).first()


def test_eliminated_by_ratio(spark, reqs):
    row = judged(spark, reqs, ["Built applications with Python"])
    assert (row.tier, row.missing_required) == ("no-match", 2)
    assert row.elimination_reason == "Missing 2 of 2 required requirements"


def test_great_good_and_matches(spark, reqs):
    strong = ["Built Node.js services", "Node.js in production", "Scaled Node.js apps", "Managed Kubernetes",
              "Kubernetes again", "k8s expert", "AWS hosting", "AWS work", "AWS set-up"]
    assert judged(spark, reqs, strong).tier == "great"
    weak = judged(spark, reqs, ["Worked with Node.js recently", "Some exposure to Kubernetes"])
    assert weak.tier == "good" and weak.elimination_reason is None
    row = judged(spark, reqs, ["Node.js expert", "Built Express APIs", "Node.js expert", "asp.net"])
    assert row.scored[0].matched_sentences == ["Node.js expert", "Built Express APIs", "Node.js expert"]
    assert row.scored[0].score == 1.0 and row.scored[1].matched_sentences == []


def test_no_required_items_never_trip_the_ratio(spark):
    only = spark.createDataFrame([AWS], schemas.REQUIREMENT_ROW)
    row = judged(spark, only, ["nothing here"])
    assert row.tier == "no-match" and row.elimination_reason == "Score too low (0.0/100)"


def test_every_join_form_gives_the_same_rows(spark, reqs, monkeypatch):
    """Broadcast, salted shuffle, and long form agree, with one job holding nearly all rows."""
    rng = random.Random(3)
    words = ["node.js", "express", "k8s", "aws", "php", "kubernetes", "nodejs", "the"]
    rows = [
        (i, "j" if i % 20 else "other", [" ".join(rng.choice(words) for _ in range(3)) for _ in range(rng.randint(0, 6))])
        for i in range(300)
    ]
    cvs = spark.createDataFrame(rows, "cv_id bigint, job_position_id string, sentences array<string>")

    def nested():
        found = keyword.keyword_filter(cvs, reqs)
        return sorted((r.cv_id, round(r.preliminary_score, 6), r.tier, str(r.scored)) for r in found.collect())

    def long_form():
        exploded = cvs.select("cv_id", "job_position_id", F.posexplode("sentences").alias("pos", "sentence"))
        hits = keyword.collect_matches(keyword.match_sentences(exploded, reqs))
        return sorted((r.cv_id, r.requirement_id, tuple(r.matched_sentences)) for r in hits.collect())

    small = nested(), long_form()
    from_nested = sorted(
        (r.cv_id, r.requirement_id, tuple(r.matched_sentences))
        for r in keyword.score_rows(keyword.score_requirements(cvs, reqs)).collect() if r.matched_sentences
    )
    assert small[1] == from_nested
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 0)
    assert (nested(), long_form()) == small


@pytest.mark.parametrize(
    "ai, kw, expected",
    [
        ([1.0, 1.0, 1.0], [1.0, 1.0, 1.0], ("great", 100.0, 0)),
        (None, [1.0, 0.0, 1.0], ("no-match", 56.0, 1)),
        (None, [0.0, 0.0, 1.0], ("no-match", 12.0, 2)),
        ([0.7, 0.7, 0.8], [0.0, 0.0, 0.0], ("good", 71.0, 0)),
        ([0.55, 0.55, 0.55], [0.0, 0.0, 0.0], ("no-match", 55.0, 0)),
        ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0], ("no-match", 0.0, 2)),
        ([1.0, 0.0, 1.0], [0.0, 0.0, 0.0], ("no-match", 56.0, 1)),
        ([1.0, 1.0, 0.0], [0.0, 0.0, 0.0], ("great", 88.0, 0)),
        ([1.0, None, None], [1.0, 1.0, 1.0], ("great", 100.0, 0)),
    ],
)
def test_final_score(spark, ai, kw, expected):
    weights = [(9, True), (9, True), (5, False)]
    scored = [(i, f"r{i + 1}", w, req, kw[i]) for i, (w, req) in enumerate(weights)]
    entries = None if ai is None else [(f"r{i + 1}", s, "", "") for i, s in enumerate(ai) if s is not None]
    frame = spark.createDataFrame(
        [(1, "j", scored, entries)],
        "cv_id bigint, job_position_id string, scored array<struct<req_pos:int,requirement_id:string,weight:int,"
        f"is_required:boolean,score:double>>, entries array<{schemas.AI_SCORE_STRUCT}>",
    )
    best = frame.withColumn("scored", final.best_of(F.col("scored"), F.col("entries")))
    row = final.final_score(best).first()
    assert (row.tier, row.final_score, row.missing_required) == expected


def test_first_model_entry_wins_even_at_zero(spark):
    frame = spark.createDataFrame(
        [([(0, "r1", 9, True, 1.0)], [("r1", 0.0, "", ""), ("r1", 1.0, "", "")])],
        "scored array<struct<req_pos:int,requirement_id:string,weight:int,is_required:boolean,score:double>>, "
        f"entries array<{schemas.AI_SCORE_STRUCT}>",
    )
    assert frame.select(final.best_of(F.col("scored"), F.col("entries")).alias("b")).first().b[0].score == 0.0


def test_weight_sum_zero_scores_zero(spark):
    rows = spark.createDataFrame([(1, 1.0, 0, True)], "k int, score double, weight int, is_required boolean")
    assert scoring.weighted_score(rows, ["k"]).first().weighted_score == 0.0


PAYLOADS = {
    "good": json.dumps({"requirements": [{"text": "A", "type": "technology", "weight": 9, "isRequired": True,
                                          "keywords": ["a"], "synonyms": ["b"]}, {"text": "B", "keywords": []}]}),
    "broken": '{"requirements": [ not json at all',
    "empty": '{"requirements": []}',
    "mixed": json.dumps({"requirements": [{"text": "AWS", "keywords": ["aws"]}, {"wrong": 1}, None,
                                          {"text": "Docker", "keywords": ["docker"], "synonyms": None}]}),
    "useless": json.dumps({"requirements": [None, {}, {"wrong": 1}]}),
}


def test_requirement_ingest(spark):
    frame = spark.createDataFrame(list(PAYLOADS.items()), "name string, payload string")
    got = {r.name: r for r in requirements.ingest_requirement_json(frame, "payload").collect()}
    assert [r.id for r in got["good"].requirements] == ["req_1", "req_2"]
    assert got["broken"].requirements is None and "no usable" in got["broken"].error
    assert "no usable" in got["empty"].error
    assert [(r.id, r.text, r.synonyms) for r in got["mixed"].requirements] == [("req_1", "AWS", []), ("req_2", "Docker", [])]
    assert got["mixed"].dropped == 2 and "none passed" in got["useless"].error


def test_missing_weight_is_rejected_before_it_can_score(spark):
    row = ("j", 0, "r1", "t", "technology", None, True, ["k"], [])
    checked = requirements.validate_requirements(spark.createDataFrame([row], schemas.REQUIREMENT_ROW))
    assert checked.first().violations == ["weight"]


def prompts(spark, texts):
    rows = [(i, "m", "s", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "cv_id bigint, model string, system_prompt string, user_prompt string")


def test_batch_infer_failures_stay_in_their_row(spark):
    def client(model, system, user):
        if user == "boom":
            raise RuntimeError("429 rate limit")
        return ("" if user == "blank" else user.upper()), 7, 3

    rows = {r.cv_id: r for r in inference.batch_infer(prompts(spark, ["ok", "boom", "blank", "fine"]), client, first_wait=0.0, tasks=2).collect()}
    assert (rows[0].content, rows[0].prompt_tokens, rows[0].error) == ("OK", 7, None)
    assert (rows[1].content, rows[1].prompt_tokens, rows[1].error) == (None, 0, "429 rate limit")
    assert rows[2].error == "Empty response from model" and rows[3].content == "FINE"


def test_batch_infer_retries_then_succeeds(spark):
    def client(model, system, user):
        seen = client.__dict__.setdefault("seen", {})
        seen[user] = seen.get(user, 0) + 1
        if seen[user] < 3:
            raise RuntimeError("try later")
        return f"after {seen[user]}", 1, 1

    found = inference.batch_infer(prompts(spark, ["a"]), client, first_wait=0.0).collect()
    assert [r.content for r in found] == ["after 3"]


def test_parse_and_cost(spark):
    rows = [
        (1, "gpt-5.1", '{"scores": [{"requirementId": "r1", "score": 0.6}], "overallSummary": "s"}', 1_000_000, 1_000_000, None),
        (2, "gpt-5-mini", '{"scores": not json', 1_000_000, 0, None),
        (3, "gpt-5-mini", None, 0, 0, "429 rate limit"),
        (4, "unheard-of", '{"overallSummary": "x"}', 0, 1_000_000, None),
        (5, "gpt-5-mini", "null", 0, 0, None),
    ]
    frame = spark.createDataFrame(rows, "cv_id bigint, model string, content string, prompt_tokens bigint, completion_tokens bigint, error string")
    got = {r.cv_id: r for r in inference.estimate_cost(inference.parse_responses(frame)).collect()}
    assert got[1].ai_scores.scores[0].score == 0.6 and got[1].cost_usd == 11.25
    assert got[2].ai_scores is None and "valid JSON" in got[2].error and got[2].cost_usd == 0.25
    assert got[3].cost_usd == 0.0 and got[3].error == "429 rate limit"
    assert got[4].ai_scores is None and got[4].error and got[4].cost_usd == 2.0
    assert "valid JSON" in got[5].error


def test_prompt_redacts_matched_sentences_unless_asked_not_to(spark, reqs):
    cvs = spark.createDataFrame([(1, "j", ["Mail node.js a@b.co"])], "cv_id bigint, job_position_id string, sentences array<string>")
    scored = keyword.score_requirements(cvs, reqs).select("scored")
    safe = scored.select(inference.matched_lines(F.col("scored")).alias("l")).first().l
    raw = scored.select(inference.matched_lines(F.col("scored"), True).alias("l")).first().l
    assert safe == ["r1: Mail node.js [EMAIL]"] and raw == ["r1: Mail node.js a@b.co"]


TEXTS = [
    (1, "j", "a.txt", "text/plain", "Summary\n6 years of experience.\nBuilt Node.js services. Node.js apps. More nodejs. Kubernetes work. k8s upgrades. Kubernetes on call. AWS.", None),
    (2, "j", "b.txt", "text/plain", "Kept a PHP site going for a small shop and nothing else at all, sadly.", None),
    (3, "j", "c.png", "image/png", "", None),
    (4, "j", "d.pdf", "application/pdf", "too short", None),
    (5, "j", "e.pdf", "application/pdf", None, "bad xref table"),
    (6, "nobody", "f.txt", "text/plain", "This job has no requirements, so its CVs are not part of any run here.", None),
]


def texts(spark):
    return spark.createDataFrame(
        TEXTS, "cv_id bigint, job_position_id string, original_filename string, mime_type string, raw_text string, read_error string"
    )


def answer(score):
    return json.dumps({"scores": [{"requirementId": "r1", "score": score, "reasoning": "", "evidence": ""}], "overallSummary": "s"})


def test_whole_flow(spark, reqs):
    content = answer(0.3)

    def client(model, system, user):
        assert "PHP" not in user
        return content, 1000, 100

    rows, totals, kept = screening.screen(texts(spark), reqs, client)
    got = {r.cv_id: r for r in rows.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[6].tier == "no-match" and got[6].elimination_reason == "Not screened: no requirements"
    assert got[1].ai_model_used == "gpt-5.1" and got[1].tier == "no-match" and got[1].elimination_reason is None
    assert got[2].ai_model_used is None and got[2].elimination_reason.startswith("Missing 2 of 2")
    assert got[3].elimination_reason == "Could not read file: Unsupported file type: image/png / c.png"
    assert got[4].elimination_reason.startswith("PDF parsed but no meaningful text")
    assert got[5].elimination_reason == "Could not read file: bad xref table"
    assert all(got[i].parsing_confidence == "failed" and got[i].final_score == 0 for i in (3, 4, 5))
    (total,) = [t for t in totals.collect() if t.candidates]
    assert (total.candidates, total.skipped, total.failures) == (1, 4, 0) and total.ai_cost_delta > 0

    def down(model, system, user):
        raise RuntimeError("down")

    again, totals, _ = screening.rescore(rows, kept, reqs, down, retries=0)
    got = {r.cv_id: r for r in again.collect()}
    assert got[1].tier == "great" and got[1].final_score == 96 and got[1].ai_scores is None
    assert got[5].elimination_reason == "Could not read file: bad xref table"
    assert totals.first().failures == 1


def test_failed_call_keeps_earlier_scores(spark, reqs):
    def client(model, system, user):
        return content, 10, 10

    content = answer(1.0)
    rows = screening.screen(texts(spark), reqs, client).cvs
    results = spark.createDataFrame([(1, "gpt-5.1", 0.0)], "cv_id bigint, model string, cost_usd double").withColumn(
        "ai_scores", F.lit(None).cast(schemas.AI_RESPONSE_STRUCT)
    )
    row = final.apply_ai_results(rows, results).where("cv_id = 1").first()
    assert row.ai_scores.overallSummary == "s" and row.ai_cost_usd == 0.0


def test_generation_shortfall(spark, reqs):
    requests = spark.createDataFrame([("j", 4, 0.5, 0.25)], "job_position_id string, count int, strong double, partial double")
    jobs = spark.createDataFrame([("j", "Engineer")], "job_position_id string, title string")

    def client(model, system, user):
        if "TARGET TIER: weak" in user:
            raise RuntimeError("down")
        return '{"name": "Ada", "summary": "Node.js, k8s work over many long years in production"}', 10, 10

    rows, shortfall = screening.generate_corpus(requests, jobs, reqs, client, 2024, retries=0)
    assert sorted(r.original_filename for r in rows.collect()) == [
        "generated_partial_3.txt", "generated_strong_1.txt", "generated_strong_2.txt"]
    row = shortfall.first()
    assert (row.requested, row.produced, row.failed) == (4, 3, 1)


def test_sanitise_from_json(spark):
    cases = {
        "broken": "{not valid",
        "odd": json.dumps({"name": " ", "yearsExperience": -2, "skills": [" a ", "", None, 5],
                           "experience": [{"startYear": None, "endYear": "1999", "bullets": [" x ", None]},
                                          {"company": "C", "role": "R", "startYear": 2030, "endYear": "soon"}, None]}),
    }
    frame = spark.createDataFrame(list(cases.items()), "k string, p string")
    got = {r.k: r.content for r in corpus.sanitize_generated(corpus.parse_generated(frame, "p"), 2024).collect()}
    assert (got["broken"].name, got["broken"].experience, got["broken"].skills) == ("Candidate", [], [])
    odd = got["odd"]
    assert (odd.name, odd.yearsExperience, odd.skills) == ("Candidate", 0, ["a", "5"])
    first, second, third = odd.experience
    assert (first.startYear, first.endYear, first.bullets, first.company) == (1990, 1999, ["x"], "Unknown Company")
    assert (second.startYear, second.endYear) == (2024, 2024)
    assert (third.role, third.startYear) == ("Engineer", 2024)


def test_merge_rows_rules(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(1, None, "z")], "k int, v string, w string")
    keep = {r.k: (r.v, r.w) for r in lifecycle.merge_rows(base, new, ["k"], ["v", "w"]).collect()}
    put = {r.k: (r.v, r.w) for r in lifecycle.merge_rows(base, new, ["k"], ["v", "w"], nulls="set").collect()}
    assert keep == {1: ("a", "z"), 2: ("b", "y")} and put == {1: (None, "z"), 2: ("b", "y")}
    with pytest.raises(Exception, match="more than one update"):
        lifecycle.merge_rows(base, new.union(new), ["k"], ["v"]).collect()


def test_jobs_of_one_owner(spark):
    jobs = spark.createDataFrame([(1, "u", 5), (2, "v", 9), (3, "u", 7)], "job_position_id int, user_id string, created_at int")
    assert [r.job_position_id for r in views.jobs_of(jobs, "u").collect()] == [3, 1]


def test_tier_summary_counts(spark):
    jobs = spark.createDataFrame([("a",), ("empty",)], "job_position_id string")
    cvs = spark.createDataFrame([("a", t) for t in ("great", "great", "good", "no-match", None)], "job_position_id string, tier string")
    got = {r.job_position_id: (r.great, r.good, r.no_match, r.total) for r in views.tier_summary(jobs, cvs).collect()}
    assert got == {"a": (2, 1, 2, 5), "empty": (0, 0, 0, 0)}
