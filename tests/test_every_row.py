"""No CV, entry or page is lost for want of a requirement list, an owner or an item."""

from pyspark.sql import functions as F

from shortlist.operators import inference, keyword, lifecycle
from shortlist.plans import screening
from shortlist.sources import layout

REQS = ("job_position_id string, req_pos int, requirement_id string, text string, type string, weight int, "
        "is_required boolean, keywords array<string>, synonyms array<string>")


def requirements(spark, *jobs, keywords=("python",)):
    rows = [(j, 0, "req_1", "Python", "technology", 9, True, keywords and list(keywords), []) for j in jobs]
    return spark.createDataFrame(rows, REQS)


def test_every_cv_gets_a_verdict(spark):
    cvs = spark.createDataFrame(
        [(1, "a", ["I know Python."]), (2, "b", ["I know Python."]), (3, None, ["x"]), (4, "c", ["x"])],
        "cv_id long, job_position_id string, sentences array<string>",
    )
    reqs = requirements(spark, "a").unionByName(requirements(spark, "c", keywords=None))
    got = {r.cv_id: (r.tier, r.elimination_reason) for r in keyword.keyword_filter(cvs, reqs).collect()}
    assert got == {
        1: ("good", None), 2: ("no-match", "Not screened: no requirements"),
        3: ("no-match", "Not screened: no requirements"), 4: ("no-match", "Not screened: malformed"),
    }


def test_rescoring_one_job_leaves_the_others(spark):
    texts = spark.createDataFrame(
        [(k, j, f"{k}.txt", "text/plain", "I know Python. Python daily. More python.") for k, j in enumerate("aabb")],
        "cv_id long, job_position_id string, original_filename string, mime_type string, raw_text string",
    )

    def client(model, system, user):
        return '{"scores": []}', 10, 10

    first = screening.screen(texts, requirements(spark, "a", "b"), client)
    before = first.cvs.collect()
    again = screening.rescore(first.cvs, first.texts, requirements(spark, "a", keywords=["rust"]), client)
    after = {r.cv_id: r for r in again.cvs.collect()}
    assert sorted(after) == [0, 1, 2, 3]
    assert [after[k].tier for k in (0, 1)] == ["no-match"] * 2
    kept = {r.cv_id: r for r in before if r.job_position_id == "b"}
    assert all(after[k] == kept[k] for k in (2, 3))
    assert [r.job_position_id for r in again.totals.collect()] == ["a"]


def test_entries_of_unknown_cvs_stay(spark):
    entries = spark.createDataFrame(
        [(1, 0, "req_1", 1.0, "Python"), (9, 0, "req_1", 1.0, "Python"), (None, 0, "req_1", 0.0, "")],
        "cv_id long, pos long, requirement_id string, score double, evidence string",
    )
    cvs = spark.createDataFrame([(1, "a", "Python")], "cv_id long, job_position_id string, anonymized_text string")
    got = inference.score_quality(entries, requirements(spark, "a"), cvs).collect()
    assert sorted((r.cv_id or 0, r.cv_known, r.requirement_known, r.evidence_verbatim) for r in got) == [
        (0, False, False, True), (1, True, True, True), (9, False, False, False)
    ]


def test_refused_generation_shows_in_the_shortfall(spark):
    requests = spark.createDataFrame([("a", 2, 0.5, 0.5), ("z", 4, 0.5, 0.5)], "job_position_id string, count long, strong double, partial double")
    jobs = requests.select("job_position_id", F.lit("Engineer").alias("title"))

    def client(model, system, user):
        return '{"name": "Ada Byron", "summary": "x"}', 1, 1

    _, shortfall = screening.generate_corpus(requests, jobs, requirements(spark, "a"), client, 2024)
    assert {r.job_position_id: (r.requested, r.refused) for r in shortfall.collect()} == {"a": (2, 0), "z": (4, 4)}


def test_a_page_without_text_keeps_its_place(spark):
    items = spark.createDataFrame(
        [(1, 1, 1, "a", 0.0, 10.0, False), (1, 2, 1, None, 0.0, 10.0, False), (1, 3, 1, "b", 0.0, 10.0, False)],
        "doc_id long, page int, idx int, str string, y double, height double, has_eol boolean",
    )
    assert layout.stitch_pages(layout.assemble_pages(items)).first().raw_text == "a\n\n\n\nb"
