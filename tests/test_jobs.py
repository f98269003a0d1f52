"""Job flows and bucketed tables: answers per command, plans in which texts stay where they are."""

import json

import pytest

from shortlist.operators import lifecycle
from shortlist.plans import jobs as flows, screening
from shortlist.sources.buckets import bucket_count, write_bucketed
from test_screening import answer, reqs, texts  # noqa: F401

JOBS = "job_position_id string, user_id string, title string, status string, requirements_json string, total_cvs int, processed_cvs int, current_stage string, great_match_count int, good_match_count int, no_match_count int, ai_cost_usd double"
LONG = "A description that is long enough for the form, which asks for fifty characters."
EDIT = "job_position_id string, user_id string, seq int, req_pos int, requirement_id string, text string, type string, weight int, is_required boolean, keywords array<string>, synonyms array<string>"


def job(key, owner="u", listed="[]"):
    return (key, owner, "Title", "COMPLETED", listed, 0, 0, None, 0, 0, 0, 1.0)


def entry(key, owner, seq, pos, weight=5, id="r"):
    return (key, owner, seq, pos, id, "t", "technology", weight, True, ["k"], [])


def test_forms_become_jobs_once(spark):
    stored = spark.createDataFrame([job("a")], JOBS)
    forms = spark.createDataFrame(
        [("a", "u", "Again", LONG, 1), ("b", "u", "First", LONG, 1), ("b", "u", "Second", LONG, 2), ("b", "u", "x", LONG, 3),
         ("c", "u", "Short", "too short", 1), (None, "u", "None", LONG, 1), ("d", "u", "Same", LONG, 1), ("d", "u", "Same", LONG, 1)],
        "job_position_id string, user_id string, title string, job_description_text string, seq int",
    )
    made, answers = flows.create_jobs(stored, forms)
    assert sorted((r.job_position_id, r.title, r.status, r.requirements_json, r.ai_cost_usd) for r in made.collect()) == [
        ("a", "Title", "COMPLETED", "[]", 1.0), ("b", "Second", "CREATED", "[]", 0.0), ("d", "Same", "CREATED", "[]", 0.0)
    ]
    got = sorted((str(r.job_position_id), r.title, r.answer) for r in answers.collect())
    assert got == [("None", "None", "invalid"), ("a", "Again", "exists"), ("b", "First", "superseded"), ("b", "Second", "ok"),
                   ("b", "x", "invalid"), ("c", "Short", "invalid"), ("d", "Same", "ok"), ("d", "Same", "ok")]
    assert flows.create_jobs(stored, forms.limit(0)).jobs.count() == 1


def test_lists_are_saved_whole_or_not_at_all(spark):
    before = '[{"id":"old"}]'
    stored = spark.createDataFrame([job(k, listed=before) for k in "abcd"], JOBS)
    edits = spark.createDataFrame(
        [entry("a", "u", 1, 0), entry("a", "u", 2, 1, id="second"), entry("a", "u", 2, 0, id="first"), entry("a", "u", 3, 0, weight=11),
         entry("b", "other", 1, 0), entry("x", "u", 1, 0), ("c", "u", 1, None, None, None, None, None, None, None, None)],
        EDIT,
    )
    saved, answers = flows.save_requirements(stored, edits)
    lists = {r.job_position_id: json.loads(r.requirements_json) for r in saved.collect()}
    assert [e["id"] for e in lists["a"]] == ["first", "second"] and lists["a"][0]["isRequired"] is True
    assert lists["b"] == lists["d"] == [{"id": "old"}] and lists["c"] == []
    got = sorted((r.job_position_id, r.seq, r.answer, r.bad_pos, r.violations, r.entries) for r in answers.collect())
    assert got == [("a", 1, "superseded", None, None, 1), ("a", 2, "ok", None, None, 2), ("a", 3, "invalid", 0, ["weight"], 1),
                   ("b", 1, "forbidden", None, None, 1), ("c", 1, "ok", None, None, 0), ("x", 1, "not found", None, None, 1)]
    mixed = flows.save_requirements(stored, edits.where("job_position_id = 'a' and seq < 3").drop("seq"))
    assert [(r.answer, r.bad_pos, r.violations) for r in mixed.answers.collect()] == [("invalid", 0, ["position"])]
    assert {r.requirements_json for r in mixed.jobs.collect()} == {before}
    again = edits.where("seq = 2")
    assert flows.save_requirements(stored, again.union(again)).answers.first().entries == 2


def test_an_edited_list_is_rescored_after_the_gate(spark, reqs):
    content = answer(0.9)

    def client(model, system, user):
        return content, 10, 10

    done = screening.screen(texts(spark), reqs, client)
    stored = screening.store(done, 3)
    jobs = spark.createDataFrame([job("j"), job("k", listed="[]"), job("nobody", owner="w")], JOBS)
    edit = spark.createDataFrame(
        [("j", "u", 1, 0, "r1", "Sites", "technology", 9, True, ["php"], [])], EDIT
    )
    jobs = flows.save_requirements(jobs, edit).jobs
    asked = spark.createDataFrame([("j", "u"), ("k", "u"), ("nobody", "u")], "job_position_id string, user_id string")
    again, jobs, answers = flows.rescore_jobs(stored, jobs, asked, client)
    assert {r.job_position_id: (r.answer, r.queued) for r in answers.collect()} == {
        "j": ("ok", 5), "k": ("no requirements", 0), "nobody": ("forbidden", 0)
    }
    rows = {r.cv_id: r for r in again.cvs.collect()}
    assert rows[2].ai_model_used is not None and rows[1].tier == "no-match" and rows[1].ai_model_used is None
    assert rows[6].elimination_reason == "Not screened: no requirements" and rows[5].parsing_confidence == "failed"
    states = {r.job_position_id: r for r in jobs.collect()}
    assert states["j"].status == "COMPLETED" and states["j"].processed_cvs == 5 and states["j"].ai_cost_usd > 1
    assert states["k"].processed_cvs == 0 and states["nobody"].current_stage is None
    plain, _, _ = flows.rescore_jobs(done, flows.save_requirements(spark.createDataFrame([job("j")], JOBS), edit).jobs, asked.limit(1), client)
    assert sorted(map(str, plain.cvs.collect())) == sorted(map(str, rows.values()))


def exchanged(df):
    """Columns that each shuffle of the plan moves."""
    found = []

    def walk(node):
        if "ShuffleExchange" in node.getClass().getSimpleName():
            found.append(node.output().mkString(","))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_stored_texts_do_not_move(spark, reqs):
    content = answer(0.9)

    def client(model, system, user):
        return content, 10, 10

    done = screening.screen(texts(spark), reqs, client)
    stored = screening.store(done, 3)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        moved = exchanged(lifecycle.rescore(stored.cvs, stored.texts, reqs))
        assert not any("cv_id" in m for m in moved)
        assert any("cv_id" in m for m in exchanged(lifecycle.rescore(done.cvs, done.texts, reqs)))
        passed = stored.cvs.select("cv_id").repartition(5)
        assert any("raw_text" in m for m in exchanged(done.texts.join(passed, "cv_id")))
        candidates = exchanged(stored.texts.join(passed, "cv_id"))
        assert candidates and not any("raw_text" in m for m in candidates)
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert bucket_count(stored.texts) == 4
    with pytest.raises(Exception, match="already exists"):
        write_bucketed(done.cvs.select("cv_id"), 2, "twice_written")
        write_bucketed(done.cvs.select("cv_id"), 2, "twice_written")
    spark.sql("DROP TABLE twice_written")


def test_saved_lists_are_made_once_whatever_the_number_of_jobs(spark, monkeypatch):
    from shortlist import cluster

    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 0)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = (
        "job_position_id long, user_id long, seq long, req_pos int, requirement_id string, text string, type string, weight int, "
        "is_required boolean, keywords array<string>, synonyms array<string>"
    )
    rows = [(j, j + (j == 3), s, p, f"r{p}", f"t{s}", "technology", 5 + 20 * (j == 4 and p), True, ["k"], []) for j in range(1, 7) for s in (1, 2) for p in (0, 1)]
    stored = spark.createDataFrame([(j, j, "[]") for j in range(1, 6)], "job_position_id long, user_id long, requirements_json string")
    edits = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    changed = flows.save_requirements(stored, edits)
    answers = {(r.job_position_id, r.seq): (r.answer, r.bad_pos, r.entries) for r in changed.answers.collect()}
    saved = {r.job_position_id: r.requirements_json for r in changed.jobs.collect()}
    for j in (1, 2, 5):
        assert answers[j, 1] == ("superseded", None, 2) and answers[j, 2] == ("ok", None, 2)
        assert [e["text"] for e in json.loads(saved[j])] == ["t2", "t2"]
    assert {answers[3, 1], answers[3, 2]} == {("forbidden", None, 2)} and saved[3] == "[]"
    assert {answers[4, 1], answers[4, 2]} == {("invalid", 1, 2)} and saved[4] == "[]"
    assert {answers[6, 1], answers[6, 2]} == {("not found", None, 2)} and 6 not in saved
    assert seen.value == len(rows)
