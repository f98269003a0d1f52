"""Lifecycle updates over every job and CV row."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.keyword_checks import JUDGED as SCREENED_SQL
from checks.keyword_checks import scored_documents
from checks.registry import check
from shortlist.operators import keyword, lifecycle

JOB = "job_position_id"
BASE = sql.with_(sql.JOBS, sql.CVS, sql.COUNTS)


@check(
    "l1_apply_extraction",
    BASE + """SELECT job_position_id, status, round(ai_cost_usd, 6) AS ai_cost_usd, reqs FROM (
     SELECT job_position_id, CASE WHEN hit THEN CASE WHEN failed THEN 'FAILED' ELSE 'REQUIREMENTS_EXTRACTED' END ELSE status END AS status,
      CASE WHEN hit AND NOT failed THEN job_position_id / 1000.0::DOUBLE ELSE ai_cost_usd END AS ai_cost_usd,
      CASE WHEN hit AND NOT failed THEN 'T' || job_position_id ELSE '' END AS reqs
     FROM (SELECT *, status IN ('CREATED', 'FAILED') AND job_position_id % 4 <> 3 AS hit, job_position_id % 5 = 0 AS failed FROM jobs))""",
)
def l1_apply_extraction(spark, sf):
    none = F.array().cast("array<struct<id:string,text:string>>")
    jobs = inputs.jobs(spark, sf).withColumn("requirements", none)
    k = F.col(JOB)
    outcomes = jobs.where(k % 4 != 3).select(
        JOB,
        F.when(k % 5 != 0, F.array(F.struct(F.lit("req_1").alias("id"), F.concat(F.lit("T"), k.cast("string")).alias("text")))).alias("requirements"),
        (k / F.lit(1000.0)).alias("cost_usd"),
        F.when(k % 5 == 0, "down").alias("error"),
    )
    done = lifecycle.apply_extraction(jobs, outcomes)
    return done.select(
        JOB, "status", F.round("ai_cost_usd", 6).alias("ai_cost_usd"),
        F.array_join(F.transform("requirements", lambda r: r["text"]), ",").alias("reqs"),
    )


RUN_COLUMNS = ["status", "current_stage", "processed_cvs", "total_cvs"]


@check(
    "l2_start_runs",
    BASE + """SELECT job_position_id, CASE WHEN run THEN 'PROCESSING' ELSE status END AS status,
     CASE WHEN run THEN CASE WHEN job_position_id % 4 = 0 THEN 'generating' ELSE 'parsing' END ELSE current_stage END AS current_stage,
     CASE WHEN run THEN 0 ELSE processed_cvs END AS processed_cvs,
     CASE WHEN run AND job_position_id % 3 <> 0 THEN total_cvs + 10 ELSE total_cvs END AS total_cvs
    FROM (SELECT *, job_position_id % 2 = 0 AS run FROM jobs)""",
)
def l2_start_runs(spark, sf):
    jobs = inputs.jobs(spark, sf)
    k = F.col(JOB)
    commands = jobs.where(k % 2 == 0).select(
        JOB, F.when(k % 3 != 0, 10).alias("add_cvs"), F.when(k % 4 == 0, "generating").alias("initial_stage")
    )
    return lifecycle.start_runs(jobs, commands).select(JOB, *RUN_COLUMNS)


COUNTER_COLUMNS = ["great_match_count", "good_match_count", "no_match_count"]
COUNTED = "jobs LEFT JOIN counts USING (job_position_id)"


@check(
    "l3_complete_runs",
    BASE + f"""SELECT job_position_id, CASE WHEN hit THEN 'COMPLETED' ELSE status END AS status,
     CASE WHEN hit THEN 'completed' ELSE current_stage END AS current_stage,
     CASE WHEN hit THEN coalesce(total, 0) ELSE processed_cvs END AS processed_cvs, total_cvs,
     CASE WHEN hit THEN coalesce(great, 0) ELSE great_match_count END AS great_match_count,
     CASE WHEN hit THEN coalesce(good, 0) ELSE good_match_count END AS good_match_count,
     CASE WHEN hit THEN coalesce(no_match, 0) ELSE no_match_count END AS no_match_count,
     round(CASE WHEN hit THEN ai_cost_usd + 0.5 ELSE ai_cost_usd END, 6) AS ai_cost_usd
    FROM (SELECT *, status = 'PROCESSING' AS hit FROM {COUNTED})""",
)
def l3_complete_runs(spark, sf):
    jobs = inputs.jobs(spark, sf)
    totals = jobs.where(F.col("status") == "PROCESSING").select(JOB, F.lit(0.5).alias("ai_cost_delta"))
    done = lifecycle.complete_runs(jobs, inputs.cvs(spark, sf), totals)
    return done.select(JOB, *RUN_COLUMNS, *COUNTER_COLUMNS, F.round("ai_cost_usd", 6).alias("ai_cost_usd"))


@check(
    "l4_refresh_counts",
    BASE + f"""SELECT job_position_id, coalesce(total, 0) AS total_cvs, coalesce(total, 0) AS processed_cvs,
     coalesce(great, 0) AS great_match_count, coalesce(good, 0) AS good_match_count, coalesce(no_match, 0) AS no_match_count FROM {COUNTED}""",
)
def l4_refresh_counts(spark, sf):
    refreshed = lifecycle.refresh_counts(inputs.jobs(spark, sf), inputs.cvs(spark, sf))
    return refreshed.select(JOB, "total_cvs", "processed_cvs", *COUNTER_COLUMNS)


def document_rows(spark, sf):
    return inputs.table(spark, sf, "documents").select(
        F.col("doc_id").alias("cv_id"),
        F.col("lang").alias(JOB),
        F.when(F.col("doc_id") % 3 == 0, "good").otherwise("no-match").alias("tier"),
        F.when(F.col("doc_id") % 3 != 0, "Score too low").alias("elimination_reason"),
        (F.col("n_chars") % 101).cast("double").alias("final_score"),
    )


def label_overrides(spark, sf):
    """Labels as manual tiers; every fourth one names a job the CV may not belong to."""
    labels = inputs.table(spark, sf, "labels").join(
        inputs.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id"
    )
    return labels.select(
        F.col("doc_id").alias("cv_id"),
        F.when(F.col("doc_id") % 4 == 0, "en").otherwise(F.col("lang")).alias(JOB),
        F.when(F.col("quality") == 1, "great").otherwise("no-match").alias("new_tier"),
    )


OVERRIDES = """WITH asked AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE lang END AS job,
 CASE WHEN quality = 1 THEN 'great' ELSE 'no-match' END AS new_tier FROM labels JOIN documents USING (doc_id))
"""


@check(
    "l5_override_tiers",
    OVERRIDES + """SELECT d.doc_id AS cv_id, coalesce(new_tier, CASE WHEN d.doc_id % 3 = 0 THEN 'good' ELSE 'no-match' END) AS tier,
     CASE WHEN new_tier IS NULL AND d.doc_id % 3 <> 0 THEN 'Score too low' END AS elimination_reason,
     (n_chars % 101)::DOUBLE AS final_score FROM documents d LEFT JOIN asked a ON a.doc_id = d.doc_id AND a.job = d.lang""",
)
def l5_override_tiers(spark, sf):
    changed, _ = lifecycle.override_tiers(document_rows(spark, sf), label_overrides(spark, sf))
    return changed.select("cv_id", "tier", "elimination_reason", "final_score")


@check(
    "l5_rejected_overrides",
    OVERRIDES + "SELECT a.doc_id AS cv_id, job AS job_position_id, new_tier FROM asked a JOIN documents d USING (doc_id) WHERE job <> lang",
)
def l5_rejected_overrides(spark, sf):
    return lifecycle.override_tiers(document_rows(spark, sf), label_overrides(spark, sf))[1]


rescore_sql = SCREENED_SQL + """SELECT cv_id, CASE WHEN cv_id % 7 = 0 THEN 'no-match' WHEN unrun THEN 'great' ELSE tier END AS tier,
     CASE WHEN cv_id % 7 = 0 THEN 0 WHEN unrun THEN 99 ELSE round(preliminary_score, 6) END AS final_score,
     CASE WHEN cv_id % 7 = 0 THEN 'unreadable' WHEN unrun THEN NULL ELSE elimination_reason END AS elimination_reason,
     CASE WHEN cv_id % 7 = 0 THEN 'failed' ELSE 'high' END AS parsing_confidence,
     CASE WHEN cv_id % 7 <> 0 AND unrun THEN 'gpt-5.1' END AS ai_model_used
    FROM (SELECT *, job_position_id NOT IN (SELECT job_position_id FROM corpus_reqs) AS unrun FROM screened)"""


def rescore_input(spark, sf):
    """Stored CVs of the documents, their sentences, and the lists to rescore by."""
    lost = F.col("cv_id") % 7 == 0
    stored = inputs.document_cvs(spark, sf).select("cv_id", JOB).withColumns(
        {
            "parsing_confidence": F.when(lost, "failed").otherwise("high"),
            "tier": F.when(lost, "no-match").otherwise("great"),
            "final_score": F.when(lost, 0.0).otherwise(99.0),
            "elimination_reason": F.when(lost, "unreadable"),
            "ai_model_used": F.when(~lost, "gpt-5.1"),
            "ai_cost_usd": F.lit(0.25),
        }
    )
    return stored, inputs.document_sentences(spark, sf), inputs.corpus_requirements(spark)


def rescore_columns(again):
    return again.select(
        "cv_id", "tier", F.round("final_score", 6).alias("final_score"), "elimination_reason",
        "parsing_confidence", "ai_model_used",
    )


@check("l6_rescore", rescore_sql)
def l6_rescore(spark, sf):
    return rescore_columns(lifecycle.rescore(*rescore_input(spark, sf)))


NOW = datetime(1997, 1, 1, tzinfo=timezone.utc)


@check(
    "l7_sweep_stale",
    BASE + """SELECT job_position_id, CASE WHEN old AND status IN ('PROCESSING', 'EXTRACTING_REQUIREMENTS') THEN 'FAILED' ELSE status END AS status,
     CASE WHEN old AND status = 'PROCESSING' THEN 'failed' ELSE current_stage END AS current_stage
    FROM (SELECT *, updated_at < TIMESTAMP '1997-01-01' - INTERVAL 15 MINUTE AS old FROM jobs)""",
)
def l7_sweep_stale(spark, sf):
    return lifecycle.sweep_stale(inputs.jobs(spark, sf), NOW).select(JOB, "status", "current_stage")


def _cascade(spark, sf):
    users = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    gone = users.where(F.col("user_id") % 6 == 0)
    jobs = inputs.jobs(spark, sf)
    single = jobs.where(F.col(JOB) % 50 == 0).select(JOB)
    return lifecycle.delete_cascade(users, jobs, inputs.cvs(spark, sf), gone, single)


@check(
    "l8_delete_cascade",
    BASE + """, kept AS (SELECT job_position_id FROM jobs WHERE user_id % 6 <> 0 AND job_position_id % 50 <> 0)
    SELECT 'user' AS kind, c_custkey::VARCHAR AS id FROM customer WHERE c_custkey % 6 <> 0
    UNION ALL SELECT 'job', job_position_id::VARCHAR FROM kept
    UNION ALL SELECT 'cv', cv_id FROM cvs WHERE job_position_id IN (SELECT job_position_id FROM kept)""",
)
def l8_delete_cascade(spark, sf):
    users, jobs, cvs = _cascade(spark, sf)

    def rows(df, kind, key):
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))

    return rows(users, "user", "user_id").unionByName(rows(jobs, "job", JOB)).unionByName(rows(cvs, "cv", "cv_id"))


@check(
    "l9_check_access",
    BASE + """SELECT e.event_id, CASE WHEN j.user_id IS NULL THEN 'not found' WHEN j.user_id = e.asker THEN 'ok' ELSE 'forbidden' END AS access
    FROM (SELECT event_id, event_id * 2 AS job_position_id, CASE WHEN event_id % 3 = 0 THEN o_custkey ELSE e.user_id END AS asker
     FROM events e LEFT JOIN orders ON o_orderkey = event_id * 2) e LEFT JOIN jobs j USING (job_position_id)""",
)
def l9_check_access(spark, sf):
    jobs = inputs.jobs(spark, sf)
    owners = jobs.select(JOB, F.col("user_id").alias("owner"))
    asked = inputs.table(spark, sf, "events").select(
        "event_id", (F.col("event_id") * 2).alias(JOB), F.col("user_id").alias("asker")
    ).join(owners, JOB, "left")
    requests = asked.select(
        "event_id", JOB, F.when(F.col("event_id") % 3 == 0, F.col("owner")).otherwise(F.col("asker")).alias("user_id")
    )
    return lifecycle.check_access(requests, jobs).select("event_id", "access")


@check(
    "l10_mark_failed",
    BASE + """SELECT job_position_id, CASE WHEN job_position_id % 3 = 0 THEN 'FAILED' ELSE status END AS status,
     CASE WHEN job_position_id % 3 = 0 THEN 'failed' ELSE current_stage END AS current_stage FROM jobs""",
)
def l10_mark_failed(spark, sf):
    jobs = inputs.jobs(spark, sf)
    return lifecycle.mark_failed(jobs, jobs.where(F.col(JOB) % 3 == 0)).select(JOB, "status", "current_stage")


@check(
    "l11_audit_counters",
    BASE + f"""SELECT job_position_id, total_cvs, coalesce(total, 0) AS total, total_cvs <> coalesce(total, 0) AS total_off,
     great_match_count <> coalesce(great, 0) AS great_off, good_match_count <> coalesce(good, 0) AS good_off,
     no_match_count <> coalesce(no_match, 0) AS no_match_off FROM {COUNTED}""",
)
def l11_audit_counters(spark, sf):
    audit = lifecycle.audit_counters(inputs.jobs(spark, sf), inputs.cvs(spark, sf))
    return audit.select(JOB, "total_cvs", "total", "total_off", "great_off", "good_off", "no_match_off")


@check("l12_progress_snapshot", BASE + "SELECT job_position_id, status, current_stage, processed_cvs, total_cvs FROM jobs")
def l12_progress_snapshot(spark, sf):
    return lifecycle.progress_snapshot(inputs.jobs(spark, sf))


@check(
    "l13_merge_rows",
    BASE + """, latest AS (SELECT user_id * 3 AS job_position_id, arg_max(event_type, event_id) AS new_title, arg_max(CASE WHEN event_id % 2 = 0 THEN 'S' END, event_id) AS x,
      max(event_id) AS last FROM events GROUP BY 1)
    SELECT job_position_id, coalesce(new_title, title) AS title, CASE WHEN last % 2 = 0 THEN 'FAILED' ELSE status END AS status
    FROM jobs LEFT JOIN latest USING (job_position_id)""",
)
def l13_merge_rows(spark, sf):
    updates = inputs.table(spark, sf, "events").select(
        (F.col("user_id") * 3).alias(JOB),
        F.col("event_type").alias("title"),
        F.when(F.col("event_id") % 2 == 0, "FAILED").alias("status"),
        "event_id",
    )
    merged = lifecycle.merge_rows(inputs.jobs(spark, sf), updates, [JOB], ["title", "status"], version="event_id")
    return merged.select(JOB, "title", "status")
