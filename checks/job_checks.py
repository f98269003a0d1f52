"""Job flows over every order: new jobs, saved lists, the gate before a run; rescoring of bucketed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.lifecycle_checks import JOB, rescore_columns, rescore_input, rescore_sql
from checks.registry import check
from checks.requirement_checks import BAD_ENTRY, ENTRIES, GATE_CASES, spark_case, sql_case
from shortlist.operators import lifecycle
from shortlist.plans import jobs as flows
from shortlist.sources.buckets import write_bucketed


def stored_jobs(spark, sf):
    """One job per order, its list being one of the gate's cases."""
    k = F.col("o_orderkey")
    return inputs.table(spark, sf, "orders").select(
        k.alias(JOB), F.col("o_custkey").alias("user_id"), spark_case(k, GATE_CASES).alias("requirements_json"),
        F.lit("CREATED").alias("status"), F.lit(None).cast("string").alias("current_stage"),
        F.lit(7).alias("processed_cvs"), F.lit(9).alias("total_cvs"),
    )


@check(
    "e6_create_jobs",
    f"""WITH forms AS (SELECT doc_id AS job_position_id, text, repeat('é', (doc_id % 210)::INT) AS title FROM documents)
    SELECT job_position_id, CASE WHEN {sql.units('title')} NOT BETWEEN 3 AND 200 OR text IS NULL OR {sql.units('text')} NOT BETWEEN 50 AND 20000
      THEN 'invalid' WHEN job_position_id % 3 = 0 THEN 'exists' ELSE 'ok' END AS answer,
     CASE WHEN job_position_id % 3 = 0 THEN 'COMPLETED'
      WHEN {sql.units('title')} BETWEEN 3 AND 200 AND {sql.units('text')} BETWEEN 50 AND 20000 THEN 'CREATED' END AS status FROM forms""",
)
def e6_create_jobs(spark, sf):
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias(JOB), F.col("text").alias("job_description_text"))
    stored = docs.where(f"{JOB} % 3 = 0").select(JOB, F.lit("COMPLETED").alias("status"), F.lit(3).alias("total_cvs"))
    forms = docs.select(JOB, F.expr(f"repeat('é', cast({JOB} % 210 as int))").alias("title"), "job_description_text")
    changed = flows.create_jobs(stored, forms)
    return changed.answers.select(JOB, "answer").join(changed.jobs.select(JOB, "status"), JOB, "left")


@check(
    "e3_save_requirements",
    """WITH edits AS (SELECT DISTINCT l_orderkey AS job_position_id, o_custkey + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS user_id,
      l_linenumber AS req_pos, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 41 + 1 ELSE 5 END AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    bad AS (SELECT job_position_id, req_pos, 'weight' AS rule FROM edits WHERE weight > 10
      UNION ALL SELECT job_position_id, req_pos, 'position' FROM edits GROUP BY 1, 2 HAVING count(*) > 1),
    first AS (SELECT job_position_id, req_pos AS bad_pos, rule FROM bad QUALIFY row_number() OVER (PARTITION BY job_position_id ORDER BY req_pos, rule) = 1),
    lists AS (SELECT job_position_id, any_value(user_id) AS user_id, count(*) AS entries,
      string_agg('line ' || l_partkey || '=' || weight, ';' ORDER BY req_pos) AS saved FROM edits GROUP BY 1),
    judged AS (SELECT *, CASE WHEN job_position_id % 5 = 0 THEN 'forbidden' WHEN bad_pos IS NOT NULL THEN 'invalid' ELSE 'ok' END AS answer
      FROM lists LEFT JOIN first USING (job_position_id))
    SELECT job_position_id, user_id, answer, bad_pos, rule AS violations, entries,
     CASE WHEN answer = 'ok' THEN saved ELSE 'before' END AS saved FROM judged""",
)
def e3_save_requirements(spark, sf):
    orders = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias(JOB), F.col("o_custkey").alias("user_id"))
    stored = orders.withColumn("requirements_json", F.lit('[{"text": "before", "weight": 1}]'))
    lines = inputs.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", JOB).join(orders, JOB)
    edits = lines.select(
        JOB,
        (F.col("user_id") + F.when(F.col(JOB) % 5 == 0, 1).otherwise(0)).alias("user_id"),
        F.col("l_linenumber").alias("req_pos"),
        F.concat(F.lit("req_"), "l_linenumber").alias("requirement_id"),
        F.concat(F.lit("line "), "l_partkey").alias("text"),
        F.lit("technology").alias("type"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 41 + 1).otherwise(5).alias("weight"),
        (F.col("l_partkey") % 2 == 0).alias("is_required"),
        F.array(F.lit("k")).alias("keywords"),
        F.array().cast("array<string>").alias("synonyms"),
    )
    changed = flows.save_requirements(stored, edits)
    saved = F.from_json("requirements_json", "array<struct<text:string,weight:int>>")
    text = F.array_join(
        F.transform(saved, lambda r: F.when(r["text"] == "before", r["text"]).otherwise(F.concat(r["text"], F.lit("="), r["weight"]))), ";"
    )
    return changed.answers.join(changed.jobs.select(JOB, text.alias("saved")), JOB).select(
        JOB, "user_id", "answer", F.col("bad_pos").cast("long").alias("bad_pos"),
        F.array_join("violations", ",").alias("violations"), F.col("entries").cast("long").alias("entries"), "saved",
    )


@check(
    "e1_open_runs",
    f"""WITH given AS (SELECT o_orderkey AS job_position_id, o_custkey AS user_id, {sql_case('o_orderkey', GATE_CASES)} AS doc FROM orders),
    listed AS (SELECT job_position_id, {ENTRIES} AS entries FROM given),
    bad AS (SELECT job_position_id, min(i) - 1 AS bad_index FROM (SELECT job_position_id, unnest(entries) AS e,
     generate_subscripts(entries, 1) AS i FROM listed) WHERE {BAD_ENTRY} GROUP BY 1),
    held AS (SELECT l_orderkey AS job_position_id, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1),
    judged AS (SELECT job_position_id, CASE WHEN job_position_id % 7 = 0 THEN 'forbidden' WHEN coalesce(len(entries), 0) = 0 THEN 'no requirements'
      WHEN bad_index IS NOT NULL THEN 'malformed' WHEN n IS NULL THEN 'no CVs' ELSE 'ok' END AS answer,
      CASE WHEN job_position_id % 7 <> 0 THEN bad_index END AS bad_index, n
     FROM listed LEFT JOIN bad USING (job_position_id) LEFT JOIN held USING (job_position_id))
    SELECT job_position_id, answer, bad_index, CASE WHEN answer = 'ok' THEN n ELSE 0 END AS queued,
     CASE WHEN answer = 'ok' THEN 'PROCESSING/filtering/0/9' ELSE 'CREATED/-/7/9' END AS state,
     CASE WHEN answer = 'ok' THEN len(entries) ELSE 0 END AS reqs FROM judged JOIN listed USING (job_position_id)""",
)
def e1_open_runs(spark, sf):
    stored = stored_jobs(spark, sf)
    cvs = inputs.cvs(spark, sf).where(~F.col("cv_id").rlike("^[0-9]+-1-"))
    requests = stored.select(JOB, (F.col("user_id") + F.when(F.col(JOB) % 7 == 0, 1).otherwise(0)).alias("user_id"))
    run = flows.open_runs(stored, requests, cvs)
    listed = run.requirements.groupBy(JOB).agg(F.count(F.lit(1)).alias("reqs"))
    state = F.concat_ws("/", "status", F.coalesce("current_stage", F.lit("-")), "processed_cvs", "total_cvs")
    joined = run.answers.join(run.jobs.select(JOB, state.alias("state")), JOB).join(listed, JOB, "left")
    return joined.select(JOB, "answer", F.col("bad_index").cast("long").alias("bad_index"), "queued", "state", F.coalesce("reqs", F.lit(0)).alias("reqs"))


@check("l6_rescore_bucketed", rescore_sql)
def l6_rescore_bucketed(spark, sf):
    cvs, sentences, reqs = rescore_input(spark, sf)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rescore_columns(lifecycle.rescore(write_bucketed(cvs, count), write_bucketed(sentences, count), reqs))
