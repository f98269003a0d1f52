"""Ranked views over every job and CV row; section and entity views over every template CV."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from checks import inputs, sql
from checks.registry import check
from checks.text_checks import ENRICHED, SECTIONED
from shortlist.cluster import cut_lineage
from shortlist.operators import views
from shortlist.operators.parsing import detect_sections, enrich

BASE = sql.with_(sql.JOBS, sql.CVS, sql.COUNTS)
RANKED = """(SELECT *, row_number() OVER (PARTITION BY job_position_id, bucket
 ORDER BY coalesce(final_score, 0) DESC, cv_id) AS rank_in_tier FROM
 (SELECT *, CASE WHEN tier IN ('great', 'good') THEN tier ELSE 'noMatch' END AS bucket FROM cvs))"""


@check("v1_rank_in_tier", BASE + f"SELECT cv_id, job_position_id, bucket, rank_in_tier FROM {RANKED}")
def v1_rank_in_tier(spark, sf):
    narrow = inputs.cvs(spark, sf).select("cv_id", "job_position_id", "tier", "final_score")
    return views.rank_in_tier(narrow).select("cv_id", "job_position_id", "bucket", "rank_in_tier")


@check(
    "v1_rank_one_hot_job",
    f"""WITH cvs AS (SELECT event_id AS cv_id, 0 AS job_position_id, value AS final_score, 'good' AS tier FROM events)
    SELECT cv_id, rank_in_tier FROM {RANKED}""",
)
def v1_rank_one_hot_job(spark, sf):
    """All rows in one bucket of one job: the ranking must still spread over tasks."""
    hot = inputs.table(spark, sf, "events").select(
        F.col("event_id").alias("cv_id"), F.lit(0).alias("job_position_id"),
        F.col("value").alias("final_score"), F.lit("good").alias("tier"),
    )
    return views.rank_in_tier(hot).select("cv_id", "rank_in_tier")


COUNT_COLUMNS = """coalesce(great, 0) AS great, coalesce(good, 0) AS good, coalesce(no_match, 0) AS no_match"""


@check(
    "v2_tier_summary",
    BASE + f"SELECT job_position_id, {COUNT_COLUMNS}, coalesce(total, 0) AS total FROM jobs LEFT JOIN counts USING (job_position_id)",
)
def v2_tier_summary(spark, sf):
    return views.tier_summary(inputs.jobs(spark, sf), inputs.cvs(spark, sf))


@check(
    "v3_results",
    BASE + f"SELECT job_position_id, title, status, cv_id, bucket, rank_in_tier FROM jobs LEFT JOIN {RANKED} USING (job_position_id)",
)
def v3_results(spark, sf):
    narrow = inputs.cvs(spark, sf).select("cv_id", "job_position_id", "tier", "final_score")
    return views.results(inputs.jobs(spark, sf), narrow).select(
        "job_position_id", "title", "status", "cv_id", "bucket", "rank_in_tier"
    )


@check(
    "v4_top_n",
    BASE + "SELECT cv_id, final_score FROM cvs ORDER BY final_score DESC NULLS LAST, cv_id LIMIT 25",
)
def v4_top_n(spark, sf):
    return views.top_n(inputs.cvs(spark, sf), 25).select("cv_id", "final_score")


@check(
    "v4_top_n_per_job",
    BASE + """SELECT job_position_id, cv_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_position_id
     ORDER BY final_score DESC NULLS LAST, cv_id) AS rank FROM cvs) WHERE rank <= 3""",
)
def v4_top_n_per_job(spark, sf):
    top = views.top_n(inputs.cvs(spark, sf), 3, per_job=True)
    return top.select("job_position_id", "cv_id", F.col("rank").cast("long").alias("rank"))


@check(
    "v5_filter_cvs",
    BASE + "SELECT cv_id, original_filename FROM cvs WHERE tier = 'good' AND contains(lower(original_filename), '1_r.t')",
)
def v5_filter_cvs(spark, sf):
    return views.filter_cvs(inputs.cvs(spark, sf), "good", "  1_R.t ").select("cv_id", "original_filename")


def placed(ordered, *keys):
    """The order in which a sorted table's rows come out, as places within `keys`. The order is written down
    as it is, so a lost sort shows."""
    numbered = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_at")).cast("long"))


NAMED = sql.CVS.replace("'CV_' ||", "['CV_', 'cv ', 'Été-', 'ete.', 'Zoë_', 'zoe_'][l_partkey % 6 + 1] ||")


def named_cvs(spark, sf):
    """File names with accents, case and marks."""
    prefix = F.element_at(F.array(*map(F.lit, ["CV_", "cv ", "Été-", "ete.", "Zoë_", "zoe_"])), (F.split("cv_id", "-")[2].cast("int") % 6 + 1))
    return inputs.cvs(spark, sf).withColumn("original_filename", F.concat(prefix, F.expr("substring(original_filename, 4)")))


SORTS = {
    "score": ("finalScore", "coalesce(final_score, -1)"),
    "years": ("yearsOfExperience", "years_of_experience"),
    "tier": ("tier", "CASE tier WHEN 'great' THEN 3 WHEN 'good' THEN 2 ELSE 1 END"),
    "filename": ("originalFilename", "original_filename COLLATE en_us"),
}


def _sort_check(name, key, expression, direction):
    @check(
        f"v6_sort_by_{name}" + ("" if (name in ("score", "tier")) == (direction == "desc") else f"_{direction}"),
        sql.with_(NAMED) + f"""SELECT job_position_id, cv_id, row_number() OVER (PARTITION BY job_position_id
        ORDER BY {expression} {direction}, cv_id) AS place FROM cvs""",
    )
    def query(spark, sf):
        return placed(views.sort_cvs(named_cvs(spark, sf), key, direction), "job_position_id").select("job_position_id", "cv_id", "place")


for _name, (_key, _expression) in SORTS.items():
    for _direction in ("asc", "desc"):
        _sort_check(_name, _key, _expression, _direction)


@check("v7_tier_rank", BASE + "SELECT cv_id, CASE tier WHEN 'great' THEN 3 WHEN 'good' THEN 2 ELSE 1 END AS tier_rank FROM cvs")
def v7_tier_rank(spark, sf):
    return inputs.cvs(spark, sf).select("cv_id", views.tier_rank(F.col("tier")).alias("tier_rank"))


RESUMES = sql.with_(sql.TEMPLATES, SECTIONED, ENRICHED)


@check(
    "v10_top_skills",
    RESUMES + """SELECT cv_id, array_to_string(technologies[1:3], ',') AS skills,
    greatest(len(technologies) - 3, 0) AS more FROM enriched""",
)
def v10_top_skills(spark, sf):
    skills = views.top_skills(enrich(inputs.template_cvs(spark, sf)))
    return skills.select("cv_id", F.array_join("skills", ",").alias("skills"), F.col("more").cast("long").alias("more"))


@check(
    "v11_jobs_of",
    BASE + """SELECT user_id, job_position_id, row_number() OVER (PARTITION BY user_id
    ORDER BY created_at DESC, job_position_id) AS place FROM jobs""",
)
def v11_jobs_of(spark, sf):
    """Every owner's list; the place number shows its order."""
    return placed(views.jobs_of(inputs.jobs(spark, sf)), "user_id").select("user_id", "job_position_id", "place")


@check(
    "v12_job_header",
    BASE + f"""SELECT job_position_id, title, status, total_cvs, round(ai_cost_usd, 6) AS ai_cost_usd, {COUNT_COLUMNS}
    FROM jobs LEFT JOIN counts USING (job_position_id)""",
)
def v12_job_header(spark, sf):
    header = views.job_header(inputs.jobs(spark, sf), inputs.cvs(spark, sf))
    return header.withColumn("ai_cost_usd", F.round("ai_cost_usd", 6))


@check(
    "v13_sections_long",
    RESUMES + " UNION ALL ".join(
        f"SELECT cv_id, {i} AS display_pos, '{n}' AS section, {sql.trim(n)} AS content FROM sectioned WHERE {sql.trim(n)} <> ''"
        for i, n in enumerate(["summary", "experience", "skills", "education", "other"])
    ),
)
def v13_sections_long(spark, sf):
    return views.sections_long(detect_sections(inputs.template_cvs(spark, sf)))


@check(
    "v13_has_sections",
    RESUMES + "SELECT cv_id, concat(summary, experience, skills, education, other) <> '' AS has_sections FROM sectioned",
)
def v13_has_sections(spark, sf):
    sectioned = detect_sections(inputs.template_cvs(spark, sf))
    return sectioned.select("cv_id", views.has_sections(F.col("sections")).alias("has_sections"))


@check("v14_any_active", BASE + "SELECT bool_or(status IN ('EXTRACTING_REQUIREMENTS', 'PROCESSING')) AS any_active FROM jobs")
def v14_any_active(spark, sf):
    return views.any_active(inputs.jobs(spark, sf))


@check(
    "v15_readiness",
    BASE + """SELECT job_position_id, status, status IN ('CREATED', 'FAILED') AS needs_extraction,
    status IN ('REQUIREMENTS_EXTRACTED', 'PROCESSING', 'COMPLETED') AS can_upload FROM jobs""",
)
def v15_readiness(spark, sf):
    return views.readiness(inputs.jobs(spark, sf))


@check(
    "v16_lookup",
    BASE + """SELECT k.job_position_id, j.title, j.job_position_id IS NOT NULL AS found
    FROM (SELECT c_custkey * 13 AS job_position_id FROM customer) k LEFT JOIN jobs j USING (job_position_id)""",
)
def v16_lookup(spark, sf):
    asked = inputs.table(spark, sf, "customer").select((F.col("c_custkey") * 13).alias("job_position_id"))
    return views.lookup(inputs.jobs(spark, sf), asked, "job_position_id").select("job_position_id", "title", "found")


@check(
    "v17_flatten_ranked",
    BASE + "SELECT cv_id, CASE tier WHEN 'great' THEN 0 WHEN 'good' THEN 1 ELSE 2 END AS bucket_pos FROM cvs",
)
def v17_flatten_ranked(spark, sf):
    rows = inputs.cvs(spark, sf).select("cv_id", "tier").withColumn("bucket", views.tier_bucket(F.col("tier")))
    parts = [rows.where(F.col("bucket") == b) for b in ("great", "good", "noMatch")]
    return views.flatten_ranked(*parts).select("cv_id", "bucket_pos")


FACTS = RESUMES.rstrip() + """, facts AS (
 SELECT cv_id, 'technology' AS kind, unnest(technologies) AS item FROM enriched
 UNION ALL SELECT cv_id, 'degree', unnest(degrees) FROM enriched
 UNION ALL SELECT DISTINCT cv_id, 'company', unnest(company_items) FROM enriched
 UNION ALL SELECT DISTINCT cv_id, 'role', unnest(role_items) FROM enriched)
"""


@check("v18_entity_facts", FACTS + "SELECT cv_id, kind, item FROM facts")
def v18_entity_facts(spark, sf):
    return views.entity_facts(enrich(inputs.template_cvs(spark, sf)))


@check("v18_fact_counts", FACTS + "SELECT kind, item, count(*) AS cvs FROM facts GROUP BY 1, 2")
def v18_fact_counts(spark, sf):
    return views.fact_counts(views.entity_facts(enrich(inputs.template_cvs(spark, sf))))


@check(
    "v19_screening_funnel",
    BASE + """, funnel AS (SELECT job_position_id, count(*) AS uploaded, count(*) FILTER (WHERE p) AS parsed,
     count(*) FILTER (WHERE p AND (s OR coalesce(tier IN ('good', 'great'), false))) AS gated,
     count(*) FILTER (WHERE p AND s) AS scored, count(*) FILTER (WHERE tier = 'great') AS great,
     count(*) FILTER (WHERE tier = 'good') AS good
     FROM (SELECT *, parsing_confidence <> 'failed' AS p, ai_model_used IS NOT NULL AS s FROM cvs) GROUP BY 1)
    SELECT j.job_position_id, coalesce(uploaded, 0) AS uploaded, coalesce(parsed, 0) AS parsed, coalesce(gated, 0) AS gated,
     coalesce(scored, 0) AS scored, coalesce(great, 0) AS great, coalesce(good, 0) AS good,
     round((uploaded - gated) / uploaded::DOUBLE, 6) AS elimination_rate FROM jobs j LEFT JOIN funnel USING (job_position_id)""",
)
def v19_screening_funnel(spark, sf):
    funnel = views.screening_funnel(inputs.jobs(spark, sf), inputs.cvs(spark, sf))
    return funnel.withColumn("elimination_rate", F.round("elimination_rate", 6))
