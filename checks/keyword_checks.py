"""Keyword stage over every document and every template CV."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.registry import check
from shortlist.functions import fixed
from shortlist.functions.text import boundary_match, normalize
from shortlist.operators import keyword, parsing, scoring

KW = sql.with_(sql.CORPUS_REQS, sql.DOCS, sql.matches("docs", "corpus_reqs"))
JUDGED = sql.with_(sql.CORPUS_REQS, sql.DOCS, sql.matches("docs", "corpus_reqs"), sql.JUDGED)


def long_sentences(spark, sf):
    return parsing.explode_sentences(inputs.document_cvs(spark, sf), "job_position_id")


def scored_documents(spark, sf):
    return keyword.score_requirements(
        inputs.document_sentences(spark, sf), inputs.corpus_requirements(spark)
    )


def joined(col):
    return F.array_join(col, "\n")


@check(
    "k1_needles",
    # Requirement texts of our own from the part table, so that the list grows with it.
    f"""WITH reqs AS (SELECT p_brand AS job_position_id, p_partkey AS requirement_id,
     ['-' || p_name, ' - '] AS keywords, [upper(p_type), p_brand || '  ' || p_size] AS synonyms FROM part)
    SELECT job_position_id, requirement_id, i - 1 AS needle_pos, terms[i] AS needle FROM (
     SELECT *, [n FOR n IN [{sql.normalize('k')} FOR k IN list_concat(keywords, synonyms)] IF n <> ''] AS terms
     FROM reqs), LATERAL (SELECT unnest(generate_series(1, len(terms))) AS i)""",
)
def k1_needles(spark, sf):
    parts = inputs.table(spark, sf, "part")
    reqs = parts.select(
        F.col("p_brand").alias("job_position_id"),
        F.lit(0).alias("req_pos"),
        F.col("p_partkey").alias("requirement_id"),
        F.array(F.concat(F.lit("-"), "p_name"), F.lit(" - ")).alias("keywords"),
        F.array(F.upper("p_type"), F.concat("p_brand", F.lit("  "), F.col("p_size").cast("string"))).alias("synonyms"),
    )
    return keyword.needles(reqs).select("job_position_id", "requirement_id", F.col("needle_pos").cast("long").alias("needle_pos"), "needle")


@check("k2_normalize", f"SELECT doc_id AS cv_id, {sql.normalize('text')} AS norm FROM documents")
def k2_normalize(spark, sf):
    return inputs.document_cvs(spark, sf).select("cv_id", normalize(F.col("raw_text")).alias("norm"))


PAIRS = [("the", "the"), ("und", "und"), ("c_plus", "c++"), ("net", ".net"), ("of_the", "of the"), ("accent", "é"), ("rest", "rest")]


@check(
    "k3_boundary_match",
    f"SELECT cv_id, {', '.join(sql.boundary('norm', repr(n)) + f' AS hit_{a}' for a, n in PAIRS)} FROM "
    f"(SELECT doc_id AS cv_id, {sql.normalize('text')} AS norm FROM documents)",
)
def k3_boundary_match(spark, sf):
    norms = inputs.document_cvs(spark, sf).select("cv_id", normalize(F.col("raw_text")).alias("norm"))
    return norms.select(
        "cv_id", *[boundary_match(F.col("norm"), F.lit(n)).alias(f"hit_{a}") for a, n in PAIRS]
    )


@check(
    "k4_match_sentences",
    KW + "SELECT cv_id, requirement_id, pos - 1 AS pos, sentence FROM hit",
)
def k4_match_sentences(spark, sf):
    hits = keyword.match_sentences(long_sentences(spark, sf), inputs.corpus_requirements(spark))
    return hits.select("cv_id", "requirement_id", F.col("pos").cast("long").alias("pos"), "sentence")


@check(
    "k5_collect_matches",
    KW + "SELECT cv_id, requirement_id, array_to_string(matched, chr(10)) AS matched, n AS matches FROM hits",
)
def k5_collect_matches(spark, sf):
    hits = keyword.match_sentences(long_sentences(spark, sf), inputs.corpus_requirements(spark))
    return keyword.collect_matches(hits).select(
        "cv_id",
        "requirement_id",
        joined(F.col("matched_sentences")).alias("matched"),
        F.size("matched_sentences").cast("long").alias("matches"),
    )


@check("k6_raw_score", KW + "SELECT cv_id, requirement_id, score AS raw_score FROM kw")
def k6_raw_score(spark, sf):
    rows = keyword.score_rows(scored_documents(spark, sf))
    return rows.select(
        "cv_id", "requirement_id", scoring.raw_score(F.size("matched_sentences")).alias("raw_score")
    )


@check(
    "k7_weighted_score",
    JUDGED + "SELECT cv_id, round(preliminary_score, 6) AS weighted_score FROM agg",
)
def k7_weighted_score(spark, sf):
    rows = keyword.score_rows(scored_documents(spark, sf))
    return scoring.weighted_score(rows, ["cv_id"]).select(
        "cv_id", F.round("weighted_score", 6).alias("weighted_score")
    )


@check(
    "k8_missing_required",
    JUDGED + """SELECT a.cv_id, a.missing_required, a.total_required, l.low_required FROM agg a JOIN
    (SELECT cv_id, count(*) FILTER (WHERE is_required AND score < 0.5) AS low_required FROM kw GROUP BY 1) l
    USING (cv_id)""",
)
def k8_missing_required(spark, sf):
    rows = keyword.score_rows(scored_documents(spark, sf)).withColumn(
        "_low", F.col("is_required") & scoring.ai_missing(F.col("score"))
    )
    by_zero = scoring.missing_required(rows, ["cv_id"], scoring.keyword_missing)
    by_low = scoring.missing_required(rows, ["cv_id"], scoring.ai_missing)
    return by_zero.join(
        by_low.select("cv_id", F.col("missing_required").alias("low_required")), "cv_id"
    )


def facts(spark, sf):
    """Score and counts straight from the keys, so every branch of the tier rule is met."""
    k = F.col("l_orderkey") + F.col("l_partkey")
    return inputs.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        (F.col("l_extendedprice") % 101).alias("score"),
        (k % 7).cast("int").alias("missing"),
        (k % 9).cast("int").alias("total"),
    )


FACTS = """WITH facts AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice % 101 AS score,
 ((l_orderkey + l_partkey) % 7)::INT AS missing, ((l_orderkey + l_partkey) % 9)::INT AS total FROM lineitem)
"""


@check(
    "k9_assign_tier",
    FACTS + f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {sql.tier('score', 'missing', 'total', 70, 40, '0.6')} AS keyword_tier,
    {sql.tier('score', 'missing', 'total', 85, 60, '0.5')} AS final_tier FROM facts""",
)
def k9_assign_tier(spark, sf):
    args = (F.col("score"), F.col("missing"), F.col("total"))
    return facts(spark, sf).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        scoring.assign_tier(*args, fixed.KEYWORD_THRESHOLDS).alias("keyword_tier"),
        scoring.assign_tier(*args, fixed.FINAL_THRESHOLDS).alias("final_tier"),
    )


@check(
    "k10_elimination_reason",
    FACTS + f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE
    WHEN {sql.tier('score', 'missing', 'total', 70, 40, '0.6')} <> 'no-match' THEN NULL
    WHEN total > 0 AND missing >= ceil(total * 0.6::DOUBLE)
    THEN 'Missing ' || missing || ' of ' || total || ' required requirements'
    ELSE 'Score too low (' || {sql.one_decimal('score')} || '/100)' END AS reason FROM facts""",
)
def k10_elimination_reason(spark, sf):
    args = (F.col("score"), F.col("missing"), F.col("total"))
    tiered = facts(spark, sf).withColumn("tier", scoring.assign_tier(*args, fixed.KEYWORD_THRESHOLDS))
    return tiered.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        scoring.elimination_reason(F.col("tier"), F.col("missing"), F.col("total"), F.col("score")).alias("reason"),
    )


@check(
    "k11_keyword_scores_map",
    KW + """SELECT cv_id, requirement_id, array_to_string(matched_sentences, chr(10)) AS matched,
    score AS raw_score FROM kw UNION ALL SELECT cv_id, NULL, NULL, NULL FROM bare""",
)
def k11_keyword_scores_map(spark, sf):
    mapped = scored_documents(spark, sf).select(
        "cv_id", keyword.keyword_scores_map(F.col("scored")).alias("keyword_scores")
    )
    entries = mapped.select("cv_id", F.explode_outer("keyword_scores").alias("requirement_id", "entry"))
    return entries.select(
        "cv_id", "requirement_id", joined(F.col("entry.matched_sentences")).alias("matched"), "entry.raw_score"
    )


LONG_KW = sql.with_(sql.LONG_REQS, sql.DOCS, sql.matches("docs", "long_reqs"))


@check("k4_long_lists", LONG_KW + "SELECT cv_id, requirement_id, pos - 1 AS pos, sentence FROM hit")
def k4_long_lists(spark, sf):
    hits = keyword.match_sentences(long_sentences(spark, sf), inputs.long_requirements(spark, sf))
    return hits.select("cv_id", "requirement_id", F.col("pos").cast("long").alias("pos"), "sentence")


RESULT = """SELECT cv_id, job_position_id, round(preliminary_score, 6) AS preliminary_score,
missing_required, total_required, tier, elimination_reason FROM screened"""


def result(df):
    return df.select(
        "cv_id",
        "job_position_id",
        F.round("preliminary_score", 6).alias("preliminary_score"),
        F.col("missing_required").cast("long").alias("missing_required"),
        F.col("total_required").cast("long").alias("total_required"),
        "tier",
        "elimination_reason",
    )


@check("k12_keyword_filter", JUDGED + RESULT)
def k12_keyword_filter(spark, sf):
    return result(
        keyword.keyword_filter(inputs.document_sentences(spark, sf), inputs.corpus_requirements(spark))
    )


@check(
    "k12_keyword_filter_resumes",
    sql.with_(
        sql.DEMO_REQS, sql.TEMPLATES,
        f"cv_rows AS (SELECT *, {sql.sentences('raw_text')} AS sentences FROM template_base)",
        sql.matches("cv_rows", "demo_reqs"), sql.JUDGED,
    ) + RESULT,
)
def k12_keyword_filter_resumes(spark, sf):
    return result(
        keyword.keyword_filter(parsing.sentences(inputs.template_cvs(spark, sf)), inputs.demo_requirements(spark))
    )


@check("k12_long_lists", sql.with_(sql.LONG_REQS, sql.DOCS, sql.matches("docs", "long_reqs"), sql.JUDGED) + RESULT)
def k12_long_lists(spark, sf):
    return result(
        keyword.keyword_verdicts(inputs.document_sentences(spark, sf), inputs.long_requirements(spark, sf))
    )
