"""Model stage and final stage over every document, with a deterministic stand-in for the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.keyword_checks import scored_documents
from checks.registry import check
from checks.text_checks import TECH_SQL, YEARS_SQL, _redacted_sql
from shortlist.cluster import cut_lineage
from shortlist.functions import redaction
from shortlist.functions.text import json_string
from shortlist.operators import final, inference, keyword, views
from shortlist.operators.parsing import enrich, sentences


def screened_documents(spark, sf):
    return keyword.judge(scored_documents(spark, sf))


def stored_screening(spark, sf):
    """Screened CVs as a flow keeps them: both the prompts and the merge of answers read them."""
    return cut_lineage(screened_documents(spark, sf).drop("sentences"))


def ai_answers(gated):
    """Answers derived from the CV key: broken JSON, failed calls, partial, repeated and missing
    scores each occur on a share of the CVs."""
    k = F.col("cv_id")

    def entry(r):
        place = ((k * 7 + r["req_pos"] * 3) % 4 + 1).cast("int")
        score = F.element_at(F.array(*map(F.lit, [0.0, 0.3, 0.6, 1.0])), place)
        quote = F.when(score > 0, F.coalesce(F.try_element_at(r["matched_sentences"], F.lit(1)), F.lit(""))).otherwise("")
        return F.concat(
            F.lit('{"requirementId": '), json_string(r["requirement_id"]), F.lit(', "score": '), score.cast("string"),
            F.lit(', "reasoning": "because", "evidence": '), json_string(quote), F.lit("}"),
        )

    entries = F.transform("scored", entry)
    again = F.concat(
        F.lit('{"requirementId": '), json_string(F.col("scored")[0]["requirement_id"]),
        F.lit(', "score": 0.0, "reasoning": "again", "evidence": ""}'),
    )
    listed = (
        F.when(k % 5 == 0, F.slice(entries, 1, 1))
        .when(k % 17 == 0, F.array_insert(entries, 2, again))
        .otherwise(entries)
    )
    good = F.concat(F.lit('{"scores": ['), F.array_join(listed, ", "), F.lit('], "overallSummary": "fits"}'))
    content = (
        F.when(k % 11 == 0, F.lit('{"scores": [ not json'))
        .when(k % 13 == 0, F.lit(None).cast("string"))
        .when((k % 19 == 0) & (k % 5 != 0) & (k % 17 != 0), F.lit('{"overallSummary": "none"}'))
        .otherwise(good)
    )
    failed = (k % 11 != 0) & (k % 13 == 0)
    return inference.route_model(gated).select(
        "cv_id",
        "job_position_id",
        "model",
        content.alias("content"),
        F.when(failed, 0).otherwise(1000 + k % 500).cast("long").alias("prompt_tokens"),
        F.when(failed, 0).otherwise(200 + k % 100).cast("long").alias("completion_tokens"),
        F.when(failed, "429 rate limit").alias("error"),
    )


def answered(screened):
    answers = cut_lineage(ai_answers(inference.gate_candidates(screened)))  # as a flow stores them
    return inference.estimate_cost(inference.parse_responses(answers))


SCREENED = [sql.CORPUS_REQS, sql.DOCS, sql.matches("docs", "corpus_reqs"), sql.JUDGED]
AI = """cand AS (SELECT cv_id, job_position_id, tier, CASE WHEN tier = 'great' THEN 'gpt-5.1' ELSE 'gpt-5-mini' END AS model,
  CASE WHEN cv_id % 11 = 0 THEN 'broken' WHEN cv_id % 13 = 0 THEN 'failed' WHEN cv_id % 5 = 0 THEN 'partial'
   WHEN cv_id % 17 = 0 THEN 'repeat' WHEN cv_id % 19 = 0 THEN 'empty' ELSE 'full' END AS kind
  FROM screened WHERE tier IN ('good', 'great')),
called AS (SELECT *, CASE WHEN kind = 'failed' THEN 0 ELSE 1000 + cv_id % 500 END AS prompt_tokens,
  CASE WHEN kind = 'failed' THEN 0 ELSE 200 + cv_id % 100 END AS completion_tokens,
  CASE kind WHEN 'broken' THEN 'AI response was not valid JSON' WHEN 'failed' THEN '429 rate limit'
   WHEN 'empty' THEN 'AI response has no scores' END AS error FROM cand),
costed AS (SELECT *, prompt_tokens / 1e6::DOUBLE * CASE WHEN tier = 'great' THEN 1.25::DOUBLE ELSE 0.25::DOUBLE END
  + completion_tokens / 1e6::DOUBLE * CASE WHEN tier = 'great' THEN 10::DOUBLE ELSE 2::DOUBLE END AS cost_usd FROM called),
plain AS (SELECT k.cv_id, k.job_position_id, k.req_pos, k.requirement_id, c.kind,
  [0.0::DOUBLE, 0.3::DOUBLE, 0.6::DOUBLE, 1.0::DOUBLE][(k.cv_id * 7 + k.req_pos * 3) % 4 + 1] AS ai_score,
  coalesce(k.matched_sentences[1], '') AS first_match
  FROM kw k JOIN cand c USING (cv_id) WHERE kind IN ('full', 'partial', 'repeat') AND (kind <> 'partial' OR k.req_pos = 0)),
ai_long AS (SELECT cv_id, job_position_id, CASE WHEN kind = 'repeat' AND req_pos > 0 THEN req_pos + 1 ELSE req_pos END AS pos,
  requirement_id, ai_score AS score, CASE WHEN ai_score > 0 THEN first_match ELSE '' END AS evidence FROM plain
  UNION ALL SELECT cv_id, job_position_id, 1, requirement_id, 0.0, '' FROM plain WHERE kind = 'repeat' AND req_pos = 0),
best AS (SELECT k.cv_id, k.job_position_id, k.req_pos, k.requirement_id, k.text, k.weight, k.is_required, k.matched_sentences,
  coalesce(p.ai_score, k.score) AS score, CASE WHEN p.cv_id IS NULL THEN 'Keyword' ELSE 'AI' END AS source,
  CASE WHEN p.ai_score > 0 THEN p.first_match WHEN p.cv_id IS NOT NULL THEN '' END AS evidence
  FROM kw k LEFT JOIN plain p ON p.cv_id = k.cv_id AND p.requirement_id = k.requirement_id)"""
FINAL = f"""settled AS (SELECT cv_id, greatest(0.0::DOUBLE, floor(sum(score * {sql.WEIGHT}) / sum({sql.WEIGHT}) * 100 + 0.5)) AS final_score,
  count(*) FILTER (WHERE is_required AND score < 0.5) AS missing_required,
  count(*) FILTER (WHERE is_required) AS total_required FROM best GROUP BY 1),
verdicts AS (SELECT *, {sql.tier('final_score', 'missing_required', 'total_required', 85, 60, '0.5')} AS final_tier FROM settled)"""
BASE = sql.with_(*SCREENED, AI, FINAL)


@check(
    "a1_gate_candidates",
    BASE + """SELECT job_position_id, count(*) FILTER (WHERE tier IN ('good', 'great')) AS candidates,
    count(*) FILTER (WHERE tier NOT IN ('good', 'great')) AS skipped FROM screened GROUP BY 1""",
)
def a1_gate_candidates(spark, sf):
    return inference.gate_counts(screened_documents(spark, sf))


@check("a2_route_model", BASE + "SELECT cv_id, model FROM cand")
def a2_route_model(spark, sf):
    return inference.route_model(inference.gate_candidates(screened_documents(spark, sf))).select("cv_id", "model")


RESUMES = [
    sql.DEMO_REQS, sql.TEMPLATES,
    f"cv_rows AS (SELECT *, {sql.sentences('raw_text')} AS sentences FROM template_base)",
    sql.matches("cv_rows", "demo_reqs"), sql.JUDGED,
]


def _inline_sql(x):
    """The in-line redaction steps on one sentence."""
    from checks.text_checks import STEPS

    for name, (_, as_sql) in STEPS.items():
        if name != "r7_redact_name":
            x = as_sql(x)
    return x


@check(
    "a3_scoring_prompts",
    sql.with_(*RESUMES, f"safe AS (SELECT cv_id, anonymized_text FROM {_redacted_sql('template_base')})",
              f"facts AS (SELECT cv_id, {YEARS_SQL} AS years, array_to_string({TECH_SQL}, ', ') AS techs FROM template_base)",
              f"""lines AS (SELECT cv_id, string_agg(CASE WHEN len(matched_sentences) > 0 THEN requirement_id || ': ' ||
               array_to_string([{_inline_sql('m')} FOR m IN matched_sentences], ' | ') END, chr(10) ORDER BY req_pos) AS body,
               string_agg('  {{' || chr(10) || '    "id": "' || requirement_id || '",' || chr(10) || '    "text": "' || text || '",' || chr(10)
                || '    "isRequired": ' || is_required || ',' || chr(10) || '    "weight": ' || weight || chr(10) || '  }}',
                ',' || chr(10) ORDER BY req_pos) AS listed FROM kw GROUP BY 1)""")
    + """SELECT cv_id, '[' || chr(10) || listed || chr(10) || ']' AS prompt_requirements,
     CASE WHEN techs = '' THEN '(none detected)' ELSE techs END AS prompt_technologies,
     coalesce(body, '(no keyword matches found — read the full CV below)') AS prompt_matches,
     'years of work ' || years AS years_line, anonymized_text AS tail
    FROM screened JOIN lines USING (cv_id) JOIN facts USING (cv_id) JOIN safe USING (cv_id) WHERE tier IN ('good', 'great')""",
)
def a3_scoring_prompts(spark, sf):
    matched = keyword.keyword_filter(sentences(inputs.template_cvs(spark, sf)), inputs.demo_requirements(spark))
    survivors = inference.gate_candidates(matched).drop("sentences")
    gated = redaction.redact(enrich(survivors))  # the costly steps only for those the model will see
    prompts = inference.scoring_prompts(gated)
    start = F.element_at(F.split("user_prompt", "personal data removed:\n"), 2)
    return prompts.select(
        "cv_id",
        "prompt_requirements",
        "prompt_technologies",
        "prompt_matches",
        F.regexp_extract("user_prompt", r"(years of work \d+)", 1).alias("years_line"),
        F.element_at(F.split(start, "\n\nAnswer with one JSON object"), 1).alias("tail"),
    )


@check(
    "a4_batch_infer",
    """SELECT doc_id AS cv_id, CASE WHEN length(text) % 10 <> 3 THEN length(text)::VARCHAR END AS content,
    CASE WHEN length(text) % 10 <> 3 THEN length(text) ELSE 0 END AS prompt_tokens,
    CASE WHEN length(text) % 10 = 3 THEN '429 rate limit' END AS error FROM documents""",
)
def a4_batch_infer(spark, sf):
    def client(model, system, user):
        if len(user) % 10 == 3:
            raise RuntimeError("429 rate limit")
        return str(len(user)), len(user), 1

    prompts = inputs.document_cvs(spark, sf).select(
        "cv_id", F.lit("m").alias("model"), F.lit("s").alias("system_prompt"), F.col("raw_text").alias("user_prompt")
    )
    return inference.batch_infer(prompts, client, retries=1, first_wait=0.0).select(
        "cv_id", "content", "prompt_tokens", "error"
    )


@check(
    "a5_parse_responses",
    BASE + """SELECT c.cv_id, c.error, n.entries, n.total FROM called c LEFT JOIN
    (SELECT cv_id, count(*) AS entries, round(sum(score), 6) AS total FROM ai_long GROUP BY 1) n USING (cv_id)""",
)
def a5_parse_responses(spark, sf):
    parsed = inference.parse_responses(ai_answers(inference.gate_candidates(screened_documents(spark, sf))))
    scores = F.col("ai_scores.scores")
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s["score"])
    return parsed.select(
        "cv_id", "error",
        F.when(scores.isNotNull(), F.size(scores)).cast("long").alias("entries"),
        F.round(total, 6).alias("total"),
    )


@check("a6_estimate_cost", BASE + "SELECT cv_id, round(cost_usd, 9) AS cost_usd FROM costed")
def a6_estimate_cost(spark, sf):
    return answered(screened_documents(spark, sf)).select("cv_id", F.round("cost_usd", 9).alias("cost_usd"))


@check(
    "a7_score_quality",
    BASE + f"""SELECT a.cv_id, a.pos, a.requirement_id, a.score IN (0.0, 0.3, 0.6, 1.0) AS on_scale,
     a.score <= 0 OR a.evidence <> '' AS evidence_given,
     a.evidence = '' OR contains(safe.anonymized_text, a.evidence) AS evidence_verbatim,
     true AS cv_known, true AS requirement_known, r.n > 1 AS repeated FROM ai_long a
    JOIN (SELECT cv_id, anonymized_text FROM {_redacted_sql('(SELECT cv_id, raw_text FROM docs)')}) safe USING (cv_id)
    JOIN (SELECT cv_id, requirement_id, count(*) AS n FROM ai_long GROUP BY ALL) r
     ON r.cv_id = a.cv_id AND r.requirement_id = a.requirement_id
    UNION ALL SELECT CASE WHEN pos = 0 THEN -1 - cv_id ELSE cv_id END, pos + 100, 'req_99', score IN (0.0, 0.3, 0.6, 1.0),
     score <= 0 OR evidence <> '', evidence = '' OR (pos > 0 AND contains(anonymized_text, evidence)), pos > 0, false,
     pos > 0 AND count(*) FILTER (WHERE pos > 0) OVER (PARTITION BY cv_id) > 1
    FROM ai_long JOIN {_redacted_sql('(SELECT cv_id, raw_text FROM docs)')} USING (cv_id)""",
)
def a7_score_quality(spark, sf):
    parsed = answered(screened_documents(spark, sf))
    entries = parsed.select("cv_id", F.posexplode("ai_scores.scores").alias("pos", "s")).select(
        "cv_id", F.col("pos").cast("long").alias("pos"), F.col("s.requirementId").alias("requirement_id"), "s.score", "s.evidence"
    )
    unknown = F.when(F.col("pos") == 0, -1 - F.col("cv_id")).otherwise(F.col("cv_id"))  # no such CV, no such requirement
    entries = entries.unionByName(
        entries.withColumns({"cv_id": unknown, "pos": F.col("pos") + 100, "requirement_id": F.lit("req_99")})
    )
    texts = redaction.redact(inputs.document_cvs(spark, sf))
    return inference.score_quality(entries, inputs.corpus_requirements(spark), texts)


@check(
    "a8_extract_requirements",
    """SELECT doc_id AS job_position_id, CASE n % 3 WHEN 0 THEN 'req_1=A' || n || '/' WHEN 1 THEN NULL END AS summary,
     CASE n % 3 WHEN 1 THEN 'AI returned no usable requirements' WHEN 2 THEN 'down' END AS error,
     CASE WHEN n % 3 = 2 THEN 0.0 ELSE round(n / 1e6::DOUBLE * 0.25::DOUBLE + 0.00002::DOUBLE, 9) END AS cost_usd
    FROM (SELECT doc_id, length(text) AS n FROM documents)""",
)
def a8_extract_requirements(spark, sf):
    jobs = inputs.document_cvs(spark, sf).select(
        F.col("cv_id").alias("job_position_id"), F.col("raw_text").alias("job_description_text")
    )

    def client(model, system, user):
        body = user[len("The advertisement:\n"):user.rindex("\n\nAnswer with one JSON object")]
        n = len(body)
        if n % 3 == 2:
            raise RuntimeError("down")
        if n % 3 == 1:
            return '{"requirements": []}', n, 10
        return '{"requirements": [null, {"text": "A%d", "keywords": ["k"]}]}' % n, n, 10

    found = inference.extract_requirements(jobs, client, retries=0)
    summary = F.array_join(
        F.transform("requirements", lambda r: F.concat(r["id"], F.lit("="), r["text"], F.lit("/"), F.array_join(r["synonyms"], ","))), ";"
    )
    return found.select("job_position_id", summary.alias("summary"), "error", F.round("cost_usd", 9).alias("cost_usd"))


@check("f1_best_scores", BASE + "SELECT cv_id, requirement_id, score, source FROM best")
def f1_best_scores(spark, sf):
    screened = stored_screening(spark, sf)
    return final.best_scores(screened, answered(screened)).select("cv_id", "requirement_id", "score", "source")


@check(
    "f2_final_score",
    BASE + """SELECT cv_id, final_score, missing_required, final_tier AS tier FROM verdicts
    UNION ALL SELECT cv_id, 0, 0, 'no-match' FROM bare""",
)
def f2_final_score(spark, sf):
    screened = stored_screening(spark, sf)
    joined = screened.join(answered(screened).select("cv_id", "ai_scores"), "cv_id", "left")
    best = joined.withColumn("scored", final.best_of(F.col("scored"), F.col("ai_scores.scores")))
    return final.final_score(best).select(
        "cv_id", "final_score", F.col("missing_required").cast("long").alias("missing_required"), "tier"
    )


def with_model_columns(screened):
    """Screened CVs with the columns a stored row has; every 29th already has model scores."""
    old = F.from_json(F.lit('{"scores": [], "overallSummary": "old"}'), "scores array<struct<requirementId:string,score:double,reasoning:string,evidence:string>>, overallSummary string")
    return screened.withColumnRenamed("preliminary_score", "final_score").withColumns(
        {
            "ai_scores": F.when(F.col("cv_id") % 29 == 0, old),
            "ai_model_used": F.lit(None).cast("string"),
            "ai_cost_usd": F.lit(0.0),
        }
    )


@check(
    "f3_apply_ai_results",
    BASE + """SELECT s.cv_id, round(CASE WHEN c.cv_id IS NULL THEN s.preliminary_score ELSE v.final_score END, 6) AS final_score,
     CASE WHEN c.cv_id IS NULL THEN s.tier ELSE v.final_tier END AS tier, s.elimination_reason, c.model AS ai_model_used,
     round(coalesce(c.cost_usd, 0), 9) AS ai_cost_usd,
     CASE WHEN c.kind IN ('full', 'partial', 'repeat') THEN 'fits' WHEN s.cv_id % 29 = 0 THEN 'old' END AS summary
    FROM screened s LEFT JOIN verdicts v USING (cv_id) LEFT JOIN costed c ON c.cv_id = s.cv_id""",
)
def f3_apply_ai_results(spark, sf):
    screened = stored_screening(spark, sf)
    merged = final.apply_ai_results(with_model_columns(screened), answered(screened))
    return merged.select(
        "cv_id",
        F.round("final_score", 6).alias("final_score"),
        "tier",
        "elimination_reason",
        "ai_model_used",
        F.round("ai_cost_usd", 9).alias("ai_cost_usd"),
        F.col("ai_scores.overallSummary").alias("summary"),
    )


@check(
    "f4_run_totals",
    BASE + """SELECT job_position_id, round(coalesce(sum(cost_usd), 0), 8) AS ai_cost_delta, count(cost_usd) AS candidates,
     count(error) AS failures, count(*) FILTER (WHERE s.tier NOT IN ('good', 'great')) AS skipped
    FROM screened s LEFT JOIN (SELECT cv_id, cost_usd, error FROM costed) USING (cv_id) GROUP BY 1""",
)
def f4_run_totals(spark, sf):
    screened = stored_screening(spark, sf)
    totals = final.run_totals(answered(screened), inference.gate_counts(screened))
    return totals.select("job_position_id", F.round("ai_cost_delta", 8).alias("ai_cost_delta"), "candidates", "failures", "skipped")


@check(
    "v8_explain",
    BASE + """SELECT cv_id, requirement_id, text, weight, is_required, score, source, evidence,
     CASE WHEN source = 'AI' THEN 'because' END AS reasoning,
     CASE WHEN score >= 0.8 THEN 'met' WHEN score > 0 THEN 'partial' ELSE 'missing' END AS icon,
     CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'middle' WHEN score > 0 THEN 'low' ELSE 'none' END AS bar,
     score * 10 AS out_of_ten, len(matched_sentences) AS matches FROM best""",
)
def v8_explain(spark, sf):
    screened = stored_screening(spark, sf)
    stored = final.apply_ai_results(with_model_columns(screened), answered(screened))
    rows = views.explain(stored)
    return rows.select(
        "cv_id", "requirement_id", "text", "weight", "is_required", "score", "source", "evidence", "reasoning",
        "icon", "bar", "out_of_ten", F.size("matched_sentences").cast("long").alias("matches"),
    )


@check(
    "v9_match_preview",
    BASE + """SELECT cv_id, requirement_id, array_to_string(matched_sentences[1:6], chr(10)) AS preview,
    len(matched_sentences) AS matches, greatest(len(matched_sentences) - 6, 0) AS more FROM kw""",
)
def v9_match_preview(spark, sf):
    preview = views.match_preview(keyword.score_rows(scored_documents(spark, sf)))
    return preview.select(
        "cv_id", "requirement_id", F.array_join("preview", "\n").alias("preview"),
        F.col("matches").cast("long").alias("matches"), F.col("more").cast("long").alias("more"),
    )
