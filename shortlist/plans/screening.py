"""Whole flows: screen texts, rescore after an edit, generate and screen a corpus."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from shortlist import schemas
from shortlist.cluster import cut_lineage, salted_lookup
from shortlist.functions import fixed
from shortlist.functions.redaction import redact
from shortlist.operators import corpus, inference, keyword, lifecycle, parsing
from shortlist.operators.final import apply_ai_results, run_totals
from shortlist.sources.buckets import bucket_count, write_bucketed
from shortlist.sources.files import route_format


TEXT_COLUMNS = ["raw_text", "anonymized_text", "sections", "sentences", "entities"]


class Screening(NamedTuple):
    """CV rows without their texts, run totals per job, and the texts as a table of their own, so
    that result queries and later updates never move them."""

    cvs: DataFrame
    totals: DataFrame
    texts: DataFrame


def screen_texts(texts: DataFrame, reqs: DataFrame) -> DataFrame:
    """Everything before the model: route, classify, enrich, redact, match.

    Takes (cv_id, job_position_id, original_filename, mime_type, raw_text) and optionally
    `read_error`; returns one CV row per input row; a job without a usable requirement list gives its
    CVs that verdict. One narrow pass
    over the texts: the only join looks up the job's requirement list. A failed file goes along
    with its text blanked and gets its own verdict at the end, so it costs no second scan.
    """
    if "read_error" not in texts.columns:
        texts = texts.withColumn("read_error", F.lit(None).cast("string"))
    judged = parsing.outcome_reason(parsing.classify_confidence(route_format(texts)))
    failed = F.col("failure_reason").isNotNull()
    blanked = judged.withColumn("raw_text", F.when(failed, F.lit("")).otherwise(F.col("raw_text")))
    matched = keyword.keyword_filter(redact(parsing.enrich(blanked)), reqs)
    none = F.create_map().cast(schemas.KEYWORD_SCORES_MAP)
    return matched.select(
        "cv_id",
        "job_position_id",
        "original_filename",
        "mime_type",
        *TEXT_COLUMNS,
        F.when(failed, F.lit("failed")).otherwise(F.col("parsing_confidence")).alias("parsing_confidence"),
        F.when(failed, none).otherwise(keyword.keyword_scores_map(F.col("scored"))).alias("keyword_scores"),
        F.when(failed, F.lit(0.0)).otherwise(F.col("preliminary_score")).alias("final_score"),
        F.when(failed, F.lit("no-match")).otherwise(F.col("tier")).alias("tier"),
        F.when(failed, F.col("failure_reason")).otherwise(F.col("elimination_reason")).alias("elimination_reason"),
        "scored",
        F.lit(None).cast(schemas.AI_RESPONSE_STRUCT).alias("ai_scores"),
        F.lit(None).cast("string").alias("ai_model_used"),
        F.lit(0.0).alias("ai_cost_usd"),
    )


def score_candidates(cvs: DataFrame, texts: DataFrame, client, **call_options) -> tuple[DataFrame, DataFrame]:
    """Model stage: (updated CV rows, run totals per job). `texts` has the gate's columns next to the
    texts the prompts quote.

    The gate is applied below the Python boundary. Answers are written out at once, so the calls
    are made (and paid for) one time whatever happens to executors afterwards.
    """
    gated = inference.route_model(inference.gate_candidates(texts))
    call_options.setdefault("carry", ("job_position_id",))
    answers = inference.stored_answers(inference.scoring_prompts(gated), client, **call_options)
    answered = inference.estimate_cost(inference.parse_responses(answers))
    updated = apply_ai_results(cvs, answered)
    return updated, run_totals(answered, inference.gate_counts(cvs))


def screen(texts: DataFrame, reqs: DataFrame, client, **call_options) -> Screening:
    """Texts to final CV rows. Screened rows are written out because both the prompts and the merge
    of the answers read them."""
    stored = cut_lineage(screen_texts(texts, reqs))
    updated, totals = score_candidates(stored.drop(*TEXT_COLUMNS), stored, client, **call_options)
    return Screening(updated, totals, stored.select("cv_id", "job_position_id", *TEXT_COLUMNS))


def store(screening: Screening, buckets: int | None = None, folder: str | None = None) -> Screening:
    """What `screen` returned as bucketed tables of CV rows and texts. Rescoring, overrides and merges of
    stored rows then leave the texts where they are, and rescoring reads them bucket by bucket."""
    count = buckets or bucket_count(screening.texts)
    cvs, texts = (write_bucketed(part, count, folder=folder) for part in (screening.cvs, screening.texts))
    return Screening(cvs, screening.totals, texts)


def rescore(cvs: DataFrame, texts: DataFrame, reqs: DataFrame, client, **call_options) -> Screening:
    """Keyword and model stages again on what `screen` returned, after a requirement edit. CVs of jobs
    without a usable list in `reqs` come back as they were; totals are those of the jobs rescored."""
    usable = keyword.requirement_lists(reqs).where(F.col("requirement_gate") == fixed.GATE_OK)
    run = usable.select("job_position_id", F.lit(True).alias("_run"))
    again = lifecycle.rescore(cvs, texts, reqs)
    fresh = cut_lineage(salted_lookup(again, run, ["job_position_id"], ["cv_id"], "left", bounded_by=reqs))
    part = fresh.where("_run").drop("_run").select(*cvs.columns)
    rest = fresh.where(F.col("_run").isNull()).select(*cvs.columns)
    passed = inference.gate_candidates(part).select("cv_id", "tier", "scored")
    candidates = texts.join(passed, "cv_id")
    updated, totals = score_candidates(part, candidates, client, **call_options)
    return Screening(updated.unionByName(rest), totals, texts)


def generate_corpus(
    requests: DataFrame, jobs: DataFrame, reqs: DataFrame, client, current_year: int, **call_options
) -> tuple[DataFrame, DataFrame]:
    """Generate CVs by quality mix and screen them up to the gate: (CV rows, shortfall per job).
    A failed call leaves its CV out and shows in the shortfall, and so do the CVs refused because their
    job has no title or requirements."""
    wanted, _ = corpus.allocate_mix(requests)
    prompts = corpus.generation_prompts(wanted, jobs, reqs)
    call_options.setdefault("in_flight", fixed.GENERATIONS_IN_FLIGHT)
    kept = ("job_position_id", "idx", "quality_tier")
    answers = inference.stored_answers(prompts, client, key="item", carry=kept, **call_options)
    made = corpus.sanitize_generated(
        corpus.parse_generated(answers.where(F.col("error").isNull()), "content"), current_year
    )
    # Rendered CVs are stored before they are read back, like any other upload.
    texts = cut_lineage(made.select(
        F.col("item").alias("cv_id"),
        "job_position_id",
        corpus.generated_filename(F.col("quality_tier"), F.col("idx")).alias("original_filename"),
        F.lit(fixed.MIME_BY_FORMAT["txt"]).alias("mime_type"),
        corpus.render_text(F.col("content")).alias("raw_text"),
    ))
    called = inference.estimate_cost(answers).groupBy("job_position_id").agg(
        F.count_if(F.col("error").isNull()).alias("produced"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.sum("cost_usd").alias("generation_cost_usd"),
    )
    asked = wanted.groupBy("job_position_id").agg(F.count(F.lit(1)).alias("requested"))
    shortfall = asked.join(called, "job_position_id", "left").na.fill(0, ["produced", "failed", "generation_cost_usd"])
    shortfall = shortfall.withColumn("refused", F.expr("requested - produced - failed"))
    return screen_texts(texts, reqs), shortfall
