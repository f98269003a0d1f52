"""Final stage: model scores where given, keyword scores elsewhere, strict tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.functions import fixed
from shortlist.functions.text import round_half_up
from shortlist.operators.scoring import (
    ai_missing,
    assign_tier,
    missing_required_of,
    required_count_of,
    weighted_score_of,
)


def _first_entry(entries: Column, requirement_id: Column) -> Column:
    """First model entry for the requirement. Later repeats never win, and a 0 counts as given."""
    return F.try_element_at(
        F.filter(entries, lambda s: s["requirementId"] == requirement_id), F.lit(1)
    )


def best_of(scored: Column, entries: Column) -> Column:
    """`scored` with each score replaced by the model's where it gave one."""
    return F.transform(
        scored,
        lambda r: r.withField(
            "score", F.coalesce(_first_entry(entries, r["requirement_id"])["score"], r["score"], F.lit(0.0))
        ),
    )


def best_scores(screened: DataFrame, ai: DataFrame) -> DataFrame:
    """Long form: per (CV, requirement) the score that counts and where it came from. `screened`
    has `scored`; `ai` has (cv_id, ai_scores), at most one row per CV."""
    joined = screened.select("cv_id", "job_position_id", "scored").join(
        ai.select("cv_id", "ai_scores"), "cv_id", "left"
    )
    entries = F.col("ai_scores.scores")
    rows = joined.select(
        "cv_id", "job_position_id", F.inline("scored"), entries.alias("_entries")
    ).withColumnRenamed("score", "keyword_score")
    entry = _first_entry(F.col("_entries"), F.col("requirement_id"))
    return rows.withColumn("_entry", entry).select(
        "cv_id",
        "job_position_id",
        "req_pos",
        "requirement_id",
        "weight",
        "is_required",
        F.coalesce("_entry.score", "keyword_score", F.lit(0.0)).alias("score"),
        F.when(F.col("_entry").isNotNull(), "AI").otherwise("Keyword").alias("source"),
    )


def _settle(df: DataFrame) -> DataFrame:
    """Final score, missing count and tier of the `_scored` column."""
    facts = df.select(
        "*",
        F.greatest(F.lit(0.0), round_half_up(weighted_score_of(F.col("_scored"))).cast("double")).alias(
            "final_score"
        ),
        missing_required_of(F.col("_scored"), ai_missing).alias("final_missing"),
        required_count_of(F.col("_scored")).alias("final_required"),
    )
    return facts.withColumn(
        "final_tier",
        assign_tier(
            F.col("final_score"), F.col("final_missing"), F.col("final_required"), fixed.FINAL_THRESHOLDS
        ),
    )


def final_score(scored: DataFrame) -> DataFrame:
    """Final verdict per CV from its `scored` array: weighted mean rounded half up, strict tier."""
    settled = _settle(scored.select("cv_id", "job_position_id", F.col("scored").alias("_scored")))
    return settled.select(
        "cv_id",
        "job_position_id",
        "final_score",
        F.col("final_missing").alias("missing_required"),
        F.col("final_tier").alias("tier"),
    )


def apply_ai_results(cvs: DataFrame, results: DataFrame) -> DataFrame:
    """Merge model results (cv_id, ai_scores, model, cost_usd) into screened CVs.

    A CV with a result is re-tiered by the strict thresholds even when its call failed, from
    keyword scores then. Its earlier model scores stay when the call gave none; its elimination
    reason is left alone. Of several results of one CV the last by `seq` counts where there is such a
    column, else one with scores, the dearest. One join on cv_id; everything else happens inside the row.
    """
    order = "seq" if "seq" in results.columns else F.struct(F.col("ai_scores").isNotNull(), "cost_usd", "model", F.to_json("ai_scores"))
    newest = results.groupBy("cv_id").agg(F.max_by(F.struct("ai_scores", "model", "cost_usd"), order).alias("_given"))
    given = newest.select(
        "cv_id",
        F.col("_given.ai_scores").alias("_new_scores"),
        F.col("_given.model").alias("_model"),
        F.col("_given.cost_usd").alias("_cost"),
        F.lit(True).alias("_called"),
    )
    joined = cvs.join(given, "cv_id", "left")
    settled = _settle(
        joined.withColumn("_scored", best_of(F.col("scored"), F.col("_new_scores.scores"))).withColumnRenamed(
            "final_score", "_old_score"
        )
    )
    called = F.col("_called").isNotNull()

    def chosen(name: str) -> Column:
        choices = {
            "ai_scores": F.coalesce("_new_scores", "ai_scores"),
            "ai_model_used": F.when(called, F.col("_model")).otherwise(F.col("ai_model_used")),
            "ai_cost_usd": F.when(called, F.col("_cost")).otherwise(F.col("ai_cost_usd")),
            "final_score": F.when(called, F.col("final_score")).otherwise(F.col("_old_score")),
            "tier": F.when(called, F.col("final_tier")).otherwise(F.col("tier")),
        }
        return choices.get(name, F.col(name)).alias(name)

    return settled.select(*[chosen(c) for c in cvs.columns])


def run_totals(results: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Cost, candidates, calls that failed (per job); skipped when gate counts are given."""
    totals = results.groupBy("job_position_id").agg(
        F.sum("cost_usd").alias("ai_cost_delta"),
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
    )
    if counts is None:
        return totals
    joined = counts.select("job_position_id", "skipped").join(totals, "job_position_id", "left")
    return joined.na.fill(0, ["ai_cost_delta", "candidates", "failures"])
