"""Score, tier and reason rules shared by the keyword stage and the final stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.functions import fixed
from shortlist.functions.text import one_decimal


def raw_score(count: Column) -> Column:
    """Matched sentences to a score: none 0, one or two 0.6, three or more 1.0."""
    return (
        F.when(count == 0, F.lit(0.0))
        .when(count >= fixed.STRONG_MATCH_COUNT, F.lit(1.0))
        .otherwise(F.lit(fixed.WEAK_MATCH_SCORE))
    )


def effective_weight(weight: Column, is_required: Column) -> Column:
    factor = F.when(is_required, F.lit(fixed.REQUIRED_WEIGHT_MULTIPLIER)).otherwise(F.lit(1.0))
    return F.coalesce(weight.cast("double"), F.lit(0.0)) * factor  # an entry without a weight counts nothing


def weighted_score_of(scored: Column) -> Column:
    """Weighted mean x 100 of an array of (score, weight, is_required); 0 when all weights are 0."""
    totals = F.aggregate(
        scored,
        F.struct(F.lit(0.0).alias("hit"), F.lit(0.0).alias("all")),
        lambda acc, r: F.struct(
            (acc["hit"] + r["score"] * effective_weight(r["weight"], r["is_required"])).alias("hit"),
            (acc["all"] + effective_weight(r["weight"], r["is_required"])).alias("all"),
        ),
        lambda acc: F.when(acc["all"] == 0, F.lit(0.0)).otherwise(
            F.try_divide(acc["hit"], acc["all"]) * 100
        ),
    )
    return F.coalesce(totals, F.lit(0.0))


def required_count_of(scored: Column) -> Column:
    return F.size(F.filter(scored, lambda r: r["is_required"]))


def missing_required_of(scored: Column, is_missing) -> Column:
    return F.size(F.filter(scored, lambda r: r["is_required"] & is_missing(r["score"])))


def keyword_missing(score: Column) -> Column:
    return score == 0


def ai_missing(score: Column) -> Column:
    return score < fixed.AI_MISSING_BELOW


def weighted_score(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The same mean over long rows (keys, score, weight, is_required), one output row per key."""
    effective = effective_weight(F.col("weight"), F.col("is_required"))
    total = F.sum(effective)
    return scored.groupBy(*keys).agg(
        F.when(total == 0, F.lit(0.0))
        .otherwise(F.try_divide(F.sum(F.col("score") * effective), total) * 100)
        .alias("weighted_score")
    )


def missing_required(scored: DataFrame, keys: list[str], is_missing) -> DataFrame:
    """Required items unmet (by the stage's own rule) and required items in all, per key."""
    return scored.groupBy(*keys).agg(
        F.count_if(F.col("is_required") & is_missing(F.col("score"))).alias("missing_required"),
        F.count_if("is_required").alias("total_required"),
    )


def _elimination_limit(total: Column, thresholds: dict) -> Column:
    return F.ceil(total.cast("double") * F.lit(thresholds["missing_ratio"]))


def is_eliminated(missing: Column, total: Column, thresholds: dict) -> Column:
    return (total > 0) & (missing >= _elimination_limit(total, thresholds))


def assign_tier(score: Column, missing: Column, total: Column, thresholds: dict) -> Column:
    """Too many required items missing comes first; `great` allows none missing."""
    return (
        F.when(is_eliminated(missing, total, thresholds), F.lit("no-match"))
        .when((missing == 0) & (score >= F.lit(thresholds["great"])), F.lit("great"))
        .when(score >= F.lit(thresholds["good"]), F.lit("good"))
        .otherwise(F.lit("no-match"))
    )


def elimination_reason(tier: Column, missing: Column, total: Column, score: Column) -> Column:
    """Why the keyword stage dropped a CV; null for the other tiers."""
    by_ratio = F.concat(
        F.lit("Missing "), missing.cast("string"), F.lit(" of "), total.cast("string"),
        F.lit(" required requirements"),
    )
    by_score = F.concat(F.lit("Score too low ("), one_decimal(score), F.lit("/100)"))
    return F.when(
        tier == "no-match",
        F.when(is_eliminated(missing, total, fixed.KEYWORD_THRESHOLDS), by_ratio).otherwise(by_score),
    )
