"""Job lifecycle and keyed updates. Each returns a new snapshot; nothing is changed in place."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.cluster import latest, salted_lookup
from shortlist.functions import fixed
from shortlist.operators.keyword import judge, keyword_scores_map, score_requirements
from shortlist.operators.views import tier_counts, tier_summary

JOB = "job_position_id"


def merge_rows(
    base: DataFrame,
    updates: DataFrame,
    keys: list[str],
    set_cols: list[str],
    nulls: str = "keep",
    version: str | None = None,
) -> DataFrame:
    """Update `set_cols` of the matching rows. A null in an update keeps the old value
    (`nulls="keep"`) or is written (`"set"`). With `version` the latest update per key wins;
    without it, two updates of one key fail the job when it runs."""
    values = F.struct(*set_cols)
    if version is None:
        repeated = F.raise_error(F.lit("more than one update for a key"))
        one = updates.groupBy(*keys).agg(
            F.when(F.count(F.lit(1)) > 1, repeated.cast("boolean")).alias("_check"),
            F.any_value(values).alias("_new"),
        ).where(F.col("_check").isNull())
    else:
        one = updates.groupBy(*keys).agg(F.max_by(values, F.col(version)).alias("_new"))
    joined = base.join(one.select(*keys, "_new"), keys, "left")

    def value(name: str) -> Column:
        if name not in set_cols:
            return F.col(name)
        if nulls == "keep":
            return F.coalesce(F.col(f"_new.{name}"), F.col(name)).alias(name)
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name)

    return joined.select(*[value(c) for c in base.columns])


def _set_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Replace columns on the rows where the condition holds."""
    met = F.coalesce(condition, F.lit(False))
    return df.select(
        *[
            F.when(met, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in df.columns
        ]
    )


def apply_extraction(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Requirement extraction results (job_position_id, requirements, cost_usd, error) applied to
    CREATED and FAILED jobs only; any other state is left alone, so edits are never overwritten."""
    given = latest(outcomes, JOB).select(
        JOB, F.col("requirements").alias("_reqs"), F.col("cost_usd").alias("_cost"),
        F.col("error").alias("_error"), F.lit(True).alias("_done"),
    )
    joined = jobs.join(given, JOB, "left")
    open_to = F.col("status").isin("CREATED", "FAILED") & F.col("_done").isNotNull()
    won = open_to & F.col("_error").isNull()
    return _set_where(
        joined,
        open_to,
        status=F.when(won, "REQUIREMENTS_EXTRACTED").otherwise("FAILED"),
        requirements=F.when(won, F.col("_reqs")).otherwise(F.col("requirements")),
        ai_cost_usd=F.when(won, F.col("_cost")).otherwise(F.col("ai_cost_usd")),
    ).select(*jobs.columns)


def start_runs(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (job_position_id, add_cvs, initial_stage): processing starts at 0, the stored
    total grows by `add_cvs` where given. Several commands for one job add up."""
    given = commands.groupBy(JOB).agg(
        F.sum("add_cvs").cast("int").alias("_add"), F.max("initial_stage").alias("_stage"), F.lit(True).alias("_run")
    )
    joined = jobs.join(given, JOB, "left")
    return _set_where(
        joined,
        F.col("_run").isNotNull(),
        status=F.lit("PROCESSING"),
        processed_cvs=F.lit(0),
        current_stage=F.coalesce("_stage", F.lit("parsing")),
        total_cvs=F.col("total_cvs") + F.coalesce("_add", F.lit(0)),
    ).select(*jobs.columns)


def _with_counts(jobs: DataFrame, cvs: DataFrame) -> DataFrame:
    counted = tier_counts(cvs).select(JOB, *[F.col(c).cast("int").alias(f"_{c}") for c in ("great", "good", "no_match", "total")])
    return jobs.join(counted, JOB, "left").na.fill(0, ["_great", "_good", "_no_match", "_total"])


def complete_runs(jobs: DataFrame, cvs: DataFrame, totals: DataFrame) -> DataFrame:
    """Finish the jobs in `totals` (job_position_id, ai_cost_delta): recounted tiers, cost added, that of
    repeated totals of a job summed. The stored total is not reset."""
    delta = totals.groupBy(JOB).agg(F.coalesce(F.sum("ai_cost_delta"), F.lit(0.0)).alias("_delta"))
    joined = _with_counts(jobs, cvs).join(delta, JOB, "left")
    return _set_where(
        joined,
        F.col("_delta").isNotNull(),
        status=F.lit("COMPLETED"),
        current_stage=F.lit("completed"),
        processed_cvs=F.col("_total"),
        great_match_count=F.col("_great"),
        good_match_count=F.col("_good"),
        no_match_count=F.col("_no_match"),
        ai_cost_usd=F.col("ai_cost_usd") + F.col("_delta"),
    ).select(*jobs.columns)


def refresh_counts(jobs: DataFrame, cvs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Recount after overrides; this one does reset the total. All jobs, or those in `keys`."""
    joined = _with_counts(jobs, cvs)
    chosen = F.lit(True)
    if keys is not None:
        joined = joined.join(keys.select(JOB, F.lit(True).alias("_chosen")).distinct(), JOB, "left")
        chosen = F.col("_chosen").isNotNull()
    return _set_where(
        joined,
        chosen,
        total_cvs=F.col("_total"),
        processed_cvs=F.col("_total"),
        great_match_count=F.col("_great"),
        good_match_count=F.col("_good"),
        no_match_count=F.col("_no_match"),
    ).select(*jobs.columns)


def _only_one(column: str, message: str) -> Column:
    """The value all rows of a group agree on, or an error."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(F.raise_error(F.lit(message)))


def override_tiers(cvs: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual tiers (cv_id, job_position_id, new_tier): applied only where the CV belongs to that
    job. Sets the tier, clears the reason, keeps the score. Returns (CVs, rejected overrides). Of several
    for one CV the one with the greatest `seq` counts; without such a column there may be only one, and
    more raise an error when the CVs are read."""
    owned = cvs.select("cv_id", JOB)
    known = F.coalesce(F.col("new_tier").isin("great", "good", "no-match"), F.lit(False))
    allowed = overrides.where(known)
    rejected = allowed.join(owned, ["cv_id", JOB], "left_anti").unionByName(overrides.where(~known))
    last = F.max_by("new_tier", "seq") if "seq" in overrides.columns else _only_one("new_tier", "overrides of one CV need seq")
    given = allowed.groupBy("cv_id", JOB).agg(last.alias("_tier"))
    joined = cvs.join(given, ["cv_id", JOB], "left")
    hit = F.col("_tier").isNotNull()
    changed = _set_where(
        joined, hit, tier=F.col("_tier"), elimination_reason=F.lit(None).cast("string")
    ).select(*cvs.columns)
    return changed, rejected


def rescore(cvs: DataFrame, sentences: DataFrame, reqs: DataFrame) -> DataFrame:
    """Keyword stage again after a requirement edit, on the stored sentences (cv_id,
    job_position_id, sentences) kept apart from the CV rows.

    Model columns are cleared and manual tiers are lost; failed rows stay as they are, and so do all
    CVs of jobs without a usable list in `reqs`: they are not part of the run. The sentences are read once
    and matched in place; only narrow verdicts meet the CV rows. Continue with the gate and the
    final stage.
    """
    verdicts = judge(score_requirements(sentences.select("cv_id", JOB, "sentences"), reqs)).where(
        F.col("requirement_gate") == fixed.GATE_OK
    )
    fresh = {
        "tier": F.col("_new.tier"),
        "elimination_reason": F.col("_new.elimination_reason"),
        "final_score": F.col("_new.preliminary_score"),
        "scored": F.col("_new.scored"),
        "keyword_scores": keyword_scores_map(F.col("_new.scored")),
        "ai_scores": F.lit(None),
        "ai_model_used": F.lit(None),
        "ai_cost_usd": F.lit(0.0),
    }
    new = F.struct("tier", "elimination_reason", "preliminary_score", "scored").alias("_new")
    joined = cvs.join(verdicts.select("cv_id", new), "cv_id", "left")
    stays = F.coalesce(F.col("parsing_confidence") == "failed", F.lit(False)) | F.col("_new").isNull()
    types = dict(cvs.dtypes)
    return joined.select(
        *[
            F.when(stays, F.col(c)).otherwise(fresh[c].cast(types[c])).alias(c) if c in fresh else F.col(c)
            for c in cvs.columns
        ]
    )


def sweep_stale(jobs: DataFrame, now: datetime, minutes: int = fixed.STALE_MINUTES) -> DataFrame:
    """Runs untouched for longer than the cutoff become FAILED. A stale run also gets the stage
    `failed`; a stale extraction keeps its stage."""
    stale = F.col("updated_at") < F.lit(now) - F.make_dt_interval(mins=F.lit(minutes))
    running = stale & (F.col("status") == "PROCESSING")
    extracting = stale & (F.col("status") == "EXTRACTING_REQUIREMENTS")
    staged = jobs.withColumn(
        "current_stage", F.when(running, F.lit("failed")).otherwise(F.col("current_stage"))
    )
    return staged.withColumn("status", F.when(running | extracting, F.lit("FAILED")).otherwise(F.col("status")))


def delete_cascade(
    users: DataFrame, jobs: DataFrame, cvs: DataFrame, user_keys: DataFrame, job_keys: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete users (and/or single jobs) with everything below them."""
    kept_users = users.join(user_keys, "user_id", "left_anti")
    kept_jobs = jobs.join(user_keys, "user_id", "left_anti")
    if job_keys is not None:
        kept_jobs = kept_jobs.join(job_keys, JOB, "left_anti")
    kept_cvs = salted_lookup(cvs, kept_jobs.select(JOB), [JOB], ["cv_id"], "left_semi", jobs)
    return kept_users, kept_jobs, kept_cvs


def check_access(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Class each (user, job) request: ok, not found, forbidden."""
    owners = jobs.select(JOB, F.col("user_id").alias("_owner"))
    joined = salted_lookup(requests, owners, [JOB], ["user_id"], "left", jobs)
    verdict = (
        F.when(F.col("_owner").isNull(), "not found")
        .when(F.col("_owner") == F.col("user_id"), "ok")
        .otherwise("forbidden")
    )
    return joined.withColumn("access", verdict).drop("_owner")


def mark_failed(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    marked = jobs.join(keys.select(JOB, F.lit(True).alias("_hit")).distinct(), JOB, "left")
    return _set_where(
        marked, F.col("_hit").isNotNull(), status=F.lit("FAILED"), current_stage=F.lit("failed")
    ).select(*jobs.columns)


def audit_counters(jobs: DataFrame, cvs: DataFrame) -> DataFrame:
    """Stored counters against a recount, with one flag per counter that is off."""
    stored = jobs.select(
        JOB, "total_cvs", "great_match_count", "good_match_count", "no_match_count"
    )
    joined = stored.join(tier_summary(jobs, cvs), JOB)
    pairs = {
        "total_off": ("total_cvs", "total"),
        "great_off": ("great_match_count", "great"),
        "good_off": ("good_match_count", "good"),
        "no_match_off": ("no_match_count", "no_match"),
    }
    return joined.select(
        "*", *[(~F.col(a).eqNullSafe(F.col(b))).alias(name) for name, (a, b) in pairs.items()]
    )


def progress_snapshot(jobs: DataFrame) -> DataFrame:
    return jobs.select(JOB, "status", "current_stage", "processed_cvs", "total_cvs")
