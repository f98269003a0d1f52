"""Ranked, filtered, explained and summarised views of screening results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shortlist.cluster import at_most, cut_lineage, distributed_row_number, distributed_running_sum, group_sizes, salted_lookup
from shortlist.functions import fixed
from shortlist.functions.text import js_trim

JOB = "job_position_id"
MERGED = 16  # salts that meet in one task when the best of a job are merged


def tier_bucket(tier: Column) -> Column:
    return F.when(tier.isin("great", "good"), tier).otherwise("noMatch")


def tier_rank(tier: Column) -> Column:
    ranks = F.when(tier == "great", fixed.TIER_RANKS["great"]).when(tier == "good", fixed.TIER_RANKS["good"])
    return ranks.otherwise(fixed.TIER_RANKS["no-match"])


def _ranked(cvs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked CVs and the sizes of their (job, bucket) groups."""
    group = [JOB, "bucket"]
    bucketed = cvs.withColumn("bucket", tier_bucket(F.col("tier"))).withColumn("_score", F.coalesce("final_score", F.lit(0.0)))
    order = [F.col("_score").desc(), F.col("cv_id").asc()]
    in_group = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long").alias("rank_in_tier")
    sizes, big = group_sizes(bucketed, group)
    if at_most(big, 0):
        return bucketed.select("*", in_group).drop("_score"), sizes
    same = F.col(f"c.{JOB}").eqNullSafe(F.col(f"b.{JOB}")) & (F.col("c.bucket") == F.col("b.bucket"))
    marked = bucketed.alias("c").join(F.broadcast(big).alias("b"), same, "left").select("c.*", "_big")
    small = marked.where(F.col("_big").isNull()).drop("_big").select("*", in_group)
    hot = marked.where("_big").drop("_big")
    return small.unionByName(_rank_by_counting(hot, group)).drop("_score"), sizes


def _rank_by_counting(hot: DataFrame, group: list[str]) -> DataFrame:
    """Rank in groups too big for a task: how many stand above the score, from summed counts, and the place
    among equals. Only keys are ordered; the rows meet their ranks by cv_id, which no group is hot in."""
    scored = [*group, "_score"]
    counts = hot.groupBy(*scored).agg(F.count(F.lit(1)).alias("_equal"))
    summed = distributed_running_sum(counts, group, [F.col("_score").desc()], F.col("_equal"), "_to_here")
    above = cut_lineage(summed.select(*scored, (F.col("_to_here") - F.col("_equal")).alias("_above"), (F.col("_equal") > 1).alias("_tied")))
    keys = hot.select(*scored, "cv_id")
    placed = salted_lookup(keys, above, scored, ["cv_id"])
    tied = distributed_row_number(placed.where("_tied"), scored, [F.col("cv_id").asc()], "_place")
    alone = placed.where(~F.col("_tied")).withColumn("_place", F.lit(1).cast("long"))
    ranks = tied.unionByName(alone).select("cv_id", JOB, (F.col("_above") + F.col("_place")).alias("rank_in_tier"))
    return hot.join(ranks, ["cv_id", JOB])


def rank_in_tier(cvs: DataFrame) -> DataFrame:
    """Add `bucket` and `rank_in_tier`: score descending with null as 0, key breaking ties. A group of a
    task's fair share or less is ranked by a window; a bigger one by counting, so that no task sees all
    of it and no full-width row is written. cv_id is the key of the CVs of a job, and each has a job."""
    return _ranked(cvs)[0]


def tier_counts(cvs: DataFrame) -> DataFrame:
    """Great / good / no-match (null included) / total for jobs that have CVs."""
    return cvs.groupBy(JOB).agg(
        F.count_if(F.col("tier") == "great").alias("great"),
        F.count_if(F.col("tier") == "good").alias("good"),
        F.count_if(~F.coalesce(F.col("tier").isin("great", "good"), F.lit(False))).alias("no_match"),
        F.count(F.lit(1)).alias("total"),
    )


def tier_summary(jobs: DataFrame, cvs: DataFrame) -> DataFrame:
    """Tier counts of every job; zeros for a job without CVs."""
    joined = jobs.select(JOB).join(tier_counts(cvs), JOB, "left")
    return joined.na.fill(0, ["great", "good", "no_match", "total"])


def results(jobs: DataFrame, cvs: DataFrame) -> DataFrame:
    """Job row with each of its ranked CVs; a job without CVs keeps one row. The CV side may be
    any size per job, so jobs join as the per-key side of a salted lookup."""
    ranked, sizes = _ranked(cvs)
    header = jobs.select(JOB, "title", "status")
    with_cvs = salted_lookup(ranked, header, [JOB], ["cv_id"], bounded_by=jobs)
    empty = header.join(sizes.select(JOB).distinct(), JOB, "left_anti")
    return with_cvs.unionByName(empty, allowMissingColumns=True)


def top_n(cvs: DataFrame, n: int, per_job: bool = False) -> DataFrame:
    """Best n by final score, nulls last, key breaking ties.

    Per job, a small n is cut below the shuffle by Spark's own rank limit. Beyond that limit, the best n
    are taken per (job, salt) first and salts are merged 16 at a time, so no task gets more than 16 n rows
    of a job after the first cut, and the first spreads a job over all tasks.
    """
    order = [F.col("final_score").desc_nulls_last(), F.col("cv_id").asc()]
    if not per_job:
        return cvs.orderBy(*order).limit(n)

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)

    conf = cvs.sparkSession.conf
    if n <= int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return best(cvs, JOB)
    salts = int(conf.get("spark.sql.shuffle.partitions"))
    rows = cvs.withColumn("_salt", F.pmod(F.xxhash64("cv_id"), F.lit(salts)))
    while salts > 1:
        rows = best(rows, JOB, "_salt").drop("rank").withColumn("_salt", F.floor(F.col("_salt") / MERGED))
        salts = -(-salts // MERGED)
    return best(rows.drop("_salt"), JOB)


def filter_cvs(cvs: DataFrame, tier: str = "all", search: str = "") -> DataFrame:
    if tier != "all":
        cvs = cvs.where(F.col("tier") == tier)
    wanted = search.strip(fixed.WHITESPACE).lower()
    if wanted:
        cvs = cvs.where(F.contains(F.lower("original_filename"), F.lit(wanted)))
    return cvs


def sort_cvs(cvs: DataFrame, key: str = "finalScore", direction: str = "desc") -> DataFrame:
    """Sort by finalScore (null = -1), yearsOfExperience, tier or originalFilename, names in the order of
    the root locale (accents and case count after letters); names equal in it, and ties, by cv_id."""
    columns = {
        "finalScore": [F.coalesce("final_score", F.lit(-1.0))],
        "yearsOfExperience": [F.col("years_of_experience")],
        "tier": [tier_rank(F.col("tier"))],
        "originalFilename": [F.collate("original_filename", "UNICODE")],
    }[key]
    ordered = [c.asc() if direction == "asc" else c.desc() for c in columns]
    return cvs.orderBy(*ordered, F.col("cv_id").asc())


def explain(cvs: DataFrame) -> DataFrame:
    """One row per (CV, requirement): the score shown, its source, evidence and reasoning, icon
    and bar bands, score out of ten. Needs `scored` and `ai_scores` on the CV row."""
    rows = cvs.select("cv_id", JOB, F.col("ai_scores.scores").alias("_entries"), F.inline("scored"))
    entry = F.try_element_at(
        F.filter("_entries", lambda s: s["requirementId"] == F.col("requirement_id")), F.lit(1)
    )
    shown = rows.withColumn("_entry", entry).withColumn(
        "shown", F.coalesce("_entry.score", "score", F.lit(0.0))
    )
    score = F.col("shown")
    return shown.select(
        "cv_id",
        JOB,
        "req_pos",
        "requirement_id",
        "text",
        "weight",
        "is_required",
        score.alias("score"),
        F.when(F.col("_entry").isNotNull(), "AI").otherwise("Keyword").alias("source"),
        F.col("_entry.evidence").alias("evidence"),
        F.col("_entry.reasoning").alias("reasoning"),
        F.when(score >= 0.8, "met").when(score > 0, "partial").otherwise("missing").alias("icon"),
        F.when(score >= 0.8, "high").when(score >= 0.5, "middle").when(score > 0, "low")
        .otherwise("none").alias("bar"),
        (score * 10).alias("out_of_ten"),
        "matched_sentences",
    )


def match_preview(keyword: DataFrame, n: int = 6) -> DataFrame:
    """First n matched sentences and how many more there are."""
    return keyword.select(
        "cv_id",
        "requirement_id",
        F.slice("matched_sentences", 1, n).alias("preview"),
        F.size("matched_sentences").alias("matches"),
        F.greatest(F.size("matched_sentences") - n, F.lit(0)).alias("more"),
    )


def top_skills(cvs: DataFrame, n: int = 3) -> DataFrame:
    techs = F.col("entities.technologies")
    return cvs.select(
        "cv_id",
        F.slice(techs, 1, n).alias("skills"),
        F.greatest(F.size(techs) - n, F.lit(0)).alias("more"),
    )


def jobs_of(jobs: DataFrame, owner=None) -> DataFrame:
    """Jobs newest first, of one owner or of each."""
    if owner is not None:
        jobs = jobs.where(F.col("user_id") == owner)
    return jobs.orderBy(F.col("user_id").asc(), F.col("created_at").desc(), F.col(JOB).asc())


def job_header(jobs: DataFrame, cvs: DataFrame) -> DataFrame:
    header = jobs.select(JOB, "title", "status", "total_cvs", "ai_cost_usd")
    counts = tier_counts(cvs).drop("total")
    return header.join(counts, JOB, "left").na.fill(0, ["great", "good", "no_match"])


def has_sections(sections: Column) -> Column:
    blank = [js_trim(sections[name]) == "" for name in fixed.SECTION_DISPLAY_ORDER]
    all_blank = blank[0]
    for one in blank[1:]:
        all_blank = all_blank & one
    return ~all_blank


def sections_long(cvs: DataFrame) -> DataFrame:
    """Sections as rows in display order, blank ones dropped."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("display_pos"), F.lit(name).alias("section"),
                     js_trim(F.col(f"sections.{name}")).alias("content"))
            for i, name in enumerate(fixed.SECTION_DISPLAY_ORDER)
        ]
    )
    return cvs.select("cv_id", F.inline(rows)).where(F.col("content") != "")


def any_active(jobs: DataFrame) -> DataFrame:
    active = F.col("status").isin("EXTRACTING_REQUIREMENTS", "PROCESSING")
    return jobs.agg(F.coalesce(F.bool_or(active), F.lit(False)).alias("any_active"))


def readiness(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        JOB,
        "status",
        F.col("status").isin("CREATED", "FAILED").alias("needs_extraction"),
        F.col("status").isin("REQUIREMENTS_EXTRACTED", "PROCESSING", "COMPLETED").alias("can_upload"),
    )


def lookup(df: DataFrame, keys: DataFrame, on: str = "cv_id") -> DataFrame:
    """Every asked key with its row, and whether there is one."""
    found = df.withColumn("_hit", F.lit(True))
    joined = keys.select(on).join(found, on, "left")
    return joined.withColumn("found", F.col("_hit").isNotNull()).drop("_hit")


def flatten_ranked(great: DataFrame, good: DataFrame, no_match: DataFrame) -> DataFrame:
    """The three buckets as one table with their display order."""
    parts = [df.withColumn("bucket_pos", F.lit(i)) for i, df in enumerate((great, good, no_match))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def entity_facts(cvs: DataFrame) -> DataFrame:
    """(cv_id, kind, item) for each technology, role, company and degree."""
    kinds = [("technology", "technologies"), ("role", "roles"), ("company", "companies"), ("degree", "degrees")]
    lists = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(f"entities.{field}").alias("items")) for kind, field in kinds]
    )
    listed = cvs.select("cv_id", F.inline(lists))
    return listed.select("cv_id", "kind", F.explode("items").alias("item"))


def fact_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("cvs"))


def screening_funnel(jobs: DataFrame, cvs: DataFrame) -> DataFrame:
    """Per job: uploaded, parsed, passed the gate, scored by the model, great, good, and the share
    dropped before any model call. The gate is read off what only it sets: a model used, or a
    good/great tier."""
    parsed = F.col("parsing_confidence") != "failed"
    scored = F.col("ai_model_used").isNotNull()
    gated = parsed & (scored | F.coalesce(F.col("tier").isin("good", "great"), F.lit(False)))
    counts = cvs.groupBy(JOB).agg(
        F.count(F.lit(1)).alias("uploaded"),
        F.count_if(parsed).alias("parsed"),
        F.count_if(gated).alias("gated"),
        F.count_if(parsed & scored).alias("scored"),
        F.count_if(F.col("tier") == "great").alias("great"),
        F.count_if(F.col("tier") == "good").alias("good"),
    )
    names = ["uploaded", "parsed", "gated", "scored", "great", "good"]
    joined = jobs.select(JOB).join(counts, JOB, "left").na.fill(0, names)
    dropped = F.try_divide(F.col("uploaded") - F.col("gated"), F.col("uploaded"))
    return joined.withColumn("elimination_rate", dropped)
