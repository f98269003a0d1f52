"""CV and job tables on storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shortlist import schemas
from shortlist.cluster import latest
from shortlist.functions import fixed


JOB_BUCKETS = 64  # partitions of a table of very many jobs


def _bucket(job: Column) -> Column:
    return F.pmod(F.xxhash64(job), F.lit(JOB_BUCKETS)).cast("int")


def read_cvs(spark: SparkSession, path: str, job_ids: list | None = None) -> DataFrame:
    """CVs of one, several or all jobs by falling score. The job filter prunes partitions, whichever way
    the table was written. Null scores come first, as they do in the store this replaces."""
    stored = spark.read.parquet(path)
    if "job_bucket" not in stored.columns:
        return select_cvs(stored, job_ids)
    if job_ids is not None:
        kind = stored.schema["job_position_id"].dataType
        stored = stored.where(F.col("job_bucket").isin(*[_bucket(F.lit(j).cast(kind)) for j in job_ids]))
    return select_cvs(stored.drop("job_bucket"), job_ids)


def select_cvs(cvs: DataFrame, job_ids: list | None = None) -> DataFrame:
    if job_ids is not None:
        cvs = cvs.where(F.col("job_position_id").isin(job_ids))
    return cvs.orderBy(F.col("final_score").desc_nulls_first(), F.col("cv_id").asc())


def failed_row(df: DataFrame) -> DataFrame:
    """Files that could not be parsed (with `failure_reason`), in the shape of a parsed CV."""
    empty_list = F.array().cast("array<string>")
    sections = F.struct(*[F.lit("").alias(n) for n in fixed.SECTION_NAMES])
    entities = F.struct(
        F.lit(0).alias("years_of_experience"),
        *[empty_list.alias(n) for n in ("technologies", "degrees", "companies", "roles")],
    )
    return df.select(
        "cv_id",
        "job_position_id",
        "original_filename",
        "mime_type",
        F.lit("").alias("raw_text"),
        F.lit("").alias("anonymized_text"),
        sections.alias("sections"),
        empty_list.alias("sentences"),
        entities.alias("entities"),
        F.lit("failed").alias("parsing_confidence"),
        F.create_map().cast(schemas.KEYWORD_SCORES_MAP).alias("keyword_scores"),
        F.lit(0.0).alias("final_score"),
        F.lit("no-match").alias("tier"),
        F.col("failure_reason").alias("elimination_reason"),
    )


def write_cvs(df: DataFrame, path: str, mode: str = "append", many_jobs: bool = False) -> None:
    """Partitioned by job. Rows are first spread within each job by key, so that a job holding
    much of the table is written by many tasks instead of one. With `many_jobs` partitions are buckets of
    jobs, as a folder for each of them would be one for a handful of rows."""
    by = "job_bucket" if many_jobs else "job_position_id"
    rows = df.withColumn("job_bucket", _bucket(F.col("job_position_id"))) if many_jobs else df
    (
        rows.withColumn("_part", F.pmod(F.xxhash64("cv_id"), F.lit(64)))
        .repartition(by, "_part")
        .drop("_part")
        .write.mode(mode)
        .partitionBy(by)
        .parquet(path)
    )


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add the rows whose key is not there yet; existing rows stay untouched. Of new rows with one key one
    goes in: that with the greatest `seq` where there is such a column."""
    return base.unionByName(latest(new, *keys).join(base.select(*keys), keys, "left_anti"))
