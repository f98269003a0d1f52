"""Uploaded files: read, guard, route by format, decode."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from shortlist.functions import fixed
from shortlist.functions.text import js_trim, utf16_length


FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_cv_files(spark: SparkSession, glob: str, content: bool = True) -> DataFrame:
    """(path, filename, mime_type, length, modificationTime[, content]) of files under a path. The
    MIME type follows the extension, as an upload's would. Without `content` only metadata is read."""
    return _as_uploads(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob), content)


def stream_cv_files(spark: SparkSession, glob: str, files_per_batch: int = 1000) -> DataFrame:
    """The same columns of files as they arrive under a path, each once. Spark does not list files without
    a byte, here as in a batch read."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    return _as_uploads(files.option("maxFilesPerTrigger", files_per_batch).load(glob), True)


def _as_uploads(files: DataFrame, content: bool) -> DataFrame:
    filename = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    mime = F.when(ext == "x", None)
    for name, value in fixed.MIME_BY_FORMAT.items():
        mime = mime.when(ext == name, value)
    columns = [
        "path",
        filename.alias("filename"),
        mime.otherwise("application/octet-stream").alias("mime_type"),
        "length",
        "modificationTime",
    ]
    return files.select(*columns, "content") if content else files.select(*columns)


def guard_uploads(files: DataFrame, batches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected files of each batch. A batch over 500 files, or with one file over
    10 MiB, is refused as a whole; with `batches` given, those without a file are refused too.

    Batch sizes are counted by map-side partial sums before they meet the files again, so an
    oversized batch never gathers in one task. Tasks sort a bounded number of files each.
    """
    from shortlist.cluster import salted_lookup, tasks_for

    tasks = tasks_for(files.count(), files.sparkSession)
    sizes = files.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("_files"), F.max("length").alias("_largest")
    )
    joined = salted_lookup(files, sizes, ["batch_id"], ["filename"], bounded_by=files, partitions=tasks)
    reason = F.when(F.col("_files") > fixed.MAX_UPLOAD_FILES, fixed.REASON_TOO_MANY).when(
        F.col("_largest") > fixed.MAX_UPLOAD_BYTES, fixed.REASON_TOO_LARGE
    )
    judged = joined.withColumn("reason", reason).drop("_files", "_largest")
    accepted = judged.where(F.col("reason").isNull()).drop("reason")
    rejected = judged.where(F.col("reason").isNotNull())
    if batches is not None:
        given = files.select("batch_id").distinct().repartition(tasks, "batch_id")
        empty = batches.select("batch_id").repartition(tasks, "batch_id").join(given, "batch_id", "left_anti")
        rejected = rejected.unionByName(
            empty.withColumn("reason", F.lit(fixed.REASON_NO_FILES)), allowMissingColumns=True
        )
    return accepted, rejected


def route_format(df: DataFrame) -> DataFrame:
    """Add `format`: MIME type or extension, first match in the order pdf, docx, txt."""
    lowered = F.lower("original_filename")

    def is_format(name: str):
        return (F.col("mime_type") == fixed.MIME_BY_FORMAT[name]) | F.endswith(lowered, F.lit(f".{name}"))

    routed = F.when(is_format("pdf"), "pdf").when(is_format("docx"), "docx").when(is_format("txt"), "txt")
    return df.withColumn("format", routed.otherwise("unsupported"))


def decode_text(df: DataFrame) -> DataFrame:
    """Plain-text bytes to trimmed text, bad bytes replaced; `high` above 50 characters."""
    text = js_trim(F.make_valid_utf8(F.col("content").cast("string")))
    decoded = df.withColumn("raw_text", text)
    confidence = F.when(utf16_length(F.col("raw_text")) > fixed.MIN_TEXT_LENGTH, "high").otherwise("low")
    return decoded.withColumn("parsing_confidence", confidence)


def file_texts(files: DataFrame, decoders: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(cv_id, job_position_id, original_filename, mime_type, raw_text, read_error) of uploaded files.

    The job is the name of the file's folder (`x` or `job=x`), the CV's key a digest of its path. Plain text
    is decoded by Spark; `decoders` give the text of the bytes of other formats. A file that is too large,
    has no decoder or whose decoder fails gets a `read_error` and no text; it never stops the others.
    """
    folder = F.element_at(F.split("path", "/"), -2)
    rows = route_format(files.withColumnRenamed("filename", "original_filename").withColumns(
        {"cv_id": F.sha2("path", 256), "job_position_id": F.url_decode(F.regexp_replace(folder, "^[^=]+=", ""))}
    ))
    rows = decode_text(rows).drop("parsing_confidence")
    is_text = F.col("format") == "txt"
    too_large = F.when(F.col("length") > fixed.MAX_UPLOAD_BYTES, F.lit(fixed.REASON_TOO_LARGE))
    no_decoder = F.when(~is_text & (F.col("format") != "unsupported"), F.concat(F.lit("no decoder for "), F.col("format")))
    text, error = F.when(is_text, F.col("raw_text")), F.coalesce(too_large, no_decoder)
    if decoders:
        rows = rows.withColumn("_decoded", F.when(F.col("format").isin(*decoders) & too_large.isNull(), _decoder(decoders)("content", "format")))
        known = F.col("format").isin(*decoders)
        text = F.when(known, F.col("_decoded.text")).otherwise(text)
        error = F.coalesce(too_large, F.when(known, F.col("_decoded.error")).otherwise(no_decoder))
    return rows.select(
        "cv_id", "job_position_id", "original_filename", "mime_type",
        F.when(error.isNull(), text).alias("raw_text"),
        error.alias("read_error"),
    )


def _decoder(decoders: dict[str, Callable[[bytes], str]]):
    @F.pandas_udf("text string, error string")
    def decode(content: pd.Series, format: pd.Series) -> pd.DataFrame:
        rows = []
        for data, name in zip(content, format):
            try:
                rows.append((decoders[name](data) if name in decoders and data is not None else None, None))
            except Exception as err:  # one broken file must not stop the rest
                rows.append((None, str(err)))
        return pd.DataFrame(rows, columns=["text", "error"], index=content.index)

    return decode
