"""CV rows and texts in tables bucketed by CV, so that what meets a text by cv_id comes to the text.

Merges, overrides, model results and rescoring all join on cv_id. Between two bucketed tables such a join
moves nothing; a plain table that meets a bucketed one is dealt into its buckets, and the texts stay
where they are. A CV has one key, so buckets are even however large a job is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from shortlist.cluster import shared_folder

KEY = "cv_id"
BUCKET_BYTES = 256 << 20  # of text in one bucket
MOST_BUCKETS = 100_000  # what Spark allows by default


def bucket_count(texts: DataFrame, column: str = "raw_text") -> int:
    """Buckets of about BUCKET_BYTES of text, and at least one for each shuffle partition; beyond MOST_BUCKETS
    the buckets grow instead."""
    held = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BUCKETS, max(least, -(-held // BUCKET_BYTES)))


def write_bucketed(df: DataFrame, buckets: int, table: str | None = None, folder: str | None = None) -> DataFrame:
    """Write `df` as a table in `buckets` buckets of cv_id, one file each, and read it from there.

    The rows are dealt by the hash that numbers the buckets, so a task writes whole buckets. `folder` is the
    session's shared folder unless given; `table` gets a name of its own unless given, and one that exists
    is refused: a new version of a table is a new table, as the old one is still read while it is written.
    """
    table = table or f"shortlist_{uuid.uuid4().hex}"
    path = f"{folder or shared_folder(df.sparkSession)}/{table}"
    writer = df.repartition(buckets, KEY).write.format("parquet").option("path", path)
    writer.bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(table)
    return df.sparkSession.table(table)


def drop_tables(spark: SparkSession, *tables: str) -> None:
    """Take tables that were superseded out of the catalog; their files stay in their folders."""
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
