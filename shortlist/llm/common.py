"""Shared pieces: batch sizes, block counts, byte views of texts, blobs, worker caches."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shortlist.cluster import cut_lineage, shared_folder  # noqa: F401

BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder, read in UTC with Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    set_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def set_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound what one Arrow batch holds by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def blocks(amount: int, per_block: int, least: int = 1) -> int:
    """How many blocks of about `per_block` hold `amount`: grows with the data, so a block does not."""
    return max(least, -(-int(amount) // per_block))


def apart(docs: DataFrame, needed: list[str], work) -> DataFrame:
    """`work` over the columns it needs, the others held in one struct, so that no name of theirs can meet a
    name it uses; their place and values come out as they were."""
    mine = [c for c in docs.columns if c in needed]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    out = work(docs.select(*[F.col(f"`{c}`") for c in mine], F.struct(F.lit(0).alias("_"), *rest).alias("others")))
    return out.select(*[F.col(f"`{c}`") if c in needed else F.col("others").getField(c).alias(c) for c in docs.columns])


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of the texts; a scan with two counters."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return row["n"], row["b"] or 0


def bound(value: Column, use) -> Column:
    """Evaluate `value` once and use it several times inside one expression."""
    return F.transform(F.array(value), use)[0]


def ids_and_texts(batch: pa.RecordBatch, key: str = "doc_id", text: str = "text"):
    """Python ids and UTF-8 texts (null: empty) of a batch."""
    ids = batch.column(batch.schema.get_field_index(key)).to_pylist()
    column = batch.column(batch.schema.get_field_index(text))
    return ids, [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker; only ever holds recomputable values."""
    home = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    return home.__dict__.setdefault(name, {})


class Shipped:
    """A value sent to all executors as bytes that need no module of this package there; each worker builds
    it once."""

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.name = uuid.uuid4().hex

    @property
    def value(self):
        cache = worker_cache("shipped")
        if self.name not in cache:
            if len(cache) >= 4:
                cache.pop(next(iter(cache)))
            cache[self.name] = cloudpickle.loads(self.sent.value)
        return cache[self.name]


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each run, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
