"""Token ids in files of patched frame-of-reference blocks, in document order, and back.

A segment holds up to about `SEGMENT_IDS` ids of consecutive documents. Its ids are cut into blocks of
128: the block's minimum is subtracted, the rest is packed at the width that covers `PERCENTILE` of
the block, what doesn't fit goes to an exception list, and an index has where each block's bits start,
so that any block can be read alone.

Layout, little-endian: magic `PFR1`; ids, blocks, exceptions (u32 each); block minima (u32), widths
(u8), exception counts (u8), starts of packed bits (u32); exception places in their block (u8) and
values above the minimum (u32); packed bits.

Segments are rows of Parquet files written by Spark (so a retried task leaves no half a file and any
store will do): part and seq give their order, doc_ids and lengths their directory. Defined results:
null text is an empty document (its end id alone); a null doc_id sorts first; rows with one doc_id
stand next to each other, ordered by text; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shortlist.cluster import salted_lookup
from shortlist.llm.common import blocks, read, shared_folder, text_bytes
from shortlist.llm.registry import query
from shortlist.llm.tokens import VOCABULARY, encoder

END_ID = 2
BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 20
PART_BYTES = 24 << 20
_MAGIC = b"PFR1"


def encode_segment(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """Ids (unsigned 32-bit) as patched frame-of-reference blocks."""
    count = len(ids)
    n = -(-count // BLOCK)
    whole = np.empty(n * BLOCK, np.uint32)
    whole[:count] = ids
    if n:
        whole[count:] = ids[-1]
    rows = whole.reshape(n, BLOCK)
    low = rows.min(1) if n else np.zeros(0, np.uint32)
    above = rows - low[:, None]
    fits = np.sort(above, 1)[:, -(-BLOCK * percentile // 100) - 1] if n else low
    width = np.ceil(np.log2(fits.astype(np.float64) + 1)).astype(np.uint8)
    outside = (above.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    where = np.nonzero(outside)
    values = above[where]
    above[where] = 0
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    packed = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width).tolist():
        if w == 0:
            continue
        chosen = np.flatnonzero(width == w)
        bits = np.unpackbits(above[chosen].astype("<u4").view(np.uint8).reshape(-1, BLOCK, 4), axis=2, bitorder="little")
        packed[starts[chosen][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(
            bits[:, :, :w].reshape(len(chosen), -1), axis=1, bitorder="little"
        )
    head = np.array([count, n, len(values)], "<u4").tobytes()
    return b"".join(
        (
            _MAGIC, head, low.astype("<u4").tobytes(), width.tobytes(), outside.sum(1).astype(np.uint8).tobytes(),
            starts.astype("<u4").tobytes(), where[1].astype(np.uint8).tobytes(), values.astype("<u4").tobytes(), packed.tobytes(),
        )
    )


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment."""
    if data[:4] != _MAGIC:
        raise ValueError("not a token segment")
    count, n, exceptions = np.frombuffer(data, "<u4", 3, 4).tolist()
    at = 16

    def take(kind: str, length: int) -> np.ndarray:
        nonlocal at
        values = np.frombuffer(data, kind, length, at)
        at += values.nbytes
        return values

    low, width, held, starts = take("<u4", n), take("u1", n), take("u1", n), take("<u4", n)
    places, values = take("u1", exceptions), take("<u4", exceptions)
    packed = np.frombuffer(data, np.uint8, offset=at)
    rows = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w == 0:
            continue
        chosen = np.flatnonzero(width == w)
        raw = packed[starts[chosen].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
        bits = np.zeros((len(chosen), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(chosen), BLOCK, w)
        rows[chosen] = np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(chosen), BLOCK)
    rows[np.repeat(np.arange(n), held), places] = values
    rows += low[:, None]
    return rows.reshape(-1)[:count]


def write_token_files(
    docs: DataFrame, path: str, end_id: int = END_ID, vocabulary: str = VOCABULARY, part_bytes: int = PART_BYTES, segment_ids: int = SEGMENT_IDS
) -> None:
    """Tokenise in ascending doc_id order and write segments to `path` through Spark."""
    end = np.array([end_id], "<u4").tobytes()
    parts = blocks(text_bytes(docs)[1], part_bytes)
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = keyed.repartitionByRange(parts, F.col("doc_id").asc(), tie.asc()).sortWithinPartitions(F.col("doc_id").asc(), tie.asc(), "text")

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, held, total = [], [], [], 0

        def segment():
            data = encode_segment(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([total], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary()),
                ],
                ["part", "seq", "n_ids", "doc_ids", "lengths", "data"],
            )

        for batch in batches:
            for doc_id, tokens in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode(batch.column(1).to_pylist())):
                ids.append(doc_id)
                lengths.append(len(tokens) // 4 + 1)
                held += (tokens, end)
                total += lengths[-1]
                if total >= segment_ids:
                    yield segment()
                    seq += 1
                    ids, lengths, held, total = [], [], [], 0
        if ids:
            yield segment()

    ordered.mapInArrow(
        run, "part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, data binary"
    ).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files."""
    segments = spark.read.parquet(path)
    # ids before each segment: sums inside groups of parts, then over the groups, so no task sees all
    sizes = segments.select("part", "seq", "n_ids", F.expr("part div 1000").alias("zone"))
    in_zone = Window.partitionBy("zone").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    over_zones = Window.orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)
    zones = sizes.groupBy("zone").agg(F.sum("n_ids").alias("_all")).withColumn("_zone_before", F.sum("_all").over(over_zones))
    before = sizes.withColumn("_before", F.sum("n_ids").over(in_zone)).join(zones.drop("_all"), "zone").select(
        "part", "seq", (F.coalesce("_before", F.lit(0)) + F.coalesce("_zone_before", F.lit(0))).alias("_start")
    )

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_segment(row["data"]).astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - np.array(row["lengths"], np.int64)
                spans = list(zip(starts.tolist(), ends.tolist()))
                n = len(spans)
                arrays = [
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts), pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in spans], pa.int64()),
                ]
                names = ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array([ids[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    rows = segments.select("part", "seq", "doc_ids", "lengths", "data").mapInArrow(run, schema)
    placed = salted_lookup(rows, before, ["part", "seq"], spread_by=["local"], bounded_by=segments.select("part"))
    return placed.select(
        "doc_id", (F.col("_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])
    )


@query("op9_token_files")
def op9_token_files(spark, sf_dir):
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(read(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
