"""Packing of tokenised documents into sequences by best-fit decreasing.

Overlong documents are first cut into full windows. What is left of each document goes, longest
first, into the open window with the least room that still holds it, found in a segment tree over
remaining capacity. Pieces are packed in hash blocks of at most about `BLOCK_BYTES` of ids, whatever the
documents' lengths: a block leaves at most a few partly filled windows, so padding does not depend on packing
everything in one place.

A sequence is padded to the window unless the tokens in it are a power of two. Defined results: null
text is an empty document (its end id alone); rows that repeat a document are packed each; no rows
give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shortlist.llm.common import blocks, read, text_bytes
from shortlist.llm.registry import query
from shortlist.llm.tokens import VOCABULARY, encoder

WINDOW = 1024
END_ID = 0
BLOCK_BYTES = 64 << 20  # most bytes of ids in a block: four for each byte of text and each end
MOST_PARTITIONS = 20_000

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACE = ", sequence_id long, offset long, sequence_tokens long, padding long"


class CapacityTree:
    """Counts open windows by remaining capacity; finds the least capacity of at least a given room."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, room: int) -> int | None:
        count, node = self.count, self.leaves + room
        if count[node]:
            return room
        while node > 1 and (node & 1 or not count[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        return node - self.leaves


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; the lengths must come longest first."""
    tree, open_at = CapacityTree(window), [[] for _ in range(window + 1)]
    place, offset, used = [], [], 0
    for length in lengths:
        room = tree.tightest(length)
        if room is None:
            chosen, room, used = used, window, used + 1
        else:
            chosen = open_at[room].pop()
            tree.add(room, -1)
        place.append(chosen)
        offset.append(window - room)
        if room > length:
            open_at[room - length].append(chosen)
            tree.add(room - length, 1)
    return place, offset


def cut_pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids (end id included): full windows, then the remainder."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            rows = [[], [], [], [], []]
            kept = []
            for doc_id, tokens in zip(ids, encoder(vocabulary).encode(texts)):
                tokens += end
                total = len(tokens) // 4
                for start in range(0, total, window):
                    piece = tokens[4 * start : 4 * (start + window)]
                    for column, value in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total)):
                        column.append(value)
                    if keep_ids:
                        kept.append(np.frombuffer(piece, "<u4").astype(np.int32))
            arrays = [pa.array(c, pa.int64()) for c in rows]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = _PIECE + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, count: int, window: int = WINDOW, partitions: int = MOST_PARTITIONS) -> DataFrame:
    """Adds sequence_id, offset, and the sequence's tokens and padding to each piece; `count` hash blocks. A
    task gets its blocks sorted, longest pieces first, and holds one at a time."""
    columns = pieces.columns
    block = F.pmod(F.xxhash64("doc_id", "start"), F.lit(count)).alias("_block")
    order = [F.col("_block").asc(), F.col("length").desc(), F.col("doc_id").asc(), F.col("start").asc(), F.col("ids_crc32").asc()]
    dealt = pieces.select(block, "*").repartition(min(count, partitions), "_block").sortWithinPartitions(*order)

    def placed(parts: list[pa.RecordBatch]):
        held = pa.Table.from_batches(parts)
        number = held.column("_block")[0].as_py()
        length = held.column("length").to_numpy()
        place, offset = best_fit(length.tolist(), window)
        place = np.array(place, np.int64)
        filled = np.bincount(place, weights=length).astype(np.int64)[place]
        padding = np.where((filled & (filled - 1)) == 0, 0, window - filled)
        held = held.drop_columns(["_block"])
        for name, values in (("sequence_id", place + (number << 40)), ("offset", np.array(offset, np.int64)), ("sequence_tokens", filled), ("padding", padding)):
            held = held.append_column(name, pa.array(values))
        yield from held.to_batches(max_chunksize=5_000)

    def run(batches):
        parts, now = [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                if parts and numbers[a] != now:
                    yield from placed(parts)
                    parts = []
                now = numbers[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from placed(parts)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns) + _PLACE
    return dealt.mapInArrow(run, schema)


def pack(
    docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY, keep_ids: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per piece with its place; `keep_ids` adds the ids themselves."""
    rows, size = text_bytes(docs)
    return place_pieces(cut_pieces(docs, window, end_id, vocabulary, keep_ids), blocks(4 * (size + rows), block_bytes), window)


@query("op8_packing")
def op8_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))
