"""Alignment of the tokens of two tokenizers over the bytes of each text, on Arrow arrays.

Both tokenizers' ids of a batch of texts are list arrays. Flattened, with parent indices, their byte
lengths turn into end offsets by a cumulative sum that begins anew with every text. An Acero hash join
on (text, end) links the tokens that end together; where both end, a group of tokens ends. The linked
pairs of ids are counted with Table.group_by in every task, and Spark merges the partial counts. A
second pass over the stored links looks their counts up.

Of two tokens that end together the shorter one's bytes are a suffix of the other's, so at most about
as many distinct pairs exist as the two vocabularies have bytes, whatever the corpus (`pair_bound`). The
merged counts are checked against that bound and broadcast as two plain arrays.

Defined results: null and empty texts, and texts whose tokens of either kind do not spell a space and
the text, have no tokens: zeros and an empty digest; special tokens' strings are ordinary text; rows
with the same or no doc_id are each returned; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from shortlist.llm.common import cut_lineage, ids_and_texts, read, set_batches, worker_cache
from shortlist.llm.registry import query
from shortlist.llm.tokens import encoder

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
PAIRS_HELD = 1 << 21  # links a task gathers before it counts them again


def byte_level_tokens(vocabulary: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable bytes stand for themselves, the others,
    in order, for the characters from 256 on."""
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        data = json.load(file)
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    names = data["model"]["vocab"]
    out = [b""] * (1 + max([*names.values(), *[t["id"] for t in data["added_tokens"]]]))
    for name, i in names.items():
        out[i] = bytes(byte_of[c] for c in name)
    for token in data["added_tokens"]:
        out[token["id"]] = token["content"].encode()
    return out


def piece_tokens(processor) -> list[bytes]:
    """The bytes of each id of a piece vocabulary."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Pair:
    """Both tokenizers with the bytes, byte lengths and decimal names of their ids."""

    def __init__(self, first: str, second: str):
        import sentencepiece

        self.first = encoder(first, plain_specials=True)
        self.second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
        tokens = byte_level_tokens(first), piece_tokens(self.second)
        self.sizes = [len(t) for t in tokens]
        self.bytes = [pa.array(t, pa.large_binary()) for t in tokens]
        self.lengths = [np.array([len(x) for x in t], np.int64) for t in tokens]
        self.names = [pa.array([str(i) for i in range(len(t))], pa.large_string()) for t in tokens]

    def code_type(self):
        return np.int32 if self.sizes[0] * self.sizes[1] < 1 << 31 else np.int64

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        ones = [np.frombuffer(x, np.uint32).astype(np.int32) for x in self.first.encode(texts, led=True)]
        return [ones, [np.array(x, np.int32) for x in self.second.encode(texts, num_threads=1)]]


def tokenizers(first: str, second: str) -> Pair:
    cache = worker_cache("pairs")
    if (first, second) not in cache:
        cache[first, second] = Pair(first, second)
    return cache[first, second]


def pair_bound(first: str = BYTE_LEVEL, second: str = PIECES) -> int:
    """The most distinct linked pairs: each token with each of its suffixes in the other vocabulary, which
    may hold a one-byte suffix twice (as a piece and as a byte)."""
    both = tokenizers(first, second)
    return int(2 * sum(n.sum() + len(n) for n in both.lengths))


def _flat(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
    return pa.LargeListArray.from_arrays(offsets, pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))


def _spells(tokens: pa.LargeListArray, vocabulary: pa.Array, expected: list[bytes]) -> np.ndarray:
    """Whether the tokens of each list, joined, are the expected bytes."""
    values = vocabulary.take(pc.list_flatten(tokens))
    starts = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1)[np.asarray(tokens.offsets)]
    data = values.buffers()[2]
    view = memoryview(data if data is not None else b"").cast("B")
    return np.array([view[a:b] == want for a, b, want in zip(starts[:-1].tolist(), starts[1:].tolist(), expected)], bool)


def _ends(tokens: pa.LargeListArray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent index and end offset in its text of each token."""
    parents = np.asarray(pc.list_parent_indices(tokens))
    running = np.concatenate(([0], np.cumsum(lengths[np.asarray(pc.list_flatten(tokens))])))
    return parents, running[1:] - running[np.asarray(tokens.offsets)[parents]]


def _joined(values: pa.Array, offsets: np.ndarray, between: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(offsets.astype(np.int32), values), pa.scalar(between, values.type))


def align_batch(texts: list[bytes], both: Pair) -> tuple[list[pa.Array], list[str]]:
    """Arrays n_a, n_b, n_groups, codes (a * size of B + b of each link) and the groups as text."""
    words = [t.decode() for t in texts]
    tokens = [_flat(x) for x in both.encode(words)]
    good = np.array([len(t) > 0 for t in texts], bool)
    led = [b" " + t for t in texts]
    for lists, vocabulary in zip(tokens, both.bytes):
        good &= _spells(lists, vocabulary, led)
    if not good.all():
        tokens = [pc.if_else(pa.array(good), t, pa.array([[]] * len(t), t.type)) for t in tokens]
    tables = []
    for lists, lengths in zip(tokens, both.lengths):
        parents, ends = _ends(lists, lengths)
        tables.append((parents, pa.table({"text": parents, "end": ends, "at": np.arange(len(ends)), "id": pc.list_flatten(lists)})))
    (parents_a, a), (parents_b, b) = tables
    links = a.join(b, ["text", "end"], join_type="inner", left_suffix="_a", right_suffix="_b", use_threads=False)
    links = links.sort_by([("text", "ascending"), ("end", "ascending"), ("at_a", "ascending"), ("at_b", "ascending")])
    text, end, at_a, at_b, id_a, id_b = (links[c].to_numpy() for c in ("text", "end", "at_a", "at_b", "id_a", "id_b"))
    codes = id_a.astype(np.int64) * both.sizes[1] + id_b
    last = np.concatenate((text[1:] != text[:-1], [True])) if len(text) else np.zeros(0, bool)
    if len(text):
        last[:-1] |= end[1:] != end[:-1]
    in_group = [_joined(names.take(pc.list_flatten(t)), np.concatenate(([0], at[last] + 1)), ",") for names, t, at in zip(both.names, tokens, (at_a, at_b))]
    groups = pc.binary_join_element_wise(*in_group, pa.scalar("|", pa.large_string()))
    count = len(texts)
    n_groups, n_links = (np.bincount(x, minlength=count) for x in (text[last], text))
    whole = _joined(groups, np.concatenate(([0], np.cumsum(n_groups))), ";")
    n_a, n_b = (np.bincount(p, minlength=count) for p in (parents_a, parents_b))
    held = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n_links))).astype(np.int32), pa.array(codes.astype(both.code_type())))
    return [*[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)], held], whole.to_pylist()


def align(docs: DataFrame, first: str = BYTE_LEVEL, second: str = PIECES, keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, codes, groups_sha256[, groups]) of each row; codes has one entry per link."""

    def run(batches):
        both = tokenizers(first, second)
        for batch in batches:
            ids, texts = ids_and_texts(batch)
            arrays, groups = align_batch(texts, both)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            out = [pa.array(ids, pa.int64()), *arrays, pa.array(digests, pa.string())]
            names = ["doc_id", "n_a", "n_b", "n_groups", "codes", "groups_sha256"]
            if keep_groups:
                out.append(pa.array(groups, pa.string()))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = "int" if tokenizers(first, second).code_type() is np.int32 else "long"
    schema = f"doc_id long, n_a long, n_b long, n_groups long, codes array<{kind}>, groups_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema + (", groups string" if keep_groups else ""))


def pair_counts(aligned: DataFrame, first: str = BYTE_LEVEL, second: str = PIECES) -> DataFrame:
    """(code, links, best) of each linked pair of ids; best where no other pair of its second id has more."""
    size = tokenizers(first, second).sizes[1]

    def counted(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).group_by("code", use_threads=False).aggregate([("links", "sum")])
        return pa.table({"code": table["code"], "links": table["links_sum"]})

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            codes = pc.list_flatten(batch.column(0)).cast(pa.int64())
            parts.append(pa.table({"code": codes, "links": pa.array(np.ones(len(codes), np.int64))}))
            rows += len(codes)
            if rows > PAIRS_HELD:
                parts = [counted(parts)]
                rows = 0
        if parts:
            yield from counted(parts).to_batches(max_chunksize=100_000)

    counts = aligned.select("codes").mapInArrow(run, "code long, links long").groupBy("code").agg(F.sum("links").alias("links"))
    counts = cut_lineage(counts)
    second_id = F.col("code") % size
    most = counts.groupBy(second_id.alias("second")).agg(F.max("links").alias("most"))
    # as many rows as the second vocabulary has ids, at most
    marked = counts.withColumn("second", second_id).join(F.broadcast(most), "second")
    return marked.select("code", "links", (F.col("links") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """Adds n_links, n_best and count_sum, the counts of all the links of a row."""
    table = counts.limit(bound + 1).orderBy("code").toArrow()
    if table.num_rows > bound:
        raise ValueError("more pairs than the vocabularies allow")
    held = aligned.sparkSession.sparkContext.broadcast(
        (table["code"].to_numpy(), np.concatenate((table["links"].to_numpy(), [0])), np.concatenate((table["best"].to_numpy(), [False])))
    )

    def run(batches):
        codes, links, best = held.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            offsets = np.asarray(lists.offsets)
            at = np.searchsorted(codes, pc.list_flatten(lists).to_numpy(zero_copy_only=False))
            offsets = offsets - offsets[0]
            sums = [np.concatenate(([0], np.cumsum(x[at], dtype=np.int64))) for x in (best, links)]
            added = [offsets[1:] - offsets[:-1], *[s[offsets[1:]] - s[offsets[:-1]] for s in sums]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(x, pa.int64()) for x in added]],
                [*batch.schema.names[:-1], "n_links", "n_best", "count_sum"],
            )

    kept = aligned.select(*[c for c in aligned.columns if c != "codes"], "codes")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, n_links long, n_best long, count_sum long")


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    set_batches(spark, 500, "2m")  # a token takes about 150 bytes of tables while its batch is aligned
    aligned = cut_lineage(align(docs))
    return with_counts(aligned, pair_counts(aligned), pair_bound())
