"""Scoring by prediction by partial matching, pretrained on the training part of the corpus.

The model is a trie of byte contexts up to `ORDER` bytes long with the counts of what follows, over
lower-cased texts, the end of a text being a symbol of its own and its start a context of its own. A
symbol is coded in its longest known context; a context gives its novel symbols the share d / (t + d)
of its d distinct and t counted symbols (escape), and symbols already ruled out by the longer context
are left out of both (exclusion). Below the empty context all symbols not yet seen are equally likely.

Texts are dealt into chunks by hash and shuffled once. A chunk asks for each distinct context with its
symbol, and for each distinct word, once, sending what its own training texts count; blocks of
contexts (by their last two bytes) and of words answer with totals over all chunks. Contexts of up to
one byte are a table of at most 258 x 258 counts, which is broadcast. So the trie grows with the corpus
and lies in blocks; all of a corpus is learned and every text is scored whole.

Defined results: null text is empty (one token, its end); a null doc_id is trained on (its text form is
empty); repeated rows are each learned and returned; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shortlist.llm.common import Shipped, blocks, read, text_bytes
from shortlist.llm.registry import query

ORDER = 4
FOLDS, HELD_OUT = 5, 1
CHUNK_BYTES = 6 << 20
BLOCK_BYTES = 8 << 20  # text bytes per block of contexts or words
MOST_PARTITIONS = 20_000

_END, _START, _SYMBOLS, _BITS = 256, 257, 258, 9
_NO_PAIR = -1  # rows of the pair table that carry counts: tokens, then texts
_MESSAGE = "kind int, bucket long, chunk long, a binary, b binary"
_NAMES = ["kind", "bucket", "chunk", "a", "b"]
_CONTEXTS, _WORDS = 0, 1


def in_training(doc_id) -> bool:
    name = "" if doc_id is None else str(doc_id)
    return zlib.crc32(name.encode()) % FOLDS != HELD_OUT


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each led by start symbols and closed by an end; first symbol of each."""
    lengths = np.array([len(t) for t in texts], np.int64) + ORDER + 1
    ends = np.cumsum(lengths)
    out = np.full(int(ends[-1]) if len(ends) else 0, _START, np.int64)
    body = np.frombuffer(b"".join(texts), np.uint8)
    firsts = ends - lengths + ORDER
    where = np.ones(len(out), bool)
    where[(firsts[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    where[ends - 1] = False
    out[where] = body
    out[ends - 1] = _END
    return out, firsts


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with its context as one number, text after text, and where each text begins."""
    symbols, _ = _symbols(texts)
    packed = symbols[: len(symbols) - ORDER].copy()
    for k in range(1, ORDER + 1):
        packed <<= _BITS
        packed |= symbols[k : len(symbols) - ORDER + k]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    # texts stand ORDER symbols further apart in `symbols` than their grams do here
    keep = np.ones(len(packed), bool)
    inner = (starts + np.arange(len(texts)) * ORDER)[1:]
    keep[(inner[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    return packed[keep], starts


class Chunk:
    """The texts of a chunk in a fixed order, with their distinct grams and words in a fixed order."""

    def __init__(self, table: pa.Table, buckets: int):
        ids = table.column("doc_id").to_pylist()
        texts = [(t or b"").lower() for t in table.column("text").cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.train = np.array([in_training(i) for i in self.ids])
        grams, self.starts = _grams(self.texts)
        self.sizes = np.diff(np.append(self.starts, len(grams)))
        self.codes, distinct = pd.factorize(grams)
        mixed = ((distinct >> _BITS) & ((1 << 2 * _BITS) - 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        self.place = np.argsort(bucket, kind="stable")
        self.grams, self.bucket = distinct[self.place], bucket[self.place]
        self.buckets = buckets

    def gram_counts(self) -> np.ndarray:
        learned = np.repeat(self.train, self.sizes)
        return np.bincount(self.codes[learned], minlength=len(self.grams))[self.place]

    def words(self) -> dict[int, dict[bytes, int]]:
        """Per bucket, each word of the chunk with its count in training texts, in order of appearance."""
        counts: dict[bytes, int] = {}
        for text, train in zip(self.texts, self.train.tolist()):
            if train:
                for word in text.split():
                    counts[word] = counts.get(word, 0) + 1
            else:
                for word in text.split():
                    if word not in counts:
                        counts[word] = 0
        out: dict[int, dict[bytes, int]] = {}
        buckets = self.buckets
        for word, count in counts.items():
            out.setdefault(zlib.crc32(word) % buckets, {})[word] = count
        return out


class Tables:
    """Counts of contexts of up to one byte, as a dense table."""

    def __init__(self, pairs: np.ndarray):
        self.pairs = pairs  # [context symbol, next symbol]
        self.single = pairs.sum(0)
        self.pair_total, self.pair_kinds = pairs.sum(1), (pairs > 0).sum(1)
        self.total, self.kinds = int(self.single.sum()), int((self.single > 0).sum())
        self.shared = ((pairs > 0) * self.single[None, :]).sum(1)


class _Level:
    """Counts of one order: symbols in their contexts, and sums per context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, inverse = np.unique(grams, return_inverse=True)
        self.counts = np.bincount(inverse, weights=counts, minlength=len(self.grams)).astype(np.int64)
        self.contexts, self.of = np.unique(self.grams >> _BITS, return_inverse=True)
        self.total = np.bincount(self.of, weights=self.counts, minlength=len(self.contexts)).astype(np.int64)
        self.kinds = np.bincount(self.of, minlength=len(self.contexts))

    def count_of(self, grams: np.ndarray) -> np.ndarray:
        return _found(self.grams, self.counts, grams)

    def sums_over(self, lower: np.ndarray) -> np.ndarray:
        """Per context, the sum of what the next shorter context counts for its symbols."""
        return np.bincount(self.of, weights=lower, minlength=len(self.contexts)).astype(np.int64)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if len(keys) == 0:
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def log_probabilities(queries: np.ndarray, grams: np.ndarray, counts: np.ndarray, low: Tables) -> np.ndarray:
    """log10 of each queried symbol in its context. `grams` hold all training counts of the contexts
    that end in the queries' last two context symbols; `low` those of shorter contexts."""
    out = np.zeros(len(queries))
    open_ = np.ones(len(queries), bool)
    ruled_kinds, ruled_total = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    levels = {k: _Level(grams & ((1 << _BITS * (k + 1)) - 1), counts) for k in range(ORDER, 1, -1)}

    def settle(count, total, kinds, known):
        left, novel = total - ruled_total, kinds - ruled_kinds
        whole = left + novel
        hit = open_ & known & (count > 0)
        out[hit] += np.log10(count[hit]) - np.log10(whole[hit])
        miss = open_ & known & ~hit & (whole > 0)
        out[miss] += np.log10(novel[miss]) - np.log10(whole[miss])
        open_[hit] = False

    for k in range(ORDER, 1, -1):
        level = levels[k]
        mine = queries & ((1 << _BITS * (k + 1)) - 1)
        total = _found(level.contexts, level.total, mine >> _BITS)
        kinds = _found(level.contexts, level.kinds, mine >> _BITS)
        settle(level.count_of(mine), total, kinds, total > 0)
        if k > 2:
            lower = levels[k - 1].count_of(level.grams & ((1 << _BITS * k) - 1))
        else:
            lower = low.pairs[(level.grams >> _BITS) & 511, level.grams & 511]
        ruled_total = _found(level.contexts, level.sums_over(lower), mine >> _BITS)
        ruled_kinds = kinds
    context, symbol = (queries >> _BITS) & 511, queries & 511
    total, kinds = low.pair_total[context], low.pair_kinds[context]
    settle(low.pairs[context, symbol], total, kinds, total > 0)
    ruled_total, ruled_kinds = low.shared[context], kinds
    settle(low.single[symbol], np.full(len(queries), low.total), np.full(len(queries), low.kinds), np.full(len(queries), low.total > 0))
    out[open_] -= np.log10(_SYMBOLS - 1 - low.kinds) if low.kinds < _SYMBOLS - 1 else 0.0
    return out


def _message(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 5
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)


def _slices(bucket: np.ndarray):
    if len(bucket) == 0:
        return []
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)])


def low_orders(docs: DataFrame) -> tuple[Tables, int, int]:
    """Counts of contexts of up to one byte, of training tokens and of training texts; a bounded table."""

    def run(batches):
        for batch in batches:
            texts = [(t or b"").lower() for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()) if in_training(i)]
            if not texts:
                continue
            grams, _ = _grams(texts)
            pairs = np.bincount(grams & ((1 << 2 * _BITS) - 1), minlength=1 << 2 * _BITS)
            at = np.flatnonzero(pairs)
            pair = np.concatenate((at, [_NO_PAIR, _NO_PAIR - 1]))
            count = np.concatenate((pairs[at], [sum(len(t.split()) for t in texts) + len(texts), len(texts)]))
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], ["pair", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table, counts = np.zeros((512, 512), np.int64), {_NO_PAIR: 0, _NO_PAIR - 1: 0}
    for pair, n in rows:
        if pair < 0:
            counts[pair] = n
        else:
            table[pair >> _BITS, pair & 511] = n
    return Tables(table), counts[_NO_PAIR], counts[_NO_PAIR - 1]


def score_texts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document with its token counts, the unigram base score and the model's score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = text_bytes(docs)[1]
    low, train_tokens, train_texts = low_orders(docs)
    chunks, buckets = blocks(size, chunk_bytes), blocks(size, min(block_bytes, chunk_bytes))
    partitions = min(buckets, MOST_PARTITIONS)
    sent = Shipped(docs.sparkSession, low)
    deal = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(chunks))
    dealt = docs.withColumn("_chunk", deal).repartition(min(chunks, MOST_PARTITIONS), "_chunk")

    def ask(table: pa.Table) -> pa.Table:
        chunk, where = Chunk(table, buckets), table.column("_chunk")[0].as_py()
        counts = chunk.gram_counts()
        rows = [(_CONTEXTS, k, where, chunk.grams[a:b].astype("<i8").tobytes(), counts[a:b].astype("<u4").tobytes()) for k, a, b in _slices(chunk.bucket)]
        rows += [(_WORDS, k, where, b" ".join(w), np.array(list(w.values()), "<u4").tobytes()) for k, w in chunk.words().items()]
        return _message(rows)

    def context_block(rows: list[tuple]) -> list[tuple]:
        grams = [np.frombuffer(a, "<i8") for _, a, _ in rows]
        counts = np.concatenate([np.frombuffer(b, "<u4") for *_, b in rows])
        distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        learned = total > 0
        answer = log_probabilities(distinct, distinct[learned], total[learned], sent.value)[inverse]
        ends = np.cumsum([len(g) for g in grams])
        return [(chunk, answer[e - len(g) : e].astype("<f8").tobytes()) for (chunk, *_), g, e in zip(rows, grams, ends)]

    def word_block(rows: list[tuple]) -> tuple[list[tuple], int]:
        total: dict[bytes, int] = {}
        for _, words, counts in rows:
            for word, count in zip(words.split(b" "), np.frombuffer(counts, "<u4").tolist()):
                total[word] = total.get(word, 0) + count
        return [(chunk, np.array([total[w] for w in words.split(b" ")], "<u8").tobytes()) for chunk, words, _ in rows], sum(c > 0 for c in total.values())

    def gathered(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault((row["kind"], row["bucket"]), []).append((row["chunk"], row["a"], row["b"]))
        for key in list(held):
            yield key, held.pop(key)

    def answer(batches):
        for (kind, bucket), rows in gathered(batches):
            found = context_block(rows) if kind == _CONTEXTS else word_block(rows)[0]
            yield from _message([(kind, bucket, chunk, data, b"") for chunk, data in found]).to_batches()

    def vocabulary(batches):
        for _, rows in gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([word_block(rows)[1]], pa.int64())], ["v"])

    asked = dealt.groupBy("_chunk").applyInArrow(ask, _MESSAGE).repartition(partitions, "bucket")
    answers = asked.mapInArrow(answer, _MESSAGE)
    words = asked.where(F.col("kind") == _WORDS).mapInArrow(vocabulary, "v long").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("_v"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "_logs", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if left.num_rows == 0:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        chunk = Chunk(left, buckets)
        found = {(r["kind"], r["bucket"]): r["a"] for r in right.to_pylist()}
        logs = np.empty(len(chunk.grams))
        for k, a, b in _slices(chunk.bucket):
            logs[chunk.place[a:b]] = np.frombuffer(found[_CONTEXTS, k], "<f8")
        scores = np.add.reduceat(logs[chunk.codes], chunk.starts)
        count: dict[bytes, int] = {}
        for k, mine in chunk.words().items():
            count.update(zip(mine, np.frombuffer(found[_WORDS, k], "<u8").tolist()))
        n_tokens, n_known, base = [], [], []
        for text in chunk.texts:
            held = np.array([*map(count.__getitem__, text.split()), train_texts], np.int64)
            n_tokens.append(len(held))
            n_known.append(int((held > 0).sum()))
            base.append(float(np.log10(held + 0.5).sum()))
        columns = [chunk.ids, (~chunk.train).tolist(), n_tokens, n_known, base, scores]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    scored = dealt.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, _logs double, score double"
    )
    vocabulary_size = F.col("_v") + (1 if train_texts else 0)
    each = F.log10(F.lit(float(train_tokens)) + 0.5 * (vocabulary_size + 1))
    return scored.join(F.broadcast(words)).select(  # one row
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("_logs") - F.col("n_tokens") * each).alias("base_score"), "score",
    )


@query("op2_lm_scoring")
def op2_lm_scoring(spark, sf_dir):
    return score_texts(read(spark, sf_dir, "documents"))
