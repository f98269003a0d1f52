"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

Items are cut evenly into units of at most 32 words, documents into passages of 64 words every 32, so
that each run of 32 words lies whole in some passage. A unit's BM25 score is divided by the score it
gives itself, which puts one threshold on all of them. Block-max WAND finds every unit at or above the
threshold: a passage first sums the maxima of its terms per block of `_LIVE` units, and stops there if
no block can reach the threshold; otherwise it walks the postings with their own block maxima. A candidate item is then verified on the document: at least
`MIN_OVERLAP` of the item's five-word shingles must occur in it, and, where the item has an answer, the
answer's words must stand in it as well.

The benchmark is cut into shards of bounded bytes (`SHARD_BYTES`); each shard's index goes to the
executors in turn, so nothing broadcast grows with either table. Term statistics are of all items.

Defined results: null or wordless texts and items match nothing; a null doc_id is returned as null;
repeated documents are each returned, an item_id that repeats counts as one item per row of its own
text; empty tables give no rows (or all documents back); extra columns pass through.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shortlist.llm.common import Shipped, apart, blocks, read
from shortlist.llm.registry import query

UNIT = 32
PASSAGE = 64
SHINGLE = 5
MIN_SCORE = 0.6
MIN_OVERLAP = 0.8
SHARD_BYTES = 16 << 20
K1, B = 1.2, 0.75
_POSTINGS = 64  # per block
_LIVE = 4  # units per block of the first bound

_WORD = re.compile(r"\w+")
_TOLERANCE = 1e-9


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str], size: int = SHINGLE) -> set[int]:
    """Hashes of the runs of `size` words (fewer words: of the whole run)."""
    if not words:
        return set()
    return {hash(tuple(words[i : i + size])) for i in range(max(1, len(words) - size + 1))}


class Index:
    """Inverted index over the units of some items, with block maxima."""

    def __init__(self, items: list[tuple], stats: dict[str, int], total: int, mean: float):
        self.items = items  # (item_id, text, answer)
        units = []
        for number, (_, text, _) in enumerate(items):
            words = words_of(text)
            parts = max(1, -(-len(words) // UNIT))
            for k in range(parts):
                part = words[k * len(words) // parts : (k + 1) * len(words) // parts]
                if part:
                    units.append((number, part))
        self.owner = [number for number, _ in units]
        postings: dict[str, list] = {}
        for unit, (_, part) in enumerate(units):
            counts: dict[str, int] = {}
            for word in part:
                counts[word] = counts.get(word, 0) + 1
            weight = {
                w: math.log(1 + (total - stats[w] + 0.5) / (stats[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(part) / mean))
                for w, c in counts.items()
            }
            whole = sum(weight.values())
            for w, x in weight.items():
                postings.setdefault(w, []).append((unit, x / whole))
        self.term = {w: n for n, w in enumerate(postings)}
        self.units = [[u for u, _ in p] for p in postings.values()]
        self.scores = [[x for _, x in p] for p in postings.values()]
        self.block_max = [[max(s[i : i + _POSTINGS]) for i in range(0, len(s), _POSTINGS)] for s in self.scores]
        self.bound = np.array([max(s) for s in self.scores] + [0.0])
        self.live: list[tuple[np.ndarray, np.ndarray]] = []
        for held, scores in zip(self.units, self.scores):
            block = np.array(held, np.int64) // _LIVE
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            self.live.append((block[first], np.maximum.reduceat(np.array(scores), first)))
        self.questions: dict[int, tuple[int, set[int]]] = {}
        self.answers: dict[int, list[str]] = {}

    def search(self, terms: list[int], least: float) -> dict[int, float]:
        """Units scoring at least `least` for these distinct terms, by block-max WAND."""
        found: dict[int, float] = {}
        cursors = [[self.units[t][0], 0, t] for t in terms]
        while cursors:
            cursors.sort()
            upper, pivot = 0.0, None
            for n, (_, _, t) in enumerate(cursors):
                upper += self.bound[t]
                if upper >= least - _TOLERANCE:
                    pivot = n
                    break
            if pivot is None:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            near, end = 0.0, None
            for c in cursors[: pivot + 1]:
                at = self._seek(c[2], c[1], unit)
                if at < len(self.units[c[2]]):
                    block = at // _POSTINGS
                    near += self.block_max[c[2]][block]
                    last = self.units[c[2]][min(len(self.units[c[2]]), (block + 1) * _POSTINGS) - 1]
                    end = last if end is None else min(end, last)
            if near >= least - _TOLERANCE:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    at = self._seek(c[2], c[1], unit)
                    if at < len(self.units[c[2]]) and self.units[c[2]][at] == unit:
                        score += self.scores[c[2]][at]
                        at += 1
                    c[1] = at
                if score >= least - _TOLERANCE:
                    found[unit] = score
            else:  # no unit up to the nearest block end can reach it
                target = unit + 1 if end is None else max(unit, end) + 1
                if pivot + 1 < len(cursors):
                    target = max(unit + 1, min(target, cursors[pivot + 1][0]))
                for c in cursors[: pivot + 1]:
                    c[1] = self._seek(c[2], c[1], target)
            alive = []
            for c in cursors:
                if c[1] < len(self.units[c[2]]):
                    c[0] = self.units[c[2]][c[1]]
                    alive.append(c)
            cursors = alive
        return found

    def _seek(self, term: int, at: int, unit: int) -> int:
        units = self.units[term]
        while at < len(units) and units[at] < unit:
            block = at // _POSTINGS
            last = min(len(units), (block + 1) * _POSTINGS)
            at = last if units[last - 1] < unit else at + 1
        return at

    def _alive(self, terms: set[int], least: float) -> bool:
        """Whether some block of units can reach the threshold with these terms."""
        held = [self.live[t] for t in terms]
        upper = np.bincount(np.concatenate([b for b, _ in held]), np.concatenate([m for _, m in held]))
        return upper.max() >= least - _TOLERANCE

    def candidates(self, words: list[str], least: float) -> dict[int, float]:
        """Best score of each item that some passage of the document retrieves."""
        get, unknown = self.term.get, len(self.bound) - 1
        terms = np.array([get(w, unknown) for w in words], np.int64)
        if not len(terms):
            return {}
        reach = np.concatenate(([0.0], np.cumsum(self.bound[terms])))
        starts = np.arange(0, max(1, len(terms) - UNIT), UNIT)
        ends = np.minimum(starts + PASSAGE, len(terms))
        best: dict[int, float] = {}
        for k in np.flatnonzero(reach[ends] - reach[starts] >= least - _TOLERANCE).tolist():
            distinct = set(terms[starts[k] : ends[k]].tolist()) - {unknown}
            if not distinct or not self._alive(distinct, least):
                continue
            for unit, score in self.search(list(distinct), least).items():
                item = self.owner[unit]
                best[item] = max(score, best.get(item, 0.0))
        return best

    def matches(self, text: str | None, least: float, overlap: float) -> list[tuple]:
        """(item_id, score, overlap) of the verified items in a document."""
        words = words_of(text)
        found = self.candidates(words, least)
        if not found:
            return []
        mine, line, out = {}, None, []
        for item, score in sorted(found.items()):
            if item not in self.questions:
                question = words_of(self.items[item][1])
                size = min(SHINGLE, len(question))
                self.questions[item] = size, shingles(question, size)
                self.answers[item] = words_of(self.items[item][2])
            size, wanted = self.questions[item]
            if size not in mine:
                mine[size] = shingles(words, size)
            share = len(wanted & mine[size]) / len(wanted)
            if share < overlap:
                continue
            if self.answers[item]:
                line = line or f" {' '.join(words)} "
                if f" {' '.join(self.answers[item])} " not in line:
                    continue
            out.append((self.items[item][0], score, share))
        return out


def shard_indexes(benchmark: DataFrame, question: str, answer: str | None, shard_bytes: int):
    """Indexes of the shards, one at a time; each is bounded, their number grows with the items."""

    def unit_terms(batches):
        for batch in batches:
            terms, count = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                parts = max(1, -(-len(words) // UNIT))
                for k in range(parts):
                    part = set(words[k * len(words) // parts : (k + 1) * len(words) // parts])
                    terms += part
                    count += [0] * len(part)
                terms.append("")
                count.append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(count, pa.int64())], ["term", "words"])

    items = benchmark.select("item_id", F.col(question).alias("q"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a"))
    size = items.agg(F.sum(F.octet_length("q"))).first()[0]
    if not size:
        return
    shards = blocks(size, shard_bytes)
    terms = items.select("q").mapInArrow(unit_terms, "term string, words long")
    frequency = terms.where("term != ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total, words = (
        terms.where("term = ''").agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("words") / UNIT))), F.sum("words")).first()
    )
    for k in range(shards):
        mine = items.where(F.pmod(F.xxhash64("item_id", "q"), F.lit(shards)) == k)
        here = mine.select("q").mapInArrow(unit_terms, "term string, words long").where("term != ''").select("term").distinct()
        stats = {r.term: r.df for r in frequency.join(here, "term").toLocalIterator()}
        rows = sorted((tuple(r) for r in mine.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield Index(rows, stats, int(total), max(1.0, words / total))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, question: str = "text", answer: str | None = None,
    least: float = MIN_SCORE, overlap: float = MIN_OVERLAP, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, item_id, score, overlap) of every verified item in every document."""
    spark, found = docs.sparkSession, None
    schema = "doc_id long, item_id long, score double, overlap double"
    for index in shard_indexes(benchmark, question, answer, shard_bytes):
        sent = Shipped(spark, index)

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                rows = [
                    (doc_id, *m)
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for m in index.matches(text, least, overlap)
                ]
                columns = list(zip(*rows)) or [()] * 4
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "score", "overlap"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, question: str = "text", answer: str | None = None,
    least: float = MIN_SCORE, overlap: float = MIN_OVERLAP, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The documents without those that hold a verified item; no shuffle, all columns as they were."""
    return apart(docs, ["doc_id", "text"], lambda rows: _without_leaks(rows, benchmark, question, answer, least, overlap, shard_bytes))


def _without_leaks(docs: DataFrame, benchmark: DataFrame, question: str, answer: str | None, least: float, overlap: float, shard_bytes: int) -> DataFrame:
    kept = docs
    for index in shard_indexes(benchmark, question, answer, shard_bytes):
        sent = Shipped(docs.sparkSession, index)

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not index.matches(t, least, overlap) for t in texts], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


@query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
