"""Removal of byte strings that repeat across documents, by threshold-bounded interval expansion.

A byte goes if a string of `WIDTH` bytes that covers it also starts in a document with a smaller
doc_id. The work runs in content blocks, so that no index of the whole corpus is needed:

1. Documents are dealt into chunks by hash. In every window of `WIDTH` bytes the 24-byte seed with the
   least hash is chosen, which depends on the window's bytes alone. Chunks send each distinct seed (32
   bits within its bucket) once, and learn which seeds occur in more than one document.
2. Runs of windows around a shared seed, deduplicated per chunk with their smallest document, go to the
   seed's block. Windows of a seed in very many documents go on their own instead, by their own hash,
   so that a passage in a third of all documents spreads.
3. A block forms the Burrows-Wheeler transform of the strings whose seed has several and expands intervals breadth-first by
   backward extension: level n yields every common prefix of length n between neighbours, and the
   expansion ends at `WIDTH`. Suffixes with no shorter common prefix between them share a window;
   the smallest document of each such class goes back to the chunks that asked.
4. Chunks mark the covered bytes.

A mistaken match of a seed's 32 bits only costs work: blocks compare whole strings. All steps are one
lazy plan in which the texts are shuffled once, so a lost executor costs its own tasks.

Defined results: null text is empty; a null doc_id counts as the largest; rows with one doc_id do not
remove each other's bytes; rows repeated whole get the same result each; no rows give no rows; texts
shorter than the width stay whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shortlist.llm.common import apart, blocks, ranges, read, text_bytes
from shortlist.llm.registry import query

WIDTH = 50
SEED_BYTES = 24  # a multiple of 8; longer seeds meet by chance less often
CHUNK_BYTES = 8 << 20
SEED_BLOCK = 8 << 20  # text bytes per bucket of seeds
STRING_BLOCK = 4 << 20  # text bytes per bucket of strings
INDEX_BYTES = 2 << 20  # of strings in one Burrows-Wheeler transform
WIDE_DOCS = 1 << 15  # documents of one seed beyond which its windows travel alone
MOST_PARTITIONS = 20_000  # shuffle partitions; buckets beyond them share tasks

_STEP = 1 << 19
_LAST = np.iinfo(np.int64).max
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _M[3]
    return x ^ (x >> np.uint64(29))


def _seed_hash(words: np.ndarray, at) -> np.ndarray:
    """Hash of the seeds that begin at the given places: positions, or the first so many."""

    def word(k: int) -> np.ndarray:
        return words[k : k + at] if isinstance(at, int) else words[at + k]

    first = word(0)
    hashed = _mix(first * _M[0] + (word(8) ^ (first >> np.uint64(31))) * _M[1])
    for k in range(16, SEED_BYTES, 8):
        hashed = _mix((hashed ^ word(k)) * _M[2])
    return hashed


class Chunk:
    """The texts of a chunk end to end, with the window runs of each seed."""

    def __init__(self, ids: list, texts: list[bytes], width: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.order, self.width = order, width
        self.docs = np.array([_LAST if ids[i] is None else ids[i] for i in order], np.int64)
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.size = int(lengths.sum())
        self.data = np.frombuffer(b"".join([texts[i] for i in order]) + bytes(width + 40), np.uint8)
        self._runs()

    def _runs(self) -> None:
        width, data = self.width, self.data
        edge = np.zeros(self.size + 1, np.int32)
        long = self.ends - self.starts >= width
        np.add.at(edge, self.starts[long], 1)
        np.add.at(edge, self.ends[long] - width + 1, -1)
        valid = np.cumsum(edge[:-1]) > 0
        span = width - SEED_BYTES + 1
        first, count, seed = [], [], []
        for a in range(0, self.size, _STEP):
            b = min(a + _STEP, self.size)
            part = _words_at(data[a : b + width + 7])
            n = b - a + span - 1
            hashed = _seed_hash(part, n)
            least = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
            wide = 1
            while 2 * wide <= span:
                least = np.minimum(least[:-wide], least[wide:])
                wide *= 2
            if wide < span:
                least = np.minimum(least[: b - a], least[span - wide : span - wide + b - a])
            at = least[: b - a].astype(np.uint32)
            ok = valid[a:b]
            same = np.zeros(b - a, bool)
            same[1:] = ok[1:] & ok[:-1] & (at[1:] == at[:-1])
            begin = np.flatnonzero(ok & ~same)
            last = np.ones(b - a, bool)
            last[:-1] = ~same[1:]
            end = np.flatnonzero(ok & last)
            first.append(begin + a)
            count.append(end - begin + 1)
            seed.append(at[begin].astype(np.int64) + a)
        self.first = np.concatenate(first) if first else np.zeros(0, np.int64)
        self.count = np.concatenate(count) if count else np.zeros(0, np.int64)
        at = np.concatenate(seed) if seed else np.zeros(0, np.int64)
        self.seed = _mix(_seed_hash(_words_at(data), at) ^ _M[4])
        self.doc = np.searchsorted(self.ends, self.first, "right")

    def seeds(self, buckets: int):
        """Distinct seeds ordered by (bucket, tag): (bucket, tag, documents, position of each run's seed)."""
        unique, inverse = np.unique(self.seed, return_inverse=True)
        bucket, tag = (unique % np.uint64(buckets)).astype(np.int64), (unique >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((unique, tag, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[inverse]
        pairs = np.unique(at * np.int64(len(self.docs) + 1) + self.doc) // (len(self.docs) + 1)
        return bucket[order], tag[order], np.bincount(pairs, minlength=len(order)), at

    def strings(self, at: np.ndarray, shared: np.ndarray, wide: np.ndarray, buckets: int):
        """Distinct strings to compare, ordered by (bucket, hash), and the occurrences behind them."""
        chosen = np.flatnonzero(shared[at])
        alone = wide[at[chosen]]
        plain, single = chosen[~alone], chosen[alone]
        start = np.concatenate((self.first[plain], ranges(self.first[single], self.count[single])))
        windows = np.concatenate((self.count[plain], np.ones(int(self.count[single].sum()), np.int64)))
        doc = np.concatenate((self.doc[plain], np.repeat(self.doc[single], self.count[single])))
        size = windows + self.width - 1
        one, two = self._content(start, size)
        route = np.concatenate((self.seed[plain], one[len(plain) :]))
        bucket = ((route ^ _M[2]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((two, one, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        head = order[new]
        least = np.minimum.reduceat(self.docs[doc[order]], np.flatnonzero(new)) if len(order) else self.docs[:0]
        return {
            "start": start[head], "size": size[head], "bucket": bucket[head], "least": least, "tag": (route[head] >> np.uint64(32)).astype(np.uint32),
            "at": start, "windows": windows, "doc": doc, "number": number,
        }

    def _content(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each string's bytes and length."""
        words = _words_at(self.data)
        one, two = size.astype(np.uint64) * _M[0], size.astype(np.uint64) * _M[1]
        for k in range(0, int(size.max(initial=0)), 8):
            left = size - k
            live = np.flatnonzero(left > 0)
            word = words[start[live] + k]
            short = np.minimum(left[live], 8).astype(np.uint64)
            word = word & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))
            one[live] = _mix((one[live] ^ word) * _M[2] + np.uint64(k + 1))
            two[live] = _mix((two[live] + word) * _M[4] ^ np.uint64(k + 7))
        return one, two

    def cover(self, start: np.ndarray) -> np.ndarray:
        """Which bytes lie in a window that begins at one of the given places."""
        edge = np.zeros(self.size + self.width + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.width, -1)
        return np.cumsum(edge[: self.size]) > 0


def bwt_classes(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of `text` and, in that order, the class of suffixes that agree on `width` bytes.

    The text must not hold byte 255 except as the end of each string. Suffixes are only ordered as
    deep as needed; interval borders are counts, so they are exact under any order beyond that depth.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    key = _words_at(padded)[:n].byteswap()
    depth = 8
    while True:
        order = np.argsort(key, kind="stable" if depth > width else None)
        ordered = key[order]
        step = np.concatenate(([False], ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(step).astype(np.uint64) + np.uint64(1)
        if depth >= width:
            break
        # as many ranks as a 64-bit key holds: three for up to 2.6 million bytes, which saves a sort
        ranks = 3 if (n + 2) ** 3 < 1 << 64 else 2
        key = rank
        for k in range(1, ranks):
            later = np.zeros(n, np.uint64)
            later[: max(0, n - k * depth)] = rank[k * depth :]
            key = key * np.uint64(n + 2) + later
        depth *= ranks
    order = order.astype(np.int32)
    before = text[order - 1]  # the transform; position 0 wraps to the last end mark
    heads = text[order]
    back = np.empty(n, np.int32)  # where the suffix one byte longer stands
    back[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    common = np.full(n + 1, 255, np.uint8)
    common[0] = common[n] = 0
    low, high = np.array([0]), np.array([n])
    source = np.empty(n, np.int32)
    for level in range(width):
        if len(low) == 0:
            break
        size = high - low
        inside = ranges(low, size)
        to = back[inside]
        source[to] = np.repeat(np.arange(len(low), dtype=np.int32), size)
        to.sort()
        owner, head = source[to], heads[to]
        cut = np.flatnonzero((to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (head[1:] != head[:-1])) + 1
        low = to[np.concatenate(([0], cut))].astype(np.int64)
        high = to[np.concatenate((cut - 1, [len(to) - 1]))].astype(np.int64) + 1
        fresh = (common[high] == 255) & (heads[low] != 255)
        marks = high[common[high] == 255]
        common[marks] = level
        low, high = low[fresh], high[fresh]
    return order, np.cumsum(common[:n] != 255) - 1


def least_documents(strings: list[bytes], documents: np.ndarray, width: int) -> list[np.ndarray]:
    """For each window of each string, the smallest document of any string that holds it."""
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    order, group = bwt_classes(text, width)
    value = np.full(len(text), _LAST)
    counts = sizes - width + 1
    window_at = ranges(starts, counts)
    value[window_at] = np.repeat(documents, counts)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(value[order], begin)
    result = np.empty(len(text), np.int64)
    result[order] = least[group]
    return np.split(result[window_at], np.cumsum(counts)[:-1])


def _answer_strings(strings: list[bytes], seeds: np.ndarray, documents: np.ndarray, width: int) -> list[np.ndarray]:
    """`least_documents`, with only those strings in the transform whose seed has another string too. Equal
    windows have equal seeds, so the windows of a seed's only string, as exact copies leave it, occur
    nowhere else in the block."""
    _, group, held = np.unique(seeds, return_inverse=True, return_counts=True)
    several = held[group] > 1
    at = np.flatnonzero(several)
    compared = iter(least_documents([strings[i] for i in at.tolist()], documents[at], width) if len(at) else [])
    return [
        next(compared) if shared else np.full(len(s) - width + 1, d)
        for s, d, shared in zip(strings, documents, several.tolist())
    ]


def _answer_block(entries: list[tuple]) -> list[tuple]:
    """Answers of one block: entries are (chunk, sizes, bytes, least, tags), answers (chunk, runs, lengths, documents)."""
    where, sizes, documents, tags, pieces = [], [], [], [], []
    for number, (_, size, data, least, tag, _) in enumerate(entries):
        size = np.frombuffer(size, np.uint8).astype(np.int64)
        ends = np.cumsum(size)
        pieces += [data[b - s : b] for b, s in zip(ends.tolist(), size.tolist())]
        where.append(np.full(len(size), number))
        sizes.append(size)
        documents.append(np.frombuffer(least, "<i8"))
        tags.append(np.frombuffer(tag, "<u4"))
    where, sizes = np.concatenate(where), np.concatenate(sizes)
    documents, tags = np.concatenate(documents), np.concatenate(tags)
    width = entries[0][5]
    shares = blocks(int(sizes.sum()), INDEX_BYTES)
    share = tags % np.uint32(shares)
    found: list = [None] * len(pieces)
    for k in range(shares):
        mine = np.flatnonzero(share == k).tolist()
        number: dict[bytes, int] = {}
        local = [number.setdefault(pieces[i], len(number)) for i in mine]
        if not mine:
            continue
        least = np.full(len(number), _LAST)
        np.minimum.at(least, local, documents[mine])
        seed = np.empty(len(number), np.int64)
        seed[local] = tags[mine]
        answers = _answer_strings(list(number), seed, least, width)
        for i, j in zip(mine, local):
            found[i] = answers[j]
    out = []
    for n, (chunk, *_) in enumerate(entries):
        flat = [found[i] for i in np.flatnonzero(where == n).tolist()]
        counts = np.array([len(x) for x in flat], np.int64)
        values = np.concatenate(flat)
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        new[np.cumsum(counts)[:-1]] = True
        at = np.flatnonzero(new)
        string_of = np.repeat(np.arange(len(flat)), counts)[at]
        lengths = np.diff(np.append(at, len(values)))
        out.append((chunk, np.bincount(string_of, minlength=len(flat)), lengths, values[at]))
    return out


_MESSAGE = "bucket long, chunk long, a binary, b binary, c binary, d binary"
_NAMES = ["bucket", "chunk", "a", "b", "c", "d"]


def _message(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 6
    kinds = [pa.int64()] * 2 + [pa.binary()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)


def _slices(bucket: np.ndarray):
    """(bucket, from, to) of each value of a sorted array."""
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    return zip(bucket[starts].tolist(), starts, [*starts[1:], len(bucket)]) if len(bucket) else []


class Removal:
    """The plan over one table of documents."""

    def __init__(self, docs: DataFrame, width: int, chunk_bytes: int, wide_docs: int):
        if width < SEED_BYTES + 8:
            raise ValueError(f"the width must be {SEED_BYTES + 8} bytes or more")
        size = text_bytes(docs)[1]
        self.width, self.wide_docs = width, wide_docs
        self.seed_buckets = blocks(size, min(SEED_BLOCK, chunk_bytes))
        self.string_buckets = blocks(size, min(STRING_BLOCK, chunk_bytes))
        chunks = blocks(size, chunk_bytes)
        deal = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))), F.lit(chunks))
        self.columns = docs.columns
        self.docs = docs.withColumn("_chunk", deal).repartition(min(chunks, MOST_PARTITIONS), "_chunk")

    def chunk(self, table: pa.Table) -> Chunk:
        ids = table.column("doc_id").cast(pa.int64()).to_pylist()
        texts = [b"" if t is None else t for t in table.column("text").cast(pa.binary()).to_pylist()]
        return Chunk(ids, texts, self.width)

    def _seen(self, chunk: Chunk, rows: pa.Table):
        """Shared and very frequent seeds of a chunk, from what came back."""
        bucket, _, _, at = chunk.seeds(self.seed_buckets)
        shared, wide = np.zeros(len(bucket), bool), np.zeros(len(bucket), bool)
        masks = {r["bucket"]: r for r in rows.select(["bucket", "a", "b"]).to_pylist() if r["bucket"] < 0}
        for k, a, b in _slices(bucket):
            row = masks.get(-1 - k)
            if row is not None:
                shared[a:b] = np.unpackbits(np.frombuffer(row["a"], np.uint8), count=b - a)
                wide[a:b] = np.unpackbits(np.frombuffer(row["b"], np.uint8), count=b - a)
        return at, shared, wide

    def ask_seeds(self) -> DataFrame:
        me = self._worker()

        def run(table: pa.Table) -> pa.Table:
            bucket, tag, documents, _ = me.chunk(table).seeds(me.seed_buckets)
            where = table.column("_chunk")[0].as_py()
            rows = []
            for k, a, b in _slices(bucket):
                several = np.flatnonzero(documents[a:b] > 1)
                rows.append((k, where, tag[a:b].astype("<u4").tobytes(), several.astype("<u4").tobytes(), documents[a:b][several].astype("<u4").tobytes(), b""))
            return _message(rows)

        return self.docs.select("_chunk", "doc_id", "text").groupBy("_chunk").applyInArrow(run, _MESSAGE)

    def answer_seeds(self, asked: DataFrame) -> DataFrame:
        me = self._worker()

        def answer(bucket: int, rows: list[dict]) -> list[tuple]:
            tags = [np.frombuffer(r["a"], "<u4") for r in rows]
            counts = []
            for r, tag in zip(rows, tags):
                count = np.ones(len(tag), np.int64)
                count[np.frombuffer(r["b"], "<u4")] = np.frombuffer(r["c"], "<u4")
                counts.append(count)
            _, inverse = np.unique(np.concatenate(tags), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate(counts))[inverse]
            out, at = [], 0
            for r, tag in zip(rows, tags):
                mine = total[at : at + len(tag)]
                at += len(tag)
                if (mine > 1).any():
                    out.append((-1 - bucket, r["chunk"], np.packbits(mine > 1).tobytes(), np.packbits(mine > me.wide_docs).tobytes(), b"", b""))
            return out

        def run(batches):
            held: dict[int, list] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    held.setdefault(row["bucket"], []).append(row)
            for bucket in list(held):
                yield from _message(answer(bucket, held.pop(bucket))).to_batches()

        return asked.repartition(min(self.seed_buckets, MOST_PARTITIONS), "bucket").mapInArrow(run, _MESSAGE)

    def ask_strings(self, seen: DataFrame) -> DataFrame:
        me = self._worker()

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows == 0 or right.num_rows == 0:
                return _message([])
            chunk = me.chunk(left)
            where = left.column("_chunk")[0].as_py()
            found = chunk.strings(*me._seen(chunk, right), me.string_buckets)
            rows = [tuple(r[n] for n in _NAMES) for r in right.to_pylist()]
            whole = chunk.data.tobytes()
            ends = found["start"] + found["size"]
            for k, a, b in _slices(found["bucket"]):
                data = b"".join([whole[s:e] for s, e in zip(found["start"][a:b].tolist(), ends[a:b].tolist())])
                rows.append((k, where, found["size"][a:b].astype(np.uint8).tobytes(), data, found["least"][a:b].astype("<i8").tobytes(), found["tag"][a:b].astype("<u4").tobytes()))
            return _message(rows)

        return self._texts().cogroup(seen.groupBy("chunk")).applyInArrow(run, _MESSAGE)

    def answer_strings(self, asked: DataFrame) -> DataFrame:
        me = self._worker()

        def run(batches):
            held: dict[int, list] = {}
            for batch in batches:
                through = []
                for row in batch.to_pylist():
                    if row["bucket"] < 0:
                        through.append(tuple(row[n] for n in _NAMES))
                    else:
                        held.setdefault(row["bucket"], []).append((row["chunk"], row["a"], row["b"], row["c"], row["d"], me.width))
                yield from _message(through).to_batches()
            for bucket in list(held):
                answers = _answer_block(held.pop(bucket))
                yield from _message(
                    [(bucket, chunk, runs.astype(np.uint8).tobytes(), lengths.astype(np.uint8).tobytes(), least.astype("<i8").tobytes(), b"") for chunk, runs, lengths, least in answers]
                ).to_batches()

        return asked.repartition(min(self.string_buckets, MOST_PARTITIONS), "bucket").mapInArrow(run, _MESSAGE)

    def covered(self, chunk: Chunk, rows: pa.Table) -> np.ndarray:
        """Which bytes of the chunk go."""
        if rows.num_rows == 0:
            return np.zeros(chunk.size, bool)
        found = chunk.strings(*self._seen(chunk, rows), self.string_buckets)
        answers = {r["bucket"]: r for r in rows.to_pylist() if r["bucket"] >= 0}
        windows = found["size"] - self.width + 1
        least = np.full(int(windows.sum()), _LAST)
        first = np.cumsum(windows) - windows
        for k, a, b in _slices(found["bucket"]):
            row = answers[k]
            lengths = np.frombuffer(row["b"], np.uint8).astype(np.int64)
            least[first[a] : first[a] + windows[a:b].sum()] = np.repeat(np.frombuffer(row["c"], "<i8"), lengths)
        window = ranges(first[found["number"]], found["windows"])
        place = ranges(found["at"], found["windows"])
        return chunk.cover(place[least[window] < np.repeat(chunk.docs[found["doc"]], found["windows"])])

    def _texts(self):
        return self.docs.select("_chunk", "doc_id", "text").groupBy("_chunk")

    def _worker(self) -> "Removal":
        """What tasks need, without the tables."""
        light = object.__new__(Removal)
        light.width, light.wide_docs, light.columns = self.width, self.wide_docs, self.columns
        light.seed_buckets, light.string_buckets = self.seed_buckets, self.string_buckets
        return light

    def answers(self) -> DataFrame:
        return self.answer_strings(self.ask_strings(self.answer_seeds(self.ask_seeds())))


def removal_report(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES, wide_docs: int = WIDE_DOCS) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, and SHA-256 of the bytes kept."""
    plan = Removal(docs.select("doc_id", "text"), width, chunk_bytes, wide_docs)
    me = plan._worker()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        if left.num_rows:
            chunk = me.chunk(left)
            gone = me.covered(chunk, right)
            ids = left.column("doc_id").to_pylist()
            for i, a, b in zip(chunk.order, chunk.starts.tolist(), chunk.ends.tolist()):
                mine = gone[a:b]
                removed = int(np.count_nonzero(mine))
                kept = chunk.data[a:b] if not removed else chunk.data[a:b][~mine]
                runs = int(np.count_nonzero(mine[1:] & ~mine[:-1])) + int(mine[0]) if removed else 0
                for column, value in zip(columns, (ids[i], b - a, removed, runs, hashlib.sha256(kept.tobytes()).hexdigest())):
                    column.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return plan._texts().cogroup(plan.answers().groupBy("chunk")).applyInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES, wide_docs: int = WIDE_DOCS) -> DataFrame:
    """The documents with repeated bytes taken out of their texts, all other columns as they were.

    A character that loses some of its bytes goes whole. n_chars, if there, counts what is left.
    """
    return apart(docs, ["doc_id", "text", "n_chars"], lambda rows: _without_repeats(rows, width, chunk_bytes, wide_docs))


def _without_repeats(docs: DataFrame, width: int, chunk_bytes: int, wide_docs: int) -> DataFrame:
    plan = Removal(docs, width, chunk_bytes, wide_docs)
    me = plan._worker()
    schema = docs.schema

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return left.drop_columns(["_chunk"])
        chunk = me.chunk(left)
        gone = me.covered(chunk, right)
        texts = left.column("text").to_pylist()
        sizes = left.column("n_chars").to_pylist() if "n_chars" in me.columns else None
        for i, a, b in zip(chunk.order, chunk.starts.tolist(), chunk.ends.tolist()):
            if gone[a:b].any():
                texts[i] = chunk.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore")
                if sizes is not None:
                    sizes[i] = len(texts[i])
        out = left.drop_columns(["_chunk"])
        out = out.set_column(out.schema.get_field_index("text"), out.schema.field("text"), pa.array(texts, out.schema.field("text").type))
        if sizes is not None:
            field = out.schema.field("n_chars")
            out = out.set_column(out.schema.get_field_index("n_chars"), field, pa.array(sizes, field.type))
        return out.select(me.columns)

    return plan.docs.groupBy("_chunk").cogroup(plan.answers().groupBy("chunk")).applyInArrow(run, schema)


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    return removal_report(read(spark, sf_dir, "documents"))
