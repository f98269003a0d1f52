"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two that differ in at most two bits share at least six of
them, so six (position, byte) pairs are the guaranteed minimum of shared matches. Lists of single bytes
would hold 1/256 of all fingerprints each, so a posting is filed under three positional bytes at once. Four
choices of three positions are enough: no two positions touch all four, hence a qualifying pair, which
misses two positions at most, agrees on one of them. Inside a list the shared positional bytes of
each pair are tallied, pairs below the minimum dropped and the rest verified by their differing bits. A
list of more than LONG_LIST fingerprints is split by three further positions, in each of the ten ways; such
a list holds at most 2^16 fingerprints whatever the input, and goes over the 2^16 values of its two free
bytes. A list returns a spanning star of each linked set, never its pairs.

Equal fingerprints are one node, so a group of copies costs one row whatever its size. Defined
results: null or blank text has fingerprint zero and links like any other; a null doc_id keeps its
fingerprint and takes its group's id; rows that repeat a doc_id are each returned; no rows give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from shortlist.cluster import salted_lookup
from shortlist.llm.common import apart, blocks, cut_lineage, ids_and_texts, read, starts_of
from shortlist.llm.components import connected_components
from shortlist.llm.pairs import cross_pairs
from shortlist.llm.registry import query

SHINGLE = 3
SEED = 42
MAX_BITS = 2
POSITIONS = list(combinations(range(8), 6))  # of split lists
TRIPLES = [(0, 1, 2), (0, 1, 3), (2, 3, 4), (5, 6, 7)]
CHOICES = POSITIONS + TRIPLES
LONG_LIST = 256
_STEP = 1 << 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the space-joined runs of `size` lower-cased words (fewer words: of the whole run)."""
    words = text.lower().split()  # bytes: lower-cases A-Z and splits at ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    run = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - run + 1].tolist(), ends[run - 1 :].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        block = hashes[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    if len(hashes) == 0:
        return 0
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; one pass over whole texts."""

    def run(batches):
        for batch in batches:
            ids, texts = ids_and_texts(batch)
            prints = np.array([fingerprint(shingle_hashes(t, size)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _masks() -> list[int]:
    masks = []
    for chosen in CHOICES:
        mask = sum(0xFF << (8 * p) for p in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _small_list(values: np.ndarray, max_bits: int) -> np.ndarray:
    """Root of each fingerprint of a list, by tallying shared bytes of its pairs."""
    differ = values[:, None] ^ values[None, :]
    shared = (differ.view(np.uint8).reshape(len(values), len(values), 8) == 0).sum(2)
    linked = (shared >= 8 - max_bits) & (np.bitwise_count(differ) <= max_bits)
    roots = np.arange(len(values))
    while True:
        lower = np.where(linked, roots[None, :], len(values)).min(1)
        if (lower == roots).all():
            return values[roots]
        roots = lower


def _long_list(values: np.ndarray, free: tuple[int, int], max_bits: int) -> np.ndarray:
    """The same over the 2^16 possible values of the two free bytes."""
    low, high = (np.uint64(8 * p) for p in free)
    slot = ((values >> low) & np.uint64(0xFF)) | (((values >> high) & np.uint64(0xFF)) << np.uint64(8))
    slot = slot.astype(np.int64)
    none = len(values)
    label = np.full(1 << 16, none)
    label[slot] = np.arange(none)
    flips = np.array([sum(1 << b for b in bits) for n in range(1, max_bits + 1) for bits in combinations(range(16), n)])
    while True:
        lower = label[slot]
        for flip in flips:
            lower = np.minimum(lower, label[slot ^ flip])
        if (lower == label[slot]).all():
            return values[lower]
        label[slot] = lower


def links_in_lists(choice: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) of the posting lists among the given (choice of positions, fingerprint)."""
    masks = np.array(_masks(), np.int64).view(np.uint64)
    prints = prints.view(np.uint64)
    key = prints & masks[choice]
    order = np.lexsort((prints, key, choice))
    choice, prints, key = choice[order], prints[order], key[order]
    fresh = np.ones(len(prints), bool)
    fresh[1:] = (choice[1:] != choice[:-1]) | (prints[1:] != prints[:-1])
    choice, prints, key = choice[fresh], prints[fresh], key[fresh]
    new = np.ones(len(prints), bool)
    new[1:] = (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(prints)))
    found = []
    for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        values = prints[at : at + size]
        if size <= LONG_LIST or choice[at] >= len(POSITIONS):
            roots = _small_list(values, max_bits)
        else:
            free = tuple(p for p in range(8) if p not in POSITIONS[choice[at]])
            roots = _long_list(values, free, max_bits)
        apart = roots != values
        found.append(np.stack((values[apart], roots[apart])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found, axis=1), axis=1).view(np.int64)
    return both[0], both[1]


def fingerprint_links(
    distinct: DataFrame, count: int, max_bits: int = MAX_BITS, per_block: int = 1_000_000, long_list: int = LONG_LIST
) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints (column fp) at `max_bits` (2 or fewer) bits."""
    if max_bits > 2:
        raise ValueError("six shared bytes are guaranteed up to two differing bits")
    masks = F.array(*[F.lit(m) for m in _masks()])
    first = len(POSITIONS)
    finer = [[k for k, six in enumerate(POSITIONS) if set(three) <= set(six)] for three in TRIPLES]

    def key(choice: str):
        return F.col("fp").bitwiseAND(F.get(masks, F.col(choice)))

    short = distinct.select("fp", F.explode(F.sequence(F.lit(first), F.lit(len(CHOICES) - 1))).alias("choice"))
    short = short.withColumn("key", key("choice"))
    sizes = short.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("size"))
    long = cut_lineage(sizes.where(F.col("size") > long_list))
    split = long.agg(F.sum("size")).first()[0] or 0
    marked = salted_lookup(short, long, ["choice", "key"], ["fp"], "left")
    split_to = F.get(F.array(*[F.array(*map(F.lit, f)) for f in finer]), F.col("choice") - first)
    filed = F.when(F.col("size").isNotNull(), split_to).otherwise(F.array("choice"))
    postings = marked.select("fp", F.explode(filed).alias("choice"))
    amount = count * len(TRIPLES) + split * len(finer[0])
    placed = postings.repartition(blocks(amount, per_block), F.xxhash64("choice", key("choice")))

    def run(batches):
        choice, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            prints.append(batch.column(0).to_numpy())
            choice.append(batch.column(1).to_numpy())
        a, b = links_in_lists(np.concatenate(choice), np.concatenate(prints), max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = cut_lineage(fingerprints(docs, size))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    nodes = cut_lineage(nodes)
    links = fingerprint_links(nodes.select("fp"), nodes.count(), max_bits)
    components = connected_components(links)
    linked = nodes.join(components, nodes["fp"] == components["node"])
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = linked.join(least, "component").select("fp", "component_id")
    shared = nodes.join(ids, "fp", "left").where(F.col("component_id").isNotNull() | (F.col("rows") > 1))
    # only fingerprints with company need a look-up, and one that many documents have is salted
    groups = cut_lineage(shared.select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return salted_lookup(prints, groups, ["fp"], ["doc_id"], "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


# ---- near-duplicate removal at a shingle similarity -------------------------------------------------
#
# At a similarity of 0.8 whole-text fingerprints differ in about ten bits, too many for shared bytes to
# be certain. Removal therefore also takes SimHashes of samples: sample i holds the `SAMPLE` shingles
# that hash least under seed i, so similar texts often have equal samples, and an equal fingerprint means
# all eight positional bytes shared. What meets in any posting is verified by its shingles.

SAMPLES = 12
SAMPLE = 3
NEAR_SHINGLE = 5
SIMILARITY = 0.8
ALL_PAIRS = 24  # a posting list up to this length yields all its pairs (a bounded number per text)
# (samples, shingles in each) for texts of longer lists that are not yet one group. Larger samples split
# such lists; their number keeps the chance that a pair at 0.8 has none in common under 1 in 1,000. Lists still
# long at the last level are finished exactly.
DEEPER = [(32, 6), (120, 12)]

_ODD = np.random.default_rng(64).integers(1, 1 << 63, DEEPER[-1][0], dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sample_fingerprints(hashes: np.ndarray, samples: int = SAMPLES, sample: int = SAMPLE) -> list[int]:
    out = []
    for odd in _ODD[:samples]:
        mixed = hashes * odd
        mixed ^= mixed >> np.uint64(31)
        if len(mixed) > sample:
            mixed = np.partition(mixed, sample - 1)[:sample]
        out.append(int(np.array(fingerprint(mixed), np.uint64).view(np.int64)))
    return out


def _text_hash():
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text, F.octet_length(text))


def _prints(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            _, texts = ids_and_texts(batch)
            whole, samples, counts = [], [], []
            for t in texts:
                hashes = np.unique(shingle_hashes(t, size))
                counts.append(len(hashes))
                whole.append(fingerprint(hashes))
                samples.append(sample_fingerprints(hashes) if len(hashes) else [0] * SAMPLES)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(np.array(whole, np.uint64).view(np.int64)),
                    pa.array(samples, pa.list_(pa.int64())), pa.array(counts, pa.int64()),
                ],
                ["doc_id", "th", "fp", "samples", "n"],
            )

    keyed = docs.select(F.col("doc_id").cast("long"), "text", _text_hash().alias("th"))
    return keyed.mapInArrow(run, "doc_id long, th long, fp long, samples array<long>, n long")


def _shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(th, shingles) with 32-bit shingle hashes of each text."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or b"", size).astype(np.uint32)).view(np.int32) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["th", "shingles"])

    return texts.mapInArrow(run, "th long, shingles array<int>")


def _postings(drawn: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(key, th, c) of the lists each text (th, keys) is in, c being its group so far. The group is looked
    up before the keys are opened, so that look-up moves texts and not postings."""
    if groups is None:
        return drawn.select(F.explode("keys").alias("key"), "th", F.col("th").alias("c"))
    placed = drawn.join(groups, drawn["th"] == groups["node"], "left")
    return placed.select(F.explode("keys").alias("key"), "th", F.coalesce("component", "th").alias("c"))


def _open_lists(postings: DataFrame) -> DataFrame:
    """(key, k, first) of the lists whose texts are not yet one group: their length and first text."""
    lists = postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct("th", "c")).alias("first"), F.min("c").alias("low"), F.max("c").alias("high")
    )
    return lists.where("low < high").select("key", "k", "first")


def _list_pairs(postings: DataFrame) -> DataFrame:
    """(a, b) of different groups from posting lists (key, th, c): all such pairs of short lists; of long
    ones the first with each. Long lists are never gathered. Lists keyed by two samples split what one
    sample leaves long, and larger samples what is then not yet one group."""
    lists = _open_lists(postings)
    lists = lists.select("key", "k", F.col("first.th").alias("first"), F.col("first.c").alias("of"))
    short = postings.join(lists.where(F.col("k") <= ALL_PAIRS).select("key"), "key")
    held = short.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("th", "c"))).alias("m"))
    rest = F.filter(F.slice("m", F.col("i") + 2, ALL_PAIRS), lambda x: x["c"] != F.col("one.c"))
    each = held.select(F.posexplode("m").alias("i", "one"), "m").select(F.col("one.th").alias("a"), F.explode(rest["th"]).alias("b"))
    long = postings.join(lists.where(F.col("k") > ALL_PAIRS).drop("k"), "key").where(F.col("c") != F.col("of"))
    return each.unionByName(long.select(F.col("first").alias("a"), F.col("th").alias("b")))


def _open_texts(postings: DataFrame) -> DataFrame:
    """(th) of the texts in long lists that are not yet one group."""
    long = _open_lists(postings).where(F.col("k") > ALL_PAIRS).select("key")
    return postings.join(long, "key").select("th").distinct()


def _deeper_lists(sets: DataFrame, samples: int, sample: int) -> DataFrame:
    """(th, keys) of larger samples of the given shingle sets."""

    def run(batches):
        for batch in batches:
            rows = [np.array(s.as_py(), np.int32).view(np.uint32).astype(np.uint64) for s in batch.column(1)]
            found = [sample_fingerprints(r, samples, sample) if len(r) else [0] * samples for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["th", "samples"])

    drawn = sets.select("th", "shingles").mapInArrow(run, "th long, samples array<long>")
    return drawn.select("th", F.transform("samples", lambda s, i: F.xxhash64(F.lit(sample), i, s)).alias("keys"))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity."""
    both = (
        pairs.join(sets.select(F.col("th").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(sets.select(F.col("th").alias("a"), F.col("shingles").alias("sa")), "a")
    )
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _prefixes(sets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(key, th, label, n, at) of each text's rarest shingles, one more than two similar texts can differ in; n is
    the text's number of shingles, `at` the place of this one among them.

    Shingles are ordered by their texts among the given ones, then by hash, so of two texts at the similarity
    or more the prefixes have a shingle in common.
    """
    held = cut_lineage(sets.select("th", F.size("shingles").alias("n"), F.explode("shingles").alias("key")))
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    ordered = held.join(counts, "key").groupBy("th", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "key"))).alias("m"))
    length = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int")
    rare = ordered.select("th", "n", F.slice("m", F.lit(1), length).alias("m"))
    placed = rare.join(groups, rare["th"] == groups["node"], "left")
    return placed.select(F.posexplode("m.key").alias("at", "key"), "th", F.coalesce("component", "th").alias("label"), "n")


def drop_near_duplicates(docs: DataFrame, size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without all but one (the smallest doc_id, null last) of each group of near copies.

    Groups are the connected texts at a Jaccard similarity of `similarity` or more of their word
    shingles. Equal texts are one node. Null and empty texts are one group. Of rows that repeat a
    document one stays. All columns as they were.
    """
    return apart(docs, ["doc_id", "text"], lambda rows: _without_near(rows, size, similarity))


def _without_near(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    prints = cut_lineage(_prints(docs, size))
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    nodes = cut_lineage(
        prints.groupBy("th").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("samples").alias("samples"), F.first("n").alias("n"))
    )
    distinct = nodes.select("fp").distinct()
    links = fingerprint_links(distinct, nodes.count())
    roots = connected_components(links)
    whole = F.array(F.xxhash64(F.lit(-1), F.coalesce("component", "fp")))
    single = F.transform("samples", lambda s, i: F.xxhash64(i, s))
    double = F.transform("samples", lambda s, i: F.xxhash64(i, s, F.get("samples", (i + 1) % SAMPLES)))
    drawn = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("th", F.concat(whole, single, double).alias("keys"))
    drawn = cut_lineage(drawn)
    pairs = cut_lineage(_list_pairs(_postings(drawn, None)).distinct())
    wanted = pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))).distinct()
    firsts = nodes.join(wanted, "th").select("th", F.col("first.doc_id").alias("_id"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("th"))
    texts = keyed.join(firsts, "th").where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("th", "text")
    sets = cut_lineage(_shingle_sets(texts, size).groupBy("th").agg(F.first("shingles").alias("shingles")))
    alike = cut_lineage(_alike(pairs, sets, similarity))
    groups = cut_lineage(connected_components(alike))
    for samples, sample in DEEPER:
        left_open = cut_lineage(_open_texts(_postings(drawn, groups)))
        if left_open.isEmpty():
            break
        drawn = cut_lineage(_deeper_lists(sets.join(left_open, "th"), samples, sample))
        fresh = _list_pairs(_postings(drawn, groups)).distinct()
        fresh = cut_lineage(fresh.join(pairs, ["a", "b"], "left_anti"))
        pairs = pairs.unionByName(fresh)
        alike = cut_lineage(alike.unionByName(_alike(fresh, sets, similarity)))
        groups = cut_lineage(connected_components(alike))
    # what is in a long list of the last level and not one group is compared by rarest shingles, whole lists
    left_open = cut_lineage(_open_texts(_postings(drawn, groups)))
    if not left_open.isEmpty():
        rare = cut_lineage(_prefixes(sets.join(left_open, "th"), groups, similarity))
        pairs = cut_lineage(pairs)
        for batch in cross_pairs(rare, similarity=similarity):
            fresh = cut_lineage(batch.join(pairs, ["a", "b"], "left_anti"))
            alike = cut_lineage(alike.unionByName(_alike(fresh, sets, similarity)))
        groups = cut_lineage(connected_components(alike))
    members = nodes.join(groups, nodes["th"] == groups["node"]).select("th", "first", "component")
    best = members.groupBy("component").agg(F.min(F.struct("first", "th")).alias("best"))
    losers = members.join(best, "component").where(F.col("th") != F.col("best.th")).select("th")
    keepers = nodes.join(losers, "th", "left_anti").select(F.col("th").alias("_th"), F.col("first.doc_id").alias("_id"))
    repeated = prints.groupBy("th", "doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    keepers = keepers.join(repeated, (F.col("_th") == F.col("th")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("_th", "_id", "_rows")
    out = docs.withColumn("_key", _text_hash()).join(
        keepers, (F.col("_key") == F.col("_th")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    )
    once = out.where("_rows = 1").select(*docs.columns)
    twice = out.where("_rows > 1").dropDuplicates(["_th", "_id"]).select(*docs.columns)
    return once.unionByName(twice)
