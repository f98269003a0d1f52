"""SimHash: against brute force, and the defined edge cases."""

import random

import numpy as np
import pytest
import xxhash

from shortlist.llm import simhash


def brute(rows):
    prints = {}
    for i, (doc_id, text) in enumerate(rows):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in prints:
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), f"{prints[i]:016x}", str(least.get(find(i)))) for i in prints)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        rows.append((3 * k + 7, " ".join(words)))
        if k % 3 == 0:
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((3 * k + 1000, "\n".join(copy).upper()))
    rows += [(5, None), (6, ""), (4, " \t\x0b"), (9, "Été É"), (9, "Été É"), (11, "x " * 70000), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "2 as component_id")
    mine = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(frame).collect())
    assert mine == brute(rows)


@pytest.mark.parametrize("size", [40, 700])
def test_lists_short_and_long(size):
    rng = np.random.default_rng(size)
    base = np.uint64(0x0123456789ABCDEF)
    values = {int(base)}
    while len(values) < size:
        flips = rng.integers(0, 16, rng.integers(1, 9))
        values.add(int(base) ^ int(np.bitwise_xor.reduce(1 << flips.astype(np.int64))))
    prints = np.array(sorted(values), np.uint64)
    choice = np.full(size, simhash.POSITIONS.index((2, 3, 4, 5, 6, 7)))
    a, b = simhash.links_in_lists(choice, prints.view(np.int64), 2)
    root = {int(p): int(p) for p in prints}
    for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist()):
        root[x] = y
    assert all(root[y] == y for y in root.values())
    whole = {int(p): int(p) for p in prints}
    changed = True
    while changed:
        changed = False
        for x in whole:
            for y in whole:
                if bin(x ^ y).count("1") <= 2 and whole[y] < whole[x]:
                    whole[x], changed = whole[y], True
    assert root == whole


def test_any_two_positions_leave_one_choice_of_three():
    for x in range(8):
        for y in range(8):
            assert any(x not in three and y not in three for three in simhash.TRIPLES)


@pytest.mark.parametrize("long_list", [1, 8, 256])
def test_links_equal_brute_force_whether_lists_are_split_or_not(spark, long_list):
    """A family around one base, pairs at one to three bits in any two bytes, and pairs that share five bytes."""
    rng = random.Random(long_list)
    values = set()
    for _ in range(120):
        base = rng.getrandbits(64)
        values.add(base)
        for bits in (1, 2, 3):
            values.add(base ^ sum(1 << b for b in rng.sample(range(64), bits)))
        values.add(base ^ sum(1 << (8 * p) for p in rng.sample(range(8), 3)))
    base = rng.getrandbits(64)
    values |= {base ^ sum(1 << b for b in rng.sample(range(16), rng.randrange(1, 9))) for _ in range(80)}
    values |= {0, (1 << 64) - 1, 1 << 63}
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), len(values), long_list=long_list)
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links.collect()]
    assert all(a in values and b in values for a, b in got)

    def classes(pairs):
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(v) for v in values]

    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2]
    assert classes(got) == classes(near)


def test_tally_drops_pairs_below_the_minimum():
    """Three shared bytes file two fingerprints together; the tally of shared bytes must part them."""
    values = np.array([0, 1 << 24, 0x0101010101 << 24, 3 << 40, 7 << 40], np.uint64)
    roots = simhash._small_list(values, 2)
    assert roots.tolist() == [0, 0, 0x0101010101 << 24, 0, 0]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_copies_inside_a_large_template_group(spark):
    """Every text shares six sevenths of its words, so sample lists are long; only planted pairs are near copies."""
    rng = random.Random(8)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(240):
        own = [f"u{k}x{j}" for j in range(20)]
        rows.append((10 * k, " ".join(base + own)))
        if k % 3 == 0:
            copy = base + own
            for place in (10 + rng.randrange(20), 50 + rng.randrange(20), 90 + rng.randrange(20)):
                copy[place] = f"c{k}x{place}"
            rows.append((10 * k + 1, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}

    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = {d: shingles(t) for d, t in rows}
    near = {d: {e for e in sets if e < d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])} for d in sets}
    assert kept == {d for d in sets if not near[d]} == {10 * k for k in range(240)}


def test_near_copies_in_a_family_just_below_the_similarity(spark):
    """500 texts at 0.784 with each other; 60 of them have a copy at 0.808."""
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(500):
        own = [f"u{k}x{j}" for j in range(16)]
        rows.append((10 * k, " ".join(base + own)))
        if k < 60:
            rows.append((10 * k + 1, " ".join(base + own[:2] + [f"c{k}x{j}" for j in range(14)])))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {10 * k for k in range(500)}


def shingle_sets(spark, sets):
    rows = [(th, sorted(s)) for th, s in sets.items()]
    return spark.createDataFrame(rows, "th long, shingles array<int>")


def pairs_of(spark, sets, similarity=0.8):
    groups = spark.createDataFrame([], "node long, component long")
    rare = simhash._prefixes(shingle_sets(spark, sets), groups, similarity)
    return {(r.a, r.b) for batch in simhash.cross_pairs(rare, similarity=similarity) for r in batch.collect()}


def alike(sets, similarity=0.8):
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def test_rarest_shingles_reach_every_similar_pair(spark):
    rng = np.random.default_rng(5)
    sets = {}
    for th in range(240):
        base = range(100 * (th % 3), 100 * (th % 3) + int(rng.integers(12, 60)))
        drop = rng.random(len(base)) < rng.choice([0, 0.04, 0.1, 0.2])
        own = rng.integers(1000, 1200, int(rng.integers(0, 8)))
        sets[th] = {int(x) for x, d in zip(base, drop) if not d} | {int(x) for x in own}
    wanted = alike(sets)
    assert len(wanted) > 200 and wanted <= pairs_of(spark, sets)


def test_texts_with_too_many_own_shingles_meet_nobody(spark):
    # a group whose members share 85 of 100 shingles: no two reach 0.8, and their pairs were all compared
    sets = {th: set(range(85)) | {1000 + 15 * th + i for i in range(15)} for th in range(200)}
    assert alike(sets) == set() == pairs_of(spark, sets)
    near = {th: set(range(95)) | {1000 + 5 * th + i for i in range(5)} for th in range(1000, 1010)}
    assert pairs_of(spark, sets | near) == alike(near) and len(alike(near)) == 45
