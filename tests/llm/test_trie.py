import hashlib
import random
import zlib

from shortlist.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, depth string, top string, n_convs string"


def brute(turns, rebuild=True):
    """Nodes as a dictionary of turn sequences."""
    convs = {}
    for c, t, r, x in turns:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        whole[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    rows = []
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[: len(n)] == n and len(m) > len(n) for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in held if len(whole[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        rows.append((min(held), len(node), up, len(held), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def frame(spark, turns):
    return spark.createDataFrame([(*t, "d", "t", "n") for t in turns], SCHEMA)


def nodes(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def made(seed, convs=60):
    rng = random.Random(seed)
    turns = []
    for c in range(convs):
        for t in range(rng.choice([1, 2, 3, 5, 8, 11])):
            turns.append((c, t if t else rng.choice([None, 0]), rng.choice(["user", None]), rng.choice(["a", "bé", "", None])))
    return turns


def test_rebuilt_conversations_equal_brute_force(spark):
    turns = made(1) + [(1000, 0, "user", "x"), (12345678901, 3, "user", "a"), (12345678901, 1, None, "b"), (None, 1, "user", "lost")]
    assert nodes(trie.trie_of(frame(spark, turns))) == brute(turns)


def test_shards_across_roots_and_spilling_queues(spark):
    rng = random.Random(4)
    turns = []
    for c in range(220):  # one first turn for most, long shared runs, snapshots, exact copies
        kind = c % 4
        length = {0: 30, 1: c % 29 + 1, 2: 6, 3: 3}[kind]
        for t in range(length):
            text = f"s{t}" if kind < 2 or t == 0 else (f"k{t}" if kind == 2 else f"u{rng.randrange(4)}")
            turns.append((c, t, "user", text))
    got = nodes(trie.trie_of(frame(spark, turns), rebuild=False, most=20, queue=3, shard_runs=10))
    assert got == brute(turns, rebuild=False)


def test_one_long_conversation_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(trie, "SLICE_ROWS", 100)
    monkeypatch.setattr(trie, "HEAVY_TURNS", 50)
    turns = [(c, t, "user", f"t{t}" if t < 150 else f"{c}-{t}") for c in (5, 6, 9) for t in range(300)] + [(7, 0, "user", "t0")]
    turns += [(11, t, "user", f"alone {t}") for t in range(120)]  # its base is absent, its own turns move up
    got = nodes(trie.trie_of(frame(spark, turns), most=2))
    rows = {r[:2]: r for r in got}
    whole = brute([t for t in turns if t[0] != 11 and t[1] < 170])
    whole = [r for r in whole if r[1]]  # the root has the last one too
    cut = {r[:2] for r in whole}
    assert {k: rows[k][3] for k in cut} == {r[:2]: r[3] for r in whole}
    moved = zlib.crc32(b"11") % 9
    assert moved and max(d for c, d in rows if c == 11) == 120 - moved


def test_queue_gives_messages_back_in_order():
    rng = random.Random(2)
    queue = trie.Messages(5)
    sent = [(rng.randrange(9), rng.randrange(9), i, 1, 2, 0) for i in range(60)]
    for message in sent:
        queue.put(message)
    assert queue.spills and [queue.pop() for _ in sent] == sorted(sent) and queue.peek() is None


def test_empty_table_and_single_turnless_conversation(spark):
    assert nodes(trie.trie_of(frame(spark, [(1, 0, "u", "x")]).where("false"))) == []
    turns = [(next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1), 0, "u", "x")]  # base absent
    assert nodes(trie.trie_of(frame(spark, turns))) == brute(turns)
    assert len(brute(turns)) == 1
