"""PPM scores and the unigram base: against a direct implementation."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from shortlist.llm import ppm


def corpus():
    rng = random.Random(2)
    words = ["the", "of", "And", "é", "lorem", "a-b", "x" * 30] + [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(80)]
    return rows + [(500, None), (501, ""), (502, " \t\n"), (503, "ÿþ ßæ 漢字 new"), (3, rows[3][1]), (3, rows[3][1]), (None, "null id")]


def brute(rows):
    trie = defaultdict(Counter)
    train = [(t or "").encode().lower() for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    for text in train:
        s = [257] * ppm.ORDER + list(text) + [256]
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                trie[tuple(s[i - k : i])][s[i]] += 1
    tokens = Counter(w for t in train for w in t.split())
    n, v = sum(tokens.values()) + len(train), len(tokens) + bool(train)
    out = []
    for d, t in rows:
        data = (t or "").encode().lower()
        s = [257] * ppm.ORDER + list(data) + [256]
        score = 0.0
        for i in range(ppm.ORDER, len(s)):
            ruled = set()
            for k in range(ppm.ORDER, -1, -1):
                seen = {x: c for x, c in trie.get(tuple(s[i - k : i]), {}).items() if x not in ruled}
                if not trie.get(tuple(s[i - k : i])):
                    continue
                total = sum(seen.values()) + len(seen)
                if s[i] in seen:
                    score += math.log10(seen[s[i]] / total)
                    break
                if total:
                    score += math.log10(len(seen) / total)
                ruled |= set(seen)
            else:
                score -= math.log10(257 - len(ruled))
        counts = [tokens[w] for w in data.split()] + [len(train)]
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in counts)
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
        out.append((str(d), held, len(counts), sum(c > 0 for c in counts), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 700])
def test_matches_direct_implementation(spark, chunk_bytes):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as score", "2 as chunk")
    mine = sorted((str(r[0]), *r[1:]) for r in ppm.score_texts(frame, chunk_bytes, chunk_bytes).collect())
    for a, b in zip(mine, brute(rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.score_texts(empty).collect() == []
    lone = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = ppm.score_texts(spark.createDataFrame([(lone, "ab")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_known, row.train_tokens) == (True, 0, 0)
    assert row.score == pytest.approx(-3 * math.log10(257)) and row.base_score == pytest.approx(2 * math.log10(0.5 / 0.5) + 0)
