"""Suffix-array dedup: against brute force over every window."""

import hashlib
import random

import numpy as np
import pytest

from shortlist.llm import suffix_dedup as sd


def brute(rows, width):
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        key = 2**63 - 1 if doc_id is None else doc_id
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            first[w] = min(first.get(w, key), key)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        key = 2**63 - 1 if doc_id is None else doc_id
        gone = [False] * len(data)
        for i in range(len(data) - width + 1):
            if first[data[i : i + width]] < key:
                gone[i : i + width] = [True] * width
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(doc_id), len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "and", "éa", "ñ", "lorem", "x", "qu"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(90)) * rng.randrange(2) for _ in range(n))
    passages = [text(20) for _ in range(6)]
    rows = []
    for k in range(120):
        parts = [text(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages)[rng.randrange(20) :], text(rng.randrange(0, 12))]
        rows.append((rng.randrange(10**6), "\n".join(parts)))
    rows += [(7, rows[0][1]), (7, rows[0][1]), (5, "z" * 300), (6, "z" * 49), (8, "z" * 50), (9, None), (10, ""), (None, rows[1][1]), (11, "ab" * 100 + rows[2][1])]
    return rows


@pytest.mark.parametrize("chunk_bytes, wide_docs", [(1 << 20, 1000), (3000, 1000), (3000, 3)])
def test_matches_brute_force(spark, chunk_bytes, wide_docs):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as chunk", "2 as _row")
    mine = sorted((str(r[0]), *r[1:]) for r in sd.removal_report(frame, 50, chunk_bytes, wide_docs).collect())
    assert mine == brute(rows, 50)


def test_texts_without_repeats(spark):
    rows = [(1, "é" * 40 + "abc"), (2, "x" + "é" * 40), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "'k' as source", "text", "length(text) as n_chars", "9 as chunk")
    out = {r.doc_id: r for r in sd.remove_repeats(frame).collect()}
    assert (out[1].text, out[2].text, out[3].text) == (rows[0][1], "x", None)
    assert (out[2].n_chars, out[2].source, out[2].chunk) == (1, "k", 9)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.removal_report(empty).collect() == [] and sd.remove_repeats(empty).collect() == []


def test_classes_of_a_block():
    rng = np.random.default_rng(1)
    for _ in range(30):
        strings = [bytes(rng.integers(97, 99, rng.integers(24, 60)).astype(np.uint8)) for _ in range(20)]
        documents = rng.integers(0, 50, 20)
        mine = sd.least_documents(strings, documents, 24)
        least = {}
        for s, d in zip(strings, documents.tolist()):
            for i in range(len(s) - 23):
                least[s[i : i + 24]] = min(d, least.get(s[i : i + 24], d))
        for s, m in zip(strings, mine):
            assert m.tolist() == [least[s[i : i + 24]] for i in range(len(s) - 23)]
