import hashlib
import re

import pytest

from shortlist.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string, row string, size string, level string"


def brute(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing what is above a limit again and again; then the copies of each row."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sums = {}
    for (_, _, s), n in zip(rows, size):
        sums[s] = sums.get(s, 0) + n
    names = sorted((s for s in sums if s is not None)) + ([None] if None in sums else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, share * sum(sums.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sums[s]}
        for s in full or open_:
            target[s] = most * sums[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    out = []
    for (i, t, s), n in zip(rows, size):
        draw = int(hashlib.md5(f"mix:{i if i is not None else t or ''}".encode()).hexdigest()[:13], 16) / (1 << 52)
        rate = target[s] / sums[s] if sums[s] else 0
        out.append((n, sums[s], target[s], int(rate) + (draw < rate - int(rate))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "c", "r", "z", "l") for i, t, s in rows], SCHEMA)


def test_targets_and_copies_equal_brute_force(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), f"s{i % 4}" if i % 3 else "s0") for i in range(400)]
    rows += [(400, None, "s9"), (401, "  \n", "s9"), (402, "a b c", None), (403, "x " * 5000, "\U0001f600"), (3, "again", "s1"), (3, "again", "s1")]
    rows += [(None, "no id", "s2"), (None, None, None), (404, "y " * 900, "￮")]
    sized = mixing.with_sizes(frame(spark, rows))
    placed = mixing.with_copies(sized, mixing.targets(sized)).select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "copies")
    got = sorted((tuple(r) for r in placed.collect()), key=repr)
    want = sorted(((*r, *b) for r, b in zip(rows, brute(rows))), key=repr)
    assert [g[:5] + g[6:] for g in got] == [w[:5] + w[6:] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert all(g[6] <= 2 for g in got)


def test_mix_repeats_rows_keeps_columns_and_reruns_agree(spark):
    rows = [(i, f"t{i} b", "ab"[i % 2]) for i in range(300)]
    docs = frame(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "_copy"]
    first = sorted(tuple(r) for r in mixed.collect())
    assert first == sorted(tuple(r) for r in mixing.mix(docs.repartition(7)).collect())
    times = {i: c for (i, _, _), (_, _, _, c) in zip(rows, brute(rows))}
    assert {i: sum(r[0] == i for r in first) for i in times} == times
    assert first[0][3:7] == ("c", "r", "z", "l")


def test_share_above_all_limits_takes_each_source_at_its_limit(spark):
    docs = frame(spark, [(1, "a b", "x"), (2, "c", "y")])
    got = mixing.targets(mixing.with_sizes(docs), share=5.0)
    assert {r["source"]: r["target"] for r in got.collect()} == {"x": 4.0, "y": 2.0}


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 5}") for i in range(20_000)]
    sized = mixing.with_sizes(frame(spark, rows))
    placed = mixing.with_copies(sized, mixing.targets(sized))
    near = placed.selectExpr("source", "size * copies as taken", "target").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(near) == 5 and all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.05 for r in near)


def test_empty_table_and_wordless_texts(spark):
    none = frame(spark, [(1, "x", "s")]).where("false")
    assert mixing.mix(none).collect() == []
    blank = mixing.with_sizes(frame(spark, [(1, None, "s"), (2, "", None)]))
    assert {tuple(r) for r in mixing.targets(blank).select("source_size", "target").collect()} == {(0, 0.0)}
