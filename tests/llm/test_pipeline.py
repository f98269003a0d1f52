"""The pipeline's stages and their edge cases, against brute force where a stage has one."""

import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from shortlist.llm import packing, quality, simhash

RNG = random.Random(11)
VOCABULARY = [f"word{i}" for i in range(3000)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def test_frequent_lines_go(spark):
    rows = [(i, "h", f"{prose(60)}\nSubscribe  NOW {i % 10}!\n{prose(5)}") for i in range(40)]
    rows += [(100 + i, "h", f"subscribe now 7!\n{prose(10)}\n" + "\n".join(["Subscribe now 3!"] * 30)) for i in range(3)]
    rows += [(200, None, rows[0][2]), (201, "h", None), (202, "h", ""), (203, "h", prose(80)), (203, "h", "only " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "length(text) as n_chars", "1 as row", "2 as h")
    out = {r.doc_id: r for r in quality.clean_documents(docs, min_docs=5).collect()}
    assert set(out) == set(range(40)) | {200, 203}
    assert all("ubscribe" not in out[i].text and out[i].n_chars == len(out[i].text) for i in range(40))
    assert out[200].text == rows[0][2] and out[203].h == 2
    report = {(r.doc_id, r.kept) for r in quality.quality_report(docs, min_docs=5).collect()}
    assert {(101, False), (3, True), (201, False), (203, True), (203, False)} <= report
    assert quality.clean_documents(docs.limit(0)).collect() == [] and quality.quality_report(docs.limit(0)).collect() == []


def test_one_of_each_near_group_stays(spark):
    def jaccard(a, b):
        sets = []
        for t in (a, b):
            w = t.lower().split()
            sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
        return len(sets[0] & sets[1]) / len(sets[0] | sets[1])

    rows = []
    for k in range(30):
        words = prose(300).split()
        rows.append((1000 + k, " ".join(words)))
        for c in range(k % 4):
            copy = list(words)
            for _ in range(2 + 3 * c):
                copy[RNG.randrange(300)] = "edit"
            rows.append((k + 100 * c, " ".join(copy)))
    hub = prose(200).split()
    for c in range(60):  # a posting list longer than ALL_PAIRS
        copy = list(hub)
        copy[RNG.randrange(200)] = f"e{c}"
        rows.append((5000 + c, " ".join(copy)))
    rows += [(7, None), (8, ""), (9000, rows[0][1]), (9000, rows[0][1]), (None, rows[4][1])]
    wanted, texts = set(), [(d, t or "") for d, t in rows]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = texts[i][1], texts[j][1]
            if a == b or (a and b and jaccard(a, b) >= 0.8):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(texts):
        groups.setdefault(find(i), []).append(d)
    wanted = sorted(min(x for x in g if x is not None) for g in groups.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as th", "2 as a", "3 as _x")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == wanted
    assert simhash.drop_near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_clean_documents(spark, sf_dir, name):
    rows = [(i, prose(120), "en", f"src{i % 3}", i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == rows


def test_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    pieces = out.collect()
    kept = {r.doc_id for r in pieces}
    assert 0 < len(kept) < 200
    totals = {}
    for r in pieces:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert all(totals[r.doc_id] == r.doc_tokens for r in pieces)


def test_pipeline_writes_the_ids(spark, sf_dir):
    docs = spark.createDataFrame([(1, prose(1500)), (2, prose(30)), (3, None)], "doc_id long, text string")
    pieces = corpus_pipeline.pack_sequences(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3}
    for r in pieces:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_line_rule_equals_its_sql_where_lines_go(spark):
    """The registered SQL takes lines out on sf0.01; other limits give its rows too."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        for sql, least, share in ((quality._SQL, 5, 0.05), (quality._SQL.replace("n >= 5 AND n > 0.05 *", "n >= 4 AND n > 0.01 *"), 4, 0.01)):
            wanted = db.execute(sql).fetchall()
            found = quality.quality_report(docs, min_docs=least, max_share=share)
            assert sorted(map(tuple, found.collect())) == sorted(wanted)
            assert sum(r[-1] > 0 for r in wanted) > 20


def test_lines_of_a_small_host_go_and_copies_count_as_documents(spark):
    rows = [(i, "small", f"{prose(80)}\nCookie notice" if i < 5 else prose(80)) for i in range(10)]
    rows += [(20 + i, "big", f"{prose(80)}\nRare notice" if i < 4 else prose(80)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    report = {r.doc_id: r.n_line_words for r in quality.quality_report(docs).collect()}
    assert [report[i] for i in range(10)] == [2] * 5 + [0] * 5 and not any(report[20 + i] for i in range(200))


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_extra_columns_may_have_any_name(spark, sf_dir, name):
    names = ["_th", "_id", "_key", "_h", "_t", "_hs", "_host", "_rows", "_chunk", "chunk", "row", "th", "fp", "others", "a.b"]
    rows = [(i, prose(120), "h", *[f"{n}{i}" for n in names], i) for i in range(12)]
    fields = [*["doc_id long", "text string", "source string"], *[f"`{n}` string" for n in names], "n_chars long"]
    docs = spark.createDataFrame(rows, ", ".join(fields))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows


def test_very_long_documents_are_packed_in_bounded_blocks(spark):
    """Blocks by bytes of ids, not by documents: no block holds more than its share."""
    rows = [(i, " ".join(f"w{j % 997}" for j in range(110_000))) for i in range(3)] + [(10 + i, prose(40)) for i in range(50)] + [(5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(docs, keep_ids=True, block_bytes=1 << 18).collect()
    assert max(r.doc_tokens for r in pieces) > 200_000
    sequences = {}
    for r in pieces:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(n for _, n in held) <= packing.WINDOW
    assert len({s >> 40 for s in sequences}) > 8
    total = sum(r.length for r in pieces)
    assert total == sum({r.doc_id: r.doc_tokens for r in pieces if r.doc_id != 5}.values()) + 2
    assert len(sequences) * packing.WINDOW < 1.05 * total + 64 * packing.WINDOW
