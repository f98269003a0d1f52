"""Decontamination, license scans and chat collapse: against brute force, and the defined edge cases."""

import random
from itertools import combinations

import pytest
from hypothesis import given, settings, strategies as st

from shortlist.llm import chat, decontaminate as dc, licenses

RNG = random.Random(8)
WORDS = ["the", "of", "and", "in"] + [f"term{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS[:4] if RNG.random() < 0.4 else WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def items():
    return [(i, prose(RNG.choice([3, 20, 40, 90])), None if i % 2 else prose(2)) for i in range(25)] + [(25, None, None), (26, "", "x"), (3, prose(20), None)]


@pytest.fixture(scope="module")
def rows(items):
    out = [(k, prose(RNG.randrange(300))) for k in range(60)]
    for k in range(40):
        _, question, answer = items[k % 25]
        words = question.split()
        for _ in range(k % 3):
            words[RNG.randrange(len(words))] = "edit"
        out.append((100 + k, f"{prose(30)} {' '.join(words).upper()}\n{answer or ''} {prose(k)}"))
    return out + [(7, None), (8, ""), (None, out[-1][1]), (100, out[60][1])]


def brute_leaks(rows, items, least, overlap):
    index_items = [i for i in items if dc.words_of(i[1])]
    out = []
    for doc_id, text in rows:
        words = dc.words_of(text)
        for item_id, question, answer in index_items:
            q = dc.words_of(question)
            wanted = {tuple(q[i : i + 5]) for i in range(max(1, len(q) - 4))}
            mine = {tuple(words[i : i + len(next(iter(wanted)))]) for i in range(len(words))}
            a = dc.words_of(answer)
            if len(wanted & mine) / len(wanted) >= overlap and (not a or any(words[i : i + len(a)] == a for i in range(len(words)))):
                out.append((str(doc_id), item_id))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 700])
def test_leaks(spark, rows, items, shard_bytes):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as item_id", "'s' as score")
    bench = spark.createDataFrame(items, "item_id long, q string, a string")
    found = dc.find_leaks(docs, bench, "q", "a", shard_bytes=shard_bytes).collect()
    wanted = brute_leaks(rows, items, dc.MIN_SCORE, dc.MIN_OVERLAP)
    assert sorted((str(r.doc_id), r.item_id) for r in found) == wanted
    kept = dc.drop_leaks(docs, bench, "q", "a", shard_bytes=shard_bytes)
    assert kept.columns == docs.columns
    bad = {(d, t) for d, t in rows if str(d) in {x for x, _ in wanted}}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in rows if (d, t) not in bad)


def test_leaks_of_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(docs, none).collect() == [] and dc.drop_leaks(docs, none).count() == len(rows)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.find_leaks(docs.limit(0), bench).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefghijklmnop"), min_size=1, max_size=12), min_size=1, max_size=200), st.lists(st.sampled_from("abcdefghijklmnop"), max_size=20), st.floats(0.05, 1))
def test_block_max_wand_loses_nothing(units, words, least):
    stats = {}
    for u in units:
        for w in set(u):
            stats[w] = stats.get(w, 0) + 1
    index = dc.Index([(i, " ".join(u), None) for i, u in enumerate(units)], stats, len(units), 6.0)
    terms = sorted({index.term[w] for w in words if w in index.term})
    total = {}
    for t in terms:
        for u, s in zip(index.units[t], index.scores[t]):
            total[u] = total.get(u, 0) + s
    mine = index.search(terms, least)
    assert set(mine) == {u for u, s in total.items() if s >= least - 1e-9}
    assert all(abs(total[u] - s) < 1e-9 for u, s in mine.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=9), st.lists(st.sampled_from("abcdefgh"), max_size=9))
def test_alignment_is_a_common_subsequence(text, template):
    pairs = licenses.align(text, template)
    assert all(text[i] == template[j] for i, j in pairs)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
    if len(set(text)) == len(text) and len(set(template)) == len(template):
        best = max(k for k in range(10) if k == 0 or any(list(c) in [list(x) for x in combinations(text, k)] for c in combinations(template, k)))
        assert len(pairs) == best


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit"]
    rows = [
        (1, f"{prose(50)}\nReleased under the MIT License.\n{prose(50)}"), (2, mit.upper()), (3, mit.replace("copy", "duplicate").replace("merge, ", "")),
        (4, prose(500)), (5, None), (6, ""), (7, "license " * 3000), (8, "Licensed under CC BY-NC 4.0. " * 500), (None, "Released under the MIT License"),
        (9, "released the under MIT license"), (1, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as license")
    found = sorted((str(r.doc_id), r.license, round(r.coverage, 2)) for r in licenses.scan_licenses(docs).collect())
    assert [x for x in found if x[0] != "3"] == [
        ("1", "mit-notice", 1.0), ("1", "mit-notice", 1.0), ("2", "mit", 1.0), ("8", "cc-by-nc-4.0-notice", 1.0), ("9", "mit-notice", 0.8), ("None", "mit-notice", 1.0),
    ]
    assert [x[:2] for x in found if x[0] == "3"] == [("3", "mit")]
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_chat_collapse(spark):
    talk = [("user", "a"), ("assistant", "b"), ("user", None), (None, "d")]
    convs = {5: talk[:2], 6: talk, 3: talk, 9: talk[:1], 10: [("user", "b")], 11: talk[:2] + [("user", "")], None: [("x", "y")], 12: [("t", str(i)) for i in range(2500)]}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(13, 0, "u", "same"), (13, 0, "u", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as place", "2 as slice")
    out = chat.format_chats(frame.repartition(3)).collect()
    whole = {}
    for r in sorted(out, key=lambda r: r.part):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
    form = lambda turns: "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)
    assert whole == {c: form(convs[c]) for c in (3, 10, 11, None, 12)} | {13: form([("u", "same")] * 2)}
    assert {r.conv_id: r.n_equal for r in out}[3] == 2 and sum(r.conv_id == 12 for r in out) == 3
    assert chat.format_chats(frame.limit(0)).collect() == []
