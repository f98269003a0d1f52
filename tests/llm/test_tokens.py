"""Token ids, packing and token files: exact against the tokenizer itself, and round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from shortlist.llm import packing, token_files, tokens

ODD = [
    None, "", " ", "a", " a", "a  b", "a\nb", "a\n\nb c ", "tab\tin", "nbsp\xa0x y", "nul\0x y", "é è\nÜber 'll don't x's　z",
    "<|endoftext|> x", "word " * 5000 + "end", "#*$ %&|<>\r\nx", "1234 5 67\n٣٤", "á ́b", "😀 😀\n😀",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tab'sé1.,"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_units_give_the_tokenizers_ids(tokenizer, texts):
    mine = tokens.encoder().encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in mine] == [plain(tokenizer, t) for t in texts]


def test_ids_of_documents(spark, sf_dir, tokenizer):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    mine = tokens.encoder().encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in mine] == [plain(tokenizer, t) for t in texts]


def frame(spark):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(6, "b again"), (6, "b again"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as start", "2 as part")


def test_packing(spark, tokenizer):
    docs = frame(spark)
    out = packing.pack(docs, keep_ids=True).collect()
    whole = {}
    for r in out:
        assert r.length == len(r.ids) <= 1024 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole.setdefault(r.doc_id, []).append(r)
    expected = {}
    for r in docs.collect():
        expected.setdefault(r.doc_id, []).append(plain(tokenizer, r.text) + [0])
    assert set(whole) == set(expected)
    for doc_id, lists in expected.items():
        assert sum(map(len, lists)) == sum(r.length for r in whole[doc_id])
        if len(lists) == 1:
            pieces = sorted(whole[doc_id], key=lambda r: r.start)
            assert [x for r in pieces for x in r.ids] == lists[0]
            assert all(r.doc_tokens == len(lists[0]) for r in pieces)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rows[0].sequence_tokens <= 1024
        assert rows[0].padding == (0 if at & (at - 1) == 0 else 1024 - at)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_is_the_tightest(lengths):
    lengths = sorted(lengths, reverse=True)
    place, offset = packing.best_fit(lengths, 50)
    room = []
    for length, p, o in zip(lengths, place, offset):
        fitting = [r for r in room if r >= length]
        if p == len(room):
            assert not fitting and o == 0
            room.append(50)
        else:
            assert room[p] == min(fitting) and o == 50 - room[p]
        room[p] -= length


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=700))
def test_segment_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert token_files.decode_segment(token_files.encode_segment(ids)).tolist() == ids.tolist()


def test_token_files(spark, tokenizer, tmp_path):
    docs = frame(spark)
    token_files.write_token_files(docs, str(tmp_path / "t"), part_bytes=3000, segment_ids=50)
    out = sorted(token_files.read_token_files(spark, str(tmp_path / "t"), keep_ids=True).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for r, row in zip(out, rows, strict=True):
        ids = plain(tokenizer, row.text) + [2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (row.doc_id, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"))
    assert token_files.read_token_files(spark, str(tmp_path / "t")).collect() == []


def test_stops_and_commas_are_units_of_their_own(tokenizer):
    mine = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    texts = ["one two, été. two.\nune été, 2. x..", "two, two. été, (one). it's, C×, 'll.", ",", ". ,", "a,b .c", "", "1,", "ß, ÷. x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == [plain(tokenizer, t) for t in texts]
    assert {" two", " été", ",", "."} <= set(mine.known)
    assert not {" two,", " two.", " été,", " été.", " 2"} & set(mine.known)


def test_units_in_use_outlast_the_others(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(tokens, "TEXTS_AT_ONCE", 100)
    mine, asked = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY)), []
    encode = mine.units
    monkeypatch.setattr(mine, "units", lambda units: asked.extend(units) or encode(units))
    texts = ["start " + " ".join(f"often w{i}a{j}" for j in range(9)) for i in range(200)]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == [plain(tokenizer, t) for t in texts]
    assert asked.count(" often") == 1
