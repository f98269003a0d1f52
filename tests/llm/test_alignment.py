import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shortlist.llm import alignment

SCHEMA = "doc_id long, text string, codes string, text_ string, n_a string"


def brute(texts):
    """Each text on its own, token by token."""
    one = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_LEVEL))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECES))
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in keep}
    for b in range(256):
        if b not in keep:
            byte_of[chr(256 + len(byte_of) - len(keep))] = b
    out, corpus = [], Counter()
    for text in texts:
        want = b" " + (text or "").encode()
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        spelled = [bytes(byte_of[c] for c in one.id_to_token(i)) for i in a]
        pieces = [two.id_to_piece(i) for i in b]
        said = [bytes([int(p[3:-1], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not text or b"".join(spelled) != want or b"".join(said) != want:
            out.append((0, 0, [], []))
            continue
        ends_a = [sum(map(len, spelled[: i + 1])) for i in range(len(a))]
        ends_b = [sum(map(len, said[: i + 1])) for i in range(len(b))]
        links = [(x, y) for x, e in zip(a, ends_a) for y, f in zip(b, ends_b) if e == f]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append(",".join(str(x) for x, e in zip(a, ends_a) if low < e <= high) + "|" + ",".join(str(y) for y, f in zip(b, ends_b) if low < f <= high))
        corpus.update(links)
        out.append((len(a), len(b), groups, links))
    most = {}
    for (_, y), n in corpus.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (na, nb, len(g), len(k), sum(corpus[p] == most[p[1]] for p in k), sum(corpus[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for na, nb, g, k in out
    ]


TEXTS = [
    None, "", "The quick brown fox. The quick fox, the quick brown dog", " led  twice ", "a\nb\tc\r\nd\x00e", "naïve café 漢字 🙂 ▁ x", "naïve café 漢字 🙂",
    "<|endoftext|> and <s> and <unk> <0x41>", "  ", "\n", "über größer 12345 67,8", "the " * 300 + "end", "é   　", "ﬁne", "The quick brown fox. The quick fox, the quick brown dog",
]


def rows(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def run(docs):
    aligned = alignment.align(docs)
    return alignment.with_counts(aligned, alignment.pair_counts(aligned), alignment.pair_bound())


def test_alignment_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "c", "t", "n") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    assert rows(run(docs)) == dict(enumerate(brute(TEXTS)))


def test_real_texts_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 1500")
    held = docs.collect()
    assert rows(run(docs)) == {r["doc_id"]: b for r, b in zip(held, brute([r["text"] for r in held]))}


def test_many_links_are_counted_again_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS_HELD", 10)
    docs = spark.createDataFrame([(i, t, "c", "t", "n") for i, t in enumerate(TEXTS * 5)], SCHEMA).coalesce(1)
    assert rows(run(docs)) == dict(enumerate(brute(TEXTS * 5)))


def test_groups_as_text_long_text_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a bee", "c", "t", "n"), (None, "z" * 300_000, "c", "t", "n")], SCHEMA)
    groups = {r["doc_id"]: r["groups"] for r in alignment.align(docs, keep_groups=True).collect()}
    assert hashlib.sha256(groups[1].encode()).hexdigest() == brute(["a bee"])[0][-1]
    assert groups[None].count("|") >= 1
    assert run(docs.where("false")).collect() == []


def test_pairs_stay_under_the_bound_of_the_vocabularies(spark):
    both = alignment.tokenizers(alignment.BYTE_LEVEL, alignment.PIECES)
    one, two = (set(v.to_pylist()) for v in both.bytes)
    pairs = sum(t[i:] in two for t in one for i in range(len(t))) + sum(t[i:] in one for t in two for i in range(1, len(t)))
    assert pairs < alignment.pair_bound() < 2_000_000
    with pytest.raises(ValueError):
        aligned = alignment.align(spark.createDataFrame([(1, "a bee c", "c", "t", "n")], SCHEMA))
        alignment.with_counts(aligned, alignment.pair_counts(aligned), 1)
    assert json.dumps(both.sizes) == "[50257, 32000]"
