"""BPE against the tokenizers library, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm.bpe import Encoder, Vocabulary, bpe_decode, bpe_encode, op1_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
ENC = Encoder(Vocabulary(open(PATH, encoding="utf-8").read()))
ODD = ["", " ", "  a", "a<|endoftext|>b <|endoftext|><|endoftext|>", "It's   we'll\n\n x\t\ty", "é́日本語 🙂🙂‍", "0123456789 " * 9, "a" * 5000, "=" * 300, " 　 z", "don't DON'T 'S", "\x00\x01\x7f�", "<|endoftext|", "straße Ñandú"]


@pytest.mark.parametrize("text", ODD)
def test_same_ids(text):
    assert ENC.encode([text])[0].tolist() == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_any_text(text):
    assert ENC.encode([text])[0].tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_plain_pattern_is_alike():
    chars = [chr(c) for c in range(0x500) if not ENC.v.not_plain.search(chr(c))]
    assert len(chars) > 500
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choices(chars, k=12)) + "".join(rng.choices("a1_ '-\n\x0b×÷", k=4))
        assert ENC.v.plain_pieces.findall(t) == ENC.v.pieces.findall(t)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aehinotrs' 0=-*\n", max_size=80))
def test_same_ids_dense_text(text):
    assert ENC.encode([text])[0].tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_following_tokens_by_definition():
    rng = random.Random(2)
    v, size = ENC.v, 50256
    for a, b in [(rng.randrange(size), rng.randrange(size)) for _ in range(3000)] + [(t, t) for t in range(0, 3000, 7)]:
        assert ENC.trie.may_follow(a, b) == (v.merged(v.bytewise(v.tokens[a] + v.tokens[b])) == [a, b])


def test_operator_keeps_rows_and_columns(spark):
    rows = [(k, t, "x") for k, t in enumerate([*ODD, None, ODD[3]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = {r["doc_id"]: r for r in bpe_decode(bpe_encode(df, PATH), PATH, text_col="back").collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        assert got[k]["back"] == (t or "") and got[k]["decoded"] == "x" and got[k]["text"] == t
    assert bpe_encode(df.limit(0), PATH).count() == 0
    twice = bpe_decode(bpe_encode(df.union(df).withColumn("ids", df.doc_id), PATH), PATH)
    assert sorted(twice.columns) == ["decoded", "doc_id", "ids", "text"]
    assert sorted((r["doc_id"], r["decoded"]) for r in twice.collect()) == sorted(2 * [(k, t or "") for k, t, _ in rows])
    assert bpe_decode(bpe_encode(df.limit(0), PATH), PATH).count() == 0
    bad = spark.createDataFrame([(1, [-1, 99999, 64]), (2, None)], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe_decode(bad, PATH).orderBy("doc_id").collect()] == ["a", ""]


def test_query_against_library(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op1_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = LIB.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(LIB.decode(ids, skip_special_tokens=False))
