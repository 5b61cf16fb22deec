"""The pipeline, stage by stage, against plain versions of its parts."""

import re
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_pii import base


def shingles(text):
    w = text.encode().lower().split()
    return set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) >= 5 else {tuple(w)}


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    f = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "pii", "mixing", "bpe"]
    good = f["quality_rules"](spark, docs, sf).cache()
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert good.columns == docs.columns and all(len(t.split()) >= 50 for t in kept.values())
    alone = f["minhash_near_dedup"](spark, good, sf).cache()
    stay = {r["doc_id"]: r["text"] for r in alone.collect()}
    sets = {d: shingles(t) for d, t in kept.items()}
    group = {d: d for d in sets}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    assert set(stay) == {d for d in group if group[d] == d} and alone.columns == docs.columns
    clean = f["pii"](spark, alone, sf).cache()
    for r in clean.collect():
        left = re.sub(r"\[(EMAIL|IP|CARD|PHONE|TERM)\]", "", r["text"])
        assert not base(left) and r["n_chars"] == len(r["text"])
        if not base(stay[r["doc_id"]]):
            assert r["text"] == stay[r["doc_id"]]
    mixed = f["mixing"](spark, clean, sf).cache()
    times = defaultdict(int)
    for r in mixed.collect():
        times[r["doc_id"]] += 1
    assert mixed.columns == docs.columns and max(times.values()) <= 3
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    out = f["bpe"](spark, mixed, sf).collect()
    assert len(out) == sum(times.values())
    for r in out:
        assert r["text"] == texts[r["doc_id"]] and r["ids"] == lib.encode(r["text"], add_special_tokens=False).ids


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)


def test_edges_go_through_all_stages(spark, tmp_path):
    import corpus_pipeline

    def text(k):
        return " ".join(f"word{(k * 7919 + j * 104729) % 9973} and the of" if j % 4 == 0 else f"plain{(k + 1) * (j + 3) % 997}" for j in range(80)) + "."

    rows = [(k, text(k), "en", f"s{k % 3}" if k % 5 else None, None, -k) for k in range(30)]
    rows += [(100, None, None, "s1", None, 1), (101, "", "en", None, 0, 1), (None, "short", None, None, None, None), (3, text(3), "en", "s0", None, -3), (3, text(3), "en", "s0", None, -3), (102, text(5) * 400, "en", "s1", None, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        got = out.collect()
        assert {"doc_id", "text", "ids", "n_tokens"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
        assert all(r["n_tokens"] == len(r["ids"]) and r["text"] for r in got)
        assert not {100, 101, None} & {r["doc_id"] for r in got} and bool(got) == bool(data)
