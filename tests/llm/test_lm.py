"""Language-model scores against plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tessella.llm import exchange, lm
from tessella.llm.exchange import planes, unplanes
from tessella.llm.lm import LEVELS, VALUES, op5_lm, score_texts


def middle(n):
    """What the quantised count stands for."""
    return float(VALUES[int(np.searchsorted(LEVELS, n, side="right"))])


def model(rows):
    """Token lists, held-out flags, and the plain probability of a token after another."""
    toks = [(d, [*(t or "").encode().lower().split(), None]) for d, t in rows]
    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for (_, t), h in zip(toks, held, strict=True):
        if not h:
            uni.update(t)
            bi.update(zip(["<s>", *t], t, strict=False))
    ctx = uni | Counter({"<s>": sum(not h for h in held)})
    n, v = sum(uni.values()), len(uni)
    base = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))

    def after(u, w):
        c = ctx[u]
        m = c**lm.HEAPS if c else 1.0
        return (min(middle(bi[u, w]), c) + m * base(w)) / (c + m)

    return toks, held, uni, bi, ctx, base, after


def plain(rows):
    toks, held, uni, _, _, base, after = model(rows)
    n = sum(uni.values())
    return [(d, h, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), sum(math.log10(after(u, w)) for u, w in zip(["<s>", *t], t, strict=False))) for (d, t), h in zip(toks, held, strict=True)]


def check(rows, got):
    """Base columns exactly; scores exactly but for the few bigrams that the filter takes for others."""
    key = lambda r: (r[0] is None, r[0], r[2])
    off = tokens = 0.0
    for a, b in zip(sorted(plain(rows), key=key), sorted(map(tuple, got), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(a[5]), (a, b)
        off, tokens = off + abs(a[6] - b[6]), tokens + a[2]
    assert off < 0.02 * tokens, (off, tokens)
    return off / max(tokens, 1)


def test_query_and_passes(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op5_lm(spark, sf).collect()
    check([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(spark):
    rows = [(k, "the cat sat on the mat and the dog sat on the log " * (k % 4)) for k in range(60)] + [(100, None), (101, ""), (None, "the cat"), (102, "unseen words é🙂 THE"), (102, "unseen words é🙂 THE"), (103, "x " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score").repartition(5)
    got = score_texts(df).collect()
    check(rows, got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert score_texts(df.limit(0)).count() == 0
    check([(100, None)], score_texts(df.filter("doc_id = 100")).collect())


def test_scores_are_the_plain_ones_where_the_filter_errs_never(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for most in (0, 10**9):
        assert check(rows, score_texts(docs, max_filter_bytes=most, bits_per_level=80).collect()) < 1e-9


@pytest.mark.parametrize("keys", [exchange.GROUP_KEYS, 1000])
def test_both_ways_and_finer_ranges_agree(spark, monkeypatch, keys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r["doc_id"]: r for r in score_texts(docs, chunk_bytes=60_000).collect()}
    monkeypatch.setattr(exchange, "GROUP_KEYS", keys)
    many = {r["doc_id"]: r for r in score_texts(docs, max_filter_bytes=0, chunk_bytes=60_000).collect()}
    assert one.keys() == many.keys()
    near = lambda c, room: all(abs(one[k][c] - many[k][c]) <= room * abs(one[k][c]) for k in one)
    assert near("base_score", 1e-9) and near("n_known", 0)
    assert near("score", 1e-9)


def test_the_filter_is_the_same_however_it_is_cut():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**56, 20_000, dtype=np.uint64))
    n = rng.integers(0, 9, len(keys))
    segment = lm.segment_bits(int(n.sum()))
    assert segment == 12 and lm.segment_bits(10**9) == 24 and lm.segment_bits(0) == 6
    whole = lm.bloom(keys, n, segment)
    for bits in (6, 12):
        ends = np.searchsorted(keys >> np.uint64(56 - bits), np.arange(2**bits + 1))
        parts = lm.BloomFilter.joined([lm.bloom(keys[a:e], n[a:e], segment) for a, e in zip(ends, ends[1:], strict=False)])
        assert all((x == y).all() for x, y in zip(whole, parts, strict=True))
    asked = np.concatenate([keys, rng.integers(0, 2**56, 20_000, dtype=np.uint64)])
    level, true = lm.probe(asked, whole, segment), np.searchsorted(LEVELS, np.concatenate([n, np.zeros(20_000, int)]), side="right")
    assert (level >= true).all() and (level > true).mean() < 0.04
    assert not lm.probe(asked, lm.BloomFilter.joined([]), segment).any()


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    _, _, uni, bi, ctx, base, after = model(rows)
    some = [u for u, _ in ctx.most_common(40)] + list(ctx)[:40] + ["never seen"]
    some = [u for u in some if u is not None]  # nothing follows the end
    for u in some:
        total = sum(after(u, w) for w in uni) + after(u, "a word not seen")
        exact = all(n <= 3 for (x, _), n in bi.items() if x == u)
        assert abs(total - 1) < (1e-9 if exact else 0.1), (u, total)


def test_planes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        k = np.unique(rng.integers(0, 2**56, n, dtype=np.uint64))
        assert (unplanes(planes(k)) == k).all()
