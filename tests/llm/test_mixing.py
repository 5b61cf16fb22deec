"""The mix against its own terms."""

from collections import defaultdict
from fractions import Fraction

import numpy as np

from tessella.llm.mixing import mix_report, mix_sources, op10_mixing, plan_mix, split_tree, targets


def test_targets_stop_and_reshare():
    assert targets([10, 10, 10], [5, 2, 1]) == [Fraction(150, 8), Fraction(60, 8), Fraction(30, 8)]
    got = targets([1, 100, 100], [5, 2, 1])
    assert got == [3, Fraction(198 * 2, 3), Fraction(198, 3)]
    assert sum(got) == 201


def test_tree_deals_out_exactly():
    got = split_tree(np.array([7, 0, 100]), 6, np.random.default_rng(3))
    assert got.shape == (6, 3) and got.sum(0).tolist() == [7, 0, 100] and (got >= 0).all()
    assert max(got.sum(1)) - min(got.sum(1)) <= 2


def check(rows, slack):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[n]) for n in names]
    for n, t, size in zip(names, targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))]), sizes, strict=True):
        assert {r["source_size"] for r in by[n]} == {size} and {r["target"] for r in by[n]} == {float(t)}
        assert abs(sum(r["taken"] for r in by[n]) - t) <= slack
        assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in by[n])


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = op10_mixing(spark, sf)
    rows = a.join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == docs.count()
    check(rows, 100)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, op10_mixing(spark, sf).collect()))


def test_edges(spark):
    rows = [(k, "a b c " * (k % 7), None if k % 5 == 0 else f"s{k % 3}", k) for k in range(200)] + [(7, None, "s1", 1), (8, "x y", "null", 1), (8, "x y", "null", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mix_sources(df, shards=4)
    assert out.columns == df.columns
    drawn = defaultdict(int)
    for r in out.collect():
        drawn[r["doc_id"]] += len((r["text"] or "").split())
    report = defaultdict(int)
    for r in mix_report(plan_mix(df, shards=4)).collect():
        report[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in drawn.items() if v} == {k: v for k, v in report.items() if v}
    assert mix_report(plan_mix(df.limit(0))).count() == 0 and mix_sources(df.limit(0)).count() == 0
    assert mix_report(plan_mix(df.filter("text is null"))).collect()[0]["taken"] == 0


def test_shards_hold_what_the_tree_dealt(spark):
    df = spark.createDataFrame([(k, "w " * (k % 9 + 1), f"s{k % 3}") for k in range(3000)], "doc_id long, text string, source string")
    mix = plan_mix(df, shards=5)
    units = defaultdict(list)  # per source its blocks' draws, each one unit of the quota
    draws = {}
    for r in mix.blocks.collect():
        draws[r["skey"], r["block"]] = r["draws"]
        units[r["skey"]] += [(d["shard"], r["block"], d["pass"]) for d in r["draws"]]
    assert all(len({u[1:] for u in x}) == len(x) for x in units.values())  # disjoint
    per_shard = np.bincount([u[0] for x in units.values() for u in x], minlength=5)
    assert per_shard.max() - per_shard.min() <= 4
    # The tree's own counts, drawn anew, are those of every source and shard.
    names = sorted(units)
    counts = split_tree(np.array([len(units[n]) for n in names]), 5, np.random.default_rng(17))
    assert all(np.bincount([u[0] for u in units[n]], minlength=5).tolist() == counts[:, k].tolist() for k, n in enumerate(names))
    # Rows go where their block goes, as often, and the mix itself has them there.
    rows = mix.sized.join(mix_report(mix), "doc_id").collect()
    for r in rows:
        mine = [d for d in draws[r["__m_skey"], r["__m_block"]] if d["subs"] is None or r["__m_sub"] in d["subs"]]
        assert r["shards"] == ",".join(str(d["shard"]) for d in sorted(mine, key=lambda d: d["shard"])) and r["passes"] == len(mine)
    from pyspark.sql import functions as F

    placed = defaultdict(list)
    for r in mix_sources(df, shards=5).select("doc_id", F.spark_partition_id().alias("p")).collect():
        placed[r["doc_id"]].append(r["p"])
    assert all(",".join(map(str, sorted(placed[r["doc_id"]]))) == r["shards"] for r in rows)
