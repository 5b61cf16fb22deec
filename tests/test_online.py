"""Online trainers: layered state, delayed gradients, progress, metrics of groups of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import frame, metrics
from tessella.operators.updaters import FTRL
from tessella.plans import state, trainers
from tessella.plans.config import Embedding, LearnConfig
from tessella.sources.buckets import bucketed


def rows_of(spark, n=60, features=12):
    rng = np.random.default_rng(7)
    data = []
    for k in range(n):
        # Later rows have features that earlier ones lack.
        ids = rng.choice(np.arange(k // 10, k // 10 + features), 3, replace=False)
        data.append((k, float(rng.random() < 0.5), 1.0, [(int(i), float(v)) for i, v in zip(ids, rng.normal(size=3), strict=True)]))
    return spark.createDataFrame(data, f"row_id long, label double, weight double, features {frame.FEATURES}")


def plain(rows, size, delay, folder, alpha=0.1, beta=1.0, l1=0.05):
    """FTRL in numpy: each gradient under the state before the last ``delay`` pushes, no further back than the folder's first."""
    data, states = sorted(rows.collect(), key=lambda r: r["row_id"]), [{}]
    for b in range(-(-len(data) // size)):
        old = states[max(b - b % folder, b - delay)]
        g = {}
        for r in data[b * size : (b + 1) * size]:
            m = sum(f["value"] * old.get(f["index"], (0, 0, 0))[0] for f in r["features"])
            y = 1 if r["label"] > 0 else -1
            for f in r["features"]:
                g[f["index"]] = g.get(f["index"], 0) - y / (1 + np.exp(y * m)) * f["value"]
        new = dict(states[-1])
        for i, x in g.items():
            w, z, n = new.get(i, (0, 0, 0))
            n2 = np.sqrt(n * n + x * x)
            z = z + x - (n2 - n) / alpha * w
            new[i] = (0.0 if abs(z) <= l1 else -np.sign(z) * (abs(z) - l1) / ((beta + n2) / alpha), z, n2)
        states.append(new)
    return states[-1]


@pytest.mark.parametrize(("delay", "folder", "layers"), [(0, 16, 8), (0, 2, 1), (2, 4, 1)])
def test_layers_and_delays_against_plain(spark, monkeypatch, delay, folder, layers):
    monkeypatch.setattr(trainers, "BATCHES_PER_FOLDER", folder)
    monkeypatch.setattr(state.LayeredState.__init__, "__defaults__", (None, layers))
    rows = rows_of(spark)
    model, history = trainers.train_linear(rows, LearnConfig(minibatch=10, max_data_pass=1, lambda_l1=0.05), delay=delay)
    got = {r["index"]: (r["w"], r["z"], r["n"]) for r in model.state.collect()}
    want = plain(rows, 10, delay, folder)
    assert got.keys() == want.keys() and np.allclose([got[k] for k in got], [want[k] for k in got])
    assert history[0]["train"]["n_rows"] == 60 and history[0]["train"]["n_batches"] == 6


def test_nothing_stays_cached(spark):
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = rows_of(spark)
    trainers.train_linear(rows, LearnConfig(minibatch=20, max_data_pass=1), validation=rows)
    trainers.train_factorization(rows, LearnConfig(minibatch=30, max_data_pass=1, embedding=Embedding(dim=2, threshold=1)), validation=rows)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_factorization_in_folders(spark, monkeypatch):
    rows, conf = rows_of(spark), LearnConfig(minibatch=20, max_data_pass=1, lambda_l1=0.01, lr_eta=0.1, embedding=Embedding(dim=2, threshold=2))
    of = lambda: {r["index"]: (r["cnt"], r["w"], r["z"], *(r["v"] or ())) for r in trainers.train_factorization(rows, conf)[0].state.collect()}
    one = of()
    monkeypatch.setattr(trainers, "BATCHES_PER_FOLDER", 1)
    two = of()
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k]) for k in one)


def test_a_push_reads_the_state_where_it_lies(spark):
    from tessella.operators.updaters import push

    old = bucketed(spark.range(50).select(F.col("id").alias("index"), *[F.lit(0.5).alias(c) for c in "wzn"]), "index", "state")
    grad = spark.range(9).select(F.col("id").alias("index"), F.rand(1).alias("g")).groupBy("index").agg(F.sum("g").alias("g"))
    plan = push(old, grad, FTRL())._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_auc_of_groups_of_any_size(spark):
    rng = np.random.default_rng(2)
    data = [(g, float(np.round(rng.normal() + y, d)), float(y)) for g, n, d in ((1, 3000, 4), (2, 40, 1), (None, 300, 0), (3, 1, 0)) for y in rng.integers(0, 2, n)]

    def area(s, y):
        p, n = s[y > 0], s[y <= 0]
        return 1.0 if not len(p) or not len(n) else float(((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean())

    df = spark.createDataFrame(data, "batch long, margin double, label double")
    got = {r["batch"]: r["auc"] for r in metrics.auc(df, by=["batch"]).collect()}
    want = {g: area(*(np.array([x[k] for x in data if x[0] == g]) for k in (1, 2))) for g in (1, 2, None, 3)}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)
    whole = metrics.whole_progress(df).first()
    s, y = (np.array([x[k] for x in data]) for k in (1, 2))
    assert whole["n_rows"] == len(data) and whole["n_batches"] == 1 and abs(whole["auc"] - area(s, y)) < 1e-12
