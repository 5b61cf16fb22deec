"""Expressions, rules, solvers, formats and settings by themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import hashing as H
from tessella.functions import losses as L
from tessella.operators import clustering, factorization, frame, metrics
from tessella.operators import updaters as U
from tessella.plans import trainers
from tessella.plans.config import LearnConfig, parse_args, parse_text
from tessella.plans.lbfgs import LBFGS, Objective, in_orthant, pseudo_gradient, two_loop
from tessella.sources import files, formats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_keys(spark):
    lit = lambda x: F.lit(x).cast("long")
    assert value(spark, H.reverse_nibbles(lit(0x0123456789ABCDEF))) == 0xFEDCBA9876543210 - 2**64
    assert value(spark, H.reverse_nibbles(lit(-1))) == -1
    assert value(spark, H.unsigned_mod(lit(-1), 1000)) == (2**64 - 1) % 1000
    assert value(spark, H.md5_60(F.lit("abc"))) == 648541476951500027
    assert value(spark, H.field_key(lit(-1), 3)) == (2**54 - 1) | (3 << 54)
    order = spark.createDataFrame([(-1,), (0,), (5,), (-(2**63),)], "i long").orderBy(H.unsigned_order(F.col("i"))).collect()
    assert [r["i"] for r in order] == [0, 5, -(2**63), -1]


# Worked by hand: rate 0.1, offset 1, l1 1, gradients 2, -1, 3 on a fresh key.
STEPS = {
    U.SGD: [(-0.05,), (0.0,), (-0.0732051,)],
    U.AdaGrad: [(-0.0333333, 2), (0.0, 2.2360680), (-0.0421793, 3.7416574)],
    U.FTRL: [(-0.0333333, 2, 2), (-0.0024316, 1.0786893, 2.2360680), (-0.0657007, 4.1152997, 3.7416574)],
}


@pytest.mark.parametrize("rule", STEPS)
def test_update_rules_by_hand(spark, rule):
    state = trainers.empty_state(spark, rule())
    for t, (g, want) in enumerate(zip((2.0, -1.0, 3.0), STEPS[rule], strict=True), 1):
        state = U.push(state, spark.createDataFrame([(7, g)], "index long, g double"), rule(), t)
        row = state.first()
        assert [round(row[c], 7) for c in rule().state] == [round(x, 7) for x in want]
    untouched = U.push(state, spark.createDataFrame([(8, 1.0)], "index long, g double"), rule(), 4).filter("index = 7").first()
    assert untouched["w"] == row["w"]


def test_losses_and_their_slopes(spark):
    grid = spark.createDataFrame([(y, m) for y in (-1.0, 0.0, 1.0) for m in (-800.0, -2.0, 0.3, 1.7, 800.0)], "y double, m double")
    for kind in L.LossKind:
        loss, h = L.Loss(kind), 1e-5
        for r in grid.select(loss.value(F.col("y"), F.col("m") + h).alias("a"), loss.value(F.col("y"), F.col("m") - h).alias("b"), loss.dual(F.col("y"), F.col("m")).alias("d")).collect():
            assert math.isfinite(r["a"]) and abs((r["a"] - r["b"]) / (2 * h) - r["d"]) < 1e-3 * max(1, abs(r["d"]))
    assert value(spark, L.Loss(L.LossKind.SQUARE_HINGE, compat=True).dual(F.lit(1.0), F.lit(2.0))) == -2
    assert value(spark, L.sigmoid(F.lit(-800.0))) == 0 and abs(L.base_score_logit(0.5)) < 1e-12
    with pytest.raises(ValueError):
        L.base_score_logit(1.0)
    assert value(spark, L.prox(F.lit(0.5), F.lit(2.0), 1, 0)) == 0 and value(spark, L.prox(F.lit(-3.0), F.lit(2.0), 1, 2)) == -0.5
    assert value(spark, L.quantize(F.lit(0.30001), 1, 1.0)) == round(0.30001 * 127) / 127
    assert value(spark, L.unit(F.array(F.lit(3.0), F.lit(4.0))))[0] == 0.6 and value(spark, L.unit(F.array(F.lit(0.0)))) == [0.0]


def test_auc(spark):
    def a(rows, **k):
        return metrics.auc(spark.createDataFrame(rows, "label double, margin double"), **k).first()["auc"]

    assert a([(1.0, 0.9), (0.0, 0.8), (1.0, 0.3), (0.0, 0.1)]) == 0.75
    assert a([(0.0, 0.9), (1.0, 0.1)]) == 0 and a([(0.0, 0.9), (1.0, 0.1)], folded=True) == 1
    assert a([(1.0, 0.2), (1.0, 0.3)]) == 1 and a([(1.0, 0.5), (0.0, 0.5)]) == 0.5
    rng = np.random.default_rng(1)
    rows = [(float(rng.random() < 0.4), float(round(rng.normal(), 1))) for _ in range(400)]
    p, n = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert abs(a(rows) - np.mean([(x > y) + 0.5 * (x == y) for x in p for y in n])) < 1e-12


def test_batches_and_segments(spark):
    rows = spark.createDataFrame([(k * 3, 1.0) for k in range(101)], "row_id long, label double").repartition(5)
    got = {r["row_id"]: r["batch_id"] for r in frame.minibatches(rows, 10).collect()}
    assert got == {k * 3: k // 10 for k in range(101)}
    assert [frame.segment(0, 10, k, 3) for k in range(3)] == [(0, 3), (3, 6), (6, 10)]


class Quadratic(Objective):
    def __init__(self, dim):
        rng = np.random.default_rng(2)
        q = rng.normal(size=(dim, dim))
        self.a, self.b, self.dim = q @ q.T + np.eye(dim), rng.normal(size=dim), dim

    def value(self, w):
        return 0.5 * w @ self.a @ w - self.b @ w

    def value_and_grad(self, w):
        return self.value(w), self.a @ w - self.b


def test_solver():
    target = Quadratic(12)
    w = LBFGS(tol=1e-14).run(target)
    assert np.allclose(w, np.linalg.solve(target.a, target.b), atol=1e-3)
    sparse = LBFGS(l1=0.8, tol=1e-14).run(target)
    slope = target.a @ sparse - target.b
    assert (sparse == 0).any() and np.allclose(pseudo_gradient(sparse, slope, 0.8), 0, atol=1e-2)
    assert (in_orthant(np.array([1.0, -1.0, 2.0]), np.array([-1.0, -1.0, 0.0]), np.array([0.0, 0.0, -1.0]), 1) == [0, -1, 0]).all()
    assert (two_loop(np.array([1.0, 2.0]), []) == [1, 2]).all() and LBFGS(l1=1e9).run(target).tolist() == [0] * 12


def rows_of(spark, n=80, seed=0):
    rng = np.random.default_rng(seed)
    data = []
    for k in range(n):
        x = [(int(i), float(v)) for i, v in zip(rng.choice(6, 3, replace=False), rng.normal(size=3), strict=True)]
        data.append((k, float(sum(v * (i - 2.5) for i, v in x) + rng.normal() > 0), float(1 + k % 2), x))
    return spark.createDataFrame(data, f"row_id long, label double, weight double, features {frame.FEATURES}")


def slope_error(target, w, h=1e-5):
    _, g = target.value_and_grad(w)
    return max(abs((target.value(w + h * e) - target.value(w - h * e)) / (2 * h) - (g @ e)) for e in np.eye(target.dim)[[0, target.dim // 2, target.dim - 1]])


def test_gradients_by_differences(spark):
    rng, rows = np.random.default_rng(3), rows_of(spark, 30)
    for target in (trainers.LinearObjective(rows, 0.3, base_score=0.3), trainers.LinearObjective(rows, 0.1, "linear"), trainers.FactorizationObjective(rows, 2, 0.2, 0.4)):
        assert slope_error(target, rng.normal(size=target.dim) / 3) < 1e-4


def test_logistic_like_spark_ml(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    rows, n, l2 = rows_of(spark), 80, 2.0
    model, _, _ = trainers.train_linear_lbfgs(rows, LBFGS(tol=1e-10, max_iter=40), l2=l2)
    ours = {r["index"]: r["w"] for r in model.collect()}
    dense = F.udf(lambda f: Vectors.sparse(6, sorted((x["index"], x["value"]) for x in f)), VectorUDT())
    theirs = LogisticRegression(regParam=l2 / n, standardization=False, tol=1e-10, maxIter=200).fit(rows.select("label", dense("features").alias("features")))
    assert np.allclose([ours[k] for k in range(6)], theirs.coefficients.toArray(), atol=2e-3) and abs(ours[None] - theirs.intercept) < 2e-3


def test_local_training_is_the_same_rule(spark):
    rows = rows_of(spark, 50).coalesce(1).orderBy("row_id").coalesce(1)
    conf = LearnConfig(minibatch=20, max_data_pass=1, lambda_l1=0.1)
    local = {r["index"]: r["w"] for r in trainers.train_linear_local(rows, conf).state.collect()}
    whole = {r["index"]: r["w"] for r in trainers.train_linear(rows, conf)[0].state.collect()}
    assert local.keys() == whole.keys() and all(abs(local[k] - whole[k]) < 1e-9 for k in whole)


def test_models_are_saved_and_warm_started(spark, tmp_path):
    rows = rows_of(spark, 60)
    conf = LearnConfig(minibatch=30, max_data_pass=1, lambda_l1=0.1)
    model, history = trainers.train_linear(rows, conf, validation=rows)
    assert history[0]["train"]["n_batches"] == 2 and history[0]["validation"]["n_rows"] == 60
    model.save(f"{tmp_path}/m", 3)
    back = trainers.LinearModel.load(spark, f"{tmp_path}/m", 3)
    assert sorted(map(tuple, back.state.collect())) == sorted(map(tuple, model.state.collect()))
    model.save(f"{tmp_path}/w", weights_only=True)
    assert trainers.LinearModel.load(spark, f"{tmp_path}/w").state.columns == ["index", "w"]
    from tessella.plans.lbfgs import SolverRun

    run = SolverRun(4, np.array([1.0, 2.0]), [(np.array([0.5, 0.0]), np.array([0.25, 1.0]))], 9.0, [9.0, 7.5])
    trainers.save_run(run, spark, f"{tmp_path}/s")
    back = trainers.load_run(spark, f"{tmp_path}/s")
    assert (back.iteration, back.weights.tolist(), back.first, back.trace, back.best) == (4, [1.0, 2.0], 9.0, [9.0, 7.5], None)
    assert [[x.tolist() for x in pair] for pair in back.history] == [[[0.5, 0.0], [0.25, 1.0]]] and trainers.load_run(spark, f"{tmp_path}/none") is None
    formats.write_predictions(model.transform(rows), f"{tmp_path}/p")
    assert spark.read.text(f"{tmp_path}/p").count() == 60


def test_factorization_score_and_dump(spark):
    rows = rows_of(spark, 10)
    model = spark.createDataFrame([(k, k / 10, [0.1 * k, -0.2]) for k in range(5)] + [(5, 0.5, None)], "index long, w double, v array<double>")
    got = {r["row_id"]: r["margin"] for r in factorization.score(rows, frame.triplets(rows), model, 0.25).collect()}
    w, v = {k: k / 10 for k in range(6)}, {k: [0.1 * k, -0.2] for k in range(5)}
    for r in rows.collect():
        x = {f["index"]: f["value"] for f in r["features"]}
        pairs = sum(x[i] * x[j] * sum(a * b for a, b in zip(v[i], v[j], strict=True)) for i in x for j in x if i < j and i in v and j in v)
        assert abs(got[r["row_id"]] - (0.25 + sum(w[i] * x[i] for i in x) + pairs)) < 1e-9
    lines = [r["value"] for r in factorization.dump(model, 0.25).collect()]
    assert lines[-1] == "bias\t0.25" and lines[5] == "5\t0.5"


def test_kmeans_edges(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])], "row_id long, x array<double>")
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "cluster int, centroid array<double>")
    assert {r["row_id"]: r["cluster"] for r in clustering.assign(v, c).collect()} == {0: 0, 1: 0, 2: 1, 3: 0}
    with pytest.raises(ValueError):
        clustering.fit(v, 3, 1, init=c)
    assert clustering.fit(v, 3, 1, init=c, empty="keep").count() == 3


def test_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0:2.5 18446744073709551615 7\n\n-1:0.5 3 3 \n0\n")
    rows = [(r["label"], r["weight"], [tuple(f) for f in r["features"]]) for r in formats.read_format(spark, f"{tmp_path}/a.txt", "libsvm").orderBy("row_id").collect()]
    assert rows == [(1, 1, [(0, 2.5), (-1, 1), (7, 1)]), (-1, 0.5, [(3, 1), (3, 1)]), (0, 1, [])]
    fields = ["1", "5", "", "-3", *[""] * 10, "abcdefgh", "", "short", *[""] * 22, "zzzzzzzz"]
    (tmp_path / "b.txt").write_text("\t".join(fields) + "\n")
    (tmp_path / "c.txt").write_text("\t".join(fields[1:]) + "\n")
    for name, path, label in (("criteo", "b", 1), ("criteo_test", "c", 0)):
        r = formats.read_format(spark, f"{tmp_path}/{path}.txt", name).first()
        assert r["label"] == label and [f["index"] >> 54 & 1023 for f in r["features"]] == [0, 2, 13, 38]
    (tmp_path / "d.txt").write_text("17 2 1 1048576:3 2097152:1023\n18 0 0\n")
    got = formats.read_format(spark, f"{tmp_path}/d.txt", "adfea").orderBy("row_id").collect()
    assert [r["label"] for r in got] == [1, 0] and [f["index"] for f in got[0]["features"]] == [1024 | (3 << 54), (2048 | (1023 << 54)) - 2**64]
    with pytest.raises(ValueError):
        formats.read_format(spark, "x", "none")
    formats.register_format("own", lambda s, p: s.range(3))
    assert formats.read_format(spark, "x", "own").count() == 3


def test_file_matching(spark, tmp_path):
    for n in ("part-0", "part-1", "part-10", "other"):
        (tmp_path / n).write_text("")
    names = lambda p: [f.rpartition("/")[2] for f in files.match_files(spark, f"{tmp_path}/{p}")]
    assert names("") == ["other", "part-0", "part-1", "part-10"] and names("part-1") == ["part-1", "part-10"] and names("part-[0-1]$") == ["part-0", "part-1"]
    assert files.part_of(["a", "b", "c"], 0, 2) == ["a", "c"]
    with pytest.raises(Exception):
        names("part-[")


def test_settings():
    text = """train_data = "a=b:c"  # note
    lambda_l1 : 4
    embedding { dim = 8 threshold = 10 }
    loss = SQUARE_HINGE"""
    conf = LearnConfig.load(text, minibatch=10)
    assert (conf.train_data, conf.lambda_l1, conf.embedding.dim, conf.loss, conf.minibatch) == ("a=b:c", 4, 8, L.LossKind.SQUARE_HINGE, 10)
    assert parse_text("a = 1 a = 2")["a"] == [1, 2] and parse_args(["x=1", "y=z=w"]) == {"x": 1, "y": "z=w"}
    for bad in ("a {", "}", "a ="):
        with pytest.raises(ValueError):
            parse_text(bad)
    with pytest.raises(ValueError):
        LearnConfig.load("no_such = 1")
    assert trainers.settings_of(conf)["embedding"]["dim"] == 8


def test_batches_in_another_order_each_pass(spark):
    rows = rows_of(spark, 50)
    one, ids = trainers.batch_table(rows, 20, True, 0)
    two, _ = trainers.batch_table(rows, 20, True, 1)
    of = lambda t: [sorted(r["row_id"] for r in trainers.one_batch(t, b).collect()) for b in ids]
    a, b = of(one), of(two)
    assert ids == [0, 1, 2] and a != b and sorted(sum(a, [])) == sorted(sum(b, [])) == list(range(50))
    assert set(one.columns) - {"batch_id", "batch_group"} == set(rows.columns)


def test_high_ids_are_learnt_and_written(spark, tmp_path):
    from tessella.plans import apps
    from tessella.sources import formats

    high = [-1, -(1 << 63), 5]  # the first two are 2**64 - 1 and 2**63
    data = [(k, float(k % 2), float(1 + k % 3), [(high[k % 2], 1.0), (5, 0.5)]) for k in range(60)]
    rows = spark.createDataFrame(data, f"row_id long, label double, weight double, features {frame.FEATURES}")
    model, _, _ = trainers.train_linear_lbfgs(rows, LBFGS(max_iter=10), l2=0.01)
    assert all((r["prediction"] > 0.5) == (r["label"] > 0) for r in apps.predicted(rows, model).collect())
    formats.write_format(rows, f"{tmp_path}/t", "libsvm")
    text = spark.read.text(f"{tmp_path}/t")
    assert any("18446744073709551615" in r["value"] for r in text.collect()) and not any("-" in r["value"] for r in text.collect())
    back = formats.parse_libsvm(text)
    key = lambda r: (r["label"], r["weight"], sorted((f["index"], f["value"]) for f in r["features"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, rows.collect()))


def test_solver_goes_on_from_its_state(spark, tmp_path):
    """A run that was interrupted gives the trace of one that was not: both forms, both models."""
    rows = rows_of(spark)
    linear = lambda **a: trainers.train_linear_lbfgs(rows, l2=1.0, **a)[1]
    machine = lambda **a: trainers.train_factorization_lbfgs(rows, factors=2, l2=1.0, l2_v=0.5, scale=0.3, **a)[2]
    for k, (train, tables) in enumerate(((linear, False), (linear, True), (machine, False))):
        path, make = f"{tmp_path}/{k}", lambda n: LBFGS(max_iter=n, memory=2, l1=0.1, tol=0.0)
        train(solver=make(2), state_path=path, tables=tables)
        went_on, whole = train(solver=make(4), state_path=path, tables=tables).trace, train(solver=make(4)).trace
        assert len(whole) == 5 and np.allclose(went_on, whole, rtol=1e-9)
    run = trainers.load_run(spark, f"{tmp_path}/0")
    assert run.iteration == 3 and len(run.history) == 2 and len(run.trace) == 5


def test_solver_forms_agree(spark, monkeypatch):
    """Vectors on the driver, as tables with broadcast weights, and as tables that meet entries by feature."""
    from tessella.plans import vectorfree

    rows, held = rows_of(spark), rows_of(spark, 40, 9)
    for sent, l1 in ((1 << 30, 0.0), (0, 0.7)):
        monkeypatch.setattr(vectorfree, "BROADCAST_BYTES", sent)
        traces, models = [], []
        for tables in (False, True):
            model, solver, _ = trainers.train_linear_lbfgs(rows, LBFGS(max_iter=5, memory=2, l1=l1), l2=0.3, tables=tables)
            traces.append(solver.trace)
            models.append({r["index"]: r["w"] for r in model.collect()})
        assert np.allclose(*traces, rtol=1e-9) and models[0].keys() == models[1].keys()
        assert np.allclose([models[0][k] for k in models[0]], [models[1][k] for k in models[0]], atol=1e-7)
    fits = [trainers.train_factorization_lbfgs(rows, LBFGS(max_iter=3, memory=2), held, factors=2, l2=0.5, l2_v=0.5, scale=0.3, tables=t) for t in (False, True)]
    assert np.allclose(fits[0][2].trace, fits[1][2].trace, rtol=1e-9) and abs(fits[0][1] - fits[1][1]) < 1e-8
    a, b = ({r["index"]: [r["w"], *r["v"]] for r in f[0].collect()} for f in fits)
    assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a], atol=1e-7)


def test_solver_beyond_the_driver(spark, monkeypatch):
    """Above ``MAX_DIM`` there is no error: the tables take over, with one trace."""
    rows = rows_of(spark)
    want = trainers.train_linear_lbfgs(rows, LBFGS(max_iter=3), l2=1.0)[1].trace
    monkeypatch.setattr(trainers, "MAX_DIM", 3)
    model, solver, target = trainers.train_linear_lbfgs(rows, LBFGS(max_iter=3), l2=1.0)
    assert np.allclose(solver.trace, want, rtol=1e-9) and target.n_features == 6 == model.count() - 1


def test_vector_free_step_keeps_no_shuffle_of_the_history(spark):
    from tessella.plans.vectorfree import LinearTables, run_tables

    got = run_tables(LBFGS(max_iter=2), LinearTables(rows_of(spark), l2=1.0))
    fresh = spark.range(6).select(F.col("id").alias("index"), F.rand(1).alias("h_0")).groupBy("index").agg(F.sum("h_0").alias("h_0"))
    plan = got.table.hint("merge").join(fresh, "index", "left")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_sparse_kmeans_against_dense(spark):
    from tessella.operators import clustering

    rng = np.random.default_rng(4)
    data = [(k, 0.0, 1.0, [(int(i), float(v)) for i, v in zip(rng.choice(9, 4, replace=False), rng.random(4) + 0.1, strict=True)]) for k in range(50)]
    rows = spark.createDataFrame(data, f"row_id long, label double, weight double, features {frame.FEATURES}")
    dense = np.zeros((50, 9))
    for k, _, _, f in data:
        for i, v in f:
            dense[k, i] = v
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(dense)], "row_id long, x array<double>")
    of = lambda c: np.array([r["centroid"] for r in c.orderBy("cluster").collect()])
    assert clustering.dimension(rows) == 9
    assert np.allclose(of(clustering.dense(clustering.fit_sparse(rows, 3, 3, 2, "keep"), 9)), of(clustering.fit(vectors, 3, 3, 2, empty="keep")))
    far = [(k, 0.0, 1.0, [((1 << 40) if k % 2 else -1, 2.0)]) for k in range(6)]  # -1 is 2**64 - 1
    sparse = spark.createDataFrame(far, rows.schema)
    got = clustering.fit_sparse(sparse, 2, 2, 1, "keep").collect()
    assert {r["index"] for r in got} <= {1 << 40, -1} and all(abs(r["w"] - 1) < 1e-12 for r in got if len({x["index"] for x in got if x["cluster"] == r["cluster"]}) == 1)
    assert clustering.dimension(sparse) == 1 << 64
    with pytest.raises(ValueError):
        clustering.dense(clustering.fit_sparse(sparse, 2, 1, 1, "keep"), clustering.dimension(sparse))
