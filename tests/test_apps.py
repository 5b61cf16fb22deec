"""Whole runs on small files of text."""

import numpy as np
import pytest

from tessella.plans import apps
from tessella.sources import formats


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    rng, home = np.random.default_rng(5), tmp_path_factory.mktemp("data")
    for name, n in (("part-0", 60), ("part-1", 60), ("val", 40)):
        lines = []
        for _ in range(n):
            i = rng.choice(8, 3, replace=False)
            lines.append(" ".join([str(int(sum(i) + rng.normal() > 10.5)), *[f"{k}:1.5" if k % 2 else str(k) for k in i]]))
        (home / name).write_text("\n".join(lines) + "\n")
    return home


def test_linear_saves_resumes_and_predicts(spark, data, tmp_path):
    text = f'train_data = "{data}/part.*"\nval_data = "{data}/val"\nminibatch = 60\nmax_data_pass = 2\nlambda_l1 = 0.1\nsave_iter = 1\nmodel_out = "{tmp_path}/m"'
    model, history = apps.linear(spark, text)
    assert [h["pass"] for h in history] == [0, 1] and history[0]["train"]["n_rows"] == 120 and history[1]["validation"]["logloss"] < 0.6931
    assert spark.read.parquet(f"{tmp_path}/m/iter=0").count() == 8
    apps.linear(spark, "", val_data=f"{data}/val", model_in=f"{tmp_path}/m", load_iter=0, predict_out=f"{tmp_path}/p")
    p = [float(r["value"]) for r in spark.read.text(f"{tmp_path}/p").collect()]
    assert len(p) == 40 and all(0 < x < 1 for x in p)
    with pytest.raises(ValueError):
        apps.linear(spark, "", predict_out="x")
    with pytest.raises(FileNotFoundError):
        apps.linear(spark, "", train_data=f"{data}/none")


def test_batch_tools(spark, data, tmp_path):
    apps.batch_linear(spark, f"{data}/part.*", "reg_L2=1", "max_lbfgs_iter=6", f"model_out={tmp_path}/b")
    out = apps.batch_linear(spark, f"{data}/val", "task=pred", f"model_in={tmp_path}/b", f"name_pred={tmp_path}/bp").collect()
    assert np.mean([(r["prediction"] > 0.5) == (r["label"] > 0) for r in out]) > 0.7
    apps.batch_factorization_machine(spark, f"{data}/part.*", "nfactor=2", "max_lbfgs_iter=2", "reg_L2=1", f"val_data={data}/val", f"model_out={tmp_path}/f")
    apps.batch_factorization_machine(spark, "", "task=dump", f"model_in={tmp_path}/f", f"name_dump={tmp_path}/d")
    lines = [r["value"].split("\t") for r in spark.read.text(f"{tmp_path}/d").collect()]
    assert sorted(map(len, lines)) == [2] + [4] * 8


def test_online_factorization_and_kmeans(spark, data, tmp_path):
    model, history = apps.factorization_machine(spark, "embedding { dim = 2 threshold = 5 }", train_data=f"{data}/part.*", minibatch=60, max_data_pass=1, lambda_l1=0.01, lr_eta=0.1, model_out=f"{tmp_path}/fm")
    assert history[0]["train"]["n_rows"] == 120 and model.state.filter("v IS NOT NULL").count() > 0
    apps.kmeans(spark, f"{data}/part.*", 3, 2, f"{tmp_path}/k", empty="keep", dense=True)
    rows = [list(map(float, r["value"].split())) for r in spark.read.text(f"{tmp_path}/k").collect()]
    assert len(rows) == 3 and np.allclose((np.array(rows) ** 2).sum(1), 1)
    sparse = apps.kmeans(spark, f"{data}/part.*", 3, 2, f"{tmp_path}/s", empty="keep")
    assert {(r["cluster"], r["index"]): r["w"] for r in sparse.collect()} == {(r["cluster"], r["index"]): r["w"] for r in formats.read_sparse_centroids(spark, f"{tmp_path}/s").collect()}
    got = apps.kmeans_predict(spark, f"{data}/val", f"{tmp_path}/s").collect()
    assert len(got) == 40 and {r["cluster"] for r in got} <= {0, 1, 2}


def test_lines_at_hand(spark):
    assert formats.read_lines(spark, ["1 3:2\n", "0 4\n"], formats.parse_libsvm).count() == 2
