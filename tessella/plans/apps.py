"""Whole runs from settings: read, train, validate, save, predict.

Each takes the settings of its tool, as text, keyword arguments or ``name=value``
arguments, and works on paths that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.losses import sigmoid
from tessella.operators import clustering, factorization
from tessella.operators.frame import triplets
from tessella.operators.linalg import spmv
from tessella.plans import trainers
from tessella.plans.config import LearnConfig, parse_args
from tessella.plans.lbfgs import LBFGS
from tessella.sources.files import match_files
from tessella.sources.formats import read_format, read_sparse_centroids, write_centroids, write_predictions, write_sparse_centroids


def examples(spark: SparkSession, pattern: str, name: str) -> DataFrame:
    """Rows of all files that match; see :func:`match_files`."""
    found = match_files(spark, pattern)
    if not found:
        raise FileNotFoundError(f"no file matches {pattern}")
    return read_format(spark, found, name)


def _passes(train, conf: LearnConfig, begin: int, saved):
    """Trains pass by pass, saving every ``save_iter`` passes and at the end."""
    model, history = None, []
    for k in range(begin, conf.max_data_pass):
        model, got = train(model, k)
        history.append(got[-1] | {"pass": k})
        last = k == conf.max_data_pass - 1
        if conf.model_out and conf.save_iter > 0 and (k + 1) % conf.save_iter == 0 and not last:
            saved(model, k)
    if conf.model_out and model is not None:
        saved(model, -1)
    return model, history


def linear(spark: SparkSession, text: str = "", **over) -> tuple[trainers.LinearModel | None, list[dict]]:
    """Online linear model.  With ``predict_out`` it only predicts, with ``load_iter`` it resumes after that pass.

    ``max_concurrency`` minibatches are under way at once, each against the state before the others' pushes.
    """
    conf = LearnConfig.load(text, **over)
    warm = trainers.LinearModel.load(spark, conf.model_in, conf.load_iter, trainers.Loss(conf.loss)) if conf.model_in else None
    if conf.predict_out:
        if warm is None:
            raise ValueError("predict_out needs model_in")
        write_predictions(warm.transform(examples(spark, conf.val_data or conf.train_data, conf.data_format), conf.prob_predict), conf.predict_out)
        return warm, []
    rule = trainers.rule_of(conf)
    if warm is not None:  # a weights-only model starts with a fresh optimiser
        have = warm.state.columns
        warm.state = warm.state.select("index", *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in rule.state])
    rows = examples(spark, conf.train_data, conf.data_format).persist()
    held = examples(spark, conf.val_data, conf.data_format).persist() if conf.val_data else None
    one = LearnConfig.load("", **(trainers.settings_of(conf) | {"max_data_pass": 1, "embedding": conf.embedding}))
    return _passes(lambda m, k: trainers.train_linear(rows, one, held, m or warm, shuffle=conf.rand_shuffle > 0, first_pass=k, delay=max(1, conf.max_concurrency) - 1), conf, conf.load_iter + 1 if conf.load_iter > 0 else 0, lambda m, k: m.save(conf.model_out, k))


def factorization_machine(spark: SparkSession, text: str = "", **over) -> tuple[trainers.FactorizationModel, list[dict]]:
    """Online factorization machine."""
    conf = LearnConfig.load(text, **over)
    warm = trainers.FactorizationModel(spark.read.parquet(conf.model_in), conf) if conf.model_in else None
    if conf.predict_out:
        if warm is None:
            raise ValueError("predict_out needs model_in")
        write_predictions(warm.transform(examples(spark, conf.val_data or conf.train_data, conf.data_format)), conf.predict_out)
        return warm, []
    rows = examples(spark, conf.train_data, conf.data_format).persist()
    held = examples(spark, conf.val_data, conf.data_format).persist() if conf.val_data else None
    model, history = trainers.train_factorization(rows, conf, held, warm, conf.rand_shuffle > 0)
    if conf.model_out:
        model.save(conf.model_out)
    return model, history


def _solver(args: dict) -> LBFGS:
    names = {"size_memory": "memory", "reg_L1": "l1", "max_linesearch_iter": "max_line_search", "linesearch_backoff": "backoff", "linesearch_c1": "c1", "min_lbfgs_iter": "min_iter", "max_lbfgs_iter": "max_iter", "lbfgs_stop_tol": "tol", "early_stop": "early_stop"}
    return LBFGS(**{v: args[k] for k, v in names.items() if k in args})


def predicted(rows: DataFrame, model: DataFrame, objective: str = "logistic") -> DataFrame:
    """``rows`` with margin and prediction by a batch model, whose row without an index is the bias; any 64-bit id counts."""
    bias = model.filter("index IS NULL").first()["w"]
    margin = rows.join(spmv(triplets(rows), model.filter("index IS NOT NULL"), rows, "margin"), "row_id").withColumn("margin", F.col("margin") + bias)
    return margin.withColumn("prediction", sigmoid(F.col("margin")) if objective == "logistic" else F.col("margin"))


def batch_linear(spark: SparkSession, data: str, *args: str) -> DataFrame:
    """Linear or logistic regression by L-BFGS; ``task=pred`` predicts with ``model_in``."""
    a = {"objective": "logistic", "base_score": 0.5, "reg_L2": 0.0, "task": "train", "model_out": "final.model", "name_pred": "pred.txt"} | parse_args(list(args))
    rows = examples(spark, data, "libsvm").persist()
    if a["task"] == "pred":
        out = predicted(rows, spark.read.parquet(a["model_in"]), a["objective"])
        write_predictions(out, a["name_pred"])
        return out
    model, _, _ = trainers.train_linear_lbfgs(rows, _solver(a), l2=float(a["reg_L2"]), objective=a["objective"], base_score=a["base_score"])
    model.write.mode("overwrite").parquet(a["model_out"])
    return model


def batch_factorization_machine(spark: SparkSession, data: str, *args: str) -> tuple[DataFrame, float]:
    """Factorization machine by L-BFGS; ``task=dump`` writes ``model_in`` as text to ``name_dump``."""
    a = {"nfactor": 4, "reg_L2": 0.0, "reg_L2_V": 0.0, "fm_random": 0.01, "task": "train", "model_out": "final.model"} | parse_args(list(args))
    if a["task"] == "dump":
        both = spark.read.parquet(a["model_in"])
        bias, model = both.filter("index IS NULL").first()["w"], both.filter("index IS NOT NULL")
        factorization.dump(model, bias).write.text(a["name_dump"])
        return model, bias
    held = examples(spark, a["val_data"], "libsvm") if "val_data" in a else None
    model, bias, _ = trainers.train_factorization_lbfgs(examples(spark, data, "libsvm").persist(), _solver(a), held, factors=a["nfactor"], l2=float(a["reg_L2"]), l2_v=float(a["reg_L2_V"]), scale=a["fm_random"])
    model.unionByName(spark.createDataFrame([(None, bias, None)], "index long, w double, v array<double>")).write.mode("overwrite").parquet(a["model_out"])
    return model, bias


def kmeans(spark: SparkSession, data: str, k: int, max_iter: int, out: str | None = None, empty: str = "error", seed: int = 0, dense: bool = False) -> DataFrame:
    """Spherical k-means of sparse rows: (cluster, index, w).

    Where ``out`` is given, they are written as text, one stored entry a line; with ``dense``
    as a matrix, one centroid a line, which ids of hashed features are too large for.
    """
    rows = examples(spark, data, "libsvm")
    centroids = clustering.fit_sparse(rows, k, max_iter, seed, empty)
    if out and dense:
        write_centroids(clustering.dense(centroids, clustering.dimension(rows)), out)
    elif out:
        write_sparse_centroids(centroids, out)
    return centroids


def kmeans_predict(spark: SparkSession, data: str, model_in: str) -> DataFrame:
    """Rows with the cluster that the centroids of a text file give them."""
    centroids = read_sparse_centroids(spark, model_in)
    k = centroids.agg(F.max("cluster")).first()[0] + 1
    return clustering.assign_sparse(examples(spark, data, "libsvm"), centroids, k)
