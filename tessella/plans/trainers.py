"""Trainers: online minibatch models, batch models by L-BFGS, and boosted trees.

Online models take minibatches in order of ``batch_id``: pull by join, margins by a grouped sum,
gradients by another, push by a keyed upsert.  A folder of minibatches works on the state of its
own features and leaves it as a layer of the model (``tessella.plans.state``).  A minibatch is
two jobs: one writes the margins of its rows, from which progress is made up later, the other the
state after it.  Gradients may be taken against a state that lags by a fixed number of pushes;
then as many minibatches are under way at once, and pushes still come in order.
"""

from __future__ import annotations

import json
import tempfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.hashing import seeded_normal
from tessella.functions.losses import Loss, base_score_logit, clip, dropout, logistic_nll, sigmoid
from tessella.operators.factorization import gradient as fm_gradient
from tessella.operators.factorization import normalised, score, with_margin
from tessella.operators.frame import dictionary, downsample_negatives, minibatches, triplets, unique_index
from tessella.operators.linalg import rows_t, spmv
from tessella.operators.metrics import merged_progress, progress, whole_progress
from tessella.operators.updaters import SGD, AdaGrad, FMLinear, FTRL, Rule, activate, embedding_step, fresh_embedding, push, visible_embedding
from tessella.plans.config import LearnConfig
from tessella.plans.lbfgs import LBFGS, MAX_DIM, Objective, SolverRun
from tessella.plans.state import LayeredState
from tessella.plans.vectorfree import FactorizationTables, LinearTables, columns, run_tables
from tessella.sources.buckets import bucketed, delete, dropped, folders
from tessella.sources.files import scratch, written


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder of ``spark.checkpoint.dir``; in local mode without one, in a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return df.checkpoint()


def empty_state(spark: SparkSession, rule: Rule) -> DataFrame:
    return spark.createDataFrame([], ", ".join(["index long", *[f"{c} double" for c in rule.state]]))


def rule_of(conf: LearnConfig) -> Rule:
    make = {"sgd": SGD, "adagrad": AdaGrad, "ftrl": FTRL}[conf.algo]
    return make(alpha=conf.lr_eta or 0.1, beta=conf.lr_beta, l1=conf.lambda_l1, l2=conf.lambda_l2)


@dataclass
class LinearModel:
    """Weights by feature, with the optimiser's state."""

    state: DataFrame
    loss: Loss

    def margins(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``margin``."""
        return rows.join(spmv(triplets(rows), self.state.select("index", "w"), rows, "margin"), "row_id")

    def transform(self, rows: DataFrame, prob: bool = True) -> DataFrame:
        return self.margins(rows).withColumn("prediction", self.loss.predict(F.col("margin"), prob))

    def save(self, path: str, iteration: int = -1, weights_only: bool = False) -> None:
        """Writes ``path/last`` or ``path/iter=k``; weights that are 0 are left out of a weights-only model."""
        df = self.state.select("index", "w").filter("w != 0") if weights_only else self.state
        df.write.mode("overwrite").parquet(f"{path}/last" if iteration < 0 else f"{path}/iter={iteration}")

    @staticmethod
    def load(spark: SparkSession, path: str, iteration: int = -1, loss: Loss | None = None) -> LinearModel:
        return LinearModel(spark.read.parquet(f"{path}/last" if iteration < 0 else f"{path}/iter={iteration}"), loss or Loss())


#: Minibatches per folder of a batch table: what one batch's scan may read.
BATCHES_PER_FOLDER = 16


def batch_table(rows: DataFrame, size: int, shuffle: bool, epoch: int) -> tuple[DataFrame, list[int]]:
    """Minibatches in folders of consecutive ones, and their numbers; with ``shuffle`` rows in another order each pass.

    A minibatch reads its own folder only, so a pass is linear in its rows.
    """
    order = "row_id"
    if shuffle:
        order, rows = "__order", rows.withColumn("__order", F.xxhash64("row_id", F.lit(epoch)))
    batched = minibatches(rows, size, order)
    batched = batched.drop("__order").withColumn("batch_group", F.floor(F.col("batch_id") / BATCHES_PER_FOLDER).cast("long"))
    batched = written(batched, "batches", "batch_group")
    return batched, [r[0] for r in batched.select("batch_id").distinct().orderBy("batch_id").collect()]  # one number a batch


def one_batch(batched: DataFrame, b: int) -> DataFrame:
    return batched.filter((F.col("batch_group") == b // BATCHES_PER_FOLDER) & (F.col("batch_id") == b)).drop("batch_group")


class Scores:
    """Margins of a pass, a table for each minibatch, from which its progress is made up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, scratch(spark, "scores")

    def written(self, scored: DataFrame, b: int) -> DataFrame:
        """(row_id, label, margin) of a minibatch, written."""
        at = f"{self.path}/batch_id={b}"
        rows = scored.select("row_id", "label", "margin")
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def progress(self) -> dict:
        """The merged progress of all minibatches, in one job; the margins are deleted."""
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        out = merged_progress(progress(rows)).first().asDict()
        delete(self.spark, self.path)
        return out


def _group_of(batched: DataFrame, group: int) -> DataFrame:
    """Distinct features of a folder of minibatches."""
    return batched.filter(F.col("batch_group") == group).select(F.explode("features.index").alias("index")).distinct()


def _margins(part: DataFrame, state: DataFrame) -> DataFrame:
    """(row_id, label, margin) of rows under a state, from one join and one grouped sum."""
    flat = part.select("row_id", "label", F.explode_outer("features").alias("f")).select("row_id", "label", F.col("f.index").alias("index"), F.col("f.value").alias("value"))
    got = flat.join(state.select("index", "w"), "index", "left").groupBy("row_id")
    return got.agg(F.first("label").alias("label"), F.coalesce(F.sum(F.col("value") * F.col("w")), F.lit(0.0)).alias("margin"))


def train_linear(rows: DataFrame, conf: LearnConfig, validation: DataFrame | None = None, warm: LinearModel | None = None, stop=None, shuffle: bool = False, first_pass: int = 0, delay: int = 0) -> tuple[LinearModel, list[dict]]:
    """A linear model, and per pass the merged progress of its batches.

    ``stop(progress, is_training)`` may end training after a pass.  With ``shuffle``
    each pass, numbered from ``first_pass``, has its rows in another order.

    With ``delay`` d a minibatch's gradient is taken against the state before the last d pushes
    (fewer at the head of a folder of minibatches, where a barrier stands), so d + 1 minibatches
    are under way at once.  Pushes come in order, so the result does not depend on timing.
    """
    spark, rule, loss = rows.sparkSession, rule_of(conf), Loss(conf.loss)
    state = LayeredState(spark, ", ".join(["index long", *[f"{c} double" for c in rule.state]]), warm.state if warm else None)
    if 0 <= conf.neg_sampling < 1:
        rows = downsample_negatives(rows, F.rand(conf.rand_shuffle) >= conf.neg_sampling)
    history, t, batched, ids = [], 0, None, []
    for epoch in range(conf.max_data_pass):
        scores = Scores(spark)
        if batched is None or shuffle:
            batched, ids = batch_table(rows, conf.minibatch, shuffle, first_pass + epoch)

        def gradient(b: int, at: DataFrame, scores=scores, batched=batched) -> DataFrame:
            part = one_batch(batched, b)
            scored = scores.written(_margins(part, at), b)
            d = scored.select("row_id", loss.dual(F.col("label"), F.col("margin")).alias("d"))
            g = rows_t(part.select("row_id", "features").join(d, "row_id"))
            return bucketed(g, "index", "gradient", aligned=True) if delay else g

        with ThreadPoolExecutor(delay + 1) as pool:
            for group, own in groupby(ids, lambda b: b // BATCHES_PER_FOLDER):
                own = list(own)
                first, last = own[0], own[-1]
                pulled = state.pull(_group_of(batched, group))
                versions = {first: bucketed(pulled.select("index", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in rule.state]), "index", "working", aligned=True)}
                dropped(pulled)
                under_way: dict = {}
                for b in own:
                    t += 1
                    for ahead in range(b, min(b + delay, last) + 1):
                        if ahead not in under_way and max(first, ahead - delay) in versions:
                            under_way[ahead] = pool.submit(gradient, ahead, versions[max(first, ahead - delay)])
                    grad = under_way.pop(b).result()
                    versions[b + 1] = bucketed(push(versions[b], grad, rule, t), "index", "working", aligned=True)
                    dropped(grad)
                    for old in [k for k in versions if k < b + 1 - delay or k <= b and b == last]:
                        dropped(versions.pop(old))
                state.put(versions[last + 1])
        history.append({"pass": epoch, "train": scores.progress()})
        model = LinearModel(state.fold(), loss)
        if validation is not None:
            history[-1]["validation"] = whole_progress(model.margins(validation)).first().asDict()
        if stop and stop(history[-1], validation is None):
            break
    return LinearModel(state.fold(), loss), history


class PartitionFTRL:
    """FTRL on the minibatches of one partition: arrays that grow with the features seen."""

    def __init__(self, rule: Rule):
        self.rule, self.slot = rule, {}
        self.w, self.z, self.n, self.c = (np.zeros(1024) for _ in range(4))

    def step(self, label: np.ndarray, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> None:
        """One minibatch, given as triplets with row numbers from 0."""
        ids, inverse = np.unique(index, return_inverse=True)
        at = np.fromiter((self.slot.setdefault(i, len(self.slot)) for i in ids.tolist()), np.int64, len(ids))
        while len(self.slot) > len(self.w):
            self.w, self.z, self.n, self.c = (np.concatenate([x, np.zeros(len(x))]) for x in (self.w, self.z, self.n, self.c))
        w, z, n = self.w[at], self.z[at], self.n[at]
        margin = np.bincount(row, value * w[inverse], len(label))
        y = np.where(label > 0, 1.0, -1.0)
        dual = -y / (1 + np.exp(np.minimum(y * margin, 500)))
        g = np.bincount(inverse, value * dual[row], len(ids))
        n2 = np.sqrt(n * n + g * g)
        z = z + g - (n2 - n) / self.rule.alpha * w
        over = np.maximum(np.abs(z) - self.rule.l1, 0)
        self.w[at] = -np.sign(z) * over / ((self.rule.beta + n2) / self.rule.alpha + self.rule.l2)
        self.z[at], self.n[at] = z, n2
        self.c[at] += np.bincount(inverse, minlength=len(ids))


def train_linear_local(rows: DataFrame, conf: LearnConfig) -> LinearModel:
    """FTRL with logistic loss within each partition, weights averaged by how often a partition saw the feature.

    One pass and one job, in numpy on Arrow batches: for data where a job per minibatch
    costs too much.  Rows keep their partitions, so nothing moves but the models.
    """
    rule, size = rule_of(conf), conf.minibatch
    if conf.algo != "ftrl" or conf.loss.value != "logit":
        raise ValueError("the local mode has FTRL with logistic loss")

    def run(batches):
        model = PartitionFTRL(rule)
        for b in batches:
            for k in range(0, b.num_rows, size):
                part = b.slice(k, size)
                features = part.column(1)
                flat = features.flatten()
                index, value = (flat.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                row = np.repeat(np.arange(part.num_rows), np.diff(features.offsets.to_numpy()))
                if len(index):
                    model.step(part.column(0).to_numpy(zero_copy_only=False), row, index, value)
        ids = np.fromiter(model.slot, np.int64, len(model.slot))
        yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(x[: len(ids)]) for x in (model.w, model.c)]], names=["index", "w", "c"])

    own = rows.select("label", "features").mapInArrow(run, "index long, w double, c double")
    return LinearModel(checkpointed(own.groupBy("index").agg((F.sum(F.col("w") * F.col("c")) / F.sum("c")).alias("w"))), Loss(conf.loss))


@dataclass
class FactorizationModel:
    """Per feature: count, w, z, n, and embedding v with its sums vn, null where there is none."""

    state: DataFrame
    conf: LearnConfig

    def margins(self, rows: DataFrame) -> DataFrame:
        model = self.state.select("index", "w", visible_embedding(F.col("w"), F.col("v"), self.conf.l1_shrk).alias("v"))
        return with_margin(rows, triplets(rows), model, self.conf.embedding.dim).drop("xv")

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.margins(rows).withColumn("prediction", sigmoid(F.col("margin")) if self.conf.prob_predict else F.col("margin"))

    def save(self, path: str) -> None:
        self.state.write.mode("overwrite").parquet(path)


_FM_STATE = "index long, cnt long, w double, z double, n double, v array<double>, vn array<double>"


def fm_step(state: DataFrame, part: DataFrame, conf: LearnConfig, count_features: bool, seed: int = 1) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One minibatch: count, activate, pull, step, activate where w left 0.  The new state, the scored rows, and what to unpersist after."""
    e, tri = conf.embedding, triplets(part).persist()
    alpha, beta = conf.lr_eta or 0.01, conf.lr_beta
    counts = unique_index(tri) if count_features else unique_index(tri).withColumn("count", F.lit(0).cast("long"))
    s = state.join(counts, "index", "full_outer").select(
        "index", (F.coalesce("cnt", F.lit(0)) + F.coalesce("count", F.lit(0))).alias("cnt"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("w", "z", "n")], "v", "vn", F.col("count").isNotNull().alias("here")
    )
    fresh, zeros = fresh_embedding(F.col("index"), e.dim, e.init_scale, seed), F.array(*[F.lit(0.0)] * e.dim)

    def activated(df: DataFrame, when) -> DataFrame:
        if not e.dim:
            return df
        on = when & activate(F.col("cnt"), F.col("w"), F.col("v"), e.threshold, conf.l1_shrk)
        return df.withColumn("__on", on).withColumn("vn", F.when(F.col("__on"), zeros).otherwise(F.col("vn"))).withColumn("v", F.when(F.col("__on"), fresh).otherwise(F.col("v"))).drop("__on")

    s = activated(s, F.col("here")).persist()
    held = [tri, s]
    seen_v = visible_embedding(F.col("w"), F.col("v"), conf.l1_shrk)
    model = s.filter("here").select("index", "w", seen_v.alias("v"))
    scored = with_margin(part, tri, model, e.dim).persist()
    held.append(scored)
    grad = fm_gradient(scored.withColumn("d", Loss().dual(F.col("label"), F.col("margin"))), model, e.dim)
    rule = FMLinear(alpha=alpha, beta=beta, l1=conf.lambda_l1, l2=conf.lambda_l2)
    new = rule.update(F.col("g"), 0)
    if e.dim:
        kept = F.array(*[dropout(clip(F.get("gv", F.lit(i)), e.grad_clipping), e.dropout, seed + i) for i in range(e.dim)])
        grad = grad.withColumn("gv", F.when(F.col("gv").isNotNull(), kept))
        grad = normalised(grad) if e.grad_normalization > 0 else grad
    s = s.join(grad, "index", "left")
    if e.dim:
        v2, vn2 = embedding_step(F.col("v"), F.col("vn"), F.col("gv"), e.lr_eta or alpha, e.lr_beta or beta, e.lambda_l2)
        moved = F.col("gv").isNotNull()
        s = s.withColumn("__v", F.when(moved, v2).otherwise(F.col("v"))).withColumn("vn", F.when(moved, vn2).otherwise(F.col("vn"))).withColumn("v", F.col("__v"))
    was_zero = F.col("w") == 0
    s = s.select("index", "cnt", was_zero.alias("was"), *[F.when(F.col("g").isNull(), F.col(c)).otherwise(new[c]).alias(c) for c in ("w", "z", "n")], "v", "vn")
    s = activated(s, F.col("was") & (F.col("w") != 0))
    return s.select("index", "cnt", "w", "z", "n", "v", "vn"), scored, held


def train_factorization(rows: DataFrame, conf: LearnConfig, validation: DataFrame | None = None, warm: FactorizationModel | None = None, shuffle: bool = False) -> tuple[FactorizationModel, list[dict]]:
    """A factorization machine whose embeddings appear as features are seen often enough.

    Stops where the training loss per example passes ``max_objv``, or, with
    ``early_stop``, where a pass lowers the validation loss by less than ``min_objv_decr``.
    """
    spark = rows.sparkSession
    state = LayeredState(spark, _FM_STATE, warm.state if warm else None)
    history, before, batched, ids = [], 100.0, None, []
    for epoch in range(conf.max_data_pass):
        scores = Scores(spark)
        if batched is None or shuffle:
            batched, ids = batch_table(rows, conf.minibatch, shuffle, epoch)
        for group, own in groupby(ids, lambda b: b // BATCHES_PER_FOLDER):
            work = state.pull(_group_of(batched, group))
            for b in own:
                new, scored, kept = fm_step(work.filter("cnt IS NOT NULL"), one_batch(batched, b), conf, count_features=epoch == 0 and conf.embedding.dim > 0)
                scores.written(scored, b)
                old, work = work, bucketed(new, "index", "working", aligned=True)
                for x in kept:
                    x.unpersist()
                dropped(old)
            state.put(work)
        history.append({"pass": epoch, "train": scores.progress()})
        model = FactorizationModel(state.fold(), conf)
        if conf.max_objv is not None and history[-1]["train"]["logloss"] > conf.max_objv:
            break
        if validation is not None:
            got = whole_progress(model.margins(validation)).first().asDict()
            history[-1]["validation"] = got
            if conf.early_stop and before - got["logloss"] < conf.min_objv_decr:
                break
            before = got["logloss"]
    return FactorizationModel(state.fold(), conf), history


def _with_local_ids(rows: DataFrame, dic: DataFrame) -> DataFrame:
    """``rows`` with their features by dense id; those that the dictionary lacks are dropped."""
    flat = rows.select("row_id", "label", "weight", F.explode_outer("features").alias("f")).withColumn("index", F.col("f.index"))
    entry = F.when(F.col("local_id").isNotNull(), F.struct(F.col("local_id").alias("index"), F.col("f.value").alias("value")))
    found = flat.join(dic.select("index", "local_id"), "index", "left").groupBy("row_id")
    return found.agg(F.first("label").alias("label"), F.first("weight").alias("weight"), F.collect_list(entry).alias("features"))


def _local(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows with dense ids, the dictionary, and the dimension.

    Rows keep their features, so a gradient carries each row's slope along and only sums shuffle.
    """
    dic = dictionary(triplets(rows)).persist()
    return _with_local_ids(rows, dic).persist(), dic, dic.count()


class LinearObjective(Objective):
    """Logistic or squared loss of a linear model with a bias, the last coordinate.

    Sums over examples, plus l2/2 |w|^2 without the bias.  The weights, MAX_DIM numbers at most,
    are broadcast; a partition sums within its rows and returns one row a feature that it has,
    so no example is shuffled.  Examples without a label add nothing.
    """

    def __init__(self, rows: DataFrame, l2: float = 0.0, objective: str = "logistic", base_score: float = 0.5):
        self.rows, self.dictionary, n = _local(rows)
        self.dim, self.l2, self.logistic = n + 1, l2, objective == "logistic"
        self.base = base_score_logit(base_score)

    def _sums(self, w: np.ndarray, gradient: bool) -> np.ndarray:
        """The gradient of the sum over examples, if asked for, and behind it the sum itself."""
        logistic, base, dim = self.logistic, float(w[-1]) + self.base, self.dim
        shared = self.rows.sparkSession.sparkContext.broadcast(w)

        def run(batches):
            w, out = shared.value, np.zeros(dim + 1)
            for b in batches:
                b = b.filter(b.column(0).is_valid())
                label, entries = b.column(0).to_numpy(), b.column(1)
                at, value = (x.to_numpy(zero_copy_only=False) for x in entries.flatten().flatten())
                row, value = np.repeat(np.arange(len(label)), entries.value_lengths().to_numpy()), np.nan_to_num(value)
                m = np.bincount(row, w[at] * value, len(label)) + base
                if logistic:
                    e = np.exp(-np.abs(m))
                    out[dim] += (label * np.logaddexp(0, -m) + (1 - label) * np.logaddexp(0, m)).sum()
                    d = np.where(m >= 0, 1 / (1 + e), e / (1 + e)) - label
                else:
                    d = m - label
                    out[dim] += 0.5 * (d * d).sum()
                if gradient:
                    np.add.at(out, at, d[row] * value)
                    out[dim - 1] += d.sum()
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["index", "g"])

        given = self.rows.select(F.col("label").cast("double").alias("label"), F.col("features").cast("array<struct<index:long,value:double>>").alias("features"))
        sums = given.mapInArrow(run, "index long, g double").groupBy("index").agg(F.sum("g").alias("g")).toArrow()
        shared.destroy()
        out = np.zeros(dim + 1)
        out[sums["index"].to_numpy()] = sums["g"].to_numpy()
        return out

    def _ridge(self, w: np.ndarray) -> float:
        return 0.5 * self.l2 * float(w[:-1] @ w[:-1])

    def value(self, w: np.ndarray) -> float:
        return float(self._sums(w, False)[-1]) + self._ridge(w)

    def value_and_grad(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        sums = self._sums(w, True)
        out = sums[:-1]
        out[:-1] += self.l2 * w[:-1]
        return float(sums[-1]) + self._ridge(w), out


def train_linear_lbfgs(rows: DataFrame, solver: LBFGS | None = None, l2: float = 0.0, objective: str = "logistic", base_score: float = 0.5, state_path: str | None = None, tables: bool = False) -> tuple[DataFrame, LBFGS, LinearObjective | LinearTables]:
    """(index, w) with the bias in the row without an index; the solver with its trace; the objective.

    With ``state_path`` each iteration's state is saved there, and a run that finds some goes on from it.
    Models beyond ``MAX_DIM``, or all with ``tables``, keep their vectors as tables; the result is the same.
    """
    solver, spark = solver or LBFGS(), rows.sparkSession
    target = None if tables else LinearObjective(rows, l2, objective, base_score)
    if target is None or target.dim > MAX_DIM:
        big = LinearTables(rows, l2, objective, base_score)
        got = run_tables(solver, big, state_path)
        model, bias = got.weights(1).select("index", F.col("w_0").alias("w")), got.bias["w"]
        return model.union(spark.createDataFrame([(None, float(bias + big.base))], "index long, w double")), solver, big
    w = resumed(solver, target, state_path)
    local = spark.createDataFrame(pa.table({"local_id": np.arange(len(w) - 1), "w": w[:-1]}))
    model = target.dictionary.join(local, "local_id").select("index", "w")
    return model.union(spark.createDataFrame([(None, float(w[-1] + target.base))], "index long, w double")), solver, target


class FactorizationObjective(Objective):
    """Weighted logistic loss of a factorization machine: w, then V by rows, then the bias."""

    def __init__(self, rows: DataFrame, factors: int = 4, l2: float = 0.0, l2_v: float = 0.0, scale: float = 0.01, seed: int = 0):
        self.rows, self.dictionary, self.n = _local(rows)
        self.tri = triplets(self.rows)
        self.k, self.l2, self.l2_v, self.scale, self.seed = factors, l2, l2_v, scale, seed
        self.dim = self.n * (factors + 1) + 1

    def initial(self) -> np.ndarray:
        """Seeded numbers of each feature, the same in every form; the bias starts at 0."""
        draws = [seeded_normal(F.col("index"), k, self.seed, self.scale).alias(f"w_{k}") for k in range(self.k + 1)]
        t = self.dictionary.select("local_id", *draws).toArrow().sort_by("local_id")  # a row a feature, MAX_DIM numbers at most
        w = np.stack([t[f"w_{k}"].to_numpy() for k in range(self.k + 1)], 1)
        return np.concatenate([w[:, 0], w[:, 1:].ravel(), [0.0]])

    def _model(self, w: np.ndarray) -> DataFrame:
        v = w[self.n : -1].reshape(self.n, self.k)
        rows = pa.ListArray.from_arrays(np.arange(0, self.n * self.k + 1, self.k or 1, dtype=np.int32)[: self.n + 1], v.ravel()) if self.k else pa.array([[]] * self.n, pa.list_(pa.float64()))
        return self.rows.sparkSession.createDataFrame(pa.table({"index": np.arange(self.n), "w": w[: self.n], "v": rows}))

    def _ridge(self, w: np.ndarray) -> float:
        a, b = w[: self.n], w[self.n : -1]
        return 0.5 * self.l2 * float(a @ a) + 0.5 * self.l2_v * float(b @ b)

    def value(self, w: np.ndarray) -> float:
        scored = with_margin(self.rows, self.tri, self._model(w), self.k, float(w[-1]))
        return scored.agg(F.sum(F.col("weight") * logistic_nll(F.col("label"), F.col("margin")))).first()[0] + self._ridge(w)

    def value_and_grad(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        model = self._model(w)
        scored = with_margin(self.rows, self.tri, model, self.k, float(w[-1]))
        scored = scored.withColumn("d", F.col("weight") * (sigmoid(F.col("margin")) - F.col("label"))).persist()
        total, bias = scored.agg(F.sum(F.col("weight") * logistic_nll(F.col("label"), F.col("margin"))), F.sum("d")).first()
        g = fm_gradient(scored, model, self.k).toArrow()  # one row a feature, MAX_DIM numbers at most
        out, at = np.zeros(self.dim), g["index"].to_numpy()
        out[at] = g["g"].to_numpy()
        out[self.n : -1].reshape(self.n, self.k)[at] = g["gv"].combine_chunks().flatten().to_numpy().reshape(len(at), self.k)
        out[: self.n] += self.l2 * w[: self.n]
        out[self.n : -1] += self.l2_v * w[self.n : -1]
        out[-1] = bias
        scored.unpersist()
        return total + self._ridge(w), out


def train_factorization_lbfgs(rows: DataFrame, solver: LBFGS | None = None, validation: DataFrame | None = None, state_path: str | None = None, tables: bool = False, **settings) -> tuple[DataFrame, float, LBFGS]:
    """(index, w, v), the bias, and the solver; with ``validation`` the best weights by its mean loss.

    ``state_path`` and ``tables`` are as for linear models.
    """
    solver, target = solver or LBFGS(), None if tables else FactorizationObjective(rows, **settings)
    mean_loss = lambda rows, model, bias, k: rows.join(score(rows, triplets(rows), model, bias, k), "row_id").agg(F.avg(logistic_nll(F.col("label"), F.col("margin")))).first()[0]
    if target is None or target.dim > MAX_DIM:
        big = FactorizationTables(rows, **settings)
        named = lambda t: t.select("index", F.col("w_0").alias("w"), F.array(*columns("w", big.width)[1:]).cast("array<double>").alias("v"))
        check = None if validation is None else lambda t, bias: mean_loss(validation, named(t), bias, big.k)
        got = run_tables(solver, big, state_path, check)
        return named(got.table), got.bias["w"], solver
    validate = None
    if validation is not None:
        held = _with_local_ids(validation, target.dictionary).persist()
        validate = lambda w: mean_loss(held, target._model(w), float(w[-1]), target.k)
    w = resumed(solver, target, state_path, validate)
    local = target._model(w).withColumnRenamed("index", "local_id")
    return target.dictionary.join(local, "local_id").select("index", "w", "v"), float(w[-1]), solver


def save_run(run: SolverRun, spark: SparkSession, path: str) -> None:
    """Weights and history as one table, a row a coordinate; the scalars beside it, written last.  Older runs go."""
    pairs = {f"{v}{k}": x for k, pair in enumerate(run.history) for v, x in zip("sy", pair, strict=True)}
    vectors = {"index": np.arange(len(run.weights)), "w": run.weights, **pairs, **({} if run.best is None else {"best": run.best})}
    spark.createDataFrame(pa.table(vectors)).write.mode("overwrite").parquet(f"{path}/vectors/{run.iteration}")
    scalars = {"iteration": run.iteration, "first": run.first, "trace": run.trace, "pairs": len(run.history), "best_loss": run.best_loss, "worse": run.worse}
    spark.createDataFrame([(json.dumps(scalars),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/scalars/{run.iteration}")
    for old in folders(spark, f"{path}/scalars"):
        if int(old) < run.iteration - 1:
            delete(spark, f"{path}/scalars/{old}")
            delete(spark, f"{path}/vectors/{old}")


def load_run(spark: SparkSession, path: str) -> SolverRun | None:
    """The last complete run saved in ``path``, or None."""
    done = sorted(map(int, folders(spark, f"{path}/scalars")))
    if not done:
        return None
    scalars = json.loads(spark.read.text(f"{path}/scalars/{done[-1]}").first()[0])
    t = spark.read.parquet(f"{path}/vectors/{done[-1]}").toArrow().sort_by("index")  # a row a coordinate, MAX_DIM at most
    x = {c: t[c].to_numpy() for c in t.column_names}
    history = [(x[f"s{k}"], x[f"y{k}"]) for k in range(scalars.pop("pairs"))]
    return SolverRun(weights=x["w"], history=history, best=x.get("best"), **scalars)


def resumed(solver: LBFGS, target: Objective, path: str | None, validate=None) -> np.ndarray:
    """Runs the solver; with ``path`` from the run saved there, if any, and saving each iteration's."""
    if path is None:
        return solver.run(target, validate=validate)
    spark = SparkSession.getActiveSession()
    return solver.run(target, validate=validate, each=lambda run: save_run(run, spark, path), before=load_run(spark, path))


def train_boosted_trees(df: DataFrame, features: list[str], label: str = "label", **settings):
    """Spark's own gradient-boosted trees on dense columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), GBTClassifier(featuresCol="__x", labelCol=label, **settings)]).fit(df)


def settings_of(conf: LearnConfig) -> dict:
    """Settings as plain values, for saving beside a model."""
    return {k: v.value if hasattr(v, "value") else v for k, v in asdict(conf).items()}
