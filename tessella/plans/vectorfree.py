"""L-BFGS without vectors on the driver: models of any dimension.

All vectors of the solver are columns of one table with a row for each feature, bucketed by
feature: weights, gradient, and a pair (step, change of gradient) for each slot of the history.
The driver holds scalars only: the products of the basis (all pairs, and the direction of
steepest descent) come from one aggregate, the two loops run on coefficients, and the direction
is one linear combination of columns.  A gradient is a grouped sum by feature, and joins the
table where its buckets lie, so the history never moves.

The bias is one more coordinate; its entries are scalars beside the table.  Settings, line
search, L1 handling and stopping are those of :class:`tessella.plans.lbfgs.LBFGS`, so both
forms give the same trace up to the order of floating-point sums.

With a ``state_path`` every iteration's table and scalars are kept there (the last two), and a
run that finds them goes on as if it had never stopped.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.hashing import seeded_normal
from tessella.functions.losses import base_score_logit, logistic_nll, sigmoid
from tessella.operators.factorization import gradient as fm_gradient
from tessella.operators.factorization import with_margin
from tessella.operators.frame import triplets
from tessella.operators.linalg import rows_t, spmv
from tessella.plans.lbfgs import LBFGS, aligned, in_orthant, pseudo_gradient
from tessella.sources.buckets import bucketed, delete, dropped, folders

#: Bytes of weights up to which they are sent to the rows; beyond that entries meet them by feature.
BROADCAST_BYTES = 32_000_000


@dataclass
class Evaluation:
    """The data loss at one point, and what its gradient needs; ``scored`` is persisted until :meth:`release`."""

    loss: float
    bias: float
    scored: DataFrame
    gradient: DataFrame

    def release(self) -> None:
        self.scored.unpersist()


class TableObjective(ABC):
    """A model whose features have ``width`` numbers each, ``w_0`` to ``w_<width - 1>``, and a bias."""

    width: int = 1
    #: Ridge strength of each of the numbers; the bias has none.
    ridge: tuple[float, ...] = (0.0,)
    bias: float = 0.0

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.rows = bucketed(rows.select("row_id", "label", "weight", "features"), "row_id", "rows")
        seen = triplets(self.rows).select("index").distinct()
        self.features = bucketed(seen, "index", "features", aligned=True)
        self.n_features = self.features.count()
        self.small = 8 * (self.width + 1) * self.n_features <= BROADCAST_BYTES
        self.entries = triplets(self.rows) if self.small else bucketed(triplets(self.rows), "index", "entries")
        self.spark: SparkSession = spark

    def initial(self) -> DataFrame:
        """(index, w_0, ...) of every feature."""
        return self.features.select("index", *[F.lit(0.0).alias(c) for c in columns("w", self.width)])

    def sent(self, weights: DataFrame) -> DataFrame:
        """Weights ready for a join with the entries: broadcast while they are small."""
        return F.broadcast(weights) if self.small else weights

    @abstractmethod
    def evaluate(self, weights: DataFrame, bias: float) -> Evaluation:
        """Loss and gradient (index, h_0, ...) of the data alone."""

    def close(self) -> None:
        for t in (self.rows, self.features, self.entries):
            dropped(t)


class LinearTables(TableObjective):
    """Logistic or squared loss of a linear model."""

    def __init__(self, rows: DataFrame, l2: float = 0.0, objective: str = "logistic", base_score: float = 0.5):
        super().__init__(rows)
        self.ridge, self.logistic, self.base = (l2,), objective == "logistic", base_score_logit(base_score)

    def evaluate(self, weights: DataFrame, bias: float) -> Evaluation:
        w = self.sent(weights.select("index", F.col("w_0").alias("w")).filter("w != 0"))
        y, label = F.coalesce("y", F.lit(0.0)) + float(bias + self.base), F.col("label")
        scored = self.rows.join(spmv(self.entries, w), "row_id", "left").withColumn("margin", y)
        p = sigmoid(F.col("margin")) if self.logistic else F.col("margin")
        loss = logistic_nll(label, F.col("margin")) if self.logistic else 0.5 * (F.col("margin") - label) ** 2
        scored = scored.select("row_id", "features", (p - label).alias("d"), loss.alias("loss")).persist()
        total, db = scored.agg(F.coalesce(F.sum("loss"), F.lit(0.0)), F.coalesce(F.sum("d"), F.lit(0.0))).first()
        return Evaluation(total, db, scored, rows_t(scored).withColumnRenamed("g", "h_0"))


class FactorizationTables(TableObjective):
    """Weighted logistic loss of a factorization machine, from a seeded start."""

    def __init__(self, rows: DataFrame, factors: int = 4, l2: float = 0.0, l2_v: float = 0.0, scale: float = 0.01, seed: int = 0):
        self.width = factors + 1
        super().__init__(rows)
        self.k, self.scale, self.seed = factors, scale, seed
        self.ridge = (l2, *[l2_v] * factors)

    def initial(self) -> DataFrame:
        return self.features.select("index", *[seeded_normal(F.col("index"), k, self.seed, self.scale).alias(c) for k, c in enumerate(columns("w", self.width))])

    def evaluate(self, weights: DataFrame, bias: float) -> Evaluation:
        model = weights.select("index", F.col("w_0").alias("w"), F.array(*columns("w", self.width)[1:]).cast("array<double>").alias("v"))
        scored = with_margin(self.rows, self.entries, self.sent(model), self.k, float(bias))
        scored = scored.withColumn("d", F.col("weight") * (sigmoid(F.col("margin")) - F.col("label"))).persist()
        loss = F.sum(F.col("weight") * logistic_nll(F.col("label"), F.col("margin")))
        total, db = scored.agg(F.coalesce(loss, F.lit(0.0)), F.coalesce(F.sum("d"), F.lit(0.0))).first()
        g = fm_gradient(scored, self.sent(model), self.k)
        return Evaluation(total, db, scored, g.select("index", F.col("g").alias("h_0"), *[F.get("gv", F.lit(k)).alias(f"h_{k + 1}") for k in range(self.k)]))


def columns(vector: str, width: int) -> list[str]:
    """Names of a vector's columns."""
    return [f"{vector}_{k}" for k in range(width)]


def _steepest(w: Column, g: Column, l1: float) -> Column:
    if l1 <= 0:
        return -g
    return F.when(w > 0, -g - l1).when(w < 0, l1 - g).when(g < -l1, -g - l1).when(g > l1, l1 - g).otherwise(0.0)


def _projected(new: Column, old: Column, steepest: Column, l1: float) -> Column:
    if l1 <= 0:
        return new
    side = F.when(old != 0, F.signum(old)).otherwise(F.signum(steepest))
    return F.when(new * side < 0, 0.0).otherwise(new)


def two_loop_coefficients(dot, order: list[int]) -> dict[str, float]:
    """Coefficients of the quasi-Newton direction in the basis p, s<slot>, y<slot>; ``order`` has the slots, oldest first."""
    c = {"p": 1.0} | {f"{v}{k}": 0.0 for v in "sy" for k in order}
    along = lambda b: sum(x * dot(a, b) for a, x in c.items() if x)
    alphas = {}
    for k in reversed(order):
        alphas[k] = along(f"s{k}") / dot(f"s{k}", f"y{k}")
        c[f"y{k}"] -= alphas[k]
    if order:
        last = order[-1]
        scale = dot(f"s{last}", f"y{last}") / dot(f"y{last}", f"y{last}")
        c = {a: x * scale for a, x in c.items()}
    for k in order:
        c[f"s{k}"] += alphas[k] - along(f"y{k}") / dot(f"s{k}", f"y{k}")
    return c


@dataclass
class SolverTables:
    """Where a run stands: the table of vectors, and every scalar."""

    table: DataFrame
    iteration: int
    now: float
    first: float
    trace: list[float]
    bias: dict[str, float]
    order: list[int] = field(default_factory=list)
    #: The slot whose pair has not been accepted or refused yet.
    fresh: int | None = None
    dots: dict[str, float] = field(default_factory=dict)

    def weights(self, width: int) -> DataFrame:
        return self.table.select("index", *columns("w", width))

    def save(self, path: str) -> None:
        """Scalars beside the table, which lies in ``path`` already; then older states go."""
        spark = self.table.sparkSession
        scalars = {k: v for k, v in self.__dict__.items() if k != "table"}
        spark.createDataFrame([(json.dumps(scalars),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/scalars/{self.iteration}")
        for old in folders(spark, f"{path}/scalars"):
            if int(old) < self.iteration - 1:
                delete(spark, f"{path}/scalars/{old}")
                delete(spark, f"{path}/vectors/{old}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SolverTables | None:
        """The last complete state, or None."""
        done = sorted(map(int, folders(spark, f"{path}/scalars")))
        if not done:
            return None
        scalars = json.loads(spark.read.text(f"{path}/scalars/{done[-1]}").first()[0])
        return SolverTables(bucketed(spark.read.parquet(f"{path}/vectors/{done[-1]}"), "index", "vectors"), **scalars)


def run_tables(solver: LBFGS, target: TableObjective, state_path: str | None = None, validate=None) -> SolverTables:
    """The minimiser found; ``solver.trace`` gets the objective of each iteration.

    ``validate(weights, bias)`` gives a loss on held-out rows: the best weights by it are
    returned, with the solver's early stopping.
    """
    width, l1, spark = target.width, solver.l1, target.spark
    w, g = columns("w", width), columns("g", width)
    ridge = [float(x) for x in target.ridge]

    def penalties(df: DataFrame, names: list[str], bias: float) -> float:
        terms = [solver.l1 * F.abs(c) + 0.5 * r * F.col(c) * F.col(c) for c, r in zip(names, ridge, strict=True)]
        return df.agg(F.coalesce(F.sum(sum(terms, F.lit(0.0))), F.lit(0.0))).first()[0] + l1 * abs(bias)

    def kept(df: DataFrame, iteration: int) -> DataFrame:
        path = f"{state_path}/vectors/{iteration}" if state_path else None
        if path:
            delete(spark, path)  # of a run that ended before its scalars were written
        return bucketed(df, "index", "vectors", aligned=True, path=path)

    def with_gradient(df: DataFrame, ev: Evaluation, new: list[Column], others: list[Column], slot: int | None) -> DataFrame:
        """The table at a new point: joined where its buckets lie."""
        both = df.join(ev.gradient, "index", "left")
        new_g = [F.coalesce(h, F.lit(0.0)) + r * x for h, r, x in zip(columns("h", width), ridge, new, strict=True)]
        pair = []
        if slot is not None:
            pair = [(x - F.col(a)).alias(f"s{slot}_{k}") for k, (x, a) in enumerate(zip(new, w, strict=True))]
            pair += [(x - F.col(a)).alias(f"y{slot}_{k}") for k, (x, a) in enumerate(zip(new_g, g, strict=True))]
        return both.select("index", *[x.alias(a) for x, a in zip(new, w, strict=True)], *[x.alias(a) for x, a in zip(new_g, g, strict=True)], *others, *pair)

    at = SolverTables.load(spark, state_path) if state_path else None
    if at is None:
        start = bucketed(target.initial(), "index", "start")
        ev = target.evaluate(start, target.bias)
        now = ev.loss + penalties(start, w, target.bias)
        table = kept(with_gradient(start, ev, [F.col(c) for c in w], [], None), -1)
        ev.release()
        dropped(start)
        at = SolverTables(table, -1, now, now, [now], {"w": target.bias, "g": ev.bias})
        if state_path:
            at.save(state_path)
    solver.trace = list(at.trace)
    best, best_loss, worse = None, np.inf, 0
    for it in range(at.iteration + 1, solver.max_iter):
        basis = [f"{v}{k}" for k in (*at.order, *([] if at.fresh is None else [at.fresh])) for v in "sy"]
        p = [_steepest(F.col(a), F.col(b), l1) for a, b in zip(w, g, strict=True)]
        vector = {b: [F.col(c) for c in columns(b, width)] for b in basis} | {"p": p}
        p_bias = float(pseudo_gradient(np.array([at.bias["w"]]), np.array([at.bias["g"]]), l1)[0])
        scalar = at.bias | {"p": p_bias}
        pairs = [("p", b) for b in basis]
        if at.fresh is not None:
            pairs += [(f"{v}{at.fresh}", b) for v in "sy" for b in basis if not (v == "y" and b == f"s{at.fresh}")]
        if pairs:  # every product that is new, in one aggregate
            sums = [F.sum(sum((x * y for x, y in zip(vector[a], vector[b], strict=True)), F.lit(0.0))) for a, b in pairs]
            for (a, b), x in zip(pairs, at.table.agg(*sums).first(), strict=True):
                at.dots["|".join(sorted((a, b)))] = (x or 0.0) + scalar[a] * scalar[b]
        dot = lambda a, b, known=at.dots: known["|".join(sorted((a, b)))]
        if at.fresh is not None and dot(f"s{at.fresh}", f"y{at.fresh}") > 0:
            at.order = [*at.order, at.fresh][-solver.memory :]
        at.fresh = None
        c = two_loop_coefficients(dot, at.order)
        raw = [sum((x * vector[b][k] for b, x in c.items()), F.lit(0.0)) for k in range(width)]
        d = [F.when(x * y > 0, x).otherwise(0.0) if l1 > 0 else x for x, y in zip(raw, p, strict=True)]
        d_bias = float(aligned(np.array([sum(x * scalar[b] for b, x in c.items())]), np.array([p_bias]), l1)[0])
        line = bucketed(at.table.select("index", *w, *[x.alias(f"p_{k}") for k, x in enumerate(p)], *[x.alias(f"d_{k}") for k, x in enumerate(d)]), "index", "line", aligned=True)
        along = line.agg(F.sum(sum((F.col(f"p_{k}") * F.col(f"d_{k}") for k in range(width)), F.lit(0.0)))).first()[0] or 0.0
        slope = -(along + p_bias * d_bias)
        if slope >= 0:
            break
        step, backoff = (1.0, solver.backoff) if it else (1 / np.sqrt(-slope), 0.1)
        found = None
        for _ in range(solver.max_line_search):
            new_bias = float(in_orthant(np.array([at.bias["w"] + step * d_bias]), np.array([at.bias["w"]]), np.array([p_bias]), l1)[0])
            point = line.select("index", *[_projected(F.col(a) + float(step) * F.col(f"d_{k}"), F.col(a), F.col(f"p_{k}"), l1).alias(a) for k, a in enumerate(w)])
            ev = target.evaluate(point, new_bias)
            value = ev.loss + penalties(point, w, new_bias)
            if value - at.now <= solver.c1 * step * slope:
                found = ev, value, new_bias
                break
            ev.release()
            step *= backoff
        if found is None:
            dropped(line)
            break
        ev, value, new_bias = found
        slot = min(set(range(solver.memory + 1)) - set(at.order))  # one more than is used, so the oldest pair stays until the new one is accepted
        others = [F.col(x) for k in at.order for v in "sy" for x in columns(f"{v}{k}", width)]
        new = [_projected(F.col(a) + float(step) * x, F.col(a), y, l1) for a, x, y in zip(w, d, p, strict=True)]
        table = kept(with_gradient(at.table, ev, new, others, slot), it)
        ev.release()
        dropped(line)
        if not state_path:
            dropped(at.table)
        bias = {b: x for b, x in at.bias.items() if b[0] in "sy"} | {"w": new_bias, "g": ev.bias, f"s{slot}": new_bias - at.bias["w"], f"y{slot}": ev.bias - at.bias["g"]}
        before = at.now
        at = SolverTables(table, it, value, at.first, [*at.trace, value], bias, at.order, slot, {k: x for k, x in at.dots.items() if f"s{slot}" not in k.split("|") and f"y{slot}" not in k.split("|")})
        solver.trace = list(at.trace)
        if state_path:
            at.save(state_path)
        if validate is not None:
            loss = validate(at.weights(width), new_bias)
            if loss < best_loss:
                dropped(best.table if best else None)
                best, best_loss, worse = SolverTables(bucketed(at.weights(width), "index", "best", aligned=True), it, value, at.first, at.trace, bias), loss, 0
            else:
                worse += 1
            if solver.early_stop and worse > solver.early_stop and it >= solver.min_iter:
                break
        if it >= solver.min_iter and before - value < solver.tol * at.first:
            break
    return best if best is not None else at
