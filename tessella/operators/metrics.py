"""Binary metrics over (label, margin) rows, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.losses import sigmoid, sign_label, softplus

#: Ranges of a group's scores that the AUC sums up apart.
SCORE_RANGES = 256


def logit_objective(label: Column, m: Column) -> Column:
    return F.sum(softplus(-sign_label(label) * m))


def log_loss(label: Column, p: Column, least: float = 1e-10) -> Column:
    """Summed; probabilities are kept off both ends."""
    p = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return -F.sum(F.when(label > 0, F.ln(p)).otherwise(F.ln(1 - p)))


def accuracy(label: Column, m: Column, threshold: float = 0.0, folded: bool = False) -> Column:
    a = F.avg(F.when((label > 0) == (m > threshold), F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.greatest(a, 1 - a) if folded else a


def copc(label: Column, m: Column) -> Column:
    """Clicks over the sum of predicted probabilities."""
    return F.sum((label > 0).cast("double")) / F.sum(sigmoid(m))


def fold(a: Column) -> Column:
    return F.when(a < 0.5, 1 - a).otherwise(a)


def auc(df: DataFrame, score: str = "margin", label: str = "label", by: list[str] | None = None, folded: bool = False, digits: int | None = None) -> DataFrame:
    """Area under the curve per group; ties count one half; 1 where one class is missing.

    Rows are summed per distinct score first.  Each group's scores fall into ranges about as
    even as quantiles make them; ranges are summed apart and shifted by the ranges before,
    of which a group has :data:`SCORE_RANGES` at most, so no task needs a group's scores.
    """
    by = by or []
    s = F.col(score) if digits is None else F.round(F.col(score), digits)
    per = df.groupBy(*by, s.alias("s")).agg(F.sum((F.col(label) > 0).cast("double")).alias("p"), F.sum((F.col(label) <= 0).cast("double")).alias("n"))
    edges = per.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.percentile_approx("s", F.array(*[F.lit(k / SCORE_RANGES) for k in range(1, SCORE_RANGES)])).alias("edges"))
    # A score's range in two steps: which run of edges, then where in it.
    run = int(SCORE_RANGES**0.5)
    heads = F.transform(F.sequence(F.lit(run), F.lit(SCORE_RANGES - 1), F.lit(run)), lambda k: F.get("edges", k - 1))
    edges, below = edges.withColumn("heads", heads), lambda x: F.size(F.filter(x, lambda e: e < F.col("s")))
    per = per.join(edges, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).drop(*[f"__{c}" for c in by]) if by else per.join(F.broadcast(edges))  # one row
    start = run * below("heads")
    per = per.withColumn("r", start + below(F.slice("edges", start + 1, F.lit(run)))).drop("edges", "heads")
    ranges = per.groupBy(*[F.col(c).alias(f"__{c}") for c in by], F.col("r").alias("__r")).agg(F.sum("n").alias("rn"))
    all_before = Window.partitionBy(*[f"__{c}" for c in by]).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("shift", F.coalesce(F.sum("rn").over(all_before), F.lit(0.0))).drop("rn")
    before = Window.partitionBy(*by, "r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    summed = per.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    same = [F.col("r") == F.col("__r"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]]
    summed = summed.join(ranges if by else F.broadcast(ranges), same).withColumn("below", F.col("below") + F.col("shift"))
    area = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))
    a = F.when((F.sum("p") == 0) | (F.sum("n") == 0), F.lit(1.0)).otherwise(area)
    return summed.groupBy(*by).agg((fold(a) if folded else a).alias("auc"))


def progress(df: DataFrame, by: str = "batch_id") -> DataFrame:
    """Per batch: rows, objective, folded accuracy and folded AUC."""
    own = df.groupBy(by).agg(F.count("*").alias("n"), logit_objective(F.col("label"), F.col("margin")).alias("objv"), accuracy(F.col("label"), F.col("margin"), folded=True).alias("acc"))
    return own.join(auc(df, by=[by], folded=True, digits=9), by)


def merged_progress(per_batch: DataFrame) -> DataFrame:
    """What a report shows: loss per example, and accuracy and AUC as means over batches."""
    return per_batch.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_batches"), (F.sum("objv") / F.sum("n")).alias("logloss"), F.avg("acc").alias("acc"), F.avg("auc").alias("auc"))


def whole_progress(df: DataFrame) -> DataFrame:
    """The report of rows that are no batches, such as held-out ones: one group, whatever its size."""
    y, m = F.col("label"), F.col("margin")
    own = df.agg(F.count("*").alias("n_rows"), F.lit(1).cast("long").alias("n_batches"), (logit_objective(y, m) / F.count("*")).alias("logloss"), accuracy(y, m, folded=True).alias("acc"))
    return own.crossJoin(auc(df, folded=True, digits=9))
