"""Factorization machines over triplets: scores and gradients.

    score = X w + 1/2 sum_f ((X V)_f^2 - (X o X)(V o V)_f)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.hashing import unsigned_order, unsigned_text
from tessella.functions.losses import logistic_nll


def factors_of(model: DataFrame) -> int:
    """Length of the embeddings, read from one of them; 0 where there are none."""
    first = model.filter("v IS NOT NULL").select(F.size("v")).first()
    return first[0] if first else 0


def projections(tri: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """(row_id, y, xv, x2) for ``model`` (index, w, v): X w, the k sums of value times v, and the sum of the squares of all those terms.

    All are columns of one aggregate, so a row's entries shuffle once, whatever k is.
    """
    terms = [F.col("value") * F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)) for i in range(k)]
    return (
        tri.join(model.select("index", "w", "v"), "index")
        .groupBy("row_id")
        .agg(
            F.sum(F.col("value") * F.col("w")).alias("y"),
            F.array(*[F.sum(t) for t in terms]).cast("array<double>").alias("xv"),
            F.sum(sum((t * t for t in terms), F.lit(0.0))).alias("x2"),
        )
    )


def with_margin(rows: DataFrame, tri: DataFrame, model: DataFrame, k: int, bias: float = 0.0) -> DataFrame:
    """``rows`` with ``margin`` and ``xv``, which is null where no entry is in the model."""
    q = F.aggregate("xv", F.lit(0.0), lambda s, x: s + x * x) - F.col("x2")
    got = rows.join(projections(tri, model, k), "row_id", "left")
    return got.withColumn("margin", F.coalesce(F.col("y") + 0.5 * q, F.lit(0.0)) + bias).drop("y", "x2")


def score(rows: DataFrame, tri: DataFrame, model: DataFrame, bias: float = 0.0, k: int | None = None) -> DataFrame:
    """(row_id, margin) for ``model`` (index, w, v); without ``k`` the length of the embeddings is read from one of them."""
    k = factors_of(model) if k is None else k
    return with_margin(rows.select("row_id"), tri, model, k, bias).select("row_id", "margin")


def gradient(rows: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """(index, g, gv) for rows with their features, ``d`` and ``xv``; gv is null for features without an embedding.

    The sum over rows of d x (xv - x v) is taken as sum(d x xv) - v sum(d x x), so v meets
    the sums of its feature, not its entries, and only partial sums shuffle.
    """
    value, d = F.col("f.value"), F.col("d")
    flat = rows.select("d", "xv", F.explode("features").alias("f")).select(F.col("f.index").alias("index"), (d * value).alias("dx"), (d * value * value).alias("dxx"), "xv")
    sums = flat.groupBy("index").agg(
        F.sum("dx").alias("g"),
        F.sum("dxx").alias("sxx"),
        F.array(*[F.coalesce(F.sum(F.col("dx") * F.get("xv", F.lit(i))), F.lit(0.0)) for i in range(k)]).cast("array<double>").alias("s"),
    )
    own = F.zip_with("s", "v", lambda s, x: s - x * F.col("sxx"))
    return sums.join(model.select("index", "v"), "index", "left").select("index", "g", F.when(F.col("v").isNotNull(), own).alias("gv"))


def normalised(grad: DataFrame, least: float = 1e-10) -> DataFrame:
    """``grad`` with the whole of its ``gv`` arrays at length 1, unless the square is below ``least``."""
    n2 = grad.agg(F.coalesce(F.sum(F.aggregate("gv", F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0)).alias("n2"))  # one row
    scaled = F.when(F.col("n2") < least, F.col("gv")).otherwise(F.transform("gv", lambda x: x / F.sqrt("n2")))
    return grad.crossJoin(F.broadcast(n2)).withColumn("gv", scaled).drop("n2")


def objective(scored: DataFrame, model: DataFrame, l2: float, l2_v: float) -> DataFrame:
    """One row: weighted loss plus ridge terms of w and V (not of the bias)."""
    loss = scored.agg(F.sum(F.col("weight") * logistic_nll((F.col("label") > 0).cast("double"), F.col("margin"))).alias("loss"))
    sq = F.aggregate(F.coalesce("v", F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x * x)
    ridge = model.agg((0.5 * l2 * F.sum(F.col("w") * F.col("w")) + 0.5 * l2_v * F.sum(sq)).alias("ridge"))
    return loss.crossJoin(ridge).select((F.col("loss") + F.col("ridge")).alias("objective"))


def dump(model: DataFrame, bias: float) -> DataFrame:
    """Text rows of a model: index, w and V by tabs, the bias last."""
    line = F.concat_ws("\t", unsigned_text(F.col("index")), F.col("w").cast("string"), F.col("v").cast("array<string>"))
    last = model.sparkSession.createDataFrame([(f"bias\t{bias}",)], "value string")
    return model.orderBy(unsigned_order(F.col("index"))).select(line.alias("value")).union(last)
