"""Products of a sparse matrix, given as triplets, with vectors and narrow matrices.

Each is an equi-join and a grouped sum with map-side combining; Spark picks the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spmv(tri: DataFrame, w: DataFrame, rows: DataFrame | None = None, out: str = "y") -> DataFrame:
    """(row_id, y): y = D w for ``w`` (index, w).  With ``rows`` each of its ids is there, at 0 where nothing matched."""
    got = tri.join(w, "index").groupBy("row_id").agg(F.sum(F.col("value") * F.col("w")).alias(out))
    return got if rows is None else rows.select("row_id").join(got, "row_id", "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def spmv_t(tri: DataFrame, d: DataFrame, by: str = "d", out: str = "g") -> DataFrame:
    """(index, g): g = D' d for ``d`` (row_id, d)."""
    return tri.join(d, "row_id").groupBy("index").agg(F.sum(F.col("value") * F.col(by)).alias(out))


def rows_t(rows: DataFrame, by: str = "d", out: str = "g") -> DataFrame:
    """(index, g): g = D' d for rows that carry their features and ``d``; only the grouped sum shuffles."""
    flat = rows.select(F.col(by), F.explode("features").alias("f"))
    return flat.groupBy("f.index").agg(F.sum(F.col("f.value") * F.col(by)).alias(out))


def _sums(df: DataFrame, by: str, array: str, k: int, square: bool = False) -> DataFrame:
    """``by`` with the k sums of value times the array's entries: columns of one aggregate, so entries are not multiplied by k."""
    terms = [F.col("value") * F.get(array, F.lit(i)) for i in range(k)]
    return df.groupBy(by).agg(F.array(*[F.sum(t * t if square else t) for t in terms]).alias("__s"))


def spmm(tri: DataFrame, m: DataFrame, k: int, out: str = "y", square: bool = False) -> DataFrame:
    """(row_id, k, y): Y = D M for ``m`` (index, v array of length ``k``); ``square`` takes squares of both."""
    return _sums(tri.join(m.select("index", "v"), "index"), "row_id", "v", k, square).select("row_id", F.posexplode("__s").alias("k", out))


def spmm_t(tri: DataFrame, m: DataFrame, k: int, z: DataFrame | None = None, p: float = 1.0, out: str = "y") -> DataFrame:
    """(index, k, y): Y = D' M + p Z for ``m`` (row_id, x array of length ``k``) and ``z`` (index, z array)."""
    got = _sums(tri.join(m.select("row_id", "x"), "row_id"), "index", "x", k)
    if z is not None:
        got = got.join(z, "index", "left").withColumn("__s", F.when(F.col("z").isNull(), F.col("__s")).otherwise(F.zip_with("__s", "z", lambda a, b: a + p * b)))
    return got.select("index", F.posexplode("__s").alias("k", out))
