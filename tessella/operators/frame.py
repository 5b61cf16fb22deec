"""Sparse examples as rows and as triplets.

A row is (row_id, label, weight, features), features being array<struct<index, value>>
with value 1 where none is given.  The triplet view (row_id, index, value) is what the
products join on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.hashing import unsigned_mod, unsigned_order
from tessella.sources.files import written

FEATURES = "array<struct<index:bigint,value:double>>"


def feature(index: Column, value: Column | float = 1.0) -> Column:
    """One entry of ``features``."""
    value = F.lit(value) if isinstance(value, float) else value
    return F.struct(index.cast("long").alias("index"), F.coalesce(value.cast("double"), F.lit(1.0)).alias("value"))


def sparse_rows(df: DataFrame, row_id: Column, label: Column, features: list[Column], weight: Column | None = None) -> DataFrame:
    """Canonical rows; null entries of ``features`` are left out."""
    entries = F.filter(F.array(*features), lambda f: f.isNotNull())
    return df.select(row_id.alias("row_id"), label.cast("double").alias("label"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"), entries.alias("features"))


def triplets(rows: DataFrame) -> DataFrame:
    """(row_id, index, value): one row per stored entry; map-side only."""
    return rows.select("row_id", F.explode("features").alias("f")).select("row_id", F.col("f.index").alias("index"), F.col("f.value").alias("value"))


def is_binary(rows: DataFrame) -> DataFrame:
    """One row: whether all values are 1, and how many entries there are."""
    ones = F.forall("features", lambda f: f["value"] == 1.0)
    return rows.agg(F.coalesce(F.bool_and(ones), F.lit(True)).alias("all_ones"), F.coalesce(F.sum(F.size("features").cast("long")), F.lit(0)).alias("nnz"))


def hash_kernel(tri: DataFrame, max_key: int | None) -> DataFrame:
    """Indices folded below ``max_key`` as unsigned numbers."""
    return tri if not max_key else tri.withColumn("index", unsigned_mod(F.col("index"), max_key))


def unique_index(tri: DataFrame, cap: int | None = None) -> DataFrame:
    """(index, count): distinct indices with their frequency, saturating at ``cap``."""
    n = F.count("*")
    return tri.groupBy("index").agg((F.least(n, F.lit(cap)) if cap else n).cast("long").alias("count"))


def dictionary(tri: DataFrame) -> DataFrame:
    """(index, count, local_id): dense ids in unsigned order of the index.

    Range partitions are numbered apart and then shifted by the sizes of those before, so
    that no task holds all indices.  They are written first: both branches read one table.
    """
    counted = unique_index(tri).withColumn("o", unsigned_order(F.col("index")))
    parts = max(1, int(tri.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(counted.repartitionByRange(parts, "o").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("o")) - 1
    return ranged.withColumn("k", within).join(F.broadcast(shift), "part").select("index", "count", (F.col("shift") + F.col("k")).cast("long").alias("local_id"))


def remap(tri: DataFrame, dic: DataFrame) -> DataFrame:
    """Triplets with local ids; indices that the dictionary lacks are dropped."""
    return tri.join(dic.select("index", "local_id"), "index").select("row_id", "local_id", "value")


def minibatches(rows: DataFrame, size: int, order: str = "row_id") -> DataFrame:
    """Adds ``batch_id``: ``size`` rows each in order, the last one may be short.

    Rows are numbered within range partitions, written first, and shifted, as for dictionaries.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(rows.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return ranged.withColumn("__k", within).join(F.broadcast(shift), "__part").withColumn("batch_id", F.floor((F.col("__shift") + F.col("__k")) / size).cast("long")).drop("__part", "__k", "__shift")


def shuffled(rows: DataFrame, buffer_rows: int, seed: int, epoch: int = 0) -> DataFrame:
    """Rows permuted within consecutive buffers, another permutation each epoch; adds ``buffer_id``."""
    out = minibatches(rows, buffer_rows).withColumnRenamed("batch_id", "buffer_id")
    return out.orderBy("buffer_id", F.xxhash64("row_id", F.lit(seed), F.lit(epoch)))


def downsample_negatives(rows: DataFrame, keep: Column) -> DataFrame:
    """All positives, and negatives where ``keep`` is true."""
    return rows.filter((F.col("label") > 0) | keep)


def segment(begin: int, end: int, k: int, n: int) -> tuple[int, int]:
    """The k-th of n even parts of [begin, end); the last takes the rest."""
    step = (end - begin) // n
    return begin + step * k, end if k == n - 1 else begin + step * (k + 1)


def segment_of(x: Column, begin: int, end: int, n: int) -> Column:
    """The number of the even part that holds ``x``."""
    step = max(1, (end - begin) // n)
    return F.least(F.floor((x - begin) / step), F.lit(n - 1)).cast("long")
