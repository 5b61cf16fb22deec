"""Spherical k-means: nearest centroid by cosine, raw means, then unit length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.hashing import unsigned_order
from tessella.functions.losses import cosine_score, unit
from tessella.sources.files import written

#: Numbers that a dense centroid may have.
DENSE_DIM = 10_000_000


def initial_centroids(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(cluster, centroid): k rows by a seeded hash, at unit length."""
    picks = vectors.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(k)
    rows = picks.select(unit(F.col("x")).alias("x")).collect()  # k rows
    return vectors.sparkSession.createDataFrame([(i, r["x"]) for i, r in enumerate(rows)], "cluster int, centroid array<double>")


def assign(vectors: DataFrame, centroids: DataFrame, digits: int | None = None) -> DataFrame:
    """(row_id, x, cluster, score): the best centroid of each row; ties go to the lowest cluster; a zero vector to cluster 0.

    ``centroids`` has k rows; every row looks at all of them as one array, so rows are
    neither multiplied nor shuffled.
    """
    table = centroids.agg(F.sort_array(F.collect_list(F.struct("cluster", "centroid"))).alias("cs"))
    both = vectors.crossJoin(F.broadcast(table))
    x = F.col("x")

    def scored(c):
        s = F.coalesce(cosine_score(x, c["centroid"]), F.lit(0.0))
        return F.struct((F.round(s, digits) if digits is not None else s).alias("score"), (-c["cluster"]).alias("minus"))

    best = both.withColumn("best", F.array_max(F.transform("cs", scored)))
    return best.select("row_id", "x", (-F.col("best.minus")).cast("int").alias("cluster"), F.col("best.score").alias("score"))


def update(assigned: DataFrame, centroids: DataFrame, empty: str = "error") -> DataFrame:
    """New centroids: the mean of raw rows at unit length.  An empty cluster is an error, or keeps its centroid."""
    sums = assigned.select("cluster", F.posexplode("x").alias("k", "v")).groupBy("cluster", "k").agg(F.avg("v").alias("v"))
    means = sums.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("mean"))
    if empty == "error":
        return means.select("cluster", unit(F.col("mean")).alias("centroid"))
    return centroids.join(means, "cluster", "left").select("cluster", F.coalesce(unit(F.col("mean")), "centroid").alias("centroid"))


def fit(vectors: DataFrame, k: int, max_iter: int, seed: int = 0, init: DataFrame | None = None, empty: str = "error") -> DataFrame:
    """Centroids after ``max_iter`` rounds; there is no test of convergence."""
    spark, vectors = vectors.sparkSession, vectors.persist()
    centroids = init if init is not None else initial_centroids(vectors, k, seed)
    n = centroids.count()
    for _ in range(max_iter):
        rows = update(assign(vectors, centroids), centroids, empty).collect()  # k rows
        if len(rows) < n:
            raise ValueError("a cluster is empty: use fewer clusters, or empty='keep'")
        centroids = spark.createDataFrame([(r["cluster"], r["centroid"]) for r in rows], "cluster int, centroid array<double>")
    return centroids


def _at_unit_length(sums: DataFrame) -> DataFrame:
    """(cluster, index, w) at unit length of sums (cluster, index, x)."""
    norms = sums.groupBy("cluster").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return sums.join(norms, "cluster").select("cluster", "index", (F.col("x") / F.greatest("norm", F.lit(1e-300))).alias("w"))


def assign_sparse(rows: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``cluster``: the best centroid (cluster, index, w) by cosine; ties and rows without a match go to the lowest.

    A row's products with all k centroids are k sums of one aggregate, so entries shuffle
    once and no dense vector is made.
    """
    flat = rows.select("row_id", F.explode("features").alias("f")).select("row_id", F.col("f.index").alias("index"), F.col("f.value").alias("value"))
    wide = centroids.groupBy("index").agg(*[F.sum(F.when(F.col("cluster") == c, F.col("w"))).alias(f"w{c}") for c in range(k)])
    dots = flat.join(wide, "index").groupBy("row_id").agg(*[F.coalesce(F.sum(F.col("value") * F.col(f"w{c}")), F.lit(0.0)).alias(f"y{c}") for c in range(k)])
    best = F.array_max(F.array(*[F.struct(F.col(f"y{c}").alias("y"), F.lit(-c).alias("minus")) for c in range(k)]))
    found = dots.select("row_id", (-best["minus"]).alias("cluster"))
    return rows.join(found, "row_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))


def fit_sparse(rows: DataFrame, k: int, max_iter: int, seed: int = 0, empty: str = "error", init: DataFrame | None = None) -> DataFrame:
    """(cluster, index, w) of sparse rows, at unit length: work and result go with stored entries, any 64-bit id is a feature.

    ``init`` (cluster, index, w) replaces the seeded picks, of which there are ``k``.
    """
    rows = rows.persist()
    entries = lambda df: df.select("cluster", F.explode("features").alias("f")).groupBy("cluster", F.col("f.index").alias("index"))
    if init is None:
        picks = rows.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(k).select("row_id").collect()  # k rows
        first = rows.sparkSession.createDataFrame([(c, r["row_id"]) for c, r in enumerate(picks)], "cluster int, row_id long")
        init, k = _at_unit_length(entries(rows.join(first, "row_id")).agg(F.sum("f.value").alias("x"))), len(picks)
    centroids = written(init, "centroids")
    for _ in range(max_iter):
        sums = entries(assign_sparse(rows, centroids, k)).agg(F.sum("f.value").alias("x"))
        new = written(_at_unit_length(sums), "centroids")
        missing = centroids.join(new.select("cluster").distinct(), "cluster", "left_anti")
        if missing.take(1):
            if empty == "error":
                raise ValueError("a cluster is empty: use fewer clusters, or empty='keep'")
            new = written(new.unionByName(missing), "centroids")
        centroids = new
    rows.unpersist()
    return centroids


def dimension(rows: DataFrame) -> int:
    """One more than the greatest feature id, ids taken as unsigned; 0 without features."""
    top = rows.select(F.explode("features.index").alias("index")).agg(F.max(unsigned_order(F.col("index")))).first()[0]
    return 0 if top is None else top + (1 << 63) + 1


def dense(centroids: DataFrame, dim: int) -> DataFrame:
    """(cluster, centroid) with ``dim`` numbers each, for ids below ``dim``: on request, where a row of that length is wanted."""
    if not 0 < dim <= DENSE_DIM:
        raise ValueError(f"{dim} numbers a centroid: keep them sparse")
    by = centroids.filter(F.col("index").between(0, dim - 1)).groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("index", "w"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return by.select("cluster", whole.alias("centroid"))
