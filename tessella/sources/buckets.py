"""Tables bucketed by a key: joins and sums on the key need no shuffle of what is stored.

Rows with one key lie in one bucket, sorted, so the scan of a bucketed table already has the
distribution that a join on the key asks for.  A model's columns or a model and its gradients
so meet where they lie, and only what is new moves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.files import scratch


def buckets_of(spark: SparkSession) -> int:
    """As many as shuffles have partitions, so that both fit together."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df: DataFrame, key: str, name: str, aligned: bool = False, path: str | None = None) -> DataFrame:
    """``df`` written in buckets of ``key`` in the shared folder, and read again.

    ``aligned``: the rows of a bucket lie in few partitions already (after a join or a sum
    on the key), so they are written without another shuffle.
    """
    spark, n = df.sparkSession, buckets_of(df.sparkSession)
    path, table = path or scratch(spark, name), f"tessella_{uuid.uuid4().hex}"
    rows = df if aligned else df.repartition(n, key)
    rows.write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._tessella_table, out._tessella_path = table, path
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes a table of :func:`bucketed`, once nothing reads it any more."""
    table = getattr(df, "_tessella_table", None)
    if table is None:
        return
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    delete(df.sparkSession, df._tessella_path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete tables in a folder (those whose writer has ended)."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(make(path)):
        return []
    found = [s.getPath() for s in fs.listStatus(make(path)) if s.isDirectory()]
    return sorted(p.getName() for p in found if fs.exists(make(p, "_SUCCESS")))
