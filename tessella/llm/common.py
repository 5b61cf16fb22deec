"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir`` as the cluster sets it.

    Only where it is unset and Spark runs in local mode, a temporary folder of this
    process is taken; on a cluster a missing setting is an error, because executors
    do not share local folders.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="tessella-")
    return _own_dir[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Delete a table that :func:`cut` wrote, once nothing reads it any more."""
    path = getattr(df, "_tessella_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(text: str | Column) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_array(text: Column) -> Column:
    """Maximal runs of characters other than :data:`SPACES`, in order."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, SPACES_RE)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """How many words a text has, as a long."""
    return F.size(word_array(text)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
