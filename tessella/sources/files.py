"""Finding input files and a shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; in local mode without one, in a temporary folder."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tessella-"))
    return f"{base.rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Writes ``df`` to a new scratch folder and reads it again, so that what reads it twice sees one and the same table."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def match_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files whose path matches: the last part of ``pattern`` is a regular expression, searched in the full path.

    A pattern that ends with ``/`` takes every file of that folder.  The match need not
    reach the end of the name, so ``part-1`` also takes ``part-10``.
    """
    folder, _, last = pattern.rpartition("/")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder or ".")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    wanted = re.compile(".*" + last)
    found = [str(s.getPath().toString()) for s in fs.listStatus(where) if not s.isDirectory() or str(s.getPath().getName()).endswith(".parquet")]
    return sorted(p for p in found if wanted.search(p))


def part_of(files: list[str], k: int, n: int) -> list[str]:
    """The k-th of n even parts of a list of files."""
    return files[k::n]
