"""Readers and writers of sparse text formats, by name.

All readers give canonical rows (row_id, label, weight, features); Spark splits the
files.  Ids of 2**63 and more keep their 64 bits in a signed long.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.cityhash import buffers, city64
from tessella.functions.hashing import FIELD_SHIFT, HASH_DROP, group_key, string_key, unsigned_text
from tessella.functions.md5 import md5_60s
from tessella.operators.frame import FEATURES
from tessella.sources.blocks import holds_blocks, read_blocks

Reader = Callable[[SparkSession, "str | list[str]"], DataFrame]
_READERS: dict[str, Reader] = {}
# Fixed layout of the click log: a label, 13 integers, 26 categories; fields are numbered in that order.
N_INTEGERS, N_CATEGORIES = 13, 26


def register_format(name: str, reader: Reader) -> None:
    """Adds or replaces a format."""
    _READERS[name] = reader


def read_format(spark: SparkSession, path: str | list[str], name: str) -> DataFrame:
    if name not in _READERS:
        raise ValueError(f"unknown format {name}; known: {', '.join(sorted(_READERS))}")
    return _READERS[name](spark, path)


def read_lines(spark: SparkSession, lines, parse) -> DataFrame:
    """Rows of text lines at hand, such as standard input; ``parse`` is one of the parsers below."""
    return parse(spark.createDataFrame([(x.rstrip("\n"),) for x in lines], "value string"))


def unsigned_long(x: Column) -> Column:
    """A decimal string's 64 bits as a signed long."""
    return F.conv(x, 10, -10).cast("long")


def _canonical(df: DataFrame, label: Column, weight: Column, features: Column) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row_id"), label.cast("double").alias("label"), weight.cast("double").alias("weight"), features.cast(FEATURES).alias("features"))


def parse_libsvm(lines: DataFrame) -> DataFrame:
    """``label[:weight] id[:value] ...``; a missing value or weight is 1; blank lines are skipped."""
    t = F.split(F.trim("value"), r"\s+")
    head = F.split(F.get(t, F.lit(0)), ":")
    rest = F.filter(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x: x != "")

    def entry(x):
        p = F.split(x, ":")
        return F.struct(unsigned_long(F.get(p, F.lit(0))).alias("index"), F.coalesce(F.get(p, F.lit(1)).cast("double"), F.lit(1.0)).alias("value"))

    return _canonical(lines.filter(F.length(F.trim("value")) > 0), F.get(head, F.lit(0)), F.coalesce(F.get(head, F.lit(1)).cast("double"), F.lit(1.0)), F.transform(rest, entry))


def _click_features(line: Column, first: int, hashed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """Features of lines whose field 0 comes after ``first`` others; ``hashed`` takes bytes, begins and sizes of the fields that count.

    A line is cut once, and only keys come back.  It is declared not deterministic for the reason of :func:`city_hashes`.
    """

    @F.arrow_udf(FEATURES)
    def run(lines: pa.Array) -> pa.Array:
        data, bounds = buffers(lines)
        ends = np.flatnonzero(data == ord("\t"))
        start = np.concatenate([[0], ends + 1])[:-1]
        before = np.searchsorted(ends, bounds)  # fields before each line
        some = np.flatnonzero(ends > start)
        row = np.repeat(np.arange(len(lines)), np.diff(before))[some]
        field, start, size = some - before[row] - first, start[some], (ends - start)[some]
        length = size
        if (data > 127).any():  # bytes within a character do not count as one
            inner = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
            length = size - inner[start + size] + inner[start]
        which = (field >= 0) & (field < N_INTEGERS + N_CATEGORIES) & ((field < N_INTEGERS) | (length == 8))
        key = hashed(data, start[which], size[which]) >> np.uint64(HASH_DROP) | field[which].astype(np.uint64) << np.uint64(FIELD_SHIFT)
        entries = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(np.ones(len(key)))], ["index", "value"])
        sizes = np.bincount(row[which], minlength=len(lines))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), entries)

    return run.asNondeterministic()(F.concat(line, F.lit("\t")))  # so that each field ends with a tab


def parse_clicks(lines: DataFrame, labelled: bool = True, portable: bool = False, city: bool = False) -> DataFrame:
    """Tab-separated click log: each non-empty field is one hashed feature; integers are hashed as text.

    A category counts where it has eight characters.  ``city`` takes the hash of the original
    tools, so that keys are those of their models; ``portable`` is for other engines.
    """
    lines = lines.filter(F.length("value") > 0)
    label = F.substring_index("value", "\t", 1) if labelled else F.lit(0.0)
    first = 1 if labelled else 0
    if city or portable:
        return _canonical(lines, label, F.lit(1.0), _click_features(F.col("value"), first, city64 if city else md5_60s))

    def entry(x, k):
        ok = F.when(k < N_INTEGERS, x != "").otherwise(F.length(x) == 8)
        return F.when(ok, F.struct(string_key(x, k).alias("index"), F.lit(1.0).alias("value")))

    fields = F.slice(F.split("value", "\t", -1), first + 1, N_INTEGERS + N_CATEGORIES)
    return _canonical(lines, label, F.lit(1.0), F.filter(F.transform(fields, entry), lambda f: f.isNotNull()))


def parse_grouped(lines: DataFrame) -> DataFrame:
    """``lineid count label id:group id:group ...``, one example a line."""
    t = F.split(F.trim("value"), r"\s+")
    pairs = F.filter(F.slice(t, 4, F.greatest(F.size(t) - 3, F.lit(0))), lambda x: F.contains(x, F.lit(":")))

    def entry(x):
        p = F.split(x, ":")
        return F.struct(group_key(unsigned_long(F.get(p, F.lit(0))), F.get(p, F.lit(1)).cast("long")).alias("index"), F.lit(1.0).alias("value"))

    return _canonical(lines.filter(F.size(t) >= 3), F.when(F.substring(F.get(t, F.lit(2)), 1, 1) == "1", 1.0).otherwise(0.0), F.lit(1.0), F.transform(pairs, entry))


def _text(parse, **settings) -> Reader:
    return lambda spark, path: parse(spark.read.text(path), **settings)


def _packed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of compressed row blocks, or the Parquet files that stand for them here."""
    paths = [path] if isinstance(path, str) else path
    return read_blocks(spark, paths) if holds_blocks(spark, paths[0]) else spark.read.parquet(*paths).drop("file")


for _name, _reader in {
    "libsvm": _text(parse_libsvm),
    "criteo": _text(parse_clicks),
    "criteo_test": _text(parse_clicks, labelled=False),
    "adfea": _text(parse_grouped),
    # Written as Parquet with the same codec; binary files of the original tools are read too.
    "crb": _packed,
    "criteo_city": _text(parse_clicks, city=True),
    "criteo_test_city": _text(parse_clicks, labelled=False, city=True),
}.items():
    register_format(_name, _reader)


def libsvm_lines(rows: DataFrame) -> DataFrame:
    """``label[:weight] id:value ...``; a value or weight of 1 is left out; ids are unsigned."""
    entry = lambda f: F.concat(unsigned_text(f["index"]), F.when(f["value"] == 1.0, F.lit("")).otherwise(F.concat(F.lit(":"), f["value"].cast("string"))))
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    head = F.concat(F.col("label").cast("string"), F.when(weight == 1.0, F.lit("")).otherwise(F.concat(F.lit(":"), weight.cast("string"))))
    return rows.select(F.concat_ws(" ", head, F.transform("features", entry)).alias("value"))


def _in_files(rows: DataFrame, size: Column, limit: int) -> DataFrame:
    """Adds ``file``: rows of a task in order, to files of ``limit`` bytes each by the running sum of ``size``."""

    def run(batches):
        total, task = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.column(b.num_columns - 1).to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            names = pa.array([f"{task:05d}-{k:05d}" for k in (before // limit).tolist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], names, pa.array(before)], names=[*b.schema.names[:-1], "file", "__at"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = rows.withColumn("__size", size.cast("long")).mapInArrow(run, f"{kinds}, file string, __at long")
    return numbered.sortWithinPartitions("file", "__at").drop("__at")


def write_format(rows: DataFrame, path: str, name: str, max_records: int = 0, part_mb: float = -1) -> None:
    """Writes ``libsvm`` text or ``crb`` (Parquet, lz4); ``max_records`` rolls files over.

    With ``part_mb`` above 0 a file ends once it has that many MB (of 2**20 bytes; of text, or
    of what a row takes in memory), so it is at most one row larger; each lies in a folder of its own.
    """
    if name not in ("libsvm", "crb"):
        raise ValueError(f"no writer for {name}")
    out = libsvm_lines(rows) if name == "libsvm" else rows
    size = F.octet_length("value") + 1 if name == "libsvm" else 16 + 16 * F.size("features")
    writer = (_in_files(out, size, max(1, int(part_mb * 2**20))).write.partitionBy("file") if part_mb > 0 else out.write).option("maxRecordsPerFile", max_records)
    if name == "libsvm":
        writer.text(path)
    else:
        writer.option("compression", "lz4_raw").parquet(path)


def convert(spark: SparkSession, data_in: str, format_in: str, data_out: str, format_out: str, max_records: int = 0, part_mb: float = -1) -> None:
    """Reads one format and writes another."""
    write_format(read_format(spark, data_in, format_in), data_out, format_out, max_records, part_mb)


def write_predictions(df: DataFrame, path: str) -> None:
    """One prediction a line, in order of row_id."""
    df.orderBy("row_id").select(F.col("prediction").cast("string").alias("value")).write.text(path)


def write_centroids(centroids: DataFrame, path: str) -> None:
    """A text matrix, one centroid a line."""
    centroids.orderBy("cluster").select(F.concat_ws(" ", F.col("centroid").cast("array<string>")).alias("value")).coalesce(1).write.text(path)


def write_sparse_centroids(centroids: DataFrame, path: str) -> None:
    """``cluster <tab> index <tab> weight``, one stored entry a line, ids unsigned."""
    line = F.concat_ws("\t", F.col("cluster").cast("string"), unsigned_text(F.col("index")), F.col("w").cast("string"))
    centroids.select(line.alias("value")).write.text(path)


def read_sparse_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, index, w) as :func:`write_sparse_centroids` wrote them."""
    t = F.split("value", "\t")
    return spark.read.text(path).select(F.get(t, F.lit(0)).cast("int").alias("cluster"), unsigned_long(F.get(t, F.lit(1))).alias("index"), F.get(t, F.lit(2)).cast("double").alias("w"))


def read_feature_names(spark: SparkSession, path: str) -> DataFrame:
    """(index, name, kind) from ``id <tab> name=value <tab> kind`` lines."""
    return spark.read.csv(path, sep="\t", schema="index long, name string, kind string")
