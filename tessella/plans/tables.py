"""Sparse examples made from the relational tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.hashing import md5_60, string_key
from tessella.operators.frame import feature, sparse_rows, triplets


def events_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases against other events: user, hour and props.k as tagged hashes, and the scaled value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = lambda tag, x, k: feature(string_key(F.concat(F.lit(tag), x.cast("string")), k, portable=True))
    return sparse_rows(
        e,
        F.col("event_id"),
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0),
        [key("u", F.col("user_id"), 0), key("h", F.hour("ts"), 1), key("k", F.get_json_object("props", "$.k"), 2), feature(string_key(F.lit("value"), 3, portable=True), F.col("value") / 100)],
    )


def orders_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders against others: customer and priority as tagged hashes, and the scaled price."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = lambda tag, x, k: feature(string_key(F.concat(F.lit(tag), x.cast("string")), k, portable=True))
    return sparse_rows(o, F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0), [key("c", F.col("o_custkey"), 0), key("p", F.col("o_orderpriority"), 1), feature(string_key(F.lit("price"), 2, portable=True), F.col("o_totalprice") / 1e5)])


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: hashed space-separated words with their counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    words = docs.join(labels, "doc_id").select("doc_id", "quality", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word")).filter("word != ''")
    counted = words.groupBy("doc_id", "quality", string_key(F.col("word"), 0, portable=True).alias("index")).agg(F.count("*").cast("double").alias("value"))
    return counted.groupBy("doc_id", "quality").agg(F.collect_list(F.struct("index", "value")).alias("features")).select(F.col("doc_id").alias("row_id"), F.col("quality").cast("double").alias("label"), F.lit(1.0).alias("weight"), "features")


def vectors(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    """Embeddings as doubles; ``scaled`` gives rows different lengths."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    if scaled:
        x = F.transform(x, lambda v: v * (1 + F.col("vec_id") % 3))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "label", x.alias("x"))


def hash_weight(index: Column, salt: str = "") -> Column:
    """A fixed pseudo-random weight in [-1, 1] of a feature."""
    return (md5_60(F.concat(F.lit(salt), index.cast("string"))) % 2001 - 1000) / F.lit(1000.0)


def hash_model(tri: DataFrame, dim: int = 0) -> DataFrame:
    """(index, w[, v]) for the features of ``tri``."""
    out = tri.select("index").distinct().withColumn("w", hash_weight(F.col("index")))
    return out.withColumn("v", F.array(*[hash_weight(F.col("index"), f"v{k}:") / 10 for k in range(dim)])) if dim else out


def margins(rows: DataFrame, tri: DataFrame | None = None) -> DataFrame:
    """``rows`` with the margin under the hash weights.

    The weight is a function of the index, so one pass over each row's own entries gives
    the margin; a stored model takes ``linalg.spmv``.
    """
    total = F.aggregate("features", F.lit(0.0), lambda s, f: s + f["value"] * hash_weight(f["index"]))
    return rows.withColumn("margin", total)


def events_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets(events_rows(spark, sf_dir))


# --- the same as SQL ---------------------------------------------------------------


def md5_sql(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"


def key_sql(x: str, field: int) -> str:
    return f"(({md5_sql(x)} >> 10) | ({field}::BIGINT << 54))"


def weight_sql(index: str, salt: str = "") -> str:
    return f"(({md5_sql(f'''{salt!r} || {index}::VARCHAR''')} % 2001 - 1000) / 1000.0E0)"


_EVENTS_ROWS = f"""
er AS (SELECT event_id AS row_id, CASE WHEN event_type = 'purchase' THEN 1.0E0 ELSE 0.0E0 END AS label,
         [struct_pack(index := {key_sql("'u' || user_id", 0)}, value := 1.0E0),
          struct_pack(index := {key_sql("'h' || hour(ts)", 1)}, value := 1.0E0),
          struct_pack(index := {key_sql("'k' || (props::JSON ->> '$.k')", 2)}, value := 1.0E0),
          struct_pack(index := {key_sql("'value'", 3)}, value := value / 100)] AS f FROM events)"""
_TRIPLETS = """
tr AS (SELECT row_id, label, f.index AS index, f.value AS value FROM (SELECT row_id, label, unnest(f) AS f FROM er))"""
_MARGINS = f"""
mg AS (SELECT row_id, label, sum(value * {weight_sql("index")}) AS margin FROM tr GROUP BY ALL)"""

EVENTS_SQL = f"WITH {_EVENTS_ROWS}, {_TRIPLETS}, {_MARGINS}"
ORDERS_SQL = f"""WITH er AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'P' THEN 1.0E0 ELSE 0.0E0 END AS label,
         [struct_pack(index := {key_sql("'c' || o_custkey", 0)}, value := 1.0E0),
          struct_pack(index := {key_sql("'p' || o_orderpriority", 1)}, value := 1.0E0),
          struct_pack(index := {key_sql("'price'", 2)}, value := o_totalprice / 1e5)] AS f FROM orders), {_TRIPLETS}, {_MARGINS}"""
QUALITY_SQL = f"""WITH tr AS (SELECT doc_id AS row_id, quality::DOUBLE AS label, {key_sql("word", 0)} AS index, count(*)::DOUBLE AS value
      FROM (SELECT d.doc_id, quality, unnest(string_split(coalesce(text, ''), ' ')) AS word FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
      WHERE word <> '' GROUP BY ALL), {_MARGINS}"""
