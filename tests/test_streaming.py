"""Streams against batch results."""

from pyspark.sql import functions as F

from tessella.operators import frame, linalg
from tessella.operators import updaters as U
from tessella.functions.losses import Loss
from tessella.plans import trainers
from tessella.streaming import online


def small_rows(spark, n=90):
    f = F.array(*[F.struct((F.col("id") * 7 % k).alias("index"), F.lit(1.0 + k / 10).alias("value")) for k in (3, 5)])
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("double").alias("label"), F.lit(1.0).alias("weight"), f.cast(frame.FEATURES).alias("features"))


def test_one_micro_batch_is_one_push(spark):
    rows, rule = small_rows(spark), U.FTRL(l1=0.1)
    got = online.learn_stream(online.file_stream(spark, rows.coalesce(1), 1, "one"), rule)
    dual = rows.select("row_id", Loss().dual(F.col("label"), F.lit(0.0)).alias("d"))
    want = U.push(trainers.empty_state(spark, rule), linalg.spmv_t(frame.triplets(rows), dual), rule)
    a, b = ({r["index"]: (round(r["w"], 9), round(r["z"], 9), round(r["n"], 9)) for r in d.collect()} for d in (got, want))
    assert a == b


def test_keyed_state_goes_on_between_batches(spark):
    rule = U.FTRL()
    grads = spark.createDataFrame([(7, 1, 2.0), (7, 2, -1.0), (7, 3, 3.0), (8, 1, 0.5)], "index long, at long, g double").withColumn("row_id", F.col("at"))
    stream = online.file_stream(spark, grads, 2, "grads").select("index", "at", "g")
    out = online.drained(online.keyed_ftrl(stream, rule), "keyed")
    n = {r["index"]: r["n"] for r in out.orderBy("batch").collect()}
    assert abs(n[7] - 3.7416574) < 1e-6 and n[8] == 0.5


def test_goes_on_where_it_ended(spark, tmp_path):
    rows, home = small_rows(spark, 40), f"{tmp_path}/home"
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    rows.filter("row_id < 20").coalesce(1).write.parquet(f"{tmp_path}/in")
    first = {r["index"]: r["n"] for r in online.learn_stream(source(), home=home).collect()}
    assert first == {r["index"]: r["n"] for r in online.learn_stream(source(), home=home).collect()}  # nothing new
    rows.filter("row_id >= 20").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    second = {r["index"]: r["n"] for r in online.learn_stream(source(), home=home).collect()}
    assert second.keys() == first.keys() and all(second[k] >= first[k] for k in first) and second != first


def test_range_state_is_a_push_a_micro_batch(spark, tmp_path):
    """Each arrival is one micro-batch; the state goes on between runs, in blocks that share features or not."""
    rule, path = U.FTRL(l1=0.1), f"{tmp_path}/in"
    parts = [[(7, 2.0), (7, -1.0), (8, 0.5), (-3, 4.0)], [(7, 3.0), (9, 1.0), (-3, -1.0)], [(8, 1.0)] * 50]
    state = trainers.empty_state(spark, rule)
    for part in parts:
        df = spark.createDataFrame(part, "index long, g double")
        df.repartition(3).write.mode("append").parquet(path)
        out = online.drained(online.keyed_push(spark.readStream.schema(df.schema).parquet(path), rule), "pushes", f"{tmp_path}/home")
        state = spark.createDataFrame(U.push(state, df.groupBy("index").agg(F.sum("g").alias("g")), rule).collect(), "index long, w double, z double, n double")
    last = {}
    for r in sorted(out.collect(), key=lambda r: r["batch"]):
        last[r["index"]] = (round(r["w"], 9), round(r["z"], 9), round(r["n"], 9))
    assert last == {r["index"]: (round(r["w"], 9), round(r["z"], 9), round(r["n"], 9)) for r in state.collect()}
    assert out.count() == 3 + 3 + 1
