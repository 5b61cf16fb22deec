"""Online learning on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tessella.functions.losses import Loss
from tessella.operators.frame import triplets
from tessella.operators.linalg import spmv, spmv_t
from tessella.operators.updaters import FTRL, Rule, push
from tessella.sources.buckets import delete
from tessella.sources.files import scratch


def _versions(spark: SparkSession, home: str) -> list[int]:
    """Numbers of the micro-batches whose state is complete."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/states")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    done = [s.getPath() for s in fs.listStatus(where) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def learn_stream(stream: DataFrame, rule: Rule | None = None, loss: Loss | None = None, home: str | None = None) -> DataFrame:
    """The state after all micro-batches of a stream of canonical rows.

    Each micro-batch pulls weights, sums gradients and pushes them.  The state of batch k
    is a table of its own under ``home``, so a batch that runs again after a failure starts
    from the same state and gives the same result, and a later call with the same ``home``
    goes on where this one ended.
    """
    rule, loss = rule or FTRL(), loss or Loss()
    spark, home = stream.sparkSession, home or scratch(stream.sparkSession, "online")
    schema = ", ".join(["index long", *[f"{c} double" for c in rule.state]])

    def before(number: int) -> DataFrame:
        older = [k for k in _versions(spark, home) if k < number]
        return spark.read.schema(schema).parquet(f"{home}/states/{older[-1]}") if older else spark.createDataFrame([], schema)

    def step(batch: DataFrame, number: int) -> None:
        state = before(number)
        batch = batch.persist()
        margins = batch.join(spmv(triplets(batch), state.select("index", "w"), batch, "margin"), "row_id")
        dual = margins.select("row_id", loss.dual(F.col("label"), F.col("margin")).alias("d"))
        push(state, spmv_t(triplets(batch), dual), rule, number + 1).write.mode("overwrite").parquet(f"{home}/states/{number}")
        batch.unpersist()
        for old in _versions(spark, home):
            if old < number - 1:  # the one before may be asked for again after a failure
                delete(spark, f"{home}/states/{old}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{home}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return before(1 << 62)


def keyed_ftrl(grads: DataFrame, rule: FTRL | None = None) -> DataFrame:
    """A stream of (index, at, g) to a stream of (index, w, z, n): FTRL per key in Spark's own keyed state.

    Gradients of one key in one micro-batch apply in order of ``at``.
    """
    rule = rule or FTRL()

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w, z, n = state.get if state.exists else (0.0, 0.0, 0.0)
        for g in pd.concat(list(frames)).sort_values("at")["g"]:
            n2 = (n * n + g * g) ** 0.5
            z += g - (n2 - n) / rule.alpha * w
            n, over = n2, max(abs(z) - rule.l1, 0.0)
            w = 0.0 if over == 0 else (-1 if z > 0 else 1) * over / ((rule.beta + n) / rule.alpha + rule.l2)
        state.update((w, z, n))
        yield pd.DataFrame({"index": [key[0]], "w": [w], "z": [z], "n": [n]})

    return grads.groupBy("index").applyInPandasWithState(step, "index long, w double, z double, n double", "w double, z double, n double", "update", GroupStateTimeout.NoTimeout)


#: Feature ranges of the keyed learner, and blocks of features in a range's state.
RANGES, BLOCKS = 128, 256


class RangePush(StatefulProcessor):
    """One push a micro-batch for all features of a range; its state is a map from block to packed arrays.

    Only the blocks that hold a gradient's feature are read and written, whatever the model's size.
    """

    def __init__(self, rule: FTRL):
        self.rule = rule

    def init(self, handle) -> None:
        self.blocks = handle.getMapState("blocks", "block long", "features binary, state binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows))
        got = got.groupby("index", as_index=False).agg(block=("block", "first"), g=("g", "sum"))
        for block, own in got.groupby("block"):
            ids, g = own["index"].to_numpy(np.int64), own["g"].to_numpy()  # ascending, as groupby sorts
            old = self.blocks.getValue((int(block),))
            known = np.frombuffer(old[0], np.int64) if old else np.zeros(0, np.int64)
            state = np.frombuffer(old[1]).reshape(3, -1) if old else np.zeros((3, 0))
            features = np.union1d(known, ids)
            new = np.zeros((3, len(features)))
            new[:, np.searchsorted(features, known)] = state
            at = np.searchsorted(features, ids)
            new[:, at] = self.rule.arrays(*new[:, at], g)
            self.blocks.updateValue((int(block),), (features.tobytes(), new.tobytes()))
            yield pd.DataFrame({"index": ids, "w": new[0, at], "z": new[1, at], "n": new[2, at]})

    def close(self) -> None:
        pass


def _summed(batches):
    """Gradients summed by feature within a task, so a feature of every row is one row of each task."""
    sums: dict[int, float] = {}
    for b in batches:
        ids, inverse = np.unique(b.column(0).to_numpy(), return_inverse=True)
        for i, g in zip(ids.tolist(), np.bincount(inverse, b.column(1).to_numpy(), len(ids)).tolist(), strict=True):
            sums[i] = sums.get(i, 0.0) + g
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.float64())], names=["index", "g"])


def keyed_push(grads: DataFrame, rule: FTRL | None = None) -> DataFrame:
    """A stream of (index, g) to a stream of (index, w, z, n): one push of the summed gradients a micro-batch.

    The state is Spark's own, keyed by ranges of features, so there is no group for each key;
    gradients are summed by feature before they are dealt.  Features that got a gradient come out.
    """
    spark = grads.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    h = F.xxhash64("index")
    summed = grads.select(F.col("index").cast("long"), F.col("g").cast("double")).mapInArrow(_summed, "index long, g double")
    dealt = summed.withColumn("range", F.pmod(h, F.lit(RANGES))).withColumn("block", F.pmod(F.floor(h / RANGES), F.lit(BLOCKS)).cast("long"))
    return dealt.groupBy("range").transformWithStateInPandas(RangePush(rule or FTRL()), "index long, w double, z double, n double", "Update", "None")


def file_stream(spark: SparkSession, rows: DataFrame, files: int, name: str) -> DataFrame:
    """``rows`` as a stream of ``files`` files, one a micro-batch."""
    path = scratch(spark, name)
    rows.repartition(files, "row_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, name: str, home: str | None = None) -> DataFrame:
    """All rows that an update-mode stream emits, from a table written by its micro-batches; with one ``home`` later calls go on."""
    spark, home = stream.sparkSession, home or scratch(stream.sparkSession, name)
    write = lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{home}/rows/part={k}")
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{home}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{home}/rows")
