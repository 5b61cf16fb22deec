"""A model's state in layers: what a minibatch touches costs what it touches, not the model.

The base is one table, bucketed by feature.  A group of minibatches pulls the state of its own
features once, works on that small table, and leaves it as a layer above the base, bucketed
alike.  Layers are read newest first.  After some layers all of them are folded into a new base
by joins that need no shuffle, so a minibatch's share of that stays constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.buckets import bucketed, dropped

#: Layers above the base before they are folded into it.
LAYERS = 8


class LayeredState:
    """(index, columns) by feature; ``schema`` as text, with ``index long`` first."""

    def __init__(self, spark: SparkSession, schema: str, base: DataFrame | None = None, most: int = LAYERS):
        self.spark, self.schema, self.most = spark, schema, most
        self.columns = [x.split()[0] for x in schema.split(", ")][1:]
        self.layers: list[DataFrame] = []
        if base is not None:
            self.layers.append(bucketed(base.select("index", *self.columns), "index", "base"))

    def _stacked(self, start: DataFrame, how: str, layers: list[DataFrame]) -> DataFrame:
        """``start`` joined with layers, oldest first; a feature's row is the newest that has one."""
        out = start
        for layer in layers:
            new = layer.select(F.col("index").alias("__i"), F.struct(*self.columns).alias("__new"))
            out = out.join(new, out["index"] == new["__i"], how)
            out = out.select(F.coalesce("index", "__i").alias("index"), F.coalesce("__new", "__s").alias("__s"))
        return out

    def pull(self, keys: DataFrame) -> DataFrame:
        """The state of ``keys`` (index), null where a feature is new, as a table bucketed by feature."""
        empty = F.lit(None).cast(f"struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in self.schema.split(', ')[1:])}>")
        got = self._stacked(keys.select("index", empty.alias("__s")), "left", self.layers)
        return bucketed(got.select("index", *[F.col(f"__s.{c}").alias(c) for c in self.columns]), "index", "pulled", aligned=True)

    def put(self, layer: DataFrame) -> None:
        """Takes a bucketed table of features as the newest layer, and folds where there are many."""
        self.layers.append(layer)
        if len(self.layers) > self.most:
            self.fold()

    def fold(self) -> DataFrame:
        """The whole state as one table bucketed by feature; the older layers are deleted."""
        if not self.layers:
            return self.spark.createDataFrame([], self.schema)
        if len(self.layers) > 1:
            first = self.layers[0].select("index", F.struct(*self.columns).alias("__s"))
            got = self._stacked(first, "full_outer", self.layers[1:])
            base = bucketed(got.select("index", *[F.col(f"__s.{c}").alias(c) for c in self.columns]), "index", "base", aligned=True)
            for layer in self.layers:
                dropped(layer)
            self.layers = [base]
        return self.layers[0]
