"""Connected components of a link table, as joins and aggregates.

Alternating large-star and small-star steps: every node's least neighbour comes from an
aggregate with map-side combining, and links are turned towards it by a join.  Both sides
of that join are written tables, so that adaptive execution can split the rows of a hub.
Steps go on until every component is a star; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, drop_cut


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is either the far end of one link or the near end of some, never both."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("far"), F.lit(0).alias("near")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("far"), F.lit(1).alias("near")))
    return not ends.groupBy("n").agg(F.sum("far").alias("far"), F.max("near").alias("near")).filter("far > 1 OR (far = 1 AND near = 1)").take(1)


def _turned(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The far end of each link, linked to the least neighbour of the near end."""
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``: the least node that links lead to.

    Links of a node to itself add nothing; repeated and reversed links are one; null ends
    are dropped; no links give no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = cut(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "links")
    while not _is_stars(edges):
        # Large star: neighbours above a node are linked to the least of all its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # A link (a, b) has a above b, so the ends above a node are those that it is the b of.
        large = cut(_turned(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), least).filter("a != b").distinct(), "large")
        # Small star: a node and its neighbours below it are linked to the least of these.
        least2 = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = _turned(large, least2).filter("a != b").unionByName(least2.withColumnRenamed("m", "b"))
        after = cut(small.distinct(), "links")
        for t in (edges, least, large, least2):
            drop_cut(t)
        edges = after
    # Now every link leads from a node to its component's least node.
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
