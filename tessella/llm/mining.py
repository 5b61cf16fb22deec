"""Hard-negative mining with exact integer tile products by Strassen's recursion.

Vectors become 64-bit integers.  Anchors are the stated query set: they are taken in blocks of
bounded size, each block is broadcast, and every task multiplies it, tile by tile, with its own
candidates.  A tile's product is Strassen's: sides are padded with zeros to even lengths, seven
half-size products replace eight, and additions are exact, so scores are exact integers.

A first pass gives every anchor's positives: each label's candidates meet the anchors of that
label, and a task keeps a heap of the best five per anchor.  The positives' scores fix the
windows of allowed negative scores.  A second pass multiplies all candidates with all anchors,
hides pairs of one label, and keeps, per anchor and positive, a heap of the best ten scores in
its window.  Heaps are arrays that merge by best score, then least id; the tasks' heaps are
merged by Spark.  No task holds more than a tile and its heaps, and a label's size does not
matter to any of it.

Rows without an id, a label or a vector, or with a null or non-finite component, take no part.
Vectors of other length are padded with zeros.  Components beyond 64 bits after scaling
saturate; scores are exact below 2**63 and wrap beyond.  Each row counts, so a repeated row is
another candidate, and a repeated anchor gets its own list; rows with the anchor's own id are
not its positives.  Ties go to the lesser id.  An anchor without positives, or a positive
without negatives in its window, has no rows; an empty table gives an empty table.  Columns
other than those named are not read, so clashing names are safe.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, drop_cut

#: Anchors in a broadcast block, and sides of a tile.
ANCHOR_BLOCK = 65536
TILE_ANCHORS, TILE_CANDIDATES = 512, 2048
#: Sides up to which a product is done without recursion.
LEAF = 32
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2**64; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2))) if m % 2 or k % 2 else a
    b = np.pad(b, ((0, k % 2), (0, n % 2))) if k % 2 or n % 2 else b
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def merged(s: np.ndarray, i: np.ndarray, s2: np.ndarray, i2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two heaps along the last axis in one of the best ``k``: greatest score, then least id."""
    s, i = np.concatenate([s, s2], -1), np.concatenate([i, i2], -1)
    by_id = np.argsort(i, -1, kind="stable")
    s, i = np.take_along_axis(s, by_id, -1), np.take_along_axis(i, by_id, -1)
    best = np.argsort(-np.maximum(s, _NONE + 1), -1, kind="stable")[..., :k]
    return np.take_along_axis(s, best, -1), np.take_along_axis(i, best, -1)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of ``width`` columns, with zeros for what is missing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, vec) of the rows that take part."""
    finite = F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    vec = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec"), finite.alias("finite"))
    return rows.filter("finite AND id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").drop("finite")


class AnchorBlock:
    """One block of anchors: ids, labels and vectors by label, then id."""

    def __init__(self, rows: pa.Table, width: int):
        self.width = width
        vec, ids, labels = _matrix(rows["vec"], width), rows["id"].to_numpy(), rows["label"].to_numpy()
        order = np.lexsort((*vec.T[::-1], ids, labels))
        self.ids, self.labels, self.vec = ids[order], labels[order], vec[order]


def _tiles(batch: pa.RecordBatch, width: int):
    """Candidates of a batch by id, some at a time: ids, labels, vectors as columns."""
    ids, labels, vec = batch["id"].to_numpy(), batch["label"].to_numpy(), _matrix(batch["vec"], width)
    order = np.argsort(ids, kind="stable")
    for k in range(0, len(ids), TILE_CANDIDATES):
        at = order[k : k + TILE_CANDIDATES]
        yield ids[at], labels[at], vec[at].T


def _positives(batches, sent, k: int):
    """Each anchor's best ``k`` rows of its label among a task's rows."""
    block = sent.value
    n = len(block.ids)
    score, ids = np.full((n, k), _NONE), np.zeros((n, k), np.int64)
    for b in batches:
        for c_ids, c_labels, c_vec in _tiles(b, block.width):
            for label in np.intersect1d(c_labels, block.labels):
                begin, end = np.searchsorted(block.labels, [label, label + 1])
                mine = c_labels == label
                for a in range(begin, end, TILE_ANCHORS):
                    at = slice(a, min(end, a + TILE_ANCHORS))
                    s = strassen(block.vec[at], c_vec[:, mine])
                    other = c_ids[mine][None, :] != block.ids[at, None]
                    best = np.argsort(-np.where(other, s, _NONE + 1), 1, kind="stable")[:, :k]
                    got = np.where(np.take_along_axis(other, best, 1), np.take_along_axis(s, best, 1), _NONE)
                    score[at], ids[at] = merged(score[at], ids[at], got, c_ids[mine][best], k)
    at, j = np.nonzero(score > _NONE)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids[at, j]), pa.array(score[at, j])], names=["anchor", "id", "score"])


def _negatives(batches, sent, windows, k: int):
    """The best ``k`` rows of other labels within each window among a task's rows."""
    block, (low, high) = sent.value, windows.value
    score, ids = np.full((*low.shape, k), _NONE), np.zeros((*low.shape, k), np.int64)
    for b in batches:
        for c_ids, c_labels, c_vec in _tiles(b, block.width):
            for a in range(0, len(block.ids), TILE_ANCHORS):
                at = slice(a, a + TILE_ANCHORS)
                s = strassen(block.vec[at], c_vec)
                s[block.labels[at, None] == c_labels[None, :]] = _NONE
                order = np.argsort(-np.maximum(s, _NONE + 1), 1, kind="stable")
                s = np.take_along_axis(s, order, 1)  # falling; equal scores by id
                for j in range(low.shape[1]):
                    first = (s > high[at, j, None]).sum(1)
                    place = first[:, None] + np.arange(k)
                    inside = place < s.shape[1]
                    place = np.minimum(place, s.shape[1] - 1)
                    got = np.take_along_axis(s, place, 1)
                    got = np.where(inside & (got >= low[at, j, None]) & (got > _NONE), got, _NONE)
                    if (got > _NONE).any():
                        score[at, j], ids[at, j] = merged(score[at, j], ids[at, j], got, c_ids[np.take_along_axis(order, place, 1)], k)
    at, j, r = np.nonzero(score > _NONE)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(j), pa.array(ids[at, j, r]), pa.array(score[at, j, r])], names=["anchor", "positive", "id", "score"])


def _ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90), anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (id, label, vec).

    A negative's score lies between the two percentages of the positive's, bounds included.
    """
    spark = rows.sparkSession
    n_anchors, width = rows.agg(F.count_if(is_anchor), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    blocks = max(1, math.ceil(n_anchors / anchor_block))
    dealt = rows.filter(is_anchor).withColumn("block", F.pmod(F.xxhash64("id", "label", "vec"), F.lit(blocks)))
    out = None
    for k in range(blocks):  # about ``anchor_block`` anchors each, whatever their number
        block = AnchorBlock(dealt.filter(F.col("block") == k).toArrow(), width)
        sent = spark.sparkContext.broadcast(block)
        found = rows.mapInArrow(lambda x, s=sent: _positives(x, s, positives), "anchor long, id long, score long")
        found = _ranked(found, ["anchor"], positives).toArrow().to_pydict()  # ``positives`` rows an anchor of the block
        low, high = np.full((len(block.ids), positives), 1), np.zeros((len(block.ids), positives), np.int64)
        pos_id, pos_score = np.zeros_like(high), np.zeros_like(high)
        for a, i, s, r in zip(found["anchor"], found["id"], found["score"], found["rank"], strict=True):
            low[a, r - 1], high[a, r - 1] = -(-share[0] * s // 100), share[1] * s // 100
            pos_id[a, r - 1], pos_score[a, r - 1] = i, s
        windows = spark.sparkContext.broadcast((low, high))
        got = rows.mapInArrow(lambda x, s=sent, w=windows: _negatives(x, s, w, negatives), "anchor long, positive long, id long, score long")
        got = _ranked(got, ["anchor", "positive"], negatives)
        named = lambda x, c: pa.array(x.ravel(), c)
        at = np.repeat(np.arange(len(block.ids)), positives)
        names = pa.table({"anchor": at, "positive": np.tile(np.arange(positives), len(block.ids)), "anchor_id": block.ids[at], "positive_id": named(pos_id, pa.int64()), "positive_score": named(pos_score, pa.int64())})
        got = got.join(F.broadcast(spark.createDataFrame(names)), ["anchor", "positive"])  # ``positives`` rows an anchor of the block
        got = cut(got.select("anchor_id", "positive_id", F.col("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        for x in (sent, windows):
            x.unpersist()
        out = got if out is None else out.unionByName(got)
    return out


def op13_mining(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = cut(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", label, 256), "integer_vectors")
    out = hard_negatives(rows, F.col("id") % 100 == 0)
    drop_cut(rows)
    return out


OP13_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 WHERE a.label <> c.label OR a.vec_id <> c.vec_id),
p AS (SELECT * FROM (SELECT r, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS j FROM s WHERE same) WHERE j <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, j ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (r, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
