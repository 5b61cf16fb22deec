"""Near-dedup of embeddings by int8 tile products with rigorous error bounds.

Vectors of one label are dealt to blocks of bounded size; a tile is a pair of blocks and
one task's work.  A unit vector v is s q + e with an int8 code q, so two vectors' cosine
lies within |e_u| + |e_v| + |e_u||e_v| of s_u s_v (q_u . q_v).  The integer products of a
tile are one exact matrix product over the codes alone, which is all that is sent to it;
doubles are sent only for the vectors of pairs whose upper bound reaches the threshold, and
those pairs are computed again in double precision.  A tile returns a number of links and a
parent per vector, never its pairs, so dense groups stay linear.

All pairs of a label are compared, so work grows with the square of a label, in tiles of
even size.  Copies (equal components) are one vector with a multiplicity.

Vectors that are null, zero, or hold null or non-finite components link with nothing, and
so do null labels, null ids, and vectors of different length; each row gets its result.
A cosine of exactly ``least`` in double precision links; columns other than the three named
are not read, so clashing names are safe; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, drop_cut
from tessella.llm.components import components

BLOCK_ROWS = 1024
#: Room for rounding in the double-precision steps of the bound.
ROUNDING = 1e-9


def _packed(batches):
    """Vectors as bytes of doubles; null where a vector links with nothing."""
    for b in batches:
        out = []
        for v in b.column(2).to_pylist():
            if v is None or any(x is None for x in v):
                out.append(None)
                continue
            x = np.asarray(v, np.float64) + 0.0  # -0.0 becomes 0.0
            with np.errstate(over="ignore"):
                good = len(x) and np.isfinite(x).all() and 0 < np.abs(x).max()
            out.append(x.tobytes() if good else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the unit vectors: int8 codes, scales, and the norms of what the codes leave out."""
    x = x / np.abs(x).max(1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - scale[:, None] * codes
    return codes, scale, np.sqrt((rest * rest).sum(1))


def possible_pairs(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """Which pairs of two sides' codes have an upper bound of at least ``least``."""
    (qx, sx, ex), (qy, sy, ey) = x, y
    # Products of codes are integers below 2**24 for up to 1,040 components: exact in single precision.
    kind = np.float32 if qx.shape[1] <= 1040 else np.float64
    near = (qx.astype(kind) @ qy.astype(kind).T).astype(np.float64) * sx[:, None] * sy
    near += ex[:, None] + ey + ex[:, None] * ey + ROUNDING
    return near >= least


def linked_pairs(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows of x and of y whose cosine is at least ``least``."""
    i, j = np.nonzero(possible_pairs(quantised(x), quantised(y), least))
    sure = np.zeros(len(i), bool)
    for k in range(0, len(i), 65536):
        s = slice(k, k + 65536)
        a, b = x[i[s]], y[j[s]]
        a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
        sure[s] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))) >= least
    return i[sure], j[sure]


def _coded(batches):
    """(class, rep, hash, codes, scale, err) of (class, rep, vec, hash), with vectors as bytes of doubles."""
    for b in batches:
        vecs = b.column(2).to_pylist()
        codes, scale, err = [b""] * len(vecs), np.zeros(len(vecs)), np.zeros(len(vecs))
        by_length: dict[int, list[int]] = {}
        for k, v in enumerate(vecs):
            by_length.setdefault(len(v), []).append(k)
        for at in by_length.values():
            q, scale[at], err[at] = quantised(np.frombuffer(b"".join(vecs[k] for k in at), np.float64).reshape(len(at), -1))
            for k, row in zip(at, q, strict=True):
                codes[k] = row.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(codes, pa.binary()), pa.array(scale), pa.array(err)], names=["class", "rep", "hash", "codes", "scale", "err"])


def _parents(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that links lead to."""
    p = np.arange(n)
    while True:
        q = p.copy()
        np.minimum.at(q, i, p[j])
        np.minimum.at(q, j, p[i])
        q = q[q]
        if (q == p).all():
            return p
        p = q


def near_embeddings(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``."""
    rows = vectors.select(F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vec_col))
    rows = cut(rows.mapInArrow(_packed, "vec_id long, label string, vec binary"), "vectors")
    good = rows.filter("vec IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    # Vectors of another length are another class; so are equal vectors one node.
    reps = cut(good.groupBy(F.concat_ws(":", F.length("vec").cast("string"), "label").alias("class"), "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector_reps")
    blocks = cut(reps.groupBy("class").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "blocks")
    # Rows of one id may hold different vectors, which a 64-bit hash tells apart.
    coded = reps.select("class", "rep", "vec", F.xxhash64("vec").alias("hash")).mapInArrow(_coded, "class string, rep long, hash long, codes binary, scale double, err double")
    dealt = coded.join(blocks, "class").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("class", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "hash", "codes", "scale", "err")

    def sift(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.flatnonzero(pdf["block"].to_numpy() == k) for k in key[1:])
        q = np.frombuffer(b"".join(pdf["codes"]), np.int8).reshape(len(pdf), -1)
        scale, err = pdf["scale"].to_numpy(), pdf["err"].to_numpy()
        near = possible_pairs((q[a], scale[a], err[a]), (q[b], scale[b], err[b]), least)
        if key[1] == key[2]:
            np.fill_diagonal(near, False)
        return pdf.iloc[np.union1d(a[near.any(1)], b[near.any(0)])][["class", "i", "j", "block", "rep", "hash"]]

    def tile(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["vec"]), np.float64).reshape(len(pdf), -1)
        ids, copies, side = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        if key[1] == key[2]:
            i, j = linked_pairs(x, x, least)
            i, j = i[i != j], j[i != j]
            links = np.zeros(len(pdf), np.int64)
            np.add.at(links, i, copies[j])
        else:
            a, b = np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])
            i, j = linked_pairs(x[a], x[b], least)
            i, j = a[i], b[j]
            links = np.zeros(len(pdf), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
        parent = ids[_parents(len(pdf), i, j)]
        some = links > 0
        return pd.DataFrame({"rep": ids[some], "links": links[some], "parent": parent[some]})

    sifted = tiles.groupBy("class", "i", "j").applyInPandas(sift, "class string, i int, j int, block int, rep long, hash long")
    tiles = sifted.join(reps.select("class", "rep", F.xxhash64("vec").alias("hash"), "copies", "vec"), ["class", "rep", "hash"])
    made = cut(tiles.groupBy("class", "i", "j").applyInPandas(tile, "rep long, links long, parent long"), "tiles")
    same = good.select("vec_id", F.concat_ws(":", F.length("vec").cast("string"), "label").alias("class"), "vec").join(reps, ["class", "vec"]).select("vec_id", "rep", "copies")
    same = cut(same, "copies")
    odd = same.groupBy("vec_id").agg(F.count_distinct("rep").alias("n")).filter("n > 1")
    links = made.select(F.col("rep").alias("a"), F.col("parent").alias("b"))
    comp = components(links.union(same.filter("vec_id != rep").join(odd, "vec_id", "left_semi").select("vec_id", "rep")))
    counted = cut(made.groupBy("rep").agg(F.sum("links").alias("links")).join(comp.withColumnRenamed("node", "rep"), "rep", "full"), "counted")
    for t in (reps, blocks, made, comp):
        drop_cut(t)
    found = same.join(counted, "rep", "left").groupBy("vec_id").agg(
        F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id")
    )
    out = rows.select("vec_id").join(found, "vec_id", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def op3_embeddings(spark, sf_dir: str) -> DataFrame:
    """Groups of near-equal embeddings within each label."""
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id
      WHERE list_inner_product(x.v, y.v) / (x.n * y.n) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a),
k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.k, 0)::BIGINT AS n_links, coalesce(m.c, e.vec_id) AS component_id, coalesce(m.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN m ON m.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
