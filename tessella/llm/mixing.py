"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every row has a permutation key (a hash), whose leading bits name its block within its
source.  A source's quota is a number of whole passes over its blocks plus a part of a
pass: blocks in permuted order as long as they fit, and the smallest block left over in
part, by the next bits of the key.  A tree then splits the vector of source quotas over
the output shards: each inner node deals its left half a multivariate-hypergeometric draw
of blocks, each leaf holds exact block counts per source, and the counts cut every
source's permuted block list into disjoint ranges.  Rows go to the shards of their blocks
and are shuffled there by a second hash.

Shards hold about ``SHARD_WORDS`` words, with no upper bound on their number, and a source
has at least ``BLOCKS_PER_SHARD`` blocks for each shard.  Gathered on the driver: one number
per source and block, and per leftover block one per sub-block: never rows, but a mix over
very many sources (hosts, say) should first group the rare ones.

Defined results: null text has size 0; a null source is a source of its own, last; a row
of size 0 is drawn like any other; repeated rows are drawn together; very long texts are
single rows as others; working columns carry a prefix, so clashing names are safe; an empty
table gives an empty mix; reruns agree, as all draws are seeded and depend on the rows alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
BLOCK_BITS, SUB_BITS = 8, 12  # of the permutation key; blocks get more bits where there are many shards
SHARD_WORDS, BLOCKS_PER_SHARD = 4_000_000, 8
MAX_REPEATS = 3


def targets(sizes: list[int], weights: list[int], most: int = MAX_REPEATS) -> list[Fraction]:
    """Shares of the total by weight, none above ``most`` times its size; the excess is reshared by weight."""
    total, capped = Fraction(sum(sizes)), [False] * len(sizes)
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        open_weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        out = [Fraction(most * s) if c else left * w / open_weight for s, w, c in zip(sizes, weights, capped, strict=True)]
        over = [k for k, (t, s) in enumerate(zip(out, sizes, strict=True)) if t > most * s]
        if not over:
            return out
        for k in over:
            capped[k] = True


def first_fit(order: list[int], size: dict[int, int], room: Fraction) -> tuple[list[int], Fraction]:
    """Items in order as long as they fit; what room is left."""
    taken = []
    for k in order:
        if size[k] <= room:
            taken.append(k)
            room -= size[k]
    return taken, room


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Exact counts per shard and source whose columns sum to ``quotas``."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    n = int(quotas.sum()) * left // shards
    draw = rng.multivariate_hypergeometric(quotas, n, method="marginals") if n else np.zeros_like(quotas)
    return np.concatenate([split_tree(draw, left, rng), split_tree(quotas - draw, shards - left, rng)])


@dataclass(frozen=True)
class Mix:
    """``sized``: every row with size, source key, block and sub-block; ``blocks``: per source key and block its draws and its source's figures."""

    sized: DataFrame
    blocks: DataFrame
    shards: int
    block_bits: int


_BLOCKS = "skey string, block int, source_size long, target double, draws array<struct<shard:int,pass:int,subs:array<int>>>"


def with_keys(docs: DataFrame, seed: int, id_col: str, source_col: str) -> DataFrame:
    """Adds ``__m_skey`` and ``__m_key``."""
    skey = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("null"))
    return docs.withColumn("__m_skey", skey).withColumn("__m_key", F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")))


def with_blocks(df: DataFrame, bits: int) -> DataFrame:
    """Adds ``__m_block`` and ``__m_sub``, the leading bits of the key."""
    key = F.col("__m_key")
    df = df.withColumn("__m_block", F.shiftrightunsigned(key, 64 - bits).cast("int"))
    return df.withColumn("__m_sub", F.shiftrightunsigned(F.shiftleft(key, bits), 64 - SUB_BITS).cast("int"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Sizes of all rows, targets, and which blocks go where."""
    spark = docs.sparkSession
    size = word_count(text_or_empty(F.col(f"`{text_col}`"))).alias("__m_size")
    sized = cut(with_keys(docs, seed, id_col, source_col).select(F.col(f"`{id_col}`"), size, "__m_skey", "__m_key"), "sizes")
    total = sized.agg(F.coalesce(F.sum("__m_size"), F.lit(0))).first()[0]
    shards = shards or total // SHARD_WORDS + 1
    bits = max(BLOCK_BITS, (BLOCKS_PER_SHARD * shards - 1).bit_length())
    sized = with_blocks(sized, bits)
    per_block: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("__m_skey", "__m_block").agg(F.sum("__m_size").alias("n")).collect():
        per_block.setdefault(r["__m_skey"], {})[r["__m_block"]] = r["n"]
    names = sorted(per_block, key=lambda s: (s == "null", s))
    sizes = [sum(per_block[s].values()) for s in names]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(names))]) if sum(sizes) else [Fraction(0)] * len(names)
    units: list[list[tuple[int, int]]] = []  # per source: (block, pass)
    partial: dict[str, tuple[int, int, Fraction]] = {}
    for k, s in enumerate(names):
        order = np.random.default_rng([seed, k]).permutation(sorted(per_block[s])).tolist()
        whole = int(goal[k] / sizes[k]) if sizes[k] else 0
        own = [(b, p) for p in range(whole) for b in order]
        room = goal[k] - whole * sizes[k]
        if room > 0:
            taken, room = first_fit(order, per_block[s], room)
            own += [(b, whole) for b in taken]
            if rest := [b for b in order if b not in set(taken)]:
                least = min(rest, key=lambda b: per_block[s][b])
                partial[s] = (least, whole, room)
        units.append(own)
    subs: dict[str, list[int]] = {}
    if partial:
        chosen = spark.createDataFrame([(s, b) for s, (b, _, _) in partial.items()], "__m_skey string, __m_block int")
        found: dict[str, dict[int, int]] = {}
        for r in sized.join(chosen, ["__m_skey", "__m_block"], "left_semi").groupBy("__m_skey", "__m_sub").agg(F.sum("__m_size").alias("n")).collect():
            found.setdefault(r["__m_skey"], {})[r["__m_sub"]] = r["n"]
        for s, (b, p, room) in partial.items():
            taken, left = first_fit(sorted(found[s]), found[s], room)
            rest = [x for x in found[s] if x not in set(taken)]
            if rest and abs(found[s][x := min(rest, key=lambda x: (found[s][x], x))] - left) < left:
                taken.append(x)  # one more comes nearer than none
            subs[s] = taken
            units[names.index(s)].append((b, p))
    quotas = np.array([len(u) for u in units], np.int64)
    counts = split_tree(quotas, shards, np.random.default_rng(seed)) if len(names) else np.zeros((shards, 0), np.int64)
    rows = []
    for k, s in enumerate(names):
        ends, draws = np.cumsum(counts[:, k]), {}
        for at, (b, p) in enumerate(units[k]):
            part = subs[s] if s in partial and (b, p) == partial[s][:2] else None
            draws.setdefault(b, []).append((int(np.searchsorted(ends, at, side="right")), p, part))
        rows += [(s, b, sizes[k], float(goal[k]), draws.get(b, [])) for b in per_block[s]]
    return Mix(sized, spark.createDataFrame(rows, _BLOCKS), shards, bits)


def _drawn(df: DataFrame, mix: Mix) -> DataFrame:
    """One row per row of ``df``, with ``__m_draws``: the draws that take it."""
    b = mix.blocks.select(*[F.col(c).alias(f"__b_{c}") for c in mix.blocks.columns])
    df = df.join(b, (F.col("__m_skey") == F.col("__b_skey")) & (F.col("__m_block") == F.col("__b_block")), "left")
    sub = F.col("__m_sub")
    return df.withColumn("__m_draws", F.filter("__b_draws", lambda d: d["subs"].isNull() | F.array_contains(d["subs"], sub)))


def mix_report(mix: Mix, id_col: str = "doc_id") -> DataFrame:
    """Per row: size, source_size, target, the words that the mix takes of it, how often, and into which shards."""
    return _drawn(mix.sized, mix).select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col("__m_size").alias("size"),
        F.col("__b_source_size").alias("source_size"),
        F.col("__b_target").alias("target"),
        (F.col("__m_size") * F.size("__m_draws")).cast("long").alias("taken"),
        F.size("__m_draws").cast("long").alias("passes"),
        F.concat_ws(",", F.transform(F.array_sort(F.transform("__m_draws", lambda d: d["shard"])), lambda k: k.cast("string"))).alias("shards"),
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, repeated as drawn, dealt to shards and shuffled within them."""
    mix = plan_mix(docs, weights, seed, shards, id_col, text_col, source_col)
    rows = _drawn(with_blocks(with_keys(docs, seed, id_col, source_col), mix.block_bits), mix)
    rows = rows.withColumn("__m_draw", F.explode("__m_draws")).withColumn("__m_shard", F.col("__m_draw.shard"))
    rows = rows.withColumn("__m_order", F.xxhash64(F.lit(seed + 1), F.col(f"`{id_col}`"), F.col("__m_draw.pass")))
    rows = rows.repartitionById(mix.shards, "__m_shard").sortWithinPartitions("__m_order")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix_report(plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
