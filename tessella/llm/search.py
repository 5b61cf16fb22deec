"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are cut into blocks of bounded text.  A block's grid has a row for each of its terms
and a column for each document in order of id; a cell holds the term's impact there.  The grid
is a K2-treap: a quadtree whose nodes keep a four-bit mask of the quadrants that hold anything
and the greatest impact below, stored as the difference to their parent's, level by level.
Rows are ordered by their greatest impact, so that what a node holds is alike.

An item's terms are rows.  Their paths from the root descend jointly: a state is a range of
documents with the node of each term over that range, and its bound is the sum of the terms'
weights times their nodes' maxima.  States with the greatest bounds are opened first (a fixed
number at a time, as arrays), each into the two halves of its range; at a single document the
bound is the score.  A block is done when no bound reaches the tenth best score that the task
has seen, so results are exact.

``build_index`` reads the texts once, as blocks of term counts; impacts need corpus totals, so
the treaps are made from these blocks.  ``search`` takes items in blocks of bounded size: each
block of items is broadcast, its terms' document frequencies are summed up from the tiles, and
every tile is searched.  A task returns at most ten documents per item, and these are merged
in two steps, so neither a frequent term nor an item gathers anything in one task.

Null or empty texts and texts without a term are no documents (they do not count in N) and no
items.  Texts are read whole; a very long one is a block of its own.  Each row is a document,
so repeated rows rank apart; ties go to the lesser id, null ids last.  Items that share an id
are one item with the terms of all.  Empty tables give an empty result.  Columns other than
those named are not read, so clashing names are safe.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, drop_cut
from tessella.llm.exchange import press, unpress
from tessella.llm.licenses import word_line

#: Text and documents of a block, states opened at a time, and terms of items in a broadcast.
BLOCK_BYTES, BLOCK_DOCS = 8_000_000, 1 << 16
OPENED = 256
ITEM_TERMS = 1_000_000
#: Parts in which an item's candidates are cut down before they meet.
MERGE_PARTS = 64

_BLOCK = "ids array<long>, n binary, vocab binary, row binary, col binary, tf binary, n_docs long, n_terms long"
_TILE = "ids array<long>, vocab binary, df binary, height int, masks binary, drops binary, top long"


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _kinds(schema: str) -> pa.Schema:
    of = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(x.split()[0], of[x.split()[1]]) for x in schema.split(", ")])


def _block(ids: list, docs: list[np.ndarray], terms: list[bytes]) -> dict:
    """Term counts of one block; documents by id, those without one last."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    n = np.array([len(docs[k]) for k in order], np.int64)
    cell, tf = np.unique(np.repeat(np.arange(len(n)), n) * len(terms) + np.concatenate([docs[k] for k in order]), return_counts=True)
    col, row = np.divmod(cell, len(terms))
    return {"ids": [ids[k] for k in order], "n": press(n), "vocab": press(np.frombuffer(b" ".join(terms), np.uint8)), "row": press(row.astype(np.int32)), "col": press(col.astype(np.int32)), "tf": press(tf.astype(np.int64)), "n_docs": len(n), "n_terms": int(n.sum())}


def _counted(batches, block_bytes: int, block_docs: int):
    """Blocks of term counts of consecutive documents."""
    kinds = _kinds(_BLOCK)

    def fresh():
        numbers: defaultdict = defaultdict()
        numbers.default_factory = numbers.__len__
        return numbers, [], [], 0

    numbers, ids, docs, size = fresh()
    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            words = word_line(t.as_py())[0].split(" ")[1:-1]
            if not words or words == [""]:
                continue
            ids.append(i.as_py())
            docs.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            size += 8 * len(words)
            if size >= block_bytes or len(ids) >= block_docs:
                yield pa.RecordBatch.from_pylist([_block(ids, docs, [w.encode("latin-1") for w in numbers])], kinds)
                numbers, ids, docs, size = fresh()
    if ids:
        yield pa.RecordBatch.from_pylist([_block(ids, docs, [w.encode("latin-1") for w in numbers])], kinds)


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's weight is multiplied with where it stands ``tf`` times in a document of ``n`` terms."""
    m = 100 - 90 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2**31 at every other place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def treap(row: np.ndarray, col: np.ndarray, value: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Masks of inner nodes, and per node but the root its parent's maximum less its own; both level by level.  And the root's maximum."""
    code = (_spread(row) << np.uint64(1)) | _spread(col)
    order = np.argsort(code)
    code, value = code[order], value[order]
    masks, drops = [], []
    for _ in range(height):
        first = np.flatnonzero(np.diff(code >> np.uint64(2), prepend=np.uint64(2**64 - 1)))
        most = np.maximum.reduceat(value, first)
        masks.append(np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (code & np.uint64(3)).astype(np.uint8)), first))
        drops.append(np.repeat(most, np.diff(first, append=len(code))) - value)
        code, value = code[first] >> np.uint64(2), most
    return np.concatenate([*masks[::-1], np.zeros(0, np.uint8)]), np.concatenate([*drops[::-1], np.zeros(0, np.int64)]), int(value[0])


_POPULATION = np.array([bin(k).count("1") for k in range(16)], np.int64)


class Treap:
    """A stored treap ready to descend: nodes are numbered level by level, the root is 0."""

    def __init__(self, height: int, masks: np.ndarray, drops: np.ndarray, top: int):
        self.height, self.masks = height, masks
        counts = _POPULATION[masks]
        self.child = np.cumsum(counts) - counts + 1  # the number of the first child
        self.most = np.empty(len(drops) + 1, np.int64)
        self.most[0] = top
        begin, end = 0, 1
        while begin < len(masks):  # a level at a time, as maxima come from the level above
            end = min(end, len(masks))
            own = slice(int(self.child[begin]), int(self.child[end - 1] + counts[end - 1]))
            self.most[own] = np.repeat(self.most[begin:end], counts[begin:end]) - drops[own.start - 1 : own.stop - 1]
            begin, end = end, own.stop

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> list[tuple[int, int]]:
        """(score, column) of the ``k`` best columns, those with a score of ``least`` and more; ties to the lesser column.

        All columns that tie with the last are returned as far as they were opened; callers cut.
        """
        nodes, begin, level = np.zeros((1, len(rows)), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([int(weights.sum()) * int(self.most[0])])
        got_s, got_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            alive = bound >= least
            nodes, begin, level, bound = nodes[alive], begin[alive], level[alive], bound[alive]
            if not len(bound):
                break
            order = np.lexsort((begin, -bound))
            now, later = order[:OPENED], order[OPENED:]
            done = level[now] == self.height
            if done.any():
                got_s, got_c = np.concatenate([got_s, bound[now[done]]]), np.concatenate([got_c, begin[now[done]]])
                if len(got_s) >= k:
                    keep = np.lexsort((got_c, -got_s))[:k]
                    got_s, got_c = got_s[keep], got_c[keep]
                    least = max(least, int(got_s[-1]))
                now = now[~done]
            # Each range opened becomes its two halves: every term goes to the quadrant of its row there.
            at, depth = nodes[now], self.height - 1 - level[now]
            mask = np.where(at >= 0, self.masks[np.maximum(at, 0)], 0) if len(now) and self.height else np.zeros_like(at)
            low = ((rows[None, :] >> depth[:, None]) & 1) * 2
            halves = []
            for half in (0, 1):
                quadrant = low + half
                there = (mask >> quadrant) & 1 == 1
                child = self.child[np.maximum(at, 0)] + _POPULATION[mask & ((1 << quadrant) - 1)] if len(now) else at
                halves.append((np.where(there, child, -1), begin[now] + (half << depth if len(now) else 0)))
            fresh = np.concatenate([x for x, _ in halves])
            reach = (np.where(fresh >= 0, self.most[np.maximum(fresh, 0)], 0) * weights).sum(1)
            nodes = np.concatenate([nodes[later], fresh])
            begin = np.concatenate([begin[later], *[x for _, x in halves]])
            level = np.concatenate([level[later], level[now] + 1, level[now] + 1])
            bound = np.concatenate([bound[later], reach])
        return list(zip(got_s.tolist(), got_c.tolist(), strict=True))


def _tiled(batches, n_docs: int, n_terms: int):
    """Treaps of blocks."""
    kinds = _kinds(_TILE)
    for b in batches:
        for k in range(b.num_rows):
            cell = {c: b[c][k].as_py() for c in ("vocab", "n", "row", "col", "tf")}
            n, row, col, tf = (unpress(cell[c], t) for c, t in (("n", np.int64), ("row", np.int32), ("col", np.int32), ("tf", np.int64)))
            value = impact(tf, n[col], n_docs, n_terms)
            terms = unpress(cell["vocab"], np.uint8).tobytes().split(b" ")
            top = np.zeros(len(terms), np.int64)
            np.maximum.at(top, row, value)
            order = np.argsort(-top, kind="stable")
            place = np.empty(len(terms), np.int64)
            place[order] = np.arange(len(terms))
            height = max(len(terms) - 1, len(n) - 1).bit_length()
            masks, drops, most = treap(place[row], col, value, height)
            df = np.bincount(place[row], minlength=len(terms))
            made = {"ids": b["ids"][k].as_py(), "vocab": press(np.frombuffer(b" ".join(terms[j] for j in order), np.uint8)), "df": press(df.astype(np.int32)), "height": height, "masks": press(masks), "drops": press(drops.astype(np.int32)), "top": most}
            yield pa.RecordBatch.from_pylist([made], kinds)


@dataclass
class LexicalIndex:
    """Tiles of the grid, the number of documents with a term, and that of all their terms."""

    tiles: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> LexicalIndex:
    """The index of every row of ``docs``, as a written table."""
    blocks = cut(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lambda x: _counted(x, block_bytes, block_docs), _BLOCK), "term_blocks")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    tiles = cut(blocks.drop("n_docs", "n_terms").mapInArrow(lambda x: _tiled(x, n_docs, n_terms), _TILE), "treaps")
    drop_cut(blocks)
    return LexicalIndex(tiles, n_docs, n_terms)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(batches):
    for b in batches:
        ids, terms = [], []
        for i, t in zip(b.column(0), b.column(1), strict=True):
            for w in dict.fromkeys(word_line(t.as_py())[0].split(" ")[1:-1]):
                if w:
                    ids.append(i.as_py())
                    terms.append(w.encode("latin-1"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])


def _frequencies(batches, wanted):
    """Documents of a task's tiles that hold each wanted term."""
    total: dict[bytes, int] = {}
    for b in batches:
        for k in range(b.num_rows):
            df = unpress(b["df"][k].as_py(), np.int32)
            for j, w in enumerate(unpress(b["vocab"][k].as_py(), np.uint8).tobytes().split(b" ")):
                if w in wanted.value:
                    total[w] = total.get(w, 0) + int(df[j])
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])


def _found(batches, items, k: int):
    """The best ``k`` documents of a task's tiles for every item."""
    ids, queries = items.value
    best: list[list[tuple]] = [[] for _ in ids]  # sorted (-score, no id, id)
    wanted = {w for q in queries for w in q}
    for b in batches:
        for t in range(b.num_rows):
            terms = unpress(b["vocab"][t].as_py(), np.uint8).tobytes().split(b" ")
            place = {w: j for j, w in enumerate(terms) if w in wanted}
            if not place:
                continue
            tile = Treap(b["height"][t].as_py(), unpress(b["masks"][t].as_py(), np.uint8), unpress(b["drops"][t].as_py(), np.int32), b["top"][t].as_py())
            docs = b["ids"][t].as_py()
            for q, query in enumerate(queries):
                here = [(place[w], x) for w, x in query.items() if w in place]
                if here:
                    least = -best[q][-1][0] if len(best[q]) == k else 1
                    got = tile.best(np.array([r for r, _ in here], np.int64), np.array([x for _, x in here], np.int64), k, least)
                    best[q] = sorted([*best[q], *((-s, docs[c] is None, docs[c] or 0) for s, c in got)])[:k]
    rows = [(ids[q], None if none else d, -s) for q, own in enumerate(best) for s, none, d in own]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])


def search(index: LexicalIndex, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0."""
    spark = items.sparkSession
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col)).mapInArrow(_item_terms, "item_id long, term binary")
    asked = cut(asked.distinct(), "item_terms")
    blocks = max(1, math.ceil(asked.count() / item_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = None
    for block in range(blocks):  # about ITEM_TERMS terms each
        rows = asked.filter(F.col("block") == block).select("item_id", "term").toArrow().to_pydict()
        wanted = spark.sparkContext.broadcast(frozenset(map(bytes, rows["term"])))
        df = index.tiles.select("vocab", "df").mapInArrow(lambda x, w=wanted: _frequencies(x, w), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weights = {bytes(r["term"]): weight(r["df"], index.n_docs) for r in df.toLocalIterator()}  # a number for each term of the block
        queries: dict = {}
        for i, w in zip(rows["item_id"], rows["term"], strict=True):
            if weights.get(bytes(w), 0) > 0:
                queries.setdefault(i, {})[bytes(w)] = weights[bytes(w)]
        sent = spark.sparkContext.broadcast((list(queries), list(queries.values())))
        got = index.tiles.drop("df").mapInArrow(lambda x, s=sent: _found(x, s, k), "item_id long, doc_id long, score long")
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        part = Window.partitionBy("item_id", "part").orderBy(*order)
        got = got.withColumn("part", F.spark_partition_id() % MERGE_PARTS).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
        got = got.select("item_id", "doc_id", "score", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).alias("rank")).filter(F.col("rank") <= k)
        got = cut(got.select("item_id", "rank", "doc_id", "score"), "ranked")
        for x in (wanted, sent):
            x.unpersist()
        out = got if out is None else out.unionByName(got)
    drop_cut(asked)
    return out


def op12_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    drop_cut(index.tiles)
    return out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
tot AS (SELECT count(*)::BIGINT AS nd, sum(len(t))::BIGINT AS nt FROM d WHERE len(t) > 0),
u AS (SELECT r, unnest(t) AS term FROM d),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM u GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot GROUP BY term, nd),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(t)::BIGINT * nd) // nt AS m FROM d, tot WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
