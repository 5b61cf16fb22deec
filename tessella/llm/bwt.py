"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

The segments of a bucket (see ``passages``) are dealt to shards.  A shard's transform
comes from its sorted suffixes.  Two transforms are merged without sorting suffixes again:
an interleave says which shard each suffix of the merged order comes from; a stable pass
over the transform in the present order, two bytes at a time, refines it by these; after k
passes suffixes stand in order of their first 2k bytes, and neighbours not told apart so
far have a common prefix of that length.  As windows have a fixed even length, half as
many passes do.  Neighbours with a common prefix of a whole window make an interval, and
the least document of an interval tells which of its windows occur in an earlier document.

Before the merge, segments none of whose windows has a hash that another segment has are
left out; the intervals decide about the rest.

Null or empty text has no bytes; texts are read whole; a null id keeps its row, untouched
and without effect; rows that share an id never remove each other's text; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.passages import _BYTES, Units, cut_repeats, grams

WINDOW_BYTES, GRAM_BYTES = 50, 24
SHARDS = 2
_END = 0  # stands before and after each segment; bytes are shifted up by one, and UTF-8 has none above 0xF4


class Shard:
    """Symbols of some segments, the order of their suffixes, and the transform in that order.

    The transform has the two symbols before each suffix as one code; what stands after an
    end symbol does not count.
    """

    def __init__(self, text: np.ndarray, order: np.ndarray):
        self.text, self.order = text, order
        pairs = np.roll(text, 2).astype(np.uint16) << np.uint16(8) | np.roll(text, 1)
        pairs[pairs < 256] = 0
        self.bwt = pairs[order]


def build(pieces: list[bytes], depth: int) -> Shard:
    """Sorts one shard's suffixes by their first ``depth`` symbols, by doubling from eight."""
    text = np.frombuffer(b"\xff" + b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)  # 0xFF becomes the end symbol
    n, stop = len(text), np.flatnonzero(text == _END)
    until = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)
    code = np.zeros(n, np.uint64)
    for k in range(8):
        code <<= np.uint64(8)
        reach = np.flatnonzero(until > k)
        code[reach] |= text[reach + k].astype(np.uint64)
    _, rank = np.unique(code, return_inverse=True)
    size = 8
    while size < depth:
        later = np.zeros(n, np.int64)
        at = np.flatnonzero(until >= size)
        later[at] = rank[at + size] + 1
        _, rank = np.unique(rank * (n + 1) + later, return_inverse=True)
        size *= 2
    return Shard(text, np.argsort(rank, kind="stable"))


def merge(a: Shard, b: Shard, depth: int) -> tuple[Shard, np.ndarray]:
    """The merged shard, and for each suffix whether it shares ``depth`` (an even number of) symbols with the one before it."""
    n = len(a.order) + len(b.order)
    second = np.zeros(n, bool)
    second[len(a.order) :] = True
    group = np.zeros(n, np.int32)  # the class of suffixes not told apart so far
    merged = np.empty(n, np.uint16)
    for _ in range(depth // 2):
        merged[~second] = a.bwt
        merged[second] = b.bwt
        # The suffix two symbols longer than the one at place i is sorted by these two, then by i.
        to = np.argsort(merged, kind="stable")
        first, inner = merged[to], group[to]
        edge = np.empty(n, bool)
        edge[0] = True
        edge[1:] = (first[1:] != first[:-1]) | ((inner[1:] != inner[:-1]) & (first[1:] & np.uint16(255) != _END))
        group = np.cumsum(edge, dtype=np.int32)
        second = second[to]
    order = np.empty(n, np.int64)
    order[~second] = a.order
    order[second] = b.order + len(a.text)
    out = Shard.__new__(Shard)
    out.text, out.order, out.bwt = np.concatenate([a.text, b.text]), order, np.empty(n, np.uint16)
    out.bwt[~second], out.bwt[second] = a.bwt, b.bwt
    return out, ~edge


def earlier_windows(pieces: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each segment which of its windows a segment of a smaller document has."""
    size = WINDOW_BYTES
    out = [np.zeros(len(p) - size + 1, bool) for p in pieces]
    lens = np.array([len(p) for p in pieces])
    hashed = grams(_BYTES[np.frombuffer(b"".join(pieces), np.uint8)], size)
    owner = np.repeat(np.arange(len(pieces)), lens)[: len(hashed)]
    last = np.repeat(np.cumsum(lens), lens)[: len(hashed)] - np.arange(len(hashed)) >= size
    distinct, inverse, n = np.unique(hashed[last], return_inverse=True, return_counts=True)
    shared = np.unique(owner[last][n[inverse] > 1])
    if len(shared) < 2:
        return out
    ends = np.array_split(shared, min(SHARDS, len(shared)))
    whole = build([pieces[k] for k in ends[0]], size)
    for part in ends[1:]:
        whole, same = merge(whole, build([pieces[k] for k in part], size), size)
    # Each suffix's segment and place in it.
    begin = np.flatnonzero(whole.text == _END)
    row = np.searchsorted(begin, whole.order, side="right") - 1
    place = whole.order - begin[np.maximum(row, 0)] - 1
    # A shard of m segments has m + 1 end symbols, so the first of each shard opens no segment.
    opens = np.concatenate([np.append(part, -1) for part in ends]).astype(np.int64)
    segment = opens[row]
    interval = np.cumsum(~same)
    inside = (segment >= 0) & (place >= 0)
    ok = inside.copy()
    ok[inside] = place[inside] + size <= lens[segment[inside]]
    interval, segment, place = interval[ok], segment[ok], place[ok]
    least = np.full(int(interval.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, interval, docs[segment])
    late = least[interval] < docs[segment]
    for k, p in zip(segment[late].tolist(), place[late].tolist(), strict=True):
        out[k][p] = True
    return out


UNITS = Units(WINDOW_BYTES, GRAM_BYTES, words=False, within=False, kernel=earlier_windows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is binary, as cuts may fall inside a character."""
    return cut_repeats(docs, UNITS, id_col, text_col).withColumnRenamed("n_units", "n_bytes")


def op6_suffix_array(spark, sf_dir: str) -> DataFrame:
    """Bytes of repeated 50-byte strings taken out of every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS g
      FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM t WHERE len(h) >= 100)),
d AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS m FROM g) WHERE m < doc_id),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM d),
s AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN i = b + 1 THEN 0 ELSE 1 END) AS spans
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -9) AS b FROM p) GROUP BY 1),
o AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM t),
k AS (SELECT o.doc_id, string_agg(substr(h, 2 * o.i + 1, 2), '' ORDER BY o.i) AS kept
      FROM o ANTI JOIN p ON o.doc_id = p.doc_id AND o.i = p.i GROUP BY 1)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(s.n, 0)::BIGINT AS n_removed, coalesce(s.spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM t LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)
"""
