"""Substring dedup: suffix automata of reference shards and matching statistics.

The segments of a bucket (see ``passages``) are a reference shard.  In order of document
and place each segment first streams through the shard's suffix automaton, which gives
its matching statistics: the length of the longest earlier match that ends at each word.
Where that reaches the window's length, the window occurs earlier.  Then the segment
joins the automaton.

Automata are not broadcast to all tasks: a shard's automaton meets just the segments that
can match it, so its size has a bound and no text streams past all shards.

Null or empty text has no words; texts are read whole; a null id keeps its row, untouched
and without effect; of rows that share an id one counts as the earlier; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.passages import Units, cut_repeats

WINDOW_WORDS, GRAM_WORDS = 20, 5


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._split(last, c, q)
                continue
            new = len(size)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for what ends in ``q`` after ``p``."""
        nxt, link, size = self.next, self.link, self.size
        copy = len(size)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def matches(self, sequence: list[int]) -> list[int]:
        """For each place the length of the longest substring that ends there and was added."""
        nxt, link, size = self.next, self.link, self.size
        state, n, out = 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                n = size[state]
            q = nxt[state].get(c)
            if q is None:
                n = 0
            else:
                state = q
                n += 1
            out.append(n)
        return out


def earlier_windows(pieces: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each segment which of its windows some segment before it has."""
    shard, out = SuffixAutomaton(), []
    for piece in pieces:
        s = np.frombuffer(piece, np.uint64).tolist()
        out.append(np.array(shard.matches(s)[WINDOW_WORDS - 1 :]) >= WINDOW_WORDS)
        shard.add(s)
    return out


UNITS = Units(WINDOW_WORDS, GRAM_WORDS, words=True, within=True, kernel=earlier_windows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept): words left, joined by one space."""
    out = cut_repeats(docs, UNITS, id_col, text_col)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "n_spans", F.col("kept").cast("string").alias("kept"))


def op9_substring(spark, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows taken out of every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
d AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM d),
o AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT o.doc_id, string_agg(x, ' ' ORDER BY o.i) AS kept FROM o ANTI JOIN p ON o.doc_id = p.doc_id AND o.i = p.i GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
