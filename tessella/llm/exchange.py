"""Chunks ask ranges of keys: each chunk's keys meet all others' and values come back in order.

A chunk has very many distinct keys, so they travel in packets: sorted, as compressed byte
planes of their steps.  Each chunk makes one packet for each of ``FAN`` ranges of the key
space, whatever the input's size, so packets grow with the input alone.  Where a range would
hold more than ``GROUP_KEYS`` keys, the packets of some ``FAN`` chunks in one range are merged
and cut into ``FAN`` finer ranges, and so on; answers go the same way back.  Every task so
holds a bounded number of keys at any size of input, and a key that all chunks have is one
key of a merged packet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

FAN_BITS, KEY_BITS = 6, 56
FAN = 1 << FAN_BITS
#: Keys, as packets count them, that a range may hold on the average.
GROUP_KEYS = 3_000_000

PACKETS = "owner long, part long, keys binary, n binary"
_ANSWERS = "owner long, part long, answer binary, hits long, known long"
#: Gets the distinct keys of a range and their total counts, and returns a value for each.
Solve = Callable[[np.ndarray, np.ndarray], np.ndarray]


def press(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpress(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def planes(keys: np.ndarray) -> bytes:
    """Sorted 56-bit keys as compressed byte planes of their steps."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return press(steps.view(np.uint8).reshape(-1, 8)[:, :7].T)


def unplanes(x: bytes) -> np.ndarray:
    raw = unpress(x, np.uint8).reshape(7, -1)
    steps = np.zeros((raw.shape[1], 8), np.uint8)
    steps[:, :7] = raw.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def packets(owner: int, keys: np.ndarray, n: np.ndarray, level: int = 0) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows of :data:`PACKETS` for sorted distinct keys and their counts."""
    part = (keys >> np.uint64(KEY_BITS - FAN_BITS * (level + 1))).astype(np.int64)
    ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
    for a, e in zip(ends[:-1], ends[1:], strict=True):
        if e > a:
            yield owner, int(part[a]), planes(keys[a:e]), press(n[a:e].astype(np.int64))


def packet_batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = [("owner", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], schema=pa.schema(kinds))


def _together(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of some packets, their counts, each packet key's place among them, and where packets end."""
    keys = [unplanes(x) for x in pdf["keys"]]
    words, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([unpress(x, np.int64) for x in pdf["n"]]), len(words)).astype(np.int64)
    return words, total, inverse, np.cumsum([0, *map(len, keys)])


def _answers(pdf: pd.DataFrame, values: np.ndarray, ends: np.ndarray, known: int) -> pd.DataFrame:
    """One row per packet; ``values`` are of its keys, one packet after another."""
    rows = [(o, p, press(values[a:e]), np.count_nonzero(values[a:e])) for o, p, a, e in zip(pdf["owner"], pdf["part"], ends[:-1], ends[1:], strict=True)]
    out = pd.DataFrame(rows, columns=["owner", "part", "answer", "hits"])
    out["known"] = [known, *[0] * (len(rows) - 1)]
    return out


def ask(sent: DataFrame, total: int, solve: Solve, kind: str, level: int = 0, finest: int = KEY_BITS) -> tuple[DataFrame, DataFrame]:
    """(owner, part, answer, hits) per packet of ``sent``, and a table whose ``known`` sums to the number of keys with a count.

    ``total``: keys of all packets; ``kind``: the numpy type of values; ``hits``: how many of a packet's are not 0;
    ``finest``: leading bits of a key that ranges may differ in at most, where values depend on what shares those bits.
    """

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        words, n, inverse, ends = _together(pdf)
        return _answers(pdf, solve(words, n).astype(kind)[inverse], ends, int((n > 0).sum()))

    if total <= GROUP_KEYS << FAN_BITS * (level + 1) or FAN_BITS * (level + 2) > finest:
        out = cut(sent.groupBy("part").applyInPandas(leaf, _ANSWERS), "answers")
        return out, out
    sent = cut(sent, "packets")
    groups = sent.select("owner").distinct().count() // FAN + 1
    sent = sent.withColumn("group", F.col("part") * groups + F.pmod(F.xxhash64("owner"), F.lit(groups)))

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words, n, _, _ = _together(pdf)
        return pd.DataFrame(list(packets(key[0], words, n, level + 1)), columns=["owner", "part", "keys", "n"])

    def back(asked: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        _, _, inverse, ends = _together(asked)
        values = np.concatenate([unpress(x, kind) for x in got.sort_values("part")["answer"]])
        return _answers(asked, values[inverse], ends, 0)

    finer, leaves = ask(sent.groupBy("group").applyInPandas(merge, PACKETS), total, solve, kind, level + 1, finest)
    finer = finer.withColumnRenamed("owner", "group")
    return cut(sent.groupBy("group").cogroup(finer.groupBy("group")).applyInPandas(back, _ANSWERS), "answers"), leaves


def by_owner(answers: DataFrame, name: str) -> DataFrame:
    """(owner, ``name``): each chunk's answers in the order of its keys, as an array of binaries."""
    rows = F.sort_array(F.collect_list(F.struct("part", "answer")))
    return answers.groupBy("owner").agg(rows.alias(name)).select("owner", F.col(f"{name}.answer").alias(name))


def joined_answers(cell, kind: str) -> np.ndarray:
    """One array of what :func:`by_owner` gives for a chunk."""
    return np.concatenate([np.zeros(0, kind), *[unpress(x, kind) for x in cell or []]])
