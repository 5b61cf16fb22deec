"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Texts become chunks of token numbers with a sorted vocabulary each.  Chunks ask ranges of
token hashes for the exact training counts of their tokens (see ``exchange``).  The filter
holds every bigram of the training part with its quantised count: level q stands for counts
from ``LEVELS[q - 1]`` to below ``LEVELS[q]``, and the pairs (bigram, 1) to (bigram, q) are
stored, so that membership probes with rising levels find q.  It has one segment for each
value of the leading bits of a bigram's key; how many bits follows from the number of training
tokens alone, so the filter is the same bits wherever its segments are made and probed.

A filter has at most ``BITS_PER_LEVEL`` bits for each training token, as a bigram's level
never exceeds its count.  Where that bound is within ``MAX_FILTER_BYTES``, all segments are
broadcast to the workers, and each chunk probes them for its bigrams.  A larger filter
is not broadcast: each segment stays in the task that built it, the chunks' bigrams come
to it to be probed, and their levels go back.  Both ways give the same scores, however finely
the exchange cuts its ranges, and the corpus is read once in either.

The smoothed probability of w after u is

    (q(u,w) + m(u) b(w)) / (c(u) + m(u)),  b(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),  m(u) = c(u) ** HEAPS

with the counts c of training and q the middle of the bigram's level, c(u) at most.  With
exact counts these sum to one over w for each u; quantisation, which is exact for counts up
to 3, and false positives of the filter (about 1.5 % of bigrams never seen) are what is
left.  A context not seen leaves b(w) alone.

Null or empty text is the end token alone; a null id is held out; texts are read whole;
repeated rows count again; an empty table gives an empty table; columns other than the two
named are not read, so clashing names are safe.  Tokens and bigrams are told apart by
56-bit hashes.
"""

from __future__ import annotations

import uuid
import zlib
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut
from tessella.llm.exchange import FAN_BITS, KEY_BITS, PACKETS, ask, by_owner, joined_answers, packet_batch, packets, planes, press, unplanes, unpress
from tessella.llm.minhash import WordHashes, mixed

CHUNK_BYTES = 4_000_000
#: Exponent of the number of different words that follow a context, as a power of its count.
HEAPS = 0.7
PROBES, BITS_PER_LEVEL = 6, 9
#: Training tokens that a segment of the filter may have on the average.
SEGMENT_TOKENS = 1024
MAX_FILTER_BYTES = 16_000_000
_END, _START = xxhash.xxh64_intdigest(b"", seed=1), xxhash.xxh64_intdigest(b"", seed=2)
_ODD = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier: 2**64 over the golden ratio


def levels(most: int = 2**62) -> np.ndarray:
    """Least counts of the levels: each is half as much again as the one before, and one more at least."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, 3 * out[-1] // 2))
    return np.array(out, np.int64)


LEVELS = levels()
#: What a level stands for, from level 0 on: the middle of its counts.
VALUES = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2])

_TOKENS = "chunk long, ids array<long>, held array<boolean>, sizes array<int>, vocab binary, train binary, seq binary, n_vocab long, n_pairs long"


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def _tokens(batches, chunk_bytes: int):
    hashes = WordHashes()
    kinds = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("vocab", "train", "seq")], ("n_vocab", pa.int64()), ("n_pairs", pa.int64())])

    def row(ids, docs):
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        h = np.empty(int(sizes.sum()), np.uint64)
        ends = np.cumsum(sizes)
        word = np.ones(len(h), bool)
        word[ends - 1] = False
        h[word] = np.fromiter((x for d in docs for x in map(hashes.__getitem__, d)), np.uint64, int(word.sum()))
        h[~word] = _END
        held = [held_out(i) for i in ids]
        vocab, seq = np.unique(h >> np.uint64(8), return_inverse=True)
        train = np.bincount(seq[np.repeat(~np.array(held), sizes)], minlength=len(vocab))
        chunk = uuid.uuid4().int >> 65
        return {"chunk": chunk, "ids": ids, "held": held, "sizes": sizes.tolist(), "vocab": planes(vocab), "train": press(train.astype(np.int32)), "seq": press(seq.astype(np.int32)), "n_vocab": len(vocab), "n_pairs": len(h)}

    ids, docs, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            ids.append(i)
            docs.append(raw.lower().split())
            size += len(raw)
            if size >= chunk_bytes:
                yield pa.RecordBatch.from_pylist([row(ids, docs)], kinds)
                ids, docs, size = [], [], 0
    if ids:
        yield pa.RecordBatch.from_pylist([row(ids, docs)], kinds)


def _bigrams(vocab: np.ndarray, seq: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """56-bit keys of each token with the one before it in its text."""
    h = vocab[seq]
    before = np.roll(h, 1)
    before[np.cumsum(sizes) - sizes] = np.uint64(_START)
    return mixed(before * _ODD + mixed(h)) >> np.uint64(8)


def _ask_words(batches):
    for b in batches:
        for chunk, v, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
            yield packet_batch(list(packets(chunk, unplanes(v), unpress(t, np.int32))))


def _ask_bigrams(batches):
    for b in batches:
        for chunk, held, sizes, v, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
            keys = _bigrams(unplanes(v), unpress(s, np.int32), np.array(sizes, np.int64))
            keys, at = np.unique(keys, return_inverse=True)
            yield packet_batch(list(packets(chunk, keys, np.bincount(at[np.repeat(~np.array(held, bool), sizes)], minlength=len(keys)))))


def _places(keys: np.ndarray, level: int, probe: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    return mixed(keys * np.uint64(2 * level + 1) + np.uint64((probe + 1) * int(_ODD) % 2**64)) % bits


def segment_bits(n: int) -> int:
    """Leading bits of a key that name its segment, for ``n`` training tokens."""
    bits = FAN_BITS
    while n >> bits > SEGMENT_TOKENS and bits + FAN_BITS <= KEY_BITS:
        bits += FAN_BITS
    return bits


class BloomFilter(NamedTuple):
    """Segments in order of key: names, sizes in bits (multiples of eight), and their bits one after another."""

    names: np.ndarray
    sizes: np.ndarray
    field: np.ndarray

    @staticmethod
    def joined(parts: list[BloomFilter]) -> BloomFilter:
        """One filter of parts in order of key."""
        empty = BloomFilter(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
        return BloomFilter(*[np.concatenate(x) for x in zip(empty, *parts, strict=True)])


def _names(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(KEY_BITS - bits)


def bloom(keys: np.ndarray, n: np.ndarray, segment: int, bits_per_level: int = BITS_PER_LEVEL) -> BloomFilter:
    """The segments of distinct keys with these counts; keys without a count are not in them."""
    keys, level = keys[n > 0], np.searchsorted(LEVELS, n[n > 0], side="right")
    names, at = np.unique(_names(keys, segment), return_inverse=True)
    sizes = np.maximum(64, np.bincount(at, level, len(names)).astype(np.int64) * bits_per_level + 7 >> 3 << 3)
    start = (np.cumsum(sizes) - sizes).astype(np.uint64)
    field = np.zeros(int(sizes.sum()), bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        on = level >= q
        for p in range(PROBES):
            field[start[at[on]] + _places(keys[on], q, p, sizes.astype(np.uint64)[at[on]])] = True
    return BloomFilter(names, sizes, np.packbits(field))


def probe(keys: np.ndarray, f: BloomFilter, segment: int) -> np.ndarray:
    """Levels found by membership probes, each in the segment of its key; 0 for none."""
    level, q = np.zeros(len(keys), np.uint8), 0
    if not len(f.names):
        return level
    names, sizes, start = _names(keys, segment), f.sizes.astype(np.uint64), (np.cumsum(f.sizes) - f.sizes).astype(np.uint64)
    at = np.minimum(np.searchsorted(f.names, names), len(f.names) - 1)
    active = np.flatnonzero(f.names[at] == names)
    while len(active) and q < len(LEVELS) - 1:
        q += 1
        for p in range(PROBES):
            x = (start[at[active]] + _places(keys[active], q, p, sizes[at[active]])).astype(np.int64)
            active = active[(f.field[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1]
        level[active] = q
    return level


def _segments(pdf: pd.DataFrame, segment: int, bits_per_level: int) -> pd.DataFrame:
    keys, at = np.unique(np.concatenate([unplanes(x) for x in pdf["keys"]]), return_inverse=True)
    n = np.bincount(at, np.concatenate([unpress(x, np.int64) for x in pdf["n"]]), len(keys)).astype(np.int64)
    f = bloom(keys, n, segment, bits_per_level)
    return pd.DataFrame({"part": pdf["part"][:1], "names": [f.names.tobytes()], "sizes": [f.sizes.tobytes()], "field": [f.field.tobytes()]})


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(rows: DataFrame, spec, segment: int, n: int, v: int, n_train_docs: int) -> DataFrame:
    """Figures per document from ``rows``: chunks with ``counts`` and, where nothing is broadcast, ``found``."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                vocab, seq, sizes = unplanes(b["vocab"][k].as_py()), unpress(b["seq"][k].as_py(), np.int32), np.array(b["sizes"][k].as_py(), np.int64)
                first = np.cumsum(sizes) - sizes
                c = joined_answers(b["counts"][k].as_py(), "int64")[seq]
                keys, at = np.unique(_bigrams(vocab, seq, sizes), return_inverse=True)
                if spec is None:
                    level = joined_answers(b["found"][k].as_py(), "uint8")
                else:
                    level = probe(keys, spec.value, segment)
                context = np.roll(c, 1)
                context[first] = n_train_docs
                base = (c + 0.1) / (n + 0.1 * (v + 1))
                free = np.where(context > 0, context**HEAPS, 1.0)
                smooth = np.log10((np.minimum(VALUES[level][at], context) + free * base) / (context + free))
                add = lambda x, first=first: np.add.reduceat(x, first)
                ids, held = b["ids"][k].as_py(), b["held"][k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes), pa.array(add((c > 0).astype(np.int64))), pa.array(add(np.log10(base))), pa.array(add(smooth))],
                    names=[x.split()[0] for x in _SCORED.split(", ")],
                )

    return rows.mapInArrow(run, _SCORED)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES, bits_per_level: int = BITS_PER_LEVEL, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score, mean_gain) per row of ``docs``.

    ``mean_score`` is the score per token, ``mean_gain`` what the bigrams add to the base score per token.
    """
    sc = docs.sparkSession.sparkContext
    tokens = cut(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(partial(_tokens, chunk_bytes=chunk_bytes), _TOKENS), "tokens")
    train = F.zip_with("held", "sizes", lambda h, s: F.when(h, F.lit(0)).otherwise(s).cast("long"))
    n_vocab, n_pairs, n, n_train_docs = tokens.agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_vocab", "n_pairs")],
        F.coalesce(F.sum(F.aggregate(train, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)),
        F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h)).cast("long")), F.lit(0)),
    ).first()
    counts, leaves = ask(tokens.select("chunk", "vocab", "train").mapInArrow(_ask_words, PACKETS), n_vocab, lambda _, total: total, "int64")
    v = leaves.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    rows = tokens.drop("train").join(by_owner(counts, "counts"), F.col("chunk") == F.col("owner")).drop("owner")
    sent = tokens.select("chunk", "held", "sizes", "vocab", "seq").mapInArrow(_ask_bigrams, PACKETS)
    segment = segment_bits(n)
    if n * bits_per_level // 8 <= max_filter_bytes:  # a bound on all segments together
        made = cut(sent.groupBy("part").applyInPandas(lambda pdf: _segments(pdf, segment, bits_per_level), "part long, names binary, sizes binary, field binary"), "filters")
        parts = sorted(made.collect(), key=lambda r: r["part"])
        spec = sc.broadcast(BloomFilter.joined([BloomFilter(np.frombuffer(r["names"], np.uint64), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["field"], np.uint8)) for r in parts]))
    else:
        found, _ = ask(sent, n_pairs, lambda keys, c: probe(keys, bloom(keys, c, segment, bits_per_level), segment), "uint8", finest=segment)
        rows, spec = rows.join(by_owner(found, "found"), F.col("chunk") == F.col("owner")).drop("owner"), None
    out = _score(rows, spec, segment, n, v, n_train_docs)
    per = lambda x: x / F.col("n_tokens")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
        per(F.col("score")).alias("mean_score"), per(F.col("score") - F.col("base_score")).alias("mean_gain"),
    )


def op5_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
