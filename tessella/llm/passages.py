"""Passages that documents share: the frame of the two exact substring operators.

A window is ``length`` symbols (bytes or words) of one document.  Its anchor is the gram
of ``gram`` symbols with the least hash in it, so equal windows have equal anchors.  The
work goes in steps, each a Spark job over packed chunks of documents:

1. documents are packed into chunks of bounded size, written once;
2. whole copies of a document are found by digest and left out of what follows;
3. every chunk asks ranges of hashes which of its anchors occur twice (see ``exchange``);
4. around each such anchor a chunk cuts one segment, the union of the windows it anchors,
   and sends the first of equal segments to a bucket by the anchor's hash;
5. a bucket's kernel tells which windows of its segments occur earlier;
6. the marks go back to their chunks, which cut them out.

Anchors that many places share (a very common passage) could fill one bucket with
different segments, so their windows are dealt singly, by their own hash.  Equal segments
leave a chunk once, or once for each of its documents where only other documents count,
with all their places as rising sequences, so that a run of one character is one piece.
So ranges, buckets and chunks all have bounded size, rows grow with the segments, and the
whole of every text is covered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, drop_cut
from tessella.llm.exchange import PACKETS, ask, by_owner, joined_answers, packet_batch, packets
from tessella.llm.minhash import WordHashes, mixed

#: Bytes of text in a chunk: of words, and of bytes, whose arrays are several times longer.
CHUNK_BYTES = {True: 4_000_000, False: 1_000_000}
#: Occurrences from which on an anchor's windows are dealt singly.
HOT = 2_000
#: Segments per bucket, for words and for bytes.
BUCKET_SEGMENTS = {True: 6_000, False: 20_000}
#: Segments that leave a chunk at a time.
BATCH_SEGMENTS = 20_000
_POS = np.uint64(28)  # low bits of a gram's hash that its place takes while the least is sought
_BLOCK = 1 << 26  # windows whose anchors are sought at a time, so that places fit
_ODD = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier: 2**64 over the golden ratio
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)

_PACKED = "chunk long, ids array<long>, sizes array<int>, digests array<binary>, data binary"
#: A kernel gets segments in order of document and place with their documents, and says for each of their windows whether it occurs earlier.
Kernel = Callable[[list[bytes], np.ndarray], list[np.ndarray]]


@dataclass(frozen=True)
class Units:
    """What a window is made of."""

    length: int
    gram: int
    words: bool  # else bytes
    within: bool  # whether an earlier place in the same document counts
    kernel: Kernel

    @property
    def width(self) -> int:
        """Bytes of a symbol."""
        return 8 if self.words else 1


def pack(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Chunks of documents: ids, sizes in bytes, digests, and the texts one after another, compressed."""

    def run(batches):
        press, rows = zstandard.ZstdCompressor(level=3), []

        def row(ids, texts):
            data = b"".join(texts)
            chunk = xxhash.xxh64_intdigest(data, seed=xxhash.xxh64_intdigest(repr(ids).encode())) - 2**63
            return {"chunk": chunk, "ids": ids, "sizes": [len(t) for t in texts], "digests": [xxhash.xxh128_digest(t) for t in texts], "data": press.compress(data)}

        schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary())), ("data", pa.binary())])
        ids, texts, size = [], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(d)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= chunk_bytes:
                    rows.append(row(ids, texts))
                    ids, texts, size = [], [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if ids:
            yield pa.RecordBatch.from_pylist([row(ids, texts)], schema)

    packed = cut(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _PACKED), "packed")
    # Chunks with equal contents would share a number, so their places are told apart.
    if packed.groupBy("chunk").count().filter("count > 1").take(1):
        packed = cut(packed.withColumn("chunk", F.xxhash64("chunk", F.input_file_name(), F.monotonically_increasing_id())), "packed")
    return packed


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list, np.ndarray, bytes]]:
    """Number, ids, sizes and bytes of each chunk of a batch whose first columns are those."""
    press = zstandard.ZstdDecompressor()
    for k in range(batch.num_rows):
        yield batch["chunk"][k].as_py(), batch["ids"][k].as_py(), np.array(batch["sizes"][k].as_py(), np.int64), press.decompress(batch["data"][k].as_py())


def symbols(units: Units, sizes: np.ndarray, data: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (words as their 64-bit hashes), their 64-bit hashes, and how many each document has."""
    if not units.words:
        s = np.frombuffer(data, np.uint8)
        return s, _BYTES[s], sizes
    ends = np.cumsum(sizes)
    docs = [data[e - n : e].split() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    counts = np.array([len(d) for d in docs], np.int64)
    h = np.fromiter((x for d in docs for x in map(hashes.__getitem__, d)), np.uint64, int(counts.sum()))
    return h, h, counts


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` symbols: polynomials of their hashes, by doubling, mixed at the end."""
    size, power, factor, out, have = 1, h, int(_ODD), None, 0
    while True:
        if k & size:
            n = len(h) - have - size + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            out = power[have : have + n] if out is None else out[:n] * np.uint64(factor) + power[have : have + n]
            have += size
        if have == k:
            return mixed(out)
        if len(power) <= size:
            return np.zeros(0, np.uint64)
        power = power[:-size] * np.uint64(factor) + power[size:]
        size, factor = 2 * size, factor * factor % 2**64


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchored(units: Units, h: np.ndarray, counts: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the anchor's place of each, its document's number, and all gram hashes.

    Documents marked in ``skip`` have no windows here.
    """
    none = np.zeros(0, np.int64)
    if len(h) < units.length:
        return none, none, none, np.zeros(0, np.uint64)
    g = grams(h, units.gram)
    width = units.length - units.gram + 1
    best = np.empty(len(g) - width + 1, np.int64)
    for a in range(0, len(best), _BLOCK):
        part = g[a : a + _BLOCK + width - 1]
        found = least((part >> _POS << _POS) | np.arange(len(part), dtype=np.uint64), width)
        best[a : a + len(found)] = (found & ((np.uint64(1) << _POS) - np.uint64(1))).astype(np.int64) + a
    # Windows begin where a document that counts still has a whole one.
    ends = np.cumsum(counts)
    some = np.flatnonzero((counts >= units.length) & ~skip)
    n = counts[some] - units.length + 1
    doc = np.repeat(some, n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - (ends[some] - counts[some]), n)
    return start, best[start], doc, g


def _skipped(batch: pa.RecordBatch, k: int, ids: list) -> np.ndarray:
    """Documents that need no look: whole copies of an earlier one, and those without an id."""
    skip = np.array([i is None for i in ids], bool)
    copies = batch["copies"][k].as_py()
    skip[copies or []] = True
    return skip


def _copies(packed: DataFrame) -> DataFrame:
    """(chunk, copies): per chunk the numbers of its documents that equal one with a smaller id."""
    one = packed.select("chunk", F.posexplode(F.arrays_zip("ids", "digests")).alias("at", "d")).select("chunk", "at", F.col("d.ids").alias("id"), F.col("d.digests").alias("digest"))
    one = cut(one.filter("id IS NOT NULL"), "digests")
    first = cut(one.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    return cut(one.join(first, "digest").filter("id > first").groupBy("chunk").agg(F.collect_list("at").alias("copies")), "copies")


def _keys(h: np.ndarray) -> np.ndarray:
    """56-bit anchor keys; hashed again, as anchors are the least of their neighbours."""
    return mixed(h) >> np.uint64(8)


def _repeated(units: Units, packed: DataFrame, total: int) -> DataFrame:
    """Answers for each chunk's anchors: 0 for those that occur once in all, 2 for very frequent ones, 1 for others."""

    def send(batches):
        hashes = WordHashes()
        for b in batches:
            for k, (chunk, ids, sizes, data) in enumerate(chunks(b)):
                _, h, counts = symbols(units, sizes, data, hashes)
                _, at, _, g = anchored(units, h, counts, _skipped(b, k, ids))
                yield packet_batch(list(packets(chunk, *np.unique(_keys(g[at[np.diff(at, prepend=-1) != 0]]), return_counts=True))))

    hot = HOT
    return ask(packed.mapInArrow(send, PACKETS), total, lambda _, n: (n >= 2).astype(np.uint8) + (n > hot), "uint8")[0]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def progressions(x: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Numbers as rows (first, step, count), none across a place where ``apart`` is true."""
    step = np.diff(x)
    new = apart.copy()
    new[:1] = True
    new[2:] |= step[1:] != step[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(x)))
    steps = np.where(count > 1, np.append(step, 1)[first], 1)
    return np.stack([x[first], steps, count], 1).astype(np.int32)


def _sequences(starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Rows (start, step, count, windows) for runs of windows."""
    order = np.lexsort((starts, windows))
    starts, windows = starts[order], windows[order]
    apart = np.diff(windows, prepend=-1) != 0
    rows = progressions(starts, apart)
    return np.concatenate([rows, windows[np.cumsum(np.append(0, rows[:-1, 2]))][:, None].astype(np.int32)], 1)


_SEGMENTS = "bucket int, chunk long, doc long, places binary, piece binary"
_ONCE = np.int32(1).tobytes()
_MARKS = "chunk long, start int, step int, count int, windows int"


def _segments(units: Units, packed: DataFrame, repeated: DataFrame, buckets: int) -> DataFrame:
    """A row per segment with its places in the chunk as (first, step, count); rows without a piece hold marks that the chunk itself can tell."""
    kinds = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("doc", pa.int64()), ("places", pa.binary()), ("piece", pa.binary())])

    def cut_out(chunk, ids, s, start, at, doc, hot, g):
        # Windows of one anchor stand together and make one segment; those of a hot anchor stay alone.
        w, length = units.width, units.length
        new = np.ones(len(start), bool)
        new[1:] = (np.diff(at) != 0) | hot[1:] | (np.diff(start) != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        base, size, owner = start[first], start[last] - start[first] + length, doc[first]
        number = np.array([ids[d] for d in owner.tolist()], np.int64)
        raw, order = s.tobytes(), np.lexsort((base, number))
        begin, end, docs = (base * w).tolist(), ((base + size) * w).tolist(), number.tolist()
        seen: dict[bytes, int] = {}
        more: dict[bytes, list[int]] = {}  # further places of a piece in its first document
        known = []
        for j in order.tolist():
            piece = raw[begin[j] : end[j]]
            before = seen.setdefault(piece, j)
            if before == j:
                continue
            if units.within or docs[before] < docs[j]:
                known.append(j)
            else:
                more.setdefault(piece, []).append(j)
        js = np.fromiter(seen.values(), np.int64, len(seen))
        bucket = (mixed(_keys(g[at[first[js]]])) % np.uint64(buckets)).astype(np.int64).tolist()
        for i in np.flatnonzero(hot[first[js]]).tolist():
            bucket[i] = xxhash.xxh64_intdigest(raw[begin[js[i]] : end[js[i]]]) % buckets
        one = np.ones((len(js), 3), np.int32)
        one[:, 0] = base[js]
        one = one.tobytes()
        places = [one[k : k + 12] for k in range(0, len(one), 12)]
        pieces, number = list(seen), number[js].tolist()
        if more:
            where = {piece: k for k, piece in enumerate(pieces)}
            for piece, rest in more.items():
                at = base[[seen[piece], *rest]]
                places[where[piece]] = progressions(at, np.zeros(len(at), bool)).tobytes()
        if known:
            told = _sequences(base[known], size[known] - length + 1)
            bucket.append(chunk % buckets)
            number.append(0)
            places.append(told.tobytes())
            pieces.append(None)
        for a in range(0, len(pieces), BATCH_SEGMENTS):
            cols = [x[a : a + BATCH_SEGMENTS] for x in (bucket, number, places, pieces)]
            cols.insert(1, [chunk] * len(cols[0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.types, strict=True)], schema=kinds)

    def send(batches):
        hashes = WordHashes()
        for b in batches:
            for k, (chunk, ids, sizes, data) in enumerate(chunks(b)):
                s, h, counts = symbols(units, sizes, data, hashes)
                start, at, doc, g = anchored(units, h, counts, _skipped(b, k, ids))
                if not len(start):
                    continue
                keys = _keys(g[at])
                often = joined_answers(b["often"][k].as_py(), "uint8")[np.searchsorted(np.unique(keys), keys)]
                some = often > 0
                if not some.any():
                    continue
                yield from cut_out(chunk, ids, s, start[some], at[some], doc[some], often[some] > 1, g)

    known = packed.join(by_owner(repeated, "often"), F.col("chunk") == F.col("owner")).drop("owner")
    return known.mapInArrow(send, _SEGMENTS)


def _marks(units: Units, segments: DataFrame) -> DataFrame:
    """Windows that occur earlier: starts at ``start`` and every ``step`` from there, ``count`` in all, ``windows`` windows at each."""
    w, length, kernel = units.width, units.length, units.kernel

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["piece"].isna().to_numpy()
        told = [(c, np.frombuffer(x, np.int32).reshape(-1, 4)) for c, x in zip(pdf["chunk"][own], pdf["places"][own], strict=True)]
        rest = pdf[~own]
        chunk, docs, places, data = rest["chunk"].tolist(), rest["doc"].astype("int64").tolist(), rest["places"].tolist(), rest["piece"].tolist()
        begin = np.frombuffer(b"".join(x[:4] for x in places), np.int32)
        order = np.lexsort((begin, chunk, docs)).tolist() if len(rest) else []
        begin, pieces, number, where, same = begin.tolist(), [], [], {}, []
        single: list[tuple[int, int, int, int, int]] = []

        def tell(j, a, n):
            if places[j][8:] == _ONCE:
                single.append((chunk[j], begin[j] + a, 1, 1, n))
                return
            x = np.frombuffer(places[j], np.int32).reshape(-1, 3)
            told.append((chunk[j], np.concatenate([x, np.full((len(x), 1), n, np.int32)], 1) + np.array([a, 0, 0, 0], np.int32)))

        for j in order:
            k = where.setdefault(data[j], len(pieces))
            if k == len(pieces):
                pieces.append(data[j])
                number.append(docs[j])
                same.append([j])
            elif units.within or number[k] < docs[j]:
                tell(j, 0, len(data[j]) // w - length + 1)
            else:
                same[k].append(j)  # the same document again: as the first
        for k, flags in enumerate(kernel(pieces, np.array(number, np.int64)) if len(pieces) > 1 else []):
            if flags.any():
                for a, e in zip(*[x.tolist() for x in _runs(flags)], strict=True):
                    for j in same[k]:
                        tell(j, a, e - a)
        rows = [np.array(single, np.int64).reshape(-1, 5)]
        rows += [np.concatenate([np.full((len(x), 1), c, np.int64), x], 1) for c, x in told]
        out = pd.DataFrame(np.concatenate(rows), columns=["chunk", "start", "step", "count", "windows"])
        return out.astype({c: "int32" for c in out.columns[1:]})

    return segments.groupBy("bucket").applyInPandas(solve, _MARKS)


def cut_repeats(docs: DataFrame, units: Units, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept): per row what is left without the repeats; kept is binary, UTF-8."""
    packed = pack(docs, id_col, text_col, CHUNK_BYTES[units.words])
    copies = _copies(packed)
    known = packed.join(copies, "chunk", "left")
    total = packed.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    per = total / (6 if units.words else 1) * 2 / (units.length - units.gram + 2)
    repeated = _repeated(units, known, int(per))
    n = repeated.agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
    words, length = units.words, units.length
    segments = _segments(units, known, repeated, max(1, n // BUCKET_SEGMENTS[words] + 1))
    marks = cut(_marks(units, segments), "marks")
    drop_cut(repeated)

    def finish(batches):
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "n_units": [], "n_removed": [], "n_spans": [], "kept": []}
            for k, (_, ids, sizes, data) in enumerate(chunks(b)):
                ends = np.cumsum(sizes)
                texts = [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                parts = [t.split() for t in texts] if words else texts
                counts = np.array([len(p) for p in parts], np.int64)
                offset = np.concatenate([[0], np.cumsum(counts)])
                step = np.zeros(offset[-1] + 1, np.int64)
                found = b["marks"][k].values
                start, every, count, n = (found.field(c).to_numpy().astype(np.int64) for c in ("start", "step", "count", "windows")) if found is not None else np.zeros((4, 0), np.int64)
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = np.repeat(start, count) + nth * np.repeat(every, count)
                np.add.at(step, start, 1)
                np.add.at(step, start + np.repeat(n, count) + length - 1, -1)
                gone = np.cumsum(step)[:-1] > 0
                for d in b["copies"][k].as_py() or []:
                    if counts[d] >= length:
                        gone[offset[d] : offset[d + 1]] = True
                for d, part in enumerate(parts):
                    f = gone[offset[d] : offset[d + 1]]
                    a, e = _runs(f)
                    if not len(a):
                        left = b" ".join(part) if words else part
                    else:
                        keep = zip([0, *e.tolist()], [*a.tolist(), len(part)], strict=True)
                        left = b" ".join(x for i, j in keep for x in part[i:j]) if words else b"".join(part[i:j] for i, j in keep)
                    for c, v in zip(out, (ids[d], len(part), int(f.sum()), len(a), left), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_units", "n_removed", "n_spans")], ("kept", pa.binary())]))

    marks = marks.groupBy("chunk").agg(F.collect_list(F.struct("start", "step", "count", "windows")).alias("marks"))
    return known.join(marks, "chunk", "left").mapInArrow(finish, "doc_id long, n_units long, n_removed long, n_spans long, kept binary")
