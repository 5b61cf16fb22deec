"""Reader of compressed row blocks: binary files of records, each a block of sparse rows.

A record is a fixed word, a word with the record's length and kind, and the payload padded to
four bytes; a payload that holds the fixed word itself is cut there into several parts.  A
payload is a block: three numbers, then five LZ4 segments (labels, offsets, ids, values,
weights), each after its compressed length, 0 where it is absent.

Spark reads the files, so any path that it knows will do.  A file is decoded by one task, a
block at a time; the tools write files of bounded size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.frame import FEATURES

# Fixed values of the format: the word before each record, the bits of a length, and the word that begins a block.
RECORD_WORD, LENGTH_BITS, BLOCK_WORD = 0xCED7230A, 29, 1196140743
_WHOLE, _FIRST, _MIDDLE, _LAST = range(4)


def records(content: bytes) -> Iterator[bytes]:
    """Payloads of a file's records."""
    at, parts = 0, []
    while at < len(content):
        word, head = struct.unpack_from("<II", content, at)
        kind, size = head >> LENGTH_BITS, head & ((1 << LENGTH_BITS) - 1)
        if word != RECORD_WORD or at + 8 + size > len(content):
            raise ValueError(f"no record at byte {at}")
        parts.append(content[at + 8 : at + 8 + size])
        at += 8 + (size + 3) // 4 * 4
        if kind in (_WHOLE, _LAST):
            yield struct.pack("<I", RECORD_WORD).join(parts)
            parts = []
    if parts:
        raise ValueError("the last record has no end")


def decoded(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, offsets, ids, values and weights of a block; absent values and weights are 1."""
    word, width, n = struct.unpack_from("<iii", payload)
    if word != BLOCK_WORD or width not in (4, 8):
        raise ValueError("not a row block")
    lz4, at = pa.Codec("lz4_raw"), 12

    def segment(count: int, kind) -> np.ndarray | None:
        nonlocal at
        (size,) = struct.unpack_from("<i", payload, at)
        at += 4
        if size <= 0:
            return None
        raw = lz4.decompress(payload[at : at + size], decompressed_size=count * np.dtype(kind).itemsize)
        at += size
        return np.frombuffer(raw, kind, count)

    label, offset = segment(n, "<f4"), segment(n + 1, "<u8")
    offset = np.zeros(n + 1, np.int64) if offset is None else (offset - offset[0]).astype(np.int64)
    nnz = int(offset[-1])
    index = segment(nnz, "<u8" if width == 8 else "<u4")
    value, weight = segment(nnz, "<f4"), segment(n, "<f4")
    ones = lambda x, k: np.ones(k) if x is None else x.astype(np.float64)
    index = np.zeros(0, np.int64) if index is None else index.astype(np.uint64).view(np.int64)
    return (np.zeros(n) if label is None else label.astype(np.float64)), offset, index, ones(value, nnz), ones(weight, n)


def _rows(batches):
    for b in batches:
        for content in b.column(0):
            for payload in records(content.as_py()):
                label, offset, index, value, weight = decoded(payload)
                entries = pa.StructArray.from_arrays([pa.array(index, pa.int64()), pa.array(value, pa.float64())], names=["index", "value"])
                features = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.float64()), pa.array(weight, pa.float64()), features], names=["label", "weight", "features"])


def read_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Canonical rows of files of compressed row blocks; ids of 2**63 and more keep their bits in a signed long."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_rows, f"label double, weight double, features {FEATURES}")
    return rows.select(F.monotonically_increasing_id().alias("row_id"), "label", "weight", "features")


def holds_blocks(spark: SparkSession, path: str) -> bool:
    """Whether a file, or the first file of a folder, begins with a record of this format."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [s.getPath() for s in fs.listStatus(where) if s.isFile() and s.getLen() >= 8 and s.getPath().getName()[0] not in "._"]
    if not files:
        return False
    stream = fs.open(files[0])
    try:
        return stream.readInt() & 0xFFFFFFFF == int.from_bytes(struct.pack("<I", RECORD_WORD), "big")
    finally:
        stream.close()
