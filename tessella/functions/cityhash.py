"""CityHash64 (version 1.1) of short strings, vectorised: keys that models of the original tools have.

Its steps multiply modulo 2**64, which Spark's own arithmetic reports as an overflow, so a
column of strings goes through an Arrow function: every step is one operation on arrays of
all strings of a length class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed constants of the published algorithm.
K0, K1, K2 = (np.uint64(x) for x in (0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F))
#: Longest string that has a key; fields of the click log have at most 20 bytes.
MOST = 32


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return (x >> np.uint64(k)) | (x << np.uint64(64 - k))


def _mixed(u: np.ndarray, v: np.ndarray, mul: np.ndarray) -> np.ndarray:
    a = (u ^ v) * mul
    a ^= a >> np.uint64(47)
    b = (v ^ a) * mul
    b ^= b >> np.uint64(47)
    return b * mul


def city64(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the strings that begin at ``start`` in the bytes ``data``; longer ones than :data:`MOST` are an error."""
    if (size > MOST).any():
        raise ValueError(f"a string of {int(size.max())} bytes: keys are made of at most {MOST}")
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.full(len(size), K2, np.uint64)

    def word(at: np.ndarray, width: int = 8) -> np.ndarray:
        """Little-endian numbers of ``width`` bytes."""
        return sum((data[at + k].astype(np.uint64) << np.uint64(8 * k) for k in range(width)), np.zeros(len(at), np.uint64))

    with np.errstate(over="ignore"):
        for low, high in ((1, 3), (4, 7), (8, 16), (17, 32)):
            which = np.flatnonzero((size >= low) & (size <= high))
            if not len(which):
                continue
            s, n = start[which], size[which].astype(np.uint64)
            end, mul = s + size[which], K2 + n * np.uint64(2)
            if high == 3:
                y = word(s, 1) + (word(s + size[which] // 2, 1) << np.uint64(8))
                z = n + (word(end - 1, 1) << np.uint64(2))
                x = y * K2 ^ z * K0
                out[which] = (x ^ (x >> np.uint64(47))) * K2
            elif high == 7:
                out[which] = _mixed(n + (word(s, 4) << np.uint64(3)), word(end - 4, 4), mul)
            elif high == 16:
                a, b = word(s) + K2, word(end - 8)
                out[which] = _mixed(_turned(b, 37) * mul + a, (_turned(a, 25) + b) * mul, mul)
            else:
                a, b, c, d = word(s) * K1, word(s + 8), word(end - 8) * mul, word(end - 16) * K2
                out[which] = _mixed(_turned(a + b, 43) + _turned(c, 30) + d, a + _turned(b + K2, 18) + c, mul)
    return out


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings, and where each string begins and the last one ends; a null is empty."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    strings = strings.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    body = strings.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def hashes(strings: pa.Array) -> np.ndarray:
    """Hashes of an Arrow array of strings as signed longs; what stands at nulls does not count."""
    data, bounds = buffers(strings)
    return city64(data, bounds[:-1], np.diff(bounds)).view(np.int64)


def city_hashes(texts: Column) -> Column:
    """array<long>: the hash of each string of an array; 0 stands where a string is null.

    It is declared not deterministic, so that Spark evaluates it once and not again in filters it infers from its results.
    """

    @F.arrow_udf("array<long>")
    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        h = pa.array(np.where(flat.is_valid().to_numpy(zero_copy_only=False), hashes(flat), 0))
        sizes = column.value_lengths().fill_null(0).to_numpy()
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), h)

    return run.asNondeterministic()(texts)
