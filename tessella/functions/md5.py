"""The portable hash of :func:`tessella.functions.hashing.md5_60`, vectorised: many short strings at once."""

from __future__ import annotations

import hashlib

import numpy as np

# Fixed by the algorithm: rotations and constants of its 64 steps, and its first state.
_TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4]
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_STATE = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Longest string that fits one block; longer ones are hashed one by one.
BLOCK = 55
#: Strings hashed at a time, which bounds the blocks' memory to 2 MB.
AT_ONCE = 1 << 15


def _first_60_bits(words: np.ndarray) -> np.ndarray:
    """Of the digests of padded blocks, given as 16 rows of little-endian words, as numbers."""
    used = words.any(axis=1)
    a, b, c, d = (np.full(words.shape[1], x) for x in _STATE)
    for k in range(64):
        if k < 16:
            f, at = d ^ (b & (c ^ d)), k
        elif k < 32:
            f, at = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif k < 48:
            f, at = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * k % 16
        f += a
        f += _SINES[k]
        if used[at]:
            f += words[at]
        turned = f << np.uint32(_TURNS[k])
        f >>= np.uint32(32 - _TURNS[k])
        turned |= f
        turned += b
        a, b, c, d = d, turned, b, c
    high, low = ((x + first).byteswap().astype(np.uint64) for x, first in zip((a, b), _STATE[:2], strict=True))
    return (high << np.uint64(32) | low) >> np.uint64(4)


def md5_60s(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the strings that begin at ``start`` in the bytes ``data``."""
    out = np.empty(len(size), np.uint64)
    for k in np.flatnonzero(size > BLOCK).tolist():
        out[k] = int(hashlib.md5(data[start[k] : start[k] + size[k]].tobytes()).hexdigest()[:15], 16)
    short = np.flatnonzero(size <= BLOCK)
    data = np.concatenate([data, np.zeros(BLOCK, np.uint8)])
    for begin in range(0, len(short), AT_ONCE):
        which = short[begin : begin + AT_ONCE]
        s, n = start[which], size[which]
        words = np.zeros((16, len(which)), np.uint32)
        for k in range(int(n.max())):
            words[k // 4] |= np.where(k < n, data[s + k], 0).astype(np.uint32) << np.uint32(k % 4 * 8)
        words[n // 4, np.arange(len(which))] |= np.uint32(0x80) << (n % 4 * 8).astype(np.uint32)
        words[14] = n * 8
        out[which] = _first_60_bits(words)
    return out
