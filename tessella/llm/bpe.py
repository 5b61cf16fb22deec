"""Byte-level BPE encoding by a prefix-sharing trie, and decoding.

For merges applied in rank order, the last token of a prefix's encoding, together
with the encoding of what comes before that token, is the prefix's whole encoding.
So each task inserts its new distinct words into a trie of bytes and walks it depth
first: every node gets its last token once, whatever the number of words that share
the prefix.  A token may follow another exactly if the merges turn their joined bytes
back into these two tokens.

Null text is empty and gives no ids; a word of any length costs time in proportion to
it; ids outside the vocabulary decode to nothing; rows, repeated ones too, and other columns
pass through, but a column that has the output's name is replaced; an empty table gives an
empty table.
Words are kept in a dictionary of bounded size per Python worker, texts are taken in
slices of bounded size, and nothing is shuffled.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries in the dictionary of encoded words, and bytes of text at a time.
MAX_WORDS = 250_000
SLICE_BYTES = 1_500_000
#: Verdicts on pairs of tokens that a worker keeps.
MAX_VERDICTS = 500_000


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks, the special tokens and the splitting pattern of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE files are supported")
        alphabet = _byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {(self.ids[as_bytes(a)], self.ids[as_bytes(b)]): (r, self.ids[as_bytes(a + b)]) for r, (a, b) in enumerate(pairs)}
        self.made = {t: (r, pair) for pair, (r, t) in self.ranks.items()}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * size
        for t, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.tokens[i] = t
        # Fixed value: the public splitting pattern of this kind of vocabulary.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        # The same pattern for the faster built-in engine: alike where all characters are among these.
        self.plain_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.not_plain = re.compile(r"[^\t-\r -~\u00c0-\u024f\u0400-\u0481]")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, ids: list[int]) -> list[int]:
        """Merges in rank order, as the definition has it; for short inputs."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(((self.ranks[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks), default=None)
            if best is None:
                return ids
            pair = (ids[best[1]], ids[best[1] + 1])
            new, out, k = self.ranks[pair][1], [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def bytewise(self, word: bytes) -> list[int]:
        return [self.ids[bytes([b])] for b in word]


class State:
    """What matters of a path's end: its longest suffix that starts a token."""

    __slots__ = ("ends", "next", "suffix")

    def __init__(self, suffix: bytes, ends: list[tuple[int, int, dict[int, bool]]]):
        self.suffix, self.ends = suffix, ends  # ends: tokens that end here, longest first, with length and verdicts
        self.next: dict[int, State] = {}


class TrieEncoder:
    """Encodes sets of words; what words share as a prefix is worked out once.

    Words enter the trie in sorted order, so each branches off the path of the one before
    and the walk over the trie is depth first; only the current path is held.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.edges: tuple[dict, dict] = ({}, {})
        self.starts = {t[:k] for t in vocabulary.ids for k in range(1, len(t) + 1)}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[bytes, State] = {}
        self.verdicts: dict[int, dict[int, bool]] = {}
        self.n_verdicts = 0
        self.root = State(b"", [])

    def _enter(self, state: State, byte: int) -> State:
        s = state.suffix + bytes([byte])
        while s not in self.starts:
            s = s[1:]
            if not s:
                raise ValueError("the vocabulary lacks a byte")
        got = self.states.get(s)
        if got is None:
            ids = self.v.ids
            ends = [(t, len(s) - k, self.verdicts.setdefault(t, {})) for k in range(len(s)) if (t := ids.get(s[k:])) is not None]
            got = self.states[s] = State(s, ends)
        state.next[byte] = got
        return got

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token at its left (0) or right (1) edge, from the whole down to a byte, each with the rank at which it is merged away."""
        got = self.edges[side].get(token)
        if got is None:
            rank, parts = self.v.made.get(token, (0, None))
            got = [(token, math.inf)]
            if parts:
                got += [(t, min(r, rank)) for t, r in self._edge(parts[side], side)]
            self.edges[side][token] = got
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges turn the joined bytes of two tokens back into them; the first may be none (-1).

        They do unless some merge across the border comes first: of a part at the right
        edge of the one with a part at the left edge of the other, before either part is
        merged into its own token.  Of equal merges that overlap, the left one comes first.
        """
        if a < 0:
            return self.v.merged(self.v.bytewise(self.v.tokens[b])) == [b]
        ranks, right = self.v.ranks, self._edge(b, 0)
        return not any((m := ranks.get((x, y))) is not None and m[0] < gone_x and m[0] <= gone_y for x, gone_x in self._edge(a, 1) for y, gone_y in right)

    def encode(self, words: set[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The ids of each word."""
        if self.n_verdicts > MAX_VERDICTS:
            self._reset()
        out: dict[bytes, tuple[int, ...]] = {}
        last, states, at = [-1], [self.root], [0]  # of the first k bytes of the path: last token, state, where that token begins
        before = b""
        for w in sorted(words):
            depth, most = 0, min(len(w), len(before))
            while depth < most and w[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], states[depth + 1 :], at[depth + 1 :]
            state, before = states[depth], w
            for byte in w[depth:]:
                state = state.next.get(byte) or self._enter(state, byte)
                states.append(state)
                depth += 1
                for t, size, verdicts in state.ends:
                    k = depth - size
                    ok = verdicts.get(a := last[k])
                    if ok is None:
                        ok = verdicts[a] = self.may_follow(a, t)
                        self.n_verdicts += 1
                    if ok:
                        last.append(t)
                        at.append(k)
                        break
                else:
                    raise ValueError("no token can end here")
            ids, k = [], depth
            while k:
                ids.append(last[k])
                k = at[k]
            ids.reverse()
            out[w] = tuple(ids)
        return out


class Encoder:
    """Texts to ids, with a bounded dictionary of words seen before; ids are kept as packed 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.trie, self.known = vocabulary, TrieEncoder(vocabulary), {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a special token's own string in a text becomes that token."""
        v, split = self.v, []
        for t in texts:
            parts = v.cut.split(t) if v.cut and any(s in t for s in v.special) else [t]
            find = (v.pieces if v.not_plain.search(t) else v.plain_pieces).findall
            split.append([p if p in v.special else find(p) for p in parts])
        fresh = {w for doc in split for p in doc if not isinstance(p, str) for w in p}
        if len(self.known) + len(fresh) > MAX_WORDS:
            self.known = {}
        new = [w for w in fresh if w not in self.known]
        by_bytes = self.trie.encode({w.encode() for w in new})
        self.known.update((w, array("i", by_bytes[w.encode()]).tobytes()) for w in new)
        out = []
        for doc in split:
            packed = [array("i", [v.special[p]]).tobytes() if isinstance(p, str) else b"".join(map(self.known.__getitem__, p)) for p in doc]
            out.append(np.frombuffer(b"".join(packed), np.int32))
        return out


_loaded: dict = {}


def _once(spec, make):
    """What a Python worker makes of the vocabulary file, made once."""
    key = (hash(spec.value), make)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = make(Vocabulary(spec.value))
    return _loaded[key]


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of bytes in column ``at``, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + SLICE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _spec(df: DataFrame, path: str):
    """The vocabulary file as a broadcast: a file of fixed size (a few MB), read once by the driver."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col`` (array of int): the text's ids under the vocabulary file at ``path``."""
    spec = _spec(df, path)
    text_at = df.columns.index(text_col)
    schema = T.StructType([*[f for f in df.schema if f.name != ids_col], T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    keep = [k for k, c in enumerate(df.columns) if c != ids_col]

    def run(batches):
        enc = _once(spec, Encoder)
        for b in (part for batch in batches for part in _slices(batch, text_at)):
            ids = enc.encode([t or "" for t in b.column(text_at).to_pylist()])
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], flat], names=schema.names)

    return df.mapInArrow(run, schema)


def _tokens(v: Vocabulary) -> list[bytes]:
    return v.tokens


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``: the text of the ids; bytes that are no UTF-8 become U+FFFD."""
    spec = _spec(df, path)
    at = df.columns.index(ids_col)
    schema = T.StructType([*[f for f in df.schema if f.name != text_col], T.StructField(text_col, T.StringType())])
    keep = [k for k, c in enumerate(df.columns) if c != text_col]

    def run(batches):
        tokens = _once(spec, _tokens)
        table = pa.array([*tokens, b""], pa.large_binary())
        for b in batches:
            texts = []
            for ids in b.column(at):
                flat = np.asarray(ids.values) if ids.is_valid else np.zeros(0, np.int32)
                flat = np.where((flat >= 0) & (flat < len(tokens)), flat, len(tokens))
                # Taken one after another, the tokens' bytes lie next to each other in one buffer.
                got = table.take(pa.array(flat))
                data = got.buffers()[2]
                texts.append(data.to_pybytes().decode("utf-8", "replace") if data is not None else "")
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of ids and of the decoded text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = bpe_encode(docs, path).drop("text")
    ids = ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        "ids",
    )
    return bpe_decode(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
