"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens.

A long run of key characters, and each of its parts that is long itself (cut at all separators,
at ``_-`` as base64 would be, at ``/+`` as base64url would be), gets an inferred encoding (hex, base32, base64) and three tests of the hypothesis that its
characters are drawn uniformly: chi-squared of the alphabet, runs about the middle, lag-one
serial correlation.  The least of the three p-values is compared with those of random tokens
of the same alphabet and length, so the combined p-value is uniform for keys and near 0 for
words and identifiers.

Short tokens tell less, so the accepted p-value depends on length.  Within a class of encoding
and length, over all documents, the keys among the tokens are estimated from those above one
half and three quarters, where hardly any words come; a token is reported where the estimated share of non-keys among
the tokens that look at least as random is at most ``fdr``.  Classes with few tokens share one
estimate, first those of an encoding, then those of all.  As few keys leave nothing above one half,
the non-keys are also bounded from the other side: by how often the tokens of that encoding (of all,
where these are few), no longer than the class, look as random, with a prior of language that weighs
``PRIOR_TOKENS`` tokens.  So a lone key among few tokens is found; among many of its own class only
where its p-value is above three quarters.

Null text is empty and has no spans; texts are scanned whole; repeated rows count again; equal
p-values share a cell and its verdict; columns other than the two named are not read, so
clashing names are safe; an empty table gives an empty table.  The table of p-values has a
fixed number of cells and is all that is gathered.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_KEY = re.compile(r"(?ai:passw|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
#: Alphabets in the order in which they are tried.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, frozenset(a), {c: k for k, c in enumerate(a)}) for name, a in ENCODINGS]
#: Cells of the table of p-values, and lengths from which on all tokens share a class.
P_CELLS, MAX_LENGTH_CLASS = 40, 12
#: Random tokens per alphabet and length, up to which length they are drawn, and tokens that a class needs for its own estimate.
DRAWS, DRAWN_LENGTH, CLASS_TOKENS = 2000, 128, 200
_PARTS = tuple(re.compile(f"[{a}]{{20,}}") for a in ("A-Za-z0-9", "A-Za-z0-9+/", "A-Za-z0-9_-"))
#: The prior of language: its weight in tokens; the share of identifiers of words with 20 to 29 characters beyond the first cell,
#: by how much that falls with every ten characters, and over how many cells it falls by e.
PRIOR_TOKENS, PRIOR_SHARE, PRIOR_BY_LENGTH, PRIOR_CELLS = 200, 0.2, 7, 4


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution (an approximation of its logistic kind; ranks are what counts)."""
    return 1 / (1 + np.exp(np.clip(1.5976 * z + 0.07056 * z**3, -700, 700)))


def least_p(x: np.ndarray, m: int) -> np.ndarray:
    """Of each row of places in an alphabet of ``m``: the least p-value of the three tests."""
    rows, n = x.shape
    count = np.bincount((x + m * np.arange(rows)[:, None]).ravel(), minlength=rows * m).reshape(rows, m)
    # Chi-squared by the Wilson-Hilferty cube root, upper tail only: too even is no fault.
    chi = np.maximum((count * count).sum(1) * m / n - n, 0)
    z = ((chi / (m - 1)) ** (1 / 3) - (1 - 2 / (9 * (m - 1)))) / np.sqrt(2 / (9 * (m - 1)))
    p_chi = _normal_tail(z)
    high = x >= m / 2
    n1 = high.sum(1)
    mean = 1 + 2 * (n - n1) * n1 / n
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    p_runs = 2 * _normal_tail(np.abs(runs - mean) / np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)))
    p_runs = np.where((n1 == 0) | (n1 == n), 0.0, p_runs)
    off = x - x.mean(1)[:, None]
    spread = (off * off).sum(1)
    r = (off[:, 1:] * off[:, :-1]).sum(1) / np.maximum(spread, 1e-12)
    p_serial = np.where(spread > 0, 2 * _normal_tail(np.abs(r + 1 / n) * np.sqrt(n)), 0.0)
    return np.minimum(np.minimum(p_chi, p_runs), p_serial)


@lru_cache(maxsize=1024)
def _random_tokens(m: int, n: int) -> np.ndarray:
    """Sorted least p-values of random tokens."""
    return np.sort(least_p(np.random.default_rng([m, n]).integers(0, m, (DRAWS, n)), m))


def randomness(token: str) -> tuple[str, float] | None:
    """The inferred encoding and the combined p-value; None where no encoding has all characters."""
    seen = set(token)
    name, _, place = next((s for s in _SETS if seen <= s[1]), ("", None, None))
    if place is None:
        return None
    n, m = len(token), len(place)
    p = least_p(np.array([[place[c] for c in token]]), m)[0]
    if n > DRAWN_LENGTH:
        return name, float(1 - (1 - min(p, 1.0)) ** 3)  # as of three independent tests
    return name, float(np.searchsorted(_random_tokens(m, n), p, side="right") / DRAWS)


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, str, float]]]:
    """Spans of the fixed patterns, and long tokens and parts outside them with encoding and p-value."""
    spans = []
    if ("=" in text or ":" in text) and _ASSIGN_KEY.search(text):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    long = list(_LONG.finditer(text))
    # A long hex run lies in a long run of key characters, so others need no second look.
    if any(m for m in long) or len(text) >= 24:
        spans += [("hex", *m.span()) for m in _HEX.finditer(text)] if long else []
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    found = []
    for m in long:
        a, b = m.span()
        parts = dict.fromkeys((a + x.start(), a + x.end()) for p in _PARTS for x in p.finditer(m[0]))
        for c, d in [(a, b), *[x for x in parts if x != (a, b)]]:
            if not any(s < d and c < e for _, s, e in spans) and (r := randomness(text[c:d])):
                found.append((c, d, *r))
    return spans, found


def _added(cells: list[list[int]]) -> list[int]:
    return [sum(x) for x in zip(*cells, strict=True)]


def pooled(counts: dict[tuple[str, int], list[int]]) -> dict[tuple[str, int], list[int]]:
    """Per class the cells that its estimate is made of: its own, or those of all small classes of its encoding, or of all small ones."""
    small = {w: c for w, c in counts.items() if sum(c) < CLASS_TOKENS}
    of = {e: _added([c for (x, _), c in small.items() if x == e]) for e, _ in small}
    rest = [c for c in of.values() if sum(c) < CLASS_TOKENS]
    return {w: c if w not in small else of[w[0]] if sum(of[w[0]]) >= CLASS_TOKENS else _added(rest) for w, c in counts.items()}


def key_cell(cells: list[int]) -> float:
    """Expected keys in a cell: these are uniform, so the lesser of what the upper half and the upper quarter tell."""
    return min(sum(cells[P_CELLS - P_CELLS // k :]) * k / P_CELLS for k in (2, 4))


def background(counts: dict[tuple[str, int], list[int]], which: tuple[str, int]) -> list[float]:
    """Per cell: the share of non-keys that reach it, by the tokens no longer than the class and the prior."""
    encoding, length = which
    cells = _added([c for (e, n), c in counts.items() if e == encoding and n <= length])
    if sum(cells) < CLASS_TOKENS:
        cells = _added([c for (_, n), c in counts.items() if n <= length])
    keys = key_cell(cells)
    others, reach, most = max(0.0, sum(cells) - keys * P_CELLS), [0.0] * P_CELLS, 0.0
    for k in reversed(range(P_CELLS)):
        most = max(most, sum(cells[k:]) - keys * (P_CELLS - k))
        prior = PRIOR_SHARE * math.exp(-k / PRIOR_CELLS) / PRIOR_BY_LENGTH ** max(0, length - 2)
        reach[k] = min(1.0, (most + PRIOR_TOKENS * prior) / (others + PRIOR_TOKENS))
    return reach


def accepted(counts: dict[tuple[str, int], list[int]], fdr: float) -> dict[tuple[str, int], int]:
    """Per class the first cell from which on its tokens are reported; classes that report nothing are left out."""
    limits = {}
    for which, c in pooled(counts).items():
        keys = key_cell(c)
        own, reach = counts[which], background(counts, which)
        for k in range(1, P_CELLS):
            seen, here = sum(c[k:]), sum(own[k:])
            if (seen and 1 - min(1.0, keys * (P_CELLS - k) / seen) <= fdr) or (here and sum(own) * reach[k] / here <= fdr):
                limits[which] = k
                break
    return limits


_SCANNED = "doc_id long, spans array<struct<kind:string,start:int,end:int>>, found array<struct<start:int,end:int,encoding:string,length:int,cell:int>>"


def _scan(batches):
    for pdf in batches:
        spans, found = [], []
        for t in pdf["text"]:
            s, f = scan_text(t if isinstance(t, str) else "")
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in s])
            found.append([{"start": a, "end": b, "encoding": e, "length": min((b - a) // 10, MAX_LENGTH_CLASS), "cell": min(int(p * P_CELLS), P_CELLS - 1)} for a, b, e, p in f])
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": spans, "found": found})


def secret_spans(docs: DataFrame, fdr: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): per row of ``docs`` all spans by start, then kind; code points, end exclusive."""
    spark = docs.sparkSession
    scanned = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(_scan, _SCANNED), "secrets")
    cells = scanned.select(F.explode("found").alias("f")).groupBy("f.encoding", "f.length", "f.cell").count()
    # At most encodings x length classes x cells rows, whatever the input.
    counts: dict[tuple[str, int], list[int]] = {}
    for r in cells.collect():
        counts.setdefault((r["encoding"], r["length"]), [0] * P_CELLS)[r["cell"]] = r["count"]
    limits = accepted(counts, fdr)
    if not limits:
        chosen = F.filter("found", lambda f: F.lit(False))
    else:
        limit = F.create_map(*[x for (e, n), k in sorted(limits.items()) for x in (F.lit(f"{e}/{n}"), F.lit(k))])
        chosen = F.filter("found", lambda f: F.coalesce(f["cell"] >= F.try_element_at(limit, F.concat_ws("/", f["encoding"], f["length"].cast("string"))), F.lit(False)))
    # A part goes with a whole that is reported.
    chosen = F.filter(chosen, lambda f: ~F.exists(chosen, lambda g: (g["start"] <= f["start"]) & (f["end"] <= g["end"]) & (g["end"] - g["start"] > f["end"] - f["start"])))
    extra = F.transform(chosen, lambda f: F.struct(F.lit("random").alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    rank = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    ordered = F.transform(F.array_sort(F.transform(F.concat("spans", extra), lambda s: F.struct(s["start"], rank[s["kind"]].alias("r"), s["end"], s["kind"]))), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return scanned.select("doc_id", ordered.alias("spans"))


def joined(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secret_spans(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
