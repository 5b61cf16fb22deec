"""MinHash near-dedup with odd sketches.

A document's set is that of its w-word shingles.  MinHash samples are banded into bucket
keys; the same samples, folded into a parity bitmap, are its odd sketch.  Documents of
one bucket are candidates; the popcount of the XOR of two sketches estimates the sample
difference and drops pairs that are far from the threshold; what is left is confirmed on
the full sets of shingles.

No bucket is expanded into all its pairs.  Copies (equal word sequences) are one node.
In a first round each member of a bucket meets the bucket's least and greatest documents;
then only pairs of documents whose components differ remain: in small buckets the join
that forms them keeps those that pass the sketch; large buckets are cut into tiles by
component, whose tasks compare the sketches of all their pairs, then the sets of what is left,
and return no more links than they have members.
Components are as of all pairs, since a pair within one component adds nothing.

Shingles are told apart by 64-bit hashes in ``n_shingles`` and in tiles; pairs met singly are
confirmed on the words themselves.

Null or empty text has an empty set, links with nothing and is kept, also beside a row with
words of the same id; a null id links with nothing; repeated rows share their id and their
component; a pair at exactly the threshold is linked; texts are read whole; columns other
than the two named are not read, so clashing names are safe; an empty table gives an empty
table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, drop_cut
from tessella.llm.components import components

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
LANES = SKETCH_BITS // 64
#: Standard deviations by which a sketch may err before a pair at the threshold is lost.
SLACK = 6.0
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # odd multipliers of a public mixer
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
MAX_WORDS = 400_000
#: Members up to which a bucket's pairs are formed singly; rows and shingles of a tile's side; columns of its matrices at a time.
SMALL, TILE_ROWS, TILE_SHINGLES, TILE_COLUMNS = 16, 1024, 500_000, 4096
#: Links of one document that one task confirms; one with more has copies of its text and sketch dealt by salt.
HUB_LINKS = 256


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.split() splits at just the six characters meant here."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Distinct hashes of the shingles; fewer words than ``width`` are one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h += mixed(w[k : n - width + 1 + k] * _PLACE[k])
    return np.unique(mixed(h))


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[k : k + 1024, None] * _MUL + _ADD).min(0), out=out)
    return out


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples with their numbers, as 64-bit lanes."""
    at = mixed(sample ^ mixed(_ADD)) % np.uint64(SKETCH_BITS)
    bits = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def band_keys(sample: np.ndarray) -> np.ndarray:
    rows, key = sample.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * _PLACE[k] + rows[:, k])
    return key.view(np.int64)


def sketch_limit(num: int, den: int) -> int:
    """The greatest XOR popcount of a pair that may reach the threshold."""
    j = num / den
    m, n = 2 * SAMPLES * (1 - j), SKETCH_BITS
    mean = n / 2 * (1 - np.exp(-2 * m / n))
    by_samples = 2 * np.sqrt(SAMPLES * j * (1 - j)) * np.exp(-2 * m / n)
    by_folding = np.sqrt(n / 4 * (1 - np.exp(-4 * m / n)))
    return int(mean + SLACK * np.hypot(by_samples, by_folding)) + 1


_SIGNED = ", ".join(["doc_id long", "n long", "same binary", "bands array<long>", *[f"s{k} long" for k in range(LANES)]])


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: set size, digest of the word sequence, band keys and sketch lanes."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            ids, texts, n, same, bands, lanes = b.column(0), b.column(1).to_pylist(), [], [], [], []
            for t in texts:
                w = words_of(t)
                sh = shingle_hashes(w, hashes, width)
                n.append(len(sh))
                same.append(xxhash.xxh128_digest(b" ".join(w)) if len(sh) else None)
                s = samples(sh)
                bands.append(band_keys(s) if len(sh) else np.zeros(0, np.int64))
                lanes.append(odd_sketch(s))
            offsets = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            lanes = np.array(lanes, np.int64).reshape(len(texts), LANES)
            cols = [ids, pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *[pa.array(lanes[:, k]) for k in range(LANES)]]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _SIGNED.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _SIGNED)


def _apart(left: str, right: str) -> Column:
    """XOR popcount of two sketches."""
    lanes = [F.bit_count(F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))) for k in range(LANES)]
    return reduce(lambda x, y: x + y, lanes)


def _shingles(packed: bytes, width: int) -> set[tuple[bytes, ...]]:
    w = words_of(zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass"))
    return set(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else {tuple(w)} - {()}


def _packed_texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed): the compressed texts of the given documents."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    # Texts are always met by a sort-merge join, so that the plan is one at every size.
    return cut(texts.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(run, "doc_id long, packed binary"), "texts")


def _attached(met: DataFrame, hubs: DataFrame, table: DataFrame) -> DataFrame:
    """``met`` (end, doc, copies) with ``table``'s columns as structs x of the end and y of the other.

    An end may be met by very many, so its row is copied (``hubs``: end, copies) and pairs
    choose a copy by the other document's hash.
    """
    row = F.struct(*[c for c in table.columns if c != "doc_id"])
    copied = table.withColumnRenamed("doc_id", "end").withColumn("x", row).select("end", "x").join(hubs.hint("merge"), "end")
    copied = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    salted = met.withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("copies")).cast("int"))
    other = table.withColumn("y", row).select(F.col("doc_id").alias("doc"), "y")
    return salted.join(copied.hint("merge"), ["end", "copies", "salt"]).join(other.hint("merge"), "doc")


def _confirm(met: DataFrame, hubs: DataFrame, packed: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ``met`` whose full sets of shingles reach the threshold."""

    def run(batches):
        kept: tuple[bytes, set] = (b"", set())
        for b in batches:
            out = []
            for t, u in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if t != kept[0]:
                    kept = (t, _shingles(t, width))
                x, y = kept[1], _shingles(u, width)
                both = len(x & y)
                out.append(bool(both) and den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(out, pa.bool_()))

    both = _attached(met, hubs, packed).select(F.least("end", "doc").alias("a"), F.greatest("end", "doc").alias("b"), "x.packed", F.col("y.packed").alias("other"))
    return cut(both.mapInArrow(run, "a long, b long").distinct(), "confirmed")


def linked_in_tile(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of a set of ``left`` and one of ``right`` (places in ``sets``) reach the threshold.

    Sizes of intersections are a product of 0/1 matrices, whose columns are the shingles
    that more than one set has.
    """
    size = np.array([len(x) for x in sets], np.int64)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, kept = np.repeat(np.arange(len(sets)), size), n[column] > 1
    number = np.cumsum(n > 1) - 1
    row, column = row[kept], number[column[kept]]
    both = np.zeros((len(left), len(right)))
    for start in range(0, int((n > 1).sum()), TILE_COLUMNS):
        here = (column >= start) & (column < start + TILE_COLUMNS)
        m = np.zeros((len(sets), TILE_COLUMNS), np.float32)
        m[row[here], column[here] - start] = 1
        both += m[left] @ m[right].T  # counts below 2**24: exact
    return (both > 0) & (den * both >= num * (size[left][:, None] + size[right] - both))


def _dealt(full: DataFrame) -> DataFrame:
    """Members of large buckets with their block and each block that it meets, as ``block`` and ``other``.

    A component that fills a block has blocks of its own, which never meet one another; the
    members of smaller ones share the bucket's first blocks, which meet all.  So a bucket of one
    component and a few strangers has as many tiles as blocks.
    """
    need = F.greatest(F.count("*") / TILE_ROWS, F.sum("size") / TILE_SHINGLES)
    needs = full.groupBy("band", "comp").agg(need.alias("need"))
    large = F.col("need") >= 1
    shared = F.ceil(F.sum(F.when(large, 0.0).otherwise(F.col("need")))).cast("int")
    bands = cut(needs.groupBy("band").agg(shared.alias("shared"), F.sum(F.when(large, F.ceil("need")).otherwise(0)).cast("int").alias("own")), "blocks")
    before = F.sum("k").over(Window.partitionBy("band").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1))
    filling = needs.filter(large).select("band", "comp", F.ceil("need").cast("int").alias("k"))
    filling = cut(filling.select("band", "comp", "k", F.coalesce(before, F.lit(0)).cast("int").alias("before")), "filling")
    dealt = full.join(bands, "band").join(filling, ["band", "comp"], "left")
    first, k = F.when(F.col("k").isNull(), 0).otherwise(F.col("shared") + F.col("before")), F.coalesce("k", F.lit(0))
    among = F.coalesce("k", "shared")
    dealt = dealt.withColumn("block", (first + F.pmod(F.xxhash64("doc_id", "band"), among)).cast("int"))
    # The blocks of a member's own large component, [first, first + k), are left out.
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("shared") + F.col("own") - k - 1)))
    return dealt.withColumn("other", F.when(F.col("x") >= first, F.col("x") + k).otherwise(F.col("x")))


def _tile_links(full: DataFrame, packed: DataFrame, width: int, num: int, den: int, limit: int) -> DataFrame:
    """(a, b): links between components within large buckets.

    A bucket's members are dealt to blocks of bounded rows and shingles, and a tile is a
    pair of blocks of one bucket.  Tiles compare sketches first; texts are sent only for the
    members that some pair of the tile leaves over.  A tile returns at most one link per
    member, enough to connect what is linked.
    """
    lanes = [f"s{k}" for k in range(LANES)]
    columns = ["band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "comp", *lanes]
    tiles = _dealt(full).select(*columns)

    def apart_in(key, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members of either side with a pair of two components that passes the sketch, and which pairs do."""
        left, right = (np.flatnonzero(pdf["block"].to_numpy() == k) for k in key[1:])
        sketch, comp = pdf[lanes].to_numpy(np.int64).view(np.uint64), pdf["comp"].to_numpy()
        apart = comp[left][:, None] != comp[right]
        if apart.any():
            apart &= sum(np.bitwise_count(sketch[left][:, k, None] ^ sketch[right][:, k]).astype(np.int64) for k in range(LANES)) <= limit
        return left[apart.any(1)], right[apart.any(0)], apart[np.ix_(apart.any(1), apart.any(0))]

    def sift(key, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, _ = apart_in(key, pdf)
        return pdf.iloc[np.union1d(left, right)]

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, apart = apart_in(key, pdf)
        if not len(left):
            return pd.DataFrame({"a": [], "b": []})
        comp, ids = pdf["comp"].to_numpy(), pdf["doc_id"].to_numpy()
        press, hashes = zstandard.ZstdDecompressor(), WordHashes()
        sets = [shingle_hashes(press.decompress(t).lower().split(), hashes, width) for t in pdf["packed"].to_numpy()]
        i, j = np.nonzero(apart & linked_in_tile(sets, left, right, num, den))
        top: dict[int, int] = {}

        def root(d):
            while top.setdefault(d, d) != d:
                top[d] = top[top[d]]
                d = top[d]
            return d

        # Members of one component are connected already.
        forest = []
        for c, d in zip(left[i].tolist(), right[j].tolist(), strict=True):
            c0, d0 = root(int(comp[c])), root(int(comp[d]))
            if c0 != d0:
                top[c0] = d0
                forest.append((ids[c], ids[d]))
        return pd.DataFrame(forest, columns=["a", "b"])

    sifted = tiles.groupBy("band", "i", "j").applyInPandas(sift, tiles.schema)
    texts = sifted.join(packed.hint("merge"), "doc_id")
    return texts.groupBy("band", "i", "j").applyInPandas(solve, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; links where den * intersection >= num * union."""
    signed = cut(signatures(docs, width, id_col, text_col), "signatures")
    nodes = signed.filter("n > 0 AND doc_id IS NOT NULL")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Copies are one node: the least id with the same words.
    firsts = cut(nodes.groupBy("same").agg(F.min("doc_id").alias("rep")), "firsts")
    reps = cut(nodes.join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").drop("same").withColumnRenamed("n", "size"), "reps")
    sketch = reps.drop("bands")
    limit = sketch_limit(num, den)

    # Round 1: every member of a bucket with the bucket's least and greatest documents.
    members = reps.select(F.explode("bands").alias("band"), "doc_id")
    buckets = members.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first < last")
    buckets = cut(buckets, "buckets")
    inside = cut(members.join(buckets.hint("merge"), "band"), "inside")
    drop_cut(buckets)
    packed = _packed_texts(texts, inside.select("doc_id").distinct())
    # A bucket's size bounds the links that it gives its two ends; copies are powers of two, few for each end.
    copies = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / HUB_LINKS, F.lit(1.0))))).cast("int").alias("copies")
    hubs = cut(inside.select("first", "last", copies).distinct().select(F.explode(F.array("first", "last")).alias("end"), "copies").distinct(), "hubs")
    ends = inside.select("doc_id", F.explode(F.array("first", "last")).alias("end"), copies).filter("doc_id != end")
    one = F.max(F.struct("copies", "end", F.col("doc_id").alias("doc"))).alias("m")
    met = ends.groupBy(F.least("doc_id", "end").alias("a"), F.greatest("doc_id", "end").alias("b")).agg(one)
    met = cut(met.select("a", "b", "m.*"), "met")
    alike = cut(_attached(met.drop("a", "b"), hubs, sketch.drop("size")).filter(_apart("x", "y") <= limit).select("end", "doc", "copies"), "candidates")
    links = _confirm(alike, hubs, packed, width, num, den)
    drop_cut(alike)
    comp = components(links)
    # Round 2: pairs of different components that are left, singly in small buckets, by tiles in large ones.
    own = cut(inside.join(comp, F.col("doc_id") == F.col("node"), "left").select("band", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp")), "members")
    apart = own.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band")
    parted = cut(apart, "parted")
    full = cut(own.join(parted, "band", "left_semi").join(sketch, "doc_id"), "apart")
    for t in (own, parted, inside, hubs, reps):
        drop_cut(t)
    x, y = full.filter(F.col("n") <= SMALL).alias("x"), full.filter(F.col("n") <= SMALL).alias("y")
    joined = (F.col("x.band") == F.col("y.band")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.comp") != F.col("y.comp")) & (_apart("x", "y") <= limit)
    pairs = x.join(y, joined).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    left = cut(pairs.join(met.select("a", "b"), ["a", "b"], "left_anti").select(F.col("a").alias("end"), F.col("b").alias("doc"), F.lit(1).alias("copies")), "candidates")
    once = left.select("end", "copies").distinct()  # a document of small buckets has few links
    more = cut(_confirm(left, once, packed, width, num, den).union(_tile_links(full.filter(F.col("n") > SMALL), packed, width, num, den, limit)), "confirmed")
    for t in (left, full, met, packed):
        drop_cut(t)
    every = links.union(more)
    if more.take(1):
        drop_cut(comp)
        comp = components(every)
    of = nodes.select("same", F.col("doc_id")).distinct().join(firsts, "same").select("doc_id", "rep")
    # An id whose rows have different words joins their groups.
    if of.groupBy("doc_id").count().filter("count > 1").take(1):
        drop_cut(comp)
        comp = components(every.union(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
        of = nodes.select("doc_id", F.col("doc_id").alias("rep")).distinct()
    found = cut(of.join(comp, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")), "found")
    for t in (firsts, links, more, comp):
        drop_cut(t)
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    own_id = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), F.coalesce(F.col("doc_id") == own_id, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the least id; of rows with one id and group, one."""
    kept = near_duplicates(docs, width, num, den, id_col, text_col)
    ids = cut(kept.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("__n_rows")), "kept")
    out = docs.join(ids.withColumnRenamed("doc_id", "__n_id"), F.col(id_col).cast("long") == F.col("__n_id"), "left")
    out = out.filter(F.col("__n_id").isNotNull() | F.col(id_col).isNull())
    if ids.filter("__n_rows > 1").take(1):
        # The row with the least text, and of those the least hash, so that reruns agree.
        cols = [F.col(f"`{c}`") for c in docs.columns]
        first = F.min_by(F.struct(*cols), F.struct(F.col(f"`{text_col}`"), F.xxhash64(*[c for c in cols])))
        several = out.filter("__n_rows > 1").groupBy("__n_id").agg(first.alias("__n_row")).select("__n_row.*")
        out = out.select(*cols, "__n_rows")
        out = out.filter("__n_rows = 1 OR __n_rows IS NULL").drop("__n_rows").unionByName(several)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    """Groups of near copies by 4-word shingles at a Jaccard similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id SEMI JOIN rare ON a.g = rare.g GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id,
       coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
