"""Readers of the original tools' keys and files."""

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions.cityhash import city64, city_hashes
from tessella.functions.hashing import field_key, md5_60
from tessella.functions.md5 import md5_60s
from tessella.sources import blocks, formats


def city(*texts):
    raw = [t.encode() for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    return city64(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size).tolist()


def test_city_hash_of_known_strings():
    assert city("abc", "") == [2640714258260161385, 0x9AE16A3B2F90404F]
    # Every length has its own value, alone or in company.
    texts = ["abcdefghijklmnopqrstuvwxyz012345"[:k] for k in range(33)]
    assert len(set(city(*texts))) == 33 and [city(t)[0] for t in texts] == city(*texts)
    with pytest.raises(ValueError):
        city("a" * 33)


def test_click_keys_of_the_original_hash(spark):
    line = "1\t" + "\t".join(["5", "", "-2", *[""] * 10, "68fd1e64", "short", *[""] * 24])
    rows = formats.parse_clicks(spark.createDataFrame([(line,), ("",)], "value string"), city=True).collect()
    h = spark.createDataFrame([(["5", None, "-2", "68fd1e64"],)], "x array<string>").select(city_hashes(F.col("x")).alias("h"))
    want = h.select(*[field_key(F.get("h", F.lit(k)), f).alias(f"k{f}") for k, f in ((0, 0), (2, 2), (3, 13))]).first()
    assert [f["index"] for f in rows[0]["features"]] == list(want) and len(rows) == 1
    assert h.first()["h"][1] == 0 and h.first()["h"][0] == city("5")[0] - (1 << 64) * (city("5")[0] >> 63)


ODD_LINES = [
    "1\t5\t\t-3" + "\t" * 11 + "abcdefgh\t\tshort" + "\t" * 23 + "zzzzzzzz",
    "0",  # nothing but a first field
    "1\t\t\t7",  # fields are missing at the end
    "0" + "\t" * 14 + "äöüßéèêñ\täöüß\t" + "x" * 40 + "\t汉字汉字汉字汉字",  # characters are counted, not bytes; what does not count may be long
    "1" + "\t9" * 13 + "\tabcdefgh" * 28,  # more fields than the log has
    "\t" * 40,
    "0" + "\t" * 13 + "12345678901234567890\t        ",
]


def plain_features(line, labelled):
    """(field, text) of the fields that count."""
    fields = line.split("\t")[labelled:][:39]
    return [(k, x) for k, x in enumerate(fields) if (x if k < 13 else len(x) == 8)]


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_click_lines_by_the_original_hash(spark, labelled):
    lines = spark.createDataFrame([(x,) for x in [*ODD_LINES, "", None]], "value string").coalesce(1)
    got = [[(f["index"], f["value"]) for f in r["features"]] for r in formats.parse_clicks(lines, labelled, city=True).drop("label").orderBy("row_id").collect()]
    key = lambda k, x: city(x)[0] >> 10 | k << 54
    assert got == [[(key(k, x), 1.0) for k, x in plain_features(line, labelled)] for line in ODD_LINES]


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_click_lines_by_other_hashes(spark, labelled):
    lines = spark.createDataFrame([(x,) for x in [*ODD_LINES, "", None]], "value string").coalesce(1)
    fields = [[*plain_features(x, labelled)] for x in ODD_LINES]
    texts = spark.createDataFrame([(k, x) for line in fields for k, x in line], "k long, x string")
    for portable, h in ((True, md5_60(F.col("x"))), (False, F.xxhash64("x"))):
        keys = {(r["k"], r["x"]): r["key"] for r in texts.select("k", "x", field_key(h, F.col("k")).alias("key")).collect()}
        rows = formats.parse_clicks(lines, labelled, portable).drop("label").orderBy("row_id").collect()
        assert [[(f["index"], f["value"]) for f in r["features"]] for r in rows] == [[(keys[x], 1.0) for x in line] for line in fields]


def test_portable_hashes_of_many_strings():
    raw = [bytes((7 * k + j) % 256 for j in range(k)) for k in range(140)] + [b"%d" % k for k in range(70_000)]
    size = np.array([len(x) for x in raw])
    got = md5_60s(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [int(hashlib.md5(x).hexdigest()[:15], 16) for x in raw]


def test_a_line_is_cut_once(spark):
    """Also where all rows' features are only summed, the cut stands once in the plan, or in the Arrow function."""
    lines = spark.createDataFrame([(x,) for x in ODD_LINES], "value string")
    for portable in (True, False):
        plan = formats.parse_clicks(lines, labelled=False, portable=portable).select(F.size("features"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("split(") + plan.count("ArrowEvalPython") == 1


def test_click_fields_are_hashed_once(spark):
    """Filters that Spark infers from an explode or a join must not evaluate the hashes again."""
    lines = spark.createDataFrame([(x,) for x in ODD_LINES], "value string")
    keys = formats.parse_clicks(lines.filter("value LIKE '1%'"), city=True).select(F.explode("features.index").alias("key"))
    names = lines.select(F.substring("value", 1, 1).alias("x")).distinct().withColumn("key", F.get(city_hashes(F.array("x")), F.lit(0)))
    for df, times in ((keys, 1), (keys.join(names, "key"), 2)):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == times


def packed(rows, width=8, values=True, weights=True, first=0):
    lz4 = pa.Codec("lz4_raw")
    kind = "<u8" if width == 8 else "<u4"
    out = struct.pack("<iii", 1196140743, width, len(rows))
    offset = np.cumsum([first, *[len(f) for _, _, f in rows]])
    segments = [np.array([r[0] for r in rows], "<f4"), offset.astype("<u8"), np.array([i for r in rows for i, _ in r[2]], kind)]
    segments += [np.array([v for r in rows for _, v in r[2]], "<f4") if values else None, np.array([r[1] for r in rows], "<f4") if weights else None]
    for s in segments:
        body = b"" if s is None or not len(s) else lz4.compress(s.tobytes(), asbytes=True)
        out += struct.pack("<i", len(body)) + body
    return out


def framed(payload):
    """One record; a payload that holds the record word at a word boundary is cut there."""
    word, parts, begin = struct.pack("<I", 0xCED7230A), [], 0
    for k in range(0, len(payload) // 4 * 4, 4):
        if payload[k : k + 4] == word:
            parts.append(payload[begin:k])
            begin = k + 4
    parts.append(payload[begin:])
    kinds = [0] if len(parts) == 1 else [1, *[2] * (len(parts) - 2), 3]
    return b"".join(word + struct.pack("<I", kind << 29 | len(p)) + p + b"\0" * (-len(p) % 4) for kind, p in zip(kinds, parts, strict=True))


def test_files_of_row_blocks(spark, tmp_path):
    one = [(1.0, 2.0, [(3, 0.5), (2**63 + 5, 1.5)]), (0.0, 1.0, []), (-1.0, 0.5, [(7, 2.0)])]
    two = [(1.0, 1.0, [(k, 1.0) for k in range(400)])]
    home = tmp_path / "in"
    home.mkdir()
    (home / "a.crb").write_bytes(framed(packed(one, first=9)) + framed(packed(two, 4, values=False, weights=False)))
    (home / "b.crb").write_bytes(framed(packed(one, values=False)))
    signed = lambda i: i - (1 << 64) if i >> 63 else i
    key = lambda x: (x[0], x[1], [(signed(i), v) for i, v in x[2]])
    want = [*map(key, one), *map(key, two), *[(a, b, [(signed(i), 1.0) for i, _ in f]) for a, b, f in one]]
    got = formats.read_format(spark, str(home), "crb").collect()
    assert sorted(map(repr, want)) == sorted(repr((r["label"], r["weight"], [(f["index"], f["value"]) for f in r["features"]])) for r in got)
    assert len({r["row_id"] for r in got}) == len(got)
    with_word = b"abcd" + struct.pack("<I", 0xCED7230A) * 2 + b"xyz"
    assert list(blocks.records(framed(with_word) + framed(b"q"))) == [with_word, b"q"]
    for bad in (b"12345678", framed(b"abcdefgh")[:12]):
        with pytest.raises(ValueError):
            list(blocks.records(bad))
    with pytest.raises(ValueError):
        blocks.decoded(b"\0" * 40)


def test_parquet_still_stands_for_blocks(spark, tmp_path):
    rows = formats.parse_libsvm(spark.createDataFrame([("1 3:2 5",), ("0 4",)], "value string"))
    formats.write_format(rows, f"{tmp_path}/p", "crb")
    assert formats.read_format(spark, f"{tmp_path}/p", "crb").count() == 2


def test_files_of_a_stated_size(spark, tmp_path):
    import os

    lines = [f"{k % 2} {k} {k + 1}:0.{k % 97 + 1}" for k in range(4000)]
    rows = formats.parse_libsvm(spark.createDataFrame([(x,) for x in lines], "value string").repartition(2))
    limit = 0.01 * 2**20
    formats.write_format(rows, f"{tmp_path}/t", "libsvm", part_mb=0.01)
    sizes = [os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(f"{tmp_path}/t") for x in names if x.endswith(".txt")]
    assert max(sizes) <= limit + 40 and sum(x >= limit - 40 for x in sizes) >= len(sizes) - 2 and len(sizes) > 5
    formats.convert(spark, f"{tmp_path}/t", "libsvm", f"{tmp_path}/p", "crb", part_mb=0.05)
    back = formats.read_format(spark, f"{tmp_path}/p", "crb")
    assert back.columns == rows.columns
    key = lambda r: (r["label"], [(f["index"], f["value"]) for f in r["features"]])
    assert sorted(map(key, back.collect())) == sorted(map(key, rows.collect()))
    one = rows.coalesce(1).orderBy("row_id").coalesce(1)
    formats.write_format(one, f"{tmp_path}/o", "libsvm", part_mb=0.01)
    files = sorted(os.path.join(d, x) for d, _, names in os.walk(f"{tmp_path}/o") for x in names if x.endswith(".txt"))
    assert [x for f in files for x in open(f).read().splitlines()] == [r["value"] for r in formats.libsvm_lines(one).collect()]
