"""Hard negatives against their SQL."""

import numpy as np
from pyspark.sql import functions as F
from tessella.llm.mining import OP13_SQL, hard_negatives, merged, op13_mining, strassen, usable
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"


def test_against_sql(spark):
    assert_same(op13_mining(spark, SF), connect(SF), OP13_SQL)


def test_strassen_is_exact():
    rng = np.random.default_rng(0)
    for m, k, n in ((1, 1, 1), (64, 64, 64), (37, 41, 53), (130, 7, 66), (3, 100, 100)):
        a, b = rng.integers(-(2**40), 2**40, (m, k)), rng.integers(-500, 500, (k, n))
        for leaf in (1, 4, 32):
            assert (strassen(a, b, leaf) == a @ b).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(1)
    s, i = rng.integers(0, 5, (3, 40)), rng.permutation(120).reshape(3, 40)
    want = [[x for x in sorted(zip(-s[r], i[r], strict=True))[:6]] for r in range(3)]
    for cut in (1, 13, 39):
        a, b = merged(s[:, :cut], i[:, :cut], s[:, cut:], i[:, cut:], 6)
        assert [list(zip(-a[r], b[r], strict=True)) for r in range(3)] == want


def test_edges_and_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    vec = lambda: [float(x) for x in np.round(rng.normal(0, 1, 6), 1)]
    rows = [(k, vec(), int(rng.integers(0, 3)), "x") for k in range(0, 900, 5)]
    hot = vec()
    rows += [(k, hot, 1, "x") for k in range(2001, 2400)]  # copies that tie
    rows += [(200, rows[3][1], 0, "x"), (200, rows[3][1], 0, "x"), (300, None, 1, "x"), (400, vec(), None, "x"), (None, vec(), 1, "x")]
    rows += [(601, [float("nan")] * 6, 1, "x"), (602, [float("inf")] + [0.0] * 5, 1, "x"), (603, [None] + [0.0] * 5, 1, "x"), (700, [0.0] * 6, 2, "x"), (1400, vec(), 9, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank string").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ready = usable(df, "vec_id", "embedding", label, 256)
    for block in (65536, 3):
        assert_same(hard_negatives(ready, F.col("id") % 100 == 0, anchor_block=block), con, OP13_SQL)
    assert hard_negatives(ready.limit(0), F.col("id") % 100 == 0).count() == 0
    short = spark.createDataFrame([(100, [1.0, 2.0], 1), (101, [1.0], 1), (102, [0.5, 0.0, 9.0], 2)], "vec_id long, embedding array<double>, label int")
    got = hard_negatives(usable(short, "vec_id", "embedding", F.col("label"), 256), F.col("id") % 100 == 0).collect()
    assert [(r["positive_id"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got] == [(101, 102, 65536, 32768)]
