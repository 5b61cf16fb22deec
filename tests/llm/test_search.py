"""Ranked search against its SQL and a plain version."""

import random

import numpy as np
from tessella.llm.search import OP12_SQL, Treap, build_index, op12_search, search, treap
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"


def test_against_sql(spark):
    assert_same(op12_search(spark, SF), connect(SF), OP12_SQL)


def test_treap_finds_the_best_columns():
    rng = np.random.default_rng(2)
    for rows, cols, cells in ((1, 1, 1), (7, 100, 80), (300, 5, 700), (40, 40, 1600), (90, 1000, 3000)):
        cell = np.unique(rng.integers(0, rows * cols, cells))
        row, col, value = cell // cols, cell % cols, rng.integers(1, 50, len(cell))
        grid = np.zeros((rows, cols), np.int64)
        grid[row, col] = value
        height = max(rows - 1, cols - 1).bit_length()
        t = Treap(height, *treap(row, col, value, height))
        for _ in range(20):
            asked = rng.choice(rows, min(rows, 6), replace=False)
            weights = rng.integers(1, 9, len(asked))
            score = (grid[asked] * weights[:, None]).sum(0)
            want = [(int(score[c]), int(c)) for c in np.lexsort((np.arange(cols), -score)) if score[c] > 0][:10]
            assert sorted(t.best(asked, weights, 10), key=lambda x: (-x[0], x[1])) == want
            least = want[3][0] if len(want) > 3 else 1
            got = sorted(t.best(asked, weights, 10, least), key=lambda x: (-x[0], x[1]))
            assert got == [x for x in want if x[0] >= least]


def test_edges_and_blocks(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(30)] + ["é", "ÉA", "Z9"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(150)]
    docs = [(k, t, "x") for k, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, " .,! ", "x"), (None, texts[3], "x"), (5, texts[5], "x"), (5, texts[6], "x")]
    docs += [(1000 + k, "same text w1 w2", "x") for k in range(40)] + [(2000, "w3 " * 60_000 + "tail", "x")]
    items = [(k, " ".join(rng.choices(words, k=4)), 1) for k in range(6)] + [(7, None, 1), (8, "", 1), (9, "never seen", 1), (3, "same", 1), (None, "tail w1", 1)]
    # Names that the operator uses itself are taken.
    d = spark.createDataFrame(docs, "doc_id long, text string, term string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string, score int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    i.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = connect(SF)
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for blocks, terms in ((8_000_000, 1000), (300, 5)):
        got = search(build_index(d, block_bytes=blocks), i, item_terms=terms).select("item_id", "rank", "doc_id", "score")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.sql(OP12_SQL).fetchall()))
    assert search(build_index(d.limit(0)), i).count() == 0 == search(build_index(d), i.limit(0)).count()
