"""Every query: those with SQL against DuckDB, the others by what must hold of their rows."""

import pytest

from tessella import catalogue
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert catalogue.flagship(spark, SF).count() == 1


def test_fits_lower_the_loss(spark):
    trace = [r["objective"] for r in catalogue.lbfgs_fit(spark, SF).orderBy("iteration").collect()]
    assert all(b <= a for a, b in zip(trace, trace[1:], strict=False)) and trace[-1] < trace[0]
    trace = [r["objective"] for r in catalogue.fm_lbfgs_fit(spark, SF).orderBy("iteration").collect()]
    assert trace[-1] < trace[0]
    rows = catalogue.ftrl_fit_predict(spark, SF).collect()
    assert len(rows) == 1000 and all(0 < r["prediction"] < 1 for r in rows)
    assert catalogue.fm_online_fit(spark, SF).first()["nnz_v"] > 0
    assert abs(catalogue.kmeans_fit(spark, SF).agg({"square": "avg"}).first()[0] - 1) < 1e-9


def test_shuffle_stays_in_buffers(spark):
    rows = [(r["row_id"], r["buffer_id"]) for r in catalogue.shuffle_buffer(spark, "/root/testdata/sf0.01").collect()]
    assert all(b == i // 1000 for i, b in rows) and [i for i, _ in rows] != sorted(i for i, _ in rows)


def test_streams(spark):
    import numpy as np

    online = catalogue.online_ftrl_stream(spark, SF)
    assert online.count() == catalogue.unique_index_count(spark, SF).count()
    last = {}
    for r in sorted(catalogue.keyed_ftrl_stream(spark, SF).collect(), key=lambda r: r["batch"]):
        last[r["index"]] = r
    assert len(last) == online.count() and all(np.isfinite(r["w"]) for r in last.values())


def test_sql_is_text():
    import __spark_entry__ as e

    assert [name for name, sql in e.oracle_sql().items() if not isinstance(sql, str)] == []
