"""Comparing query results with DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(repr([x.item() if hasattr(x, "item") else x for x in r]) for r in plain.itertuples(index=False, name=None))


def assert_same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    assert rows_of(a, columns) == rows_of(b, columns)
