"""Compares a query with its SQL twin in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df):
    def value(v):
        if v is None or v != v or str(v) == "NaT":
            return "null"
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(v.tolist() if hasattr(v, "tolist") and not isinstance(v, str) else v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(value, row)) for row in df.itertuples(index=False))


def assert_same(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
