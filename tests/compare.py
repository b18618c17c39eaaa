"""Comparing a query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.sql(sql).df()


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame):
    return sorted((tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)
