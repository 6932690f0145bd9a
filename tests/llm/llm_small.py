"""The smallest given tables as plain rows."""

import duckdb

SMALL = "/root/testdata/sf0.001"


def read(table, *columns):
    return duckdb.connect().sql(f"select {', '.join(columns)} from '{SMALL}/{table}.parquet'").fetchall()
