"""Compare a registered query with its SQL in DuckDB: names, row count and values, in any order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from rowkeel.plans.star import NAMES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for n in NAMES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str | None:
    rel = con.sql(sql)
    names, want = rel.columns, rel.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} instead of {sorted(names)}"
    got = bag(spark_df.columns, spark_df.collect())
    want_bag = bag(names, want)
    if got == want_bag:
        return None
    return (
        f"rows {sum(got.values())} instead of {len(want)}; only here {list((got - want_bag).items())[:3]}; "
        f"only in SQL {list((want_bag - got).items())[:3]}"
    )
