"""Compare a query with its SQL run by DuckDB over the same tables."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    relation = con.sql(sql)
    order = sorted(range(len(relation.columns)), key=lambda i: relation.columns[i])
    return [relation.columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in relation.fetchall())


def differences(con, df, sql: str) -> str:
    """Empty if columns and rows agree."""
    (a_names, a), (b_names, b) = spark_rows(df), duck_rows(con, sql)
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}"
    return ""
