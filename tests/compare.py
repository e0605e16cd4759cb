"""Run a registered query on Spark and its oracle on DuckDB and compare whole results."""

import datetime as dt
import decimal
import math

import duckdb

from leadloom.plans.views import TABLES


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, decimal.Decimal)):
        return format(decimal.Decimal(value).normalize(), "f")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(decimal.Decimal(repr(value)).normalize(), "f")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(_cell(row[c]) for c in columns) for row in df.collect())


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_cell(row[i]) for i in order) for row in found.fetchall())


def difference(df, sql, sf_dir):
    """None when equal, else a short description."""
    columns, mine = spark_rows(df)
    names, theirs = oracle_rows(sql, sf_dir)
    if columns != names:
        return f"columns {columns} != {names}"
    if mine == theirs:
        return None
    only_mine = [r for r in mine if r not in set(theirs)][:3]
    only_theirs = [r for r in theirs if r not in set(mine)][:3]
    return f"{len(mine)} rows != {len(theirs)}; columns {columns}; only spark {only_mine}; only oracle {only_theirs}"
