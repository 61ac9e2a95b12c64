"""Runs a query and its SQL over the same tables and compares their rows whatever the order."""

import math
import os

import duckdb

DIR = "/root/testdata/sf0.001"


def duck(sf_dir=DIR):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(_cell, v)) if isinstance(v, list | tuple) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def assert_same(spark, query, sql, sf_dir=DIR):
    df = query(spark, sf_dir)
    cur = duck(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())
