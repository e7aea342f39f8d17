"""Run every query beside its SQL and compare rows.

python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as contract  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (bool, int)):
        return str(int(value))
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    table = [tuple(_cell(r[i]) for i in order) for r in rows]
    return names, sorted(table, key=lambda r: tuple((v is not None, str(v)) for v in r))


def mismatch(spark, con, sf_dir: str, name: str) -> str | None:
    """None when Spark and SQL agree, else the first difference."""
    df = contract.queries()[name](spark, sf_dir)
    ours = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None if ours[1] else "no rows"
    found = con.execute(sql)
    theirs = _sorted_rows([c[0] for c in found.description], found.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            return f"{str(a)[:300]} != {str(b)[:300]}"
    return None if ours[1] else "no rows"


def main(sf: str = "0.01", *names: str) -> None:
    from posthaste.session import build_session
    spark = build_session(master="local[8]", settings={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/sf{sf}"
    con = database(sf_dir)
    bad = 0
    for name in names or contract.queries():
        begun = time.time()
        try:
            problem = mismatch(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - begun:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main(*sys.argv[1:])
