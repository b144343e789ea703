"""Compares registered queries with their SQL in DuckDB: `python -m catalog.check [sf_dir] [name prefixes...]`."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from decimal import Decimal

import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    """A value as both engines spell it. Doubles keep all their digits."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or isinstance(value, (str, bytes)):
        return value
    if isinstance(value, (int, float, Decimal)):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str) -> tuple[str, int, float]:
    """(verdict, rows, seconds) for one query; the verdict is `ok` when every row agrees."""
    start = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = df.columns
    mine = rows_of(columns, df.collect())
    seconds = time.time() - start
    count = sum(mine.values())
    if name not in catalog.ORACLES:
        return ("rows only" if count else "EMPTY"), count, seconds
    result = connection.execute(catalog.ORACLES[name])
    theirs_columns = [d[0] for d in result.description]
    theirs = rows_of(theirs_columns, result.fetchall())
    if sorted(columns) != sorted(theirs_columns):
        return f"COLUMNS {sorted(columns)} against {sorted(theirs_columns)}", count, seconds
    if mine != theirs:
        extra, missing = list((mine - theirs).items())[:2], list((theirs - mine).items())[:2]
        return f"DIFFER {count} rows against {sum(theirs.values())}: only here {extra}, only there {missing}", count, \
            seconds
    return ("ok" if count else "ok but EMPTY"), count, seconds


def main(sf_dir: str = "/root/testdata/sf0.01", *prefixes: str) -> int:
    from keepwell.session import build_session

    extra = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
             "spark.sql.shuffle.partitions": "8"}
    spark = build_session("check", "local[8]", **extra)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    connection, bad = duck(sf_dir), 0
    for name in catalog.QUERIES:
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        try:
            verdict, count, seconds = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on to the next query
            verdict, count, seconds = "ERROR " + str(error)[:600], 0, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:36s} {seconds:6.2f}s {count:8d}  {verdict[:900]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
