"""Compare queries with their SQL: ``python tests/oracle.py <table folder> [query ...]``."""
from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def connect(folder: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def compare(frame, connection, sql: str) -> tuple[bool, str]:
    found = rows_of(frame.columns, frame.collect())
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    wanted = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} instead of {sorted(columns)}"
    more, less = found - wanted, wanted - found
    if more or less:
        return False, f"{sum(more.values())} extra, {sum(less.values())} missing, e.g. {list(more)[:2]} / {list(less)[:2]}"
    return True, f"{sum(found.values())} rows"


def main(folder: str, names: list[str]) -> int:
    from srcgraph.plans.queries import ORACLES, QUERIES
    from srcgraph.session import local_session
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = connect(folder), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            if name in ORACLES:
                good, note = compare(QUERIES[name](spark, folder), connection, ORACLES[name])
            else:
                good, note = True, f"{QUERIES[name](spark, folder).count()} rows, no SQL"
        except Exception as error:
            good, note = False, " ".join(str(error).split())[:700]
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {name:<28} {time.time() - start:6.1f}s  {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
