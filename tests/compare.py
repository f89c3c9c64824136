"""Result of a query against the result of its SQL in DuckDB: names, row count, values."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

from csvharbor.workload import QUERIES
from csvharbor.workload.base import TABLES


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("number", format(value.normalize(), "f"))
    if isinstance(value, bool):
        return ("bool", str(value))
    if isinstance(value, int):
        return ("number", str(value))
    if isinstance(value, float):
        return ("number", repr(value) if value != int(value) else str(int(value)))
    if isinstance(value, dt.datetime):
        return ("time", value.replace(tzinfo=None).isoformat())
    return (type(value).__name__, str(value))


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def difference(spark, db, sf_dir, name):
    """None if equal, else what differs."""
    df = QUERIES[name].run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cursor = db.execute(QUERIES[name].sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    mine, theirs = sorted_rows(df.columns, got), sorted_rows(columns, expected)
    if mine == theirs:
        return None
    extra = [r for r in mine if r not in set(theirs)][:3]
    missing = [r for r in theirs if r not in set(mine)][:3]
    return f"rows {len(mine)} != {len(theirs)}; only here {extra}; only there {missing}"


if __name__ == "__main__":
    from csvharbor.session import build_session

    folder = sys.argv[1]
    session = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    session.sparkContext.setLogLevel("OFF")
    database = connect(folder)
    for query_name in sys.argv[2:] or list(QUERIES):
        began = time.time()
        try:
            outcome = difference(session, database, folder, query_name)
        except Exception as e:  # noqa: BLE001
            outcome = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{query_name:28s} {time.time() - began:6.2f}s {'ok' if outcome is None else outcome}", flush=True)
