"""Compare registered queries with their SQL on the same Parquet files.

usage: python check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from cohortlab.plans import oracle_sql, queries
from cohortlab.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _cell(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if type(value).__name__ == "Decimal":
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, connection, name, fn, sql, sf_dir):
    started = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spark_seconds = time.time() - started
    if sql is None:
        return "ROWS", f"{len(got[1])} rows", spark_seconds, 0.0
    started = time.time()
    result = connection.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    sql_seconds = time.time() - started
    if got == want:
        return "OK", f"{len(got[1])} rows", spark_seconds, sql_seconds
    if got[0] != want[0]:
        return "DIFF", f"columns {got[0]} != {want[0]}", spark_seconds, sql_seconds
    only_spark, only_sql = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    note = (f"{len(got[1])} vs {len(want[1])} rows; only spark {len(only_spark)}: {sorted(only_spark)[:2]}; "
            f"only sql {len(only_sql)}: {sorted(only_sql)[:2]}")
    return "DIFF", note[:900], spark_seconds, sql_seconds


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session("8")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if args and name not in args:
            continue
        try:
            state, note, a, b = compare(spark, connection, name, fn, sql.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            state, note, a, b = "FAIL", str(error)[:900], 0.0, 0.0
        bad += state in ("DIFF", "FAIL")
        print(f"{state:5} {name:34} spark {a:6.2f}s sql {b:6.2f}s {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
