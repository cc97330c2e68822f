"""Run registered queries against their SQL: python -m checks.compare [sf_dir] [name ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from .catalog import ORACLE, QUERIES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value.isoformat() if hasattr(value, "isoformat") else value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return True, f"{len(got[1])} rows, no SQL"
    cur = con.execute(ORACLE[name])
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} != {len(want[1])}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if diff:
        return False, f"{len(diff)} of {len(got[1])} rows differ, first {diff[0]}"
    return True, f"{len(got[1])} rows"


def main() -> int:
    from pyspark.sql import SparkSession
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in args or QUERIES:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} bad of {len(args or QUERIES)}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
