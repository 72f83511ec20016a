"""Run registered queries next to their SQL in DuckDB and compare them exactly.

    python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, run, sql, sf_dir):
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} vs {sorted(rel.columns)}", len(got)
    if got != want:
        diff = [g for g in got if g not in want][:3], [w for w in want if w not in got][:3]
        return f"{len(got)} vs {len(want)} rows; only spark {diff[0]}; only sql {diff[1]}", len(got)
    return None, len(got)


def main() -> int:
    import __spark_entry__ as contract
    from lonja.session import get_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    prefixes = tuple(args[1:])
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, empty = connect(sf_dir), 0, []
    oracle = contract.oracle_sql()
    for name, run in contract.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem, n = compare(spark, con, name, run, oracle[name], sf_dir)
            else:
                problem, n = None, run(spark, sf_dir).count()
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", 0
        if problem:
            bad += 1
        if not n:
            empty.append(name)
        print(f"{'BAD ' if problem else 'ok  '} {name:45s} {n:7d} rows {time.time() - start:6.2f}s"
              f"{'' if name in oracle else '  (no sql)'}{'  ' + problem if problem else ''}", flush=True)
    print(f"{bad} bad; empty results: {empty}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
