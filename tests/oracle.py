"""Run a registered query on Spark and its SQL on DuckDB and compare rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path("/root/testdata")
TIMES: dict[str, float] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    connection = duckdb.connect()
    for name in TABLES:
        path = ROOT / sf / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')").fetchall()
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def run_sql(connection, sql):
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    return columns, types, cursor.fetchall()


def difference(spark, sf: str, name: str, fn, sql: str | None, connection=None) -> str | None:
    """None when equal, else what differs."""
    start = time.time()
    frame = fn(spark, str(ROOT / sf))
    columns, rows = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    TIMES[name] = time.time() - start
    if sql is None:
        return None if rows else "no rows"
    names, _, expected = run_sql(connection or duck(sf), sql)
    names, expected = _rows(names, expected)
    if columns != names:
        return f"columns {columns} != {names}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    for ours, theirs in zip(rows, expected):
        if ours != theirs:
            return f"{str(ours)[:700]}\n     != {str(theirs)[:700]}"
        kinds = [(type(a), type(b)) for a, b in zip(ours, theirs) if a is not None and b is not None and type(a) is not type(b)]
        if kinds:
            return f"types {kinds}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as entry
    from topicflow.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = difference(spark, sf, name, fn, sqls.get(name))
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {TIMES.get(name, 0):.1f}s of {time.time() - start:.1f}s {'' if name in sqls else '(rows)'} {problem or ''}", flush=True)
    print("failed:", bad)
