"""Runs registered queries next to their SQL twins: python -m tests.oracle [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    result = query(spark, sf_dir)
    got = rows_of(result.columns, [tuple(r) for r in result.collect()])
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(result.columns):
        return f"columns {sorted(result.columns)} != {sorted(names)}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"{sum(got.values())} rows, expected {sum(want.values())}; extra {sum(extra.values())}: "
            f"{list(extra)[:2]}; missing {sum(missing.values())}: {list(missing)[:2]}"
        )
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from faultlens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con, failed = local_session(), connect(sf_dir), []
    for name in names:
        start = time.time()
        try:
            if name in oracle:
                problem, how = compare(spark, con, queries[name], oracle[name], sf_dir), "sql"
            else:
                n = queries[name](spark, sf_dir).count()
                problem, how = ("" if n else "no rows"), f"rows only ({n})"
        except Exception as error:  # noqa: BLE001
            problem, how = f"{type(error).__name__}: {str(error)[:1500]}", ""
        print(f"{'ok  ' if not problem else 'FAIL'} {name:28s} {time.time() - start:6.1f}s {how} {problem[:1800]}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
