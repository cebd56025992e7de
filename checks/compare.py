"""Run queries on Spark and their SQL on DuckDB and compare the rows.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql) -> str | None:
    """None when both sides hold the same rows under the same names."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} against {sorted(names)}"
    theirs, ours = rows_of(names, cursor.fetchall()), rows_of(df.columns, df.collect())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]} (columns {sorted(names)})" if wrong else None


def main() -> int:
    from rainshed.session import local_session

    from .oracle import SQL
    from .queries import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(8), duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            what = difference(df, con, SQL[name]) if name in SQL else f"no SQL, {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            what = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += what is not None
        print(f"{name:24} {time.time() - start:6.2f}s  {'ok' if what is None else what}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal; without SQL: {sorted(set(QUERIES) - set(SQL))}; without query: {sorted(set(SQL) - set(QUERIES))}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
