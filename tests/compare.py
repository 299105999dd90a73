"""Compare registered queries with their SQL on DuckDB: python tests/compare.py [sf_dir] [names...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


TIMES: dict[str, float] = {}


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("", "null")
    return (type(v).__name__, repr(v))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(_plain(row[i]) for i in order) for row in rows])


def differences(spark_df, con, sql):
    """Empty if both give the same columns and rows, else a short report."""
    got_cols, got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    TIMES["spark"] = time.time()
    cursor = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}" if bad else ""


def main():
    import __spark_entry__ as entry
    from scoreweave.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    names = [n for n in queries if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names)] if sys.argv[2:] else names
    spark, con = local_session(cores=8), connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            TIMES["spark"] = None
            if name in oracles:
                report = differences(df, con, oracles[name])
                kind = f"oracle, spark {TIMES['spark'] - start:.1f}s"
            else:
                n = len(df.collect())
                report, kind = ("" if n else "no rows"), f"rows={n}"
        except Exception as err:
            report, kind = f"{type(err).__name__}: {str(err)[:600]}", "error"
        failed += bool(report)
        print(f"{'FAIL' if report else 'ok  '} {name:28s} {kind:22s} {time.time() - start:6.1f}s {report}", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
