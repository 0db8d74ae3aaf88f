"""Run registered queries against their SQL: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql):
    """None when equal, else a short description."""
    cols_a, rows_a = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    types = {d[0]: str(d[1]) for d in res.description}
    cols_b, rows_b = normal([d[0] for d in res.description], res.fetchall())
    if cols_a != cols_b:
        return f"columns {cols_a} != {cols_b}"
    if len(rows_a) != len(rows_b):
        return f"rows {len(rows_a)} != {len(rows_b)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = [(c, t, types[c]) for c, t in spark_df.dtypes if t in kinds and types[c] != kinds[t]]
    bad = [(a, b) for a, b in zip(rows_a, rows_b) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows_a)} rows differ {cols_a}: {bad[:2]}"
    return f"TYPES {odd}" if odd else None


def main(argv):
    from loanloom.session import local_session
    from loanloom.plans import ORACLES, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf_dir)
            if n in ORACLES:
                problem = compare(df, con, ORACLES[n])
                kind = "sql"
            else:
                rows = df.collect()
                problem, kind = (None if rows else "no rows"), f"rows={len(rows)}"
        except Exception as e:  # noqa: BLE001
            problem, kind = f"{type(e).__name__}: {str(e)[:700]}", "error"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {n:34s} {kind:10s} {time.time() - t:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
