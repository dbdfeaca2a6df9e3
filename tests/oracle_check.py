"""Run registered queries beside their SQL in DuckDB and compare values and types.

Usage: python tests/oracle_check.py [sf] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from placegraph import catalog  # noqa: E402
from placegraph.datasets import TABLES  # noqa: E402

KIND = {"int64": "int", "int32": "int", "float64": "float", "object": "object", "bool": "bool"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=repr)


def compare(spark_df, con, sql: str) -> list[str]:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} vs {sorted(want.columns)}"]
    problems = []
    for c in got.columns:
        a, b = str(got[c].dtype), str(want[c].dtype)
        if KIND.get(a, a[:5]) != KIND.get(b, b[:5]) or ("int" in a and a != b):
            problems.append(f"type of {c}: {a} vs {b}")
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        problems.append(f"{len(a)} rows vs {len(b)}")
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        problems.append(f"{len(diff)} rows differ, first {diff[0]}")
    return problems


def main():
    from placegraph.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    oracle = catalog.oracle_sql()
    for name, fn in catalog.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                t1 = time.time()
                problems = compare(df, con, oracle[name])
                rows = ""
            else:
                t1, problems, rows = t, [], f"rows only: {df.count()}"
        except Exception as err:  # noqa: BLE001
            problems, t1, rows = [f"{type(err).__name__}: {str(err)[:600]}"], t, ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:28s} {time.time() - t:6.2f}s {rows} {'; '.join(problems)}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
