"""Side-by-side check of a Spark query and its DuckDB twin on the same parquet tables.

Same idea as the driver's gate: row count, column names and kinds, and an
order-insensitive comparison of the values.
"""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(dtype) -> str:
    s = str(dtype).lower()
    if "int" in s:
        return "int"
    if "float" in s or "double" in s or "decimal" in s:
        return "float"
    if "bool" in s:
        return "bool"
    return "other"


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), int(os.environ.get("ORACLE_DIGITS", "12")))
    return v


def compare(spark_df, con, sql: str):
    """Return a list of problems (empty when equal)."""
    sp = spark_df.toPandas()
    dk = con.execute(sql).df()
    problems = []
    if sorted(sp.columns) != sorted(dk.columns):
        return [f"columns differ: spark={sorted(sp.columns)} duck={sorted(dk.columns)}"]
    cols = sorted(sp.columns)
    for c in cols:
        ks, kd = _kind(sp[c].dtype), _kind(dk[c].dtype)
        if ks == "float" and kd == "int" and sp[c].isna().any():
            continue  # Spark's toPandas turns a nullable int into float
        if ks != kd and not (sp[c].isna().all() or dk[c].isna().all()):
            problems.append(f"kind of {c}: spark {sp[c].dtype} duck {dk[c].dtype}")
    if len(sp) != len(dk):
        problems.append(f"rows: spark={len(sp)} duck={len(dk)}")
        return problems

    def rows(df):
        out = [tuple(_norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)]
        return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))

    a, b = rows(sp), rows(dk)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} rows differ, e.g. spark={bad[0][0]} duck={bad[0][1]}")
    return problems


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import time

    import __spark_entry__ as E
    from cohort.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_spark()
    con = duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    fails = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                pr = compare(df, con, sqls[name])
            else:
                n = df.count()
                pr = [] if n >= 0 else ["no rows"]
        except Exception as e:  # noqa: BLE001
            pr = [f"error: {type(e).__name__}: {str(e)[:600]}"]
        status = "OK " if not pr else "BAD"
        fails += bool(pr)
        tag = "sql" if name in sqls else "rows"
        print(f"{status} {name:40s} {tag:4s} {time.time() - t0:6.2f}s {'; '.join(pr)}", flush=True)
    print(f"{fails} failing of {len([n for n in qs if not only or n in only])}")
