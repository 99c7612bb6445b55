"""Registry of named queries over the driver tables, each with an optional DuckDB twin.

A query is ``fn(spark, sf_dir) -> DataFrame``. Its SQL twin (DuckDB dialect) reads the
same tables as views and must give the same rows, column names and types. Doubles are
rounded to ``DIGITS`` places on both sides so that summation order cannot change a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double/float column (the oracle rounds the same columns)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # round(x * 10^d) / 10^d: both engines round the scaled double the same way
            scale = float(10 ** digits)
            out.append((F.round(F.col(f"`{f.name}`").cast("double") * F.lit(scale), 0) / F.lit(scale)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def load_all() -> None:
    """Import every module that registers queries."""
    from . import cleaning, evaluation, modeling, statistics  # noqa: F401
