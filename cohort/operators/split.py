"""Deterministic splits and samples.

Every random choice is an md5 of (row id, seed), so results do not depend on the
partitioning and DuckDB can reproduce them. Ranks are taken with the chunked windows of
``windows.py`` (md5 prefix chunks), so no stratum is ranked inside a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import (md5_chunks, chunked_row_number, chunked_running, join_small, md5_chunk, md5_order, range_chunk,
                      range_edges)


def _ranked(df: DataFrame, id_col: str, by: Sequence[str], seed) -> DataFrame:
    """Adds _rn (rank in stratum by md5) and _n (stratum size) in one windowed pass."""
    d = df.withColumn("_ok", md5_order(F.col(id_col), seed))
    d = chunked_running(d, by, [F.col("_ok")], md5_chunk(F.col("_ok")), {"_rn": F.lit(1)},
                        n_chunks=md5_chunks(), totals=True)
    return d.withColumnRenamed("_rn_total", "_n").drop("_ok")


def random_split(df: DataFrame, id_col: str, test_ratio: float = 0.2, seed=42) -> tuple[DataFrame, DataFrame]:
    """(train, test): test = the round(n * ratio) rows with the smallest md5(id-seed)."""
    d = _ranked(df, id_col, [], seed)
    is_test = F.col("_rn") <= F.round(F.col("_n") * F.lit(test_ratio))
    return (d.where(~is_test).drop("_rn", "_n"), d.where(is_test).drop("_rn", "_n"))


def stratified_split(df: DataFrame, id_col: str, by: str | Sequence[str], test_ratio: float = 0.2,
                     seed=42) -> tuple[DataFrame, DataFrame]:
    """Per stratum the round(n_s * ratio) rows with the smallest md5(id-seed) go to test."""
    by = [by] if isinstance(by, str) else list(by)
    d = _ranked(df, id_col, by, seed)
    is_test = F.col("_rn") <= F.round(F.col("_n") * F.lit(test_ratio))
    return (d.where(~is_test).drop("_rn", "_n"), d.where(is_test).drop("_rn", "_n"))


def split_flag(df: DataFrame, id_col: str, by: str | Sequence[str], test_ratio: float = 0.2, seed=42,
               name: str = "is_test") -> DataFrame:
    """Same split as a boolean column (one plan feeds both sides)."""
    by = [by] if isinstance(by, str) else list(by)
    d = _ranked(df, id_col, by, seed)
    return d.withColumn(name, F.col("_rn") <= F.round(F.col("_n") * F.lit(test_ratio))).drop("_rn", "_n")


def stratified_folds(df: DataFrame, id_col: str, by: str | Sequence[str], k: int = 3, seed=42,
                     name: str = "fold") -> DataFrame:
    """fold = (rank in stratum - 1) mod k; usable as ``CrossValidator(foldCol=...)``."""
    by = [by] if isinstance(by, str) else list(by)
    d = chunked_row_number(df, by, md5_order(F.col(id_col), seed), name="_rn")
    return d.withColumn(name, ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def _hex_to_long(h):
    return F.conv(h, 16, 10).cast("bigint")


def sample_with_replacement(df: DataFrame, id_col: str, n: int, seed=0) -> DataFrame:
    """n draws with replacement: draw i picks the row at position md5(i-seed) mod N,
    positions being ranks of md5(id-seed). The draw table (n rows) is generated by Spark
    and joined on position (shuffle join; the draw table grows with n, not broadcast)."""
    ranked = chunked_row_number(df, [], md5_order(F.col(id_col), seed), name="_pos")
    total = df.count()
    draws = (df.sparkSession.range(n).select(
        F.col("id").alias("draw"),
        (_hex_to_long(F.substring(md5_order(F.col("id"), f"draw-{seed}"), 1, 15)) % F.lit(total) + 1)
        .alias("_pos")))
    return draws.join(ranked, "_pos").drop("_pos")


def halves(df: DataFrame, order_col: str, frac: float = 0.5, chunks: int | None = None) -> DataFrame:
    """Positional split by an explicit order: the first floor(N * frac) rows are ``reference``.

    Adds ``part`` = 'reference' | 'current'. Rank is chunked by value range of ``order_col``.
    """
    edges = range_edges(df, order_col, chunks)
    d = chunked_running(df, [], [F.col(order_col)], range_chunk(order_col, edges), {"_rn": F.lit(1)},
                        n_chunks=len(edges) + 1, totals=True)
    cut = F.floor(F.col("_rn_total") * F.lit(frac))
    return d.withColumn("part", F.when(F.col("_rn") <= cut, F.lit("reference")).otherwise(F.lit("current"))).drop(
        "_rn", "_rn_total")


__all__ = ["random_split", "stratified_split", "split_flag", "stratified_folds", "sample_with_replacement",
           "halves", "join_small"]
