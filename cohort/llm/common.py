"""Shared pieces of the training-data operators.

Every operator identifies a row by ``(id, hash of its text)`` so that null ids, repeated
ids and extra columns with any name are harmless: only the id and text columns are read,
and internal column names start with an underscore.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SHINGLE = 5


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters (null and empty texts: no element)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def shingle_hashes(word_array: Column, n_words: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of all k-word runs, in order; ``word_array`` must be a column, not an expression."""
    each = F.transform(F.sequence(F.lit(0), n_words - F.lit(k)),
                       lambda i: F.xxhash64(*[F.get(word_array, i + F.lit(j)) for j in range(k)]))
    return F.when(n_words >= k, each).otherwise(F.array().cast("array<bigint>"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on derived columns.

    A plain filter would be pushed below the projections, with a copy of every expression the
    condition refers to, and copies of copies; a generator is computed where it stands.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.explode(F.when(condition, F.array(row))).alias("_kept")).select("_kept.*")


class Scratch:
    """Tables written to the shared checkpoint folder, to cut lineage and to compute once.

    A table that a later lost executor needs is read again from the shared folder, never
    recomputed from a half-lost cache. ``drop`` deletes one that no plan reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.tables: list[DataFrame] = []

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{label}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.tables.append(out)
        return out

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all tables written so far but ``kept``."""
        self.drop(*[t for t in self.tables if not any(t is k for k in kept)])

    def drop(self, *tables: DataFrame | None) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
                self.tables = [x for x in self.tables if x is not t]


def join_bounded(df: DataFrame, small: DataFrame, on, how: str, rows: int, limit: int = 100_000) -> DataFrame:
    """Join with a broadcast if the counted ``rows`` of ``small`` are within ``limit``, else as Catalyst plans it."""
    return df.join(F.broadcast(small) if rows <= limit else small, on, how)
