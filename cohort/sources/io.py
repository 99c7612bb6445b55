"""Readers and writers: CSV with an explicit schema, parquet, metric tables as JSON,
fallback paths, and an append-only run log."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = "run_id string, metric string, grp string, value double"


def read_csv(spark: SparkSession, path: str, schema=None, header: bool = True,
             mode: str = "FAILFAST") -> DataFrame:
    """CSV with header. Give ``schema`` in production: inference costs an extra scan."""
    r = spark.read.option("header", header).option("mode", mode)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet read; selecting ``columns`` here lets the scan read only those columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def _is_missing_path(e: AnalysisException) -> bool:
    get = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
    cls = (get() if get else None) or ""
    return "PATH_NOT_FOUND" in cls or "Path does not exist" in str(e)


def read_first(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options) -> DataFrame:
    """Read the first path that exists (e.g. validated table, else the combined one).

    Only a missing path moves on to the next candidate; any other error is raised.
    """
    last = None
    for p in paths:
        try:
            return spark.read.format(fmt).options(**options).load(p)
        except AnalysisException as e:  # noqa: PERF203
            if not _is_missing_path(e):
                raise
            last = e
    raise FileNotFoundError(f"none of {list(paths)} exists") from last


def metrics_frame(spark: SparkSession, run_id: str, metrics: Mapping, grp: str | None = None) -> DataFrame:
    """Small driver-side dict of scalar results -> long metric table."""
    rows = [(run_id, str(k), grp, float(v)) for k, v in metrics.items()]
    return spark.createDataFrame(rows, METRIC_SCHEMA)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric table (run_id, metric, grp, value) as JSON lines."""
    df.write.mode(mode).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).json(path)


RUN_LOG_SCHEMA = "run_id string, ts double, kind string, name string, value string"


def log_run(spark: SparkSession, path: str, run_id: str, params: Mapping | None = None,
            metrics: Mapping | None = None) -> None:
    """Append one run's params and metrics to a parquet run log (replaces a tracking server)."""
    now = time.time()
    rows = [(run_id, now, "param", str(k), str(v)) for k, v in (params or {}).items()]
    rows += [(run_id, now, "metric", str(k), repr(float(v))) for k, v in (metrics or {}).items()]
    spark.createDataFrame(rows, RUN_LOG_SCHEMA).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(path)


def save_model(model, path: str) -> None:
    """Persist a fitted ML pipeline (any MLWritable)."""
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns): one count job."""
    return df.count(), len(df.columns)


def head(df: DataFrame, n: int, *order) -> DataFrame:
    """Top-n by explicit order (TakeOrderedAndProject); without order the rows are arbitrary."""
    return (df.orderBy(*order) if order else df).limit(n)


def with_source_tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))
