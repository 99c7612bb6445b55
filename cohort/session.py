"""Session helpers: one place that decides shuffle sizing, AQE and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "cohort",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one configured for this library.

    On a cluster the session is created by the launcher and only reused here, so
    none of these settings override what the cluster chose.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("COHORT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Read from ``spark.checkpoint.dir`` (what a cluster sets). Only a local session
    without that setting gets a fresh scratch folder; a cluster session without it
    is an error, because a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    local = tempfile.mkdtemp(prefix="cohort-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local one)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used by iterative loops: unlike ``checkpoint()``, the re-read table carries its real
    file size as statistics, so size estimates of joins in later rounds do not compound.
    """
    import uuid

    base = checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


ROWS_PER_PARTITION = 100_000    #: of rows that a model is fitted on


def spread(df: DataFrame) -> DataFrame:
    """The rows over a few partitions a core, for work whose time is in the rows and not in their bytes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def rows_to_score(df: DataFrame) -> DataFrame:
    """Rows for a model that takes long on each: written once and dealt evenly, where what they come from may end in one partition."""
    return spread(materialize(df, "to-score"))


def full_partitions(df: DataFrame, name: str = "rows") -> DataFrame:
    """Rows for an iterative fit: a table of more than ``ROWS_PER_PARTITION`` rows a core is written once, so that no pass
    recomputes it, and read in partitions of that size, so that no task holds a large part of it; a smaller one is left as it is."""
    rows = df.count()
    if rows <= ROWS_PER_PARTITION * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return materialize(df, name).repartition(-(-rows // ROWS_PER_PARTITION))


def side_by_side(work: Callable, jobs: Iterable, parallelism: int) -> list:
    """``work(job)`` of each job in threads, in order. Each has local properties of its own: threads that share them
    take away each other's execution number ("Cannot parse null string")."""
    own = [inheritable_thread_target(partial(work, job)) for job in jobs]
    with ThreadPool(max(1, min(parallelism, len(own)))) as pool:
        return pool.map(lambda f: f(), own, chunksize=1)
