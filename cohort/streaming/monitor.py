"""Contract checks and drift monitoring on arriving files (Structured Streaming).

The batch operators are plain DataFrame functions, so a stream only needs a
``foreachBatch`` sink: each micro-batch is validated against the contract and compared
with a fixed reference table by PSI, and both results are appended (with the batch id)
to tables in a shared folder. Exactly-once follows from the checkpointed source offsets
plus idempotent per-batch output folders (``batch_id`` in the path, overwrite mode).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.monitor import drift_status, psi
from ..sources.contract import Contract, validate


def monitor_batch(batch: DataFrame, batch_id: int, reference: DataFrame, cols: Sequence[str],
                  contract: Contract | None, out_dir: str) -> None:
    if contract is not None:
        (validate(batch, contract).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{out_dir}/violations/batch_id={batch_id}"))
    (drift_status(psi(reference, batch, cols)).withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").parquet(f"{out_dir}/drift/batch_id={batch_id}"))


def start_monitor(spark: SparkSession, source_dir: str, schema, reference: DataFrame, cols: Sequence[str],
                  out_dir: str, checkpoint: str, contract: Contract | None = None,
                  max_files_per_trigger: int | None = None, trigger_once: bool = False):
    """Start the monitoring stream over parquet files arriving in ``source_dir``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    ref = reference.select(*cols).cache()
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: monitor_batch(b, i, ref, cols, contract, out_dir)))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def read_drift(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/drift")
