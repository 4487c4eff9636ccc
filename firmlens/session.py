"""Session settings the operators rely on, and the checkpoint folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import firmlens

RUNTIME_CONF = {
    # Timestamps are UTC on both the write and the read side.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The first k rows of a key are limited on the map side for every k.
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
    # Page bodies are large: bound Arrow batches in rows and in bytes so a batch of HTML fits a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's parsing functions to the Python workers inside the tasks that use them."""
    cloudpickle.register_pickle_by_value(firmlens)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    Where none is configured, a session in a single process gets a temporary folder; on a cluster that
    would be one folder per machine, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="firmlens-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame below the checkpoint folder and continue from the written table.

    The table is computed once, survives lost executors, and is read with column pruning, which a
    checkpointed RDD is not.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
