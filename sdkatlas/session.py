"""Cutting lineage in iterative jobs so that a lost executor costs one round, not all of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; only a local session gets one of its own, beside its tables."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")


def saved(rows: DataFrame) -> DataFrame:
    """`rows` as a compressed table in the checkpoint folder, read back: for many rows, as checkpoints are not compressed by default."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def checkpointed(rows: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()
