"""Cutting the lineage of iterated plans by written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, below the warehouse, or a local folder if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="catchment-")
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/grid-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back; survives the loss of executors."""
    schema, path = df.schema, folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
