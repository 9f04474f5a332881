"""Helpers of the training-data operators: tables, shared folders, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is hot when it holds at least one part in HOT_PARTS of all rows, so at most HOT_PARTS groups are hot.
HOT_PARTS = 1000
#: Bytes of a written table's row groups, which a writing task holds in memory.
ROW_GROUP = 32 << 20
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, tag: str) -> str:
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
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back: the lineage is cut and survives the loss of executors."""
    schema = df.schema
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def bound_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the rows of an Arrow batch to BATCH_ROWS where the session has more: whole texts travel in batches, which the JVM and the worker both hold."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(conf)) <= BATCH_ROWS:
        df.sparkSession.conf.set(conf, BATCH_ROWS)
    return df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this run wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parts(df: DataFrame, each: int = 64_000_000) -> int:
    """How many partitions df needs for about `each` bytes of the tables it reads in one, and no fewer than the session's."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(width(df.sparkSession), sum(s for s in sizes if s < 1 << 60) // each)  # a size that isn't known is larger


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def hot_keys(counts: DataFrame, key: str, size: str) -> DataFrame:
    """The at most HOT_PARTS keys whose size is that share of the sum of all sizes (one row goes to the driver)."""
    total = counts.agg(F.sum(size)).first()[0] or 0
    least = max(2, -(-total // HOT_PARTS))
    return counts.where(F.col(size) >= least).select(key)


def salted_join(big: DataFrame, unique: DataFrame, key: str, hot: DataFrame, spread: Column, salts: int, how: str = "inner") -> DataFrame:
    """big joined with unique (one row for each key); rows of the hot keys (a bounded list) are spread over salts partitions."""
    flag = F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot")))
    left = big.join(flag, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    right = unique.join(flag, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")
