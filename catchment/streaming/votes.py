"""Votes and labels as streams: sums of votes are associative, so a stream and a batch of the same rows agree."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.operators import evaluate

BUCKETS = 64


def vote_stream(votes: DataFrame) -> DataFrame:
    """Running sums of a stream of votes (grid_id, r, c, d, w), for update or complete mode."""
    return votes.groupBy("grid_id", "r", "c", "d").agg(F.sum("w").alias("w"))


def windowed_votes(votes: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sums per event-time window of votes with a column ts; rows later than `late` behind the watermark are dropped."""
    return votes.withWatermark("ts", late).groupBy(F.window("ts", size), "grid_id", "r", "c", "d").agg(F.sum("w").alias("w"))


def newest(results: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The result of the newest generation of each task in each window of event time: older ones that arrive later don't replace it. A window's state goes once the watermark has passed it."""
    rest = [c for c in results.columns if c not in ("task", "generation", "ts")]
    return results.withWatermark("ts", late).groupBy(F.window("ts", size), "task").agg(F.max("generation").alias("generation"), F.max_by(F.struct(*rest), "generation").alias("result"))


def progress_counts(lines: DataFrame) -> DataFrame:
    """Lines of running engines (task, line, ts) by what they tell, per ten minutes: notes of running batches as they come."""
    from catchment.sources.texts import progress_note

    noted = lines.withColumn("note", progress_note(F.col("line"))).where("note IS NOT NULL")
    return noted.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "10 minutes"), "task").agg(F.count("*").alias("lines"), F.max_by("note", "ts").alias("last"))


def bucket_of(key: list[str]):
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def current_labels(spark: SparkSession, path: str) -> DataFrame:
    """The labels that `upsert_labels` wrote: of each bucket its newest version."""
    rows = spark.read.parquet(f"{path}/labels")
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # BUCKETS rows at most
    return rows.join(F.broadcast(newest), ["bucket", "version"]).drop("version")


def upsert_labels(stream: DataFrame, path: str, key: list[str]):
    """A writer whose query merges each batch of labels into the table below path (see current_labels).

    Labels lie in BUCKETS buckets by their key's hash; a batch writes a new version of the buckets that it touches, no others. A batch
    that is run again after a failure overwrites its own version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", bucket_of(key))
        columns = [c for c in batch.columns if c != "bucket"]
        try:
            seen = spark.read.parquet(f"{path}/labels").where(F.col("version") < number)
            last = seen.groupBy("bucket").agg(F.max("version").alias("version")).join(batch.select("bucket").distinct(), "bucket")
            old = seen.join(F.broadcast(last), ["bucket", "version"]).select(*columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old = batch.select(*columns).limit(0)
        done = evaluate.upsert(old, batch.select(*columns), key)
        done.withColumn("bucket", bucket_of(key)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/labels/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/_progress")
