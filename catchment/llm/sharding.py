"""Sharding: contiguous shards of near equal bytes from global prefix sums.

Rows are put into ranges of doc_id ("slices"); the totals of the slices (one row a slice, a bounded
number) give each slice its global offset, a running sum inside each slice gives each row its own, and
the row goes to the shard in whose equal share of all bytes its middle byte lies. Law: `bytes`.

Null text counts as empty (size 1). Rows are ordered by doc_id (nulls first), then checksum and size, so
rows that tie in all three are interchangeable. A document is never cut: a shard is off its target by
less than the largest document. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catchment.llm import shared

ORDER = ("doc_id", "text_crc32", "size")


def shard_by_bytes(docs: DataFrame, work: str, shards: int = 16, slices: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; work is a folder for two small tables."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    ranged = sized.repartitionByRange(slices or shared.width(spark), *ORDER).withColumn("slice", F.spark_partition_id())
    ranged = shared.stash(ranged, f"{work}/ranged")
    # one row for each slice: bounded by the number of slices
    totals = sorted(ranged.groupBy("slice").agg(F.sum("size"), F.count("*")).collect())
    starts, at, rows = [], 0, 0
    for slice_, size, count in totals:
        starts.append((slice_, at, rows))
        at, rows = at + size, rows + count
    starts = spark.createDataFrame(starts, "slice int, byte_start long, row_start long")
    inside = Window.partitionBy("slice").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(F.broadcast(starts), "slice").withColumn("before", F.col("byte_start") + F.sum("size").over(inside) - F.col("size"))
    placed = placed.withColumn("row", F.col("row_start") + F.count("*").over(inside) - 1)
    shard = F.expr(f"least({shards - 1}, (2 * before + size) * {shards} div {max(1, 2 * at)})")
    placed = shared.stash(placed.select(*ORDER, "row", shard.cast("int").alias("shard")), f"{work}/placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard_by_bytes(docs, shared.work_dir(spark, "byte-shards"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = """
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n::BIGINT] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(n))),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, crc_table),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized),
placed AS (SELECT *, least(15, (2 * before + size) * 16 // (2 * total))::INT AS shard FROM summed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard
FROM placed
"""
