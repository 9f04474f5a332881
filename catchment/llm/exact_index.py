"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

A batch of rows becomes one row for each digest. A sort-merge anti-join against the index finds the digests that it
lacks, and only these are appended; for digests that it has, the batch's count and largest row go to a side table in the
same buckets. After some batches, or when the side table has outgrown the index, both are compacted into one sorted file
a bucket, so an index grows with the different texts, not with the rows or batches. Rows are then resolved against the
index, which meets its side table without a shuffle. Built-in expressions only.

A batch counts from the moment that its part is written to the index's layout: what a writer left that died before
is not read, and the batch can be added again. One writer at a time; readers see the parts that there were when they opened.

Null text counts as empty. Of equal texts the row with the largest doc_id stays, over all batches that were
added; a null doc_id loses to any other. Rows repeated under one doc_id are told apart by batch and
number, so exactly one row of each text is kept. An empty table gives an empty result; other columns of
the input are never read.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import shared

#: The batches in which the query adds its rows.
BATCHES = 3


class DigestIndex:
    """Tables (digest, keep, rows, part) in sorted buckets below `path`; keep = (doc_id, batch, row) of the largest doc_id.

    The layout beside them has the number of buckets, the generation (a compaction begins one) and its parts: opening the path
    again, in any session, continues with it. `close` takes the tables' names from the catalogue; their files stay.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, compact_after: int = 8):
        self.spark, self.path, self.compact_after = spark, path, compact_after
        held = self.layout()
        if held and buckets and held[0].buckets != buckets:
            raise ValueError(f"the index has {held[0].buckets} buckets, not {buckets}")
        self.buckets = held[0].buckets if held else buckets or shared.width(spark)
        self.generation = max((x.generation for x in held), default=0)
        self.parts = [x.part for x in held if x.generation == self.generation]
        if not held:
            self._commit(0)
        self._open()

    def layout(self) -> list:
        """One row for each part that counts."""
        try:
            return self.spark.read.schema("buckets int, generation int, part long").parquet(f"{self.path}/layout").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _commit(self, part: int) -> None:
        row = self.spark.createDataFrame([(self.buckets, self.generation, part)], "buckets int, generation int, part long")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/layout")
        self.parts.append(part)

    def _open(self) -> None:
        self.name = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}_{self.generation}"
        self.more = f"{self.name}_more"
        for name in (self.name, self.more):
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep STRUCT<doc_id: BIGINT, batch: BIGINT, row: BIGINT>, rows BIGINT, part BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{'more' if name == self.more else 'index'}-{self.generation}'"
            )

    def close(self) -> None:
        for name in (self.name, self.more):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def held(self, name: str) -> DataFrame:
        """The rows of a table's parts that count."""
        return self.spark.table(name).where(F.col("part").isin(self.parts)).drop("part")

    def entries(self) -> DataFrame:
        """digest, keep, rows: one for each digest, with what its later batches brought, which lies in the same bucket."""
        later = self.held(self.more).groupBy("digest").agg(F.max("keep").alias("later_keep"), F.sum("rows").alias("later_rows"))
        both = self.held(self.name).join(later.hint("merge"), "digest", "left")
        return both.select("digest", F.greatest("keep", "later_keep").alias("keep"), (F.col("rows") + F.coalesce("later_rows", F.lit(0))).alias("rows"))

    def add(self, rows: DataFrame) -> None:
        """Adds a batch of `digested` rows. Aggregation combines copies before its shuffle."""
        part = uuid.uuid4().int >> 66
        groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "batch", "row")).alias("keep"), F.count("*").alias("rows"))
        # written, as the optimiser would push the anti-join below the aggregate and shuffle every copy
        work = f"{self.path}/batch-{part}"
        groups = shared.stash(groups.withColumn("part", F.lit(part)), work)
        known = self.held(self.name).select("digest").hint("merge")
        fresh, again = (groups.join(known, "digest", how).select("digest", "keep", "rows", "part") for how in ("left_anti", "left_semi"))
        again.write.insertInto(self.more)
        fresh.write.insertInto(self.name)
        self._commit(part)
        shared.remove(self.spark, work)
        if len(self.parts) > self.compact_after or self.held(self.more).count() > self.held(self.name).count():
            self.compact()

    def compact(self) -> None:
        """Writes the index anew, a sorted file a bucket; the layout then names it, and the tables before go."""
        old, before = self.entries(), (self.name, self.more, self.generation)
        self.generation, self.parts = self.generation + 1, []
        self._open()
        old.withColumn("part", F.lit(0).cast("long")).repartition(self.buckets, "digest").write.insertInto(self.name)
        self._commit(0)
        for name in before[:2]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for kind in ("index", "more"):
            shared.remove(self.spark, f"{self.path}/{kind}-{before[2]}")

    def resolve(self, rows: DataFrame) -> DataFrame:
        """Each of the `digested` rows with the index's entry for its text.

        Digests with a thousandth of all rows or more (at most a thousand) are answered by a broadcast;
        their rows then join under keys of their own, which spreads them and matches nothing.
        """
        index = self.entries()
        hot = shared.hot_keys(index, "digest", "rows").select("digest")
        hot = F.broadcast(index.join(F.broadcast(hot), "digest").select("digest", F.struct("keep", "rows").alias("hot")))
        rows = rows.join(hot, "digest", "left")
        own = F.encode(F.concat_ws("-", "batch", "row"), "UTF-8")
        rows = rows.withColumn("key", F.when(F.col("hot").isNotNull(), own).otherwise(F.col("digest")))
        cold = index.select(F.col("digest").alias("key"), F.struct("keep", "rows").alias("cold"))
        found = F.coalesce("hot", "cold")
        return rows.join(cold.hint("merge"), "key", "left").select(
            "doc_id",
            found["keep"]["doc_id"].alias("keep_id"),
            found["rows"].alias("group_size"),
            F.struct("doc_id", "batch", "row").eqNullSafe(found["keep"]).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def digested(docs: DataFrame, work: str, batch=0) -> DataFrame:
    """Written (doc_id, digest, batch, row) of every row of docs: the texts are read once, and row numbers stay."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest")
    batch = batch if hasattr(batch, "cast") else F.lit(batch)
    return shared.stash(docs.select("doc_id", digest, batch.cast("long").alias("batch"), F.monotonically_increasing_id().alias("row")), work)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, added to a new index in BATCHES batches and resolved against it."""
    docs, work = shared.table(spark, sf_dir, "documents").select("doc_id", "text"), shared.work_dir(spark, "digest-index")
    rows = digested(docs, f"{work}/rows", F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)))
    index = DigestIndex(spark, f"{work}/index", shared.parts(rows))
    for batch in range(BATCHES):
        index.add(rows.where(F.col("batch") == batch))
    found = index.resolve(rows)
    index.close()
    return found


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
