"""The stored training set: samples (identity, x, label, group_id, seq) in a versioned table, appended, deduplicated and replaced as one step.

A sample's identity is a digest of its vector as 32-bit floats. Of the samples of one identity the last stays, by
(batch, place in the batch); a label that differs from the one before it is a conflict. Both counts are in the
version's note. A batch that dies, or a reader in between, sees the version before.

Each identity is reduced before the shuffle to its last sample, so a vector that fills a third of a batch is a row for
each task. Conflicts need the order of all samples of an identity: only identities with two labels or more are
sorted, in runs of one range of the order each, joined at their ends.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catchment.functions.materialise import cut
from catchment.sources.snapshots import Snapshots, Version

COLUMNS = ("identity", "x", "label", "group_id", "batch", "place")
SCHEMA = "identity string, x array<float>, label int, group_id long, batch int, place long"
#: The labels of samples: no direction and the four directions.
LABELS = (0, 1, 2, 3, 4)
#: Ranges of the order that a hot identity's samples are split into.
RUNS = 64


def group_number(key: str) -> int:
    """A number for a group's key that doesn't change: 8 bytes of BLAKE2b, little-endian, without the sign."""
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little") & ((1 << 63) - 1)


def label_changes(samples: DataFrame) -> DataFrame:
    """One row: conflicts = samples whose label differs from the one before with their identity."""
    some = samples.groupBy("identity").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("identity")
    rows = samples.join(some, "identity", "left_semi").select("identity", "label", "batch", "place")
    # place // span puts neighbours in the order into one run, so runs of an identity follow each other
    ends = rows.groupBy("batch").agg(F.min("place").alias("low"), ((F.max("place") - F.min("place")) / RUNS + 1).alias("span"))
    rows = rows.join(ends, "batch").withColumn("run", F.floor((F.col("place") - F.col("low")) / F.col("span")).cast("int"))
    inside = Window.partitionBy("identity", "batch", "run").orderBy("place")
    marked = rows.withColumn("was", F.lag("label").over(inside))
    order = F.struct("batch", "place")
    runs = marked.groupBy("identity", "batch", "run").agg(F.count_if(F.col("was") != F.col("label")).alias("n"), F.min_by("label", order).alias("first"), F.max_by("label", order).alias("last"))
    across = Window.partitionBy("identity").orderBy("batch", "run")
    joined = runs.withColumn("was", F.lag("last").over(across))
    return joined.agg(F.coalesce(F.sum("n") + F.count_if(F.col("was") != F.col("first")), F.lit(0)).alias("conflicts"))


class TrainingStore:
    """A versioned training set whose vectors have `size` numbers."""

    def __init__(self, table: Snapshots, size: int):
        self.table, self.size = table, size

    def samples(self, number: int | None = None) -> DataFrame:
        """The samples of a version; none of a set that was never written."""
        if self.table.version(number) is None:
            return self.table.spark.createDataFrame([], SCHEMA)
        return self.table.read(number)

    def counts(self, number: int | None = None) -> dict:
        """removed and conflicts of the step that made a version."""
        held = self.table.version(number)
        return json.loads(held.note) if held and held.note else {"removed": 0, "conflicts": 0}

    def checked(self, new: DataFrame) -> None:
        """An error for a batch (x, label, place) with a vector of another size, a number that isn't finite, a label outside of LABELS, or a null."""
        finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        right = (F.size("x") == self.size) & F.col("label").isin(*LABELS) & F.col("place").isNotNull() & finite
        bad = new.where(~F.coalesce(right, F.lit(False))).limit(1).collect()
        if bad:
            raise ValueError(f"not a sample of {self.size} finite numbers and a label of {LABELS}: {str(bad[0])[:200]}")

    def append(self, new: DataFrame, group_key: str | None = None) -> Version | None:
        """Adds a batch (x, label, place: its order, different in each row). Its group is that of group_key, or the next number. None, and no version, for an empty batch."""
        new = new.select(F.col("x").cast("array<float>").alias("x"), F.col("label").cast("int").alias("label"), F.col("place").cast("long").alias("place"))
        if new.isEmpty():
            return None
        self.checked(new)
        identity = F.sha2(F.array_join(F.transform("x", lambda v: (v + F.lit(0.0).cast("float")).cast("string")), ","), 256)  # -0 is 0
        new = cut(new.withColumn("identity", identity))

        def change(old: DataFrame | None) -> tuple[DataFrame, str]:
            last = (None, None) if old is None else tuple(old.agg(F.max("group_id"), F.max("batch")).first())
            group = group_number(group_key) if group_key else (0 if last[0] is None else (last[0] + 1) & ((1 << 63) - 1))
            batch = 0 if last[1] is None else last[1] + 1
            added = new.select("identity", "x", "label", F.lit(group).cast("long").alias("group_id"), F.lit(batch).alias("batch"), "place")
            both = added if old is None else old.select(*COLUMNS).union(added.select(*COLUMNS))
            rest = [c for c in COLUMNS if c != "identity"]
            kept = both.groupBy("identity").agg(F.max_by(F.struct(*rest), F.struct("batch", "place")).alias("row"))
            found = both.agg(F.count("*").alias("n")).first().n - kept.count()
            return kept.select("identity", "row.*"), json.dumps({"removed": found, "conflicts": label_changes(both).first().conflicts if found else 0})

        return self.table.update(change)

    def reset(self) -> bool:
        """Empties the set; the version before stays until it is expired. False if there is none."""
        before = self.table.version()
        if before is None:
            return False
        self.table.replace(self.table.spark.createDataFrame([], SCHEMA), before, "")
        return True
