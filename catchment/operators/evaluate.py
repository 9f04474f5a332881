"""Evaluation of predicted grids against reviewed ones, audits of runs, label upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["grid_id", "r", "c"]


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return share(2 * p * r, p + r)


def aligned(prediction: DataFrame, gold: DataFrame, reviewed: DataFrame) -> DataFrame:
    """reviewed cells with gold and predicted codes (0 where absent)."""
    out = reviewed.select(*CELL).join(gold.select(*CELL, F.col("d").alias("gold")), CELL, "left").join(prediction.select(*CELL, F.col("d").alias("pred")), CELL, "left")
    return out.fillna(0, ["gold", "pred"])


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("grid_id", "gold", "pred").agg(F.count("*").alias("n"))


def metrics(pairs: DataFrame) -> DataFrame:
    """One row a grid: pipe counts, precision, recall, f1; direction accuracy, strict recall, macro F1 over codes 1..4."""
    p, g, same = F.col("pred") > 0, F.col("gold") > 0, F.col("pred") == F.col("gold")
    per = [F.struct(F.count_if(same & (F.col("gold") == k)).alias("tp"), F.count_if(~same & (F.col("pred") == k)).alias("fp"), F.count_if(~same & (F.col("gold") == k)).alias("fn")) for k in (1, 2, 3, 4)]
    out = pairs.groupBy("grid_id").agg(
        F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"),
        F.count_if(same & g).alias("exact"), F.count("*").alias("reviewed"), F.array(*per).alias("codes"),
    )
    out = out.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    one = lambda k: f1(share(k["tp"], k["tp"] + k["fp"]), share(k["tp"], k["tp"] + k["fn"]))
    macro = F.aggregate(F.transform("codes", one), F.lit(0.0), lambda a, x: a + x) / 4
    return out.select("grid_id", "reviewed", "tp", "fp", "fn", "tn", "exact", "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"), share(F.col("exact"), F.col("tp")).alias("accuracy"), share(F.col("exact"), F.col("tp") + F.col("fn")).alias("strict_recall"), macro.alias("macro_f1"))


def match(a: DataFrame, b: DataFrame, total: int) -> DataFrame:
    """One row a grid: percent of equal cells among `total`, IoU of active cells, equal directions on both."""
    both = a.select(*CELL, F.col("d").alias("x")).join(b.select(*CELL, F.col("d").alias("y")), CELL, "full").fillna(0, ["x", "y"])
    x, y, same = F.col("x") > 0, F.col("y") > 0, F.col("x") == F.col("y")
    return both.groupBy("grid_id").agg((100.0 * (total - F.count_if(~same)) / total).alias("exact"), (100.0 * share(F.count_if(x & y), F.count_if(x | y))).alias("iou"), (100.0 * share(F.count_if(x & y & same), F.count_if(x & y))).alias("direction"))


def audit(records: DataFrame) -> DataFrame:
    """One row an image over its row runs: spans and ratios of object counts and densities, least coverage, warnings."""
    out = records.groupBy("image").agg(
        (F.max("object_count") - F.min("object_count")).alias("object_span"),
        (F.max("object_count") / F.greatest(F.lit(1.0), F.min("object_count").cast("double"))).alias("object_ratio"),
        (F.max("final_density") - F.min("final_density")).alias("density_span"),
        (F.max("final_density") / F.greatest(F.lit(1e-9), F.min("final_density"))).alias("density_ratio"),
        F.min("coverage").alias("least_coverage"),
    )
    return out.withColumns({"unstable": (F.col("object_span") >= 8) | (F.col("object_ratio") >= 2), "density_warning": F.col("density_ratio") >= 2, "coverage_warning": F.col("least_coverage") < 0.7})


def latest(labels: DataFrame, *by: str) -> DataFrame:
    """The label row with the latest created_at (as text) of each key."""
    rest = [c for c in labels.columns if c not in by]
    return labels.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("created_at", F.struct(*rest))).alias("row")).select(*by, "row.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Review labels: newly reviewed cells replace old ones, all others stay; reviewed is the larger flag."""
    both = old.select(*key, F.col("d").alias("old_d"), F.col("reviewed").alias("old_r")).join(new.select(*key, F.col("d").alias("new_d"), F.col("reviewed").alias("new_r")), key, "full")
    was, now = F.coalesce("old_r", F.lit(False)), F.coalesce("new_r", F.lit(False))
    keep = was & ~now
    return both.select(*key, F.when(keep, F.col("old_d")).otherwise(F.coalesce("new_d", "old_d")).alias("d"), (was | now).alias("reviewed"))


def dedupe_keep_last(rows: DataFrame, identity: Column, order: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The last row of each identity, and one row of counts: removed rows, label conflicts with the row before."""
    w = Window.partitionBy("_key").orderBy(order)
    keyed = rows.withColumn("_key", F.sha2(identity, 256))
    marked = keyed.select("*", F.lead(order).over(w).alias("_next"), F.lag(label).over(w).alias("_was"))
    kept = marked.where("_next IS NULL").drop("_key", "_next", "_was")
    counts = marked.agg(F.count_if(F.col("_next").isNotNull()).alias("removed"), F.count_if(F.col("_was") != F.col(label)).alias("conflicts"))
    return kept, counts


def report(m: DataFrame) -> DataFrame:
    """A line of text for each grid, metrics with four decimals, rounded as C's printf does: by the number's binary value (Java's formatter rounds its shortest decimal text)."""
    shares = ("precision", "recall", "f1", "accuracy", "strict_recall", "macro_f1")
    line = F.udf(lambda *v: "pipe P=%.4f R=%.4f F1=%.4f | direction acc=%.4f strict=%.4f macro=%.4f" % v, "string", useArrow=True)
    return m.select("grid_id", line(*shares).alias("line"))
