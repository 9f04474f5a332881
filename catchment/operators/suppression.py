"""Greedy suppression of points on whole tables: rounds of local winners, without pairs of neighbours.

Candidates lie in bins as wide as the radius. In each round the best undecided candidate of a bin that is also the best of
the eight bins around stays: nothing better can reach it. It meets the undecided ones of these nine bins, each of
which meets one winner a bin at most, and those that are near and alike go. The best of all undecided ones is a
winner of every round, so rounds end; in a crowded place there are about as many as candidates that stay there.
Candidates at one place with one direction are reduced to the best first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catchment.functions.materialise import cut

PLACE = ["image_id", "bx", "by"]


def around(rows: DataFrame) -> DataFrame:
    """Each row for its bin and the eight around it."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    out = rows.withColumn("ax", F.explode(step)).withColumn("ay", F.explode(step))
    return out.withColumns({"bx": F.col("bx") + F.col("ax"), "by": F.col("by") + F.col("ay")}).drop("ax", "ay")


def suppressed(candidates: DataFrame, radius: float, alike: float = 0.7, most: int | None = None) -> DataFrame:
    """The candidates (image_id, x, y, dx, dy, score, any others but _id) that stay, taken by falling score, then x, y and direction: one stays if no
    better one that stayed is within radius and has a product of directions over `alike`. With `most` the best so many of an image."""
    rows = cut(candidates.withColumn("_id", F.monotonically_increasing_id()))
    order = F.struct((-F.col("score")).alias("s"), "x", "y", "dx", "dy", "_id")
    twins = F.when(F.col("dx") ** 2 + F.col("dy") ** 2 > alike, F.lit(-1)).otherwise(F.col("_id"))  # of these one would suppress the others
    undecided = rows.groupBy("image_id", "x", "y", "dx", "dy", twins.alias("twins")).agg(F.min(order).alias("order"))
    at = lambda c: F.floor(F.col(c) / radius).cast("long")
    undecided = cut(undecided.select("image_id", "order", at("x").alias("bx"), at("y").alias("by")))
    kept = None
    while True:
        best = undecided.groupBy(*PLACE).agg(F.min("order").alias("order"))
        least = around(best).groupBy(*PLACE).agg(F.min("order").alias("least"))
        sure = cut(best.join(least, PLACE).where("order = least").drop("least"))
        if sure.isEmpty():
            break
        kept = sure if kept is None else kept.union(sure)
        near = around(sure).withColumnRenamed("order", "by_one")
        a, b = F.col("order"), F.col("by_one")
        hit = (F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= radius) & (a["dx"] * b["dx"] + a["dy"] * b["dy"] > alike) | (a["_id"] == b["_id"])
        gone = undecided.join(near, PLACE).where(hit).select("image_id", "order._id").distinct()
        undecided = cut(undecided.withColumn("_id", F.col("order._id")).join(gone, ["image_id", "_id"], "left_anti").drop("_id"))
    if kept is None:
        return candidates.limit(0)
    out = kept.select("image_id", "order")
    if most is not None:
        out = out.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("order"))).where(F.col("place") <= most)
    return rows.join(out.select("image_id", "order._id"), ["image_id", "_id"], "left_semi").select(*candidates.columns)


def hidden(candidates: DataFrame, known: DataFrame, radius: float, alike: float, name: str) -> DataFrame:
    """image_id and name of the candidates (image_id, x, y, dx, dy, name) that are within radius of a known point with a product of directions over `alike`."""
    at = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = around(known.select("image_id", F.struct("x", "y", "dx", "dy").alias("k"), at("x").alias("bx"), at("y").alias("by")).distinct())
    both = candidates.withColumns({"bx": at("x"), "by": at("y")}).join(near, PLACE)
    k = F.col("k")
    hit = (F.hypot(F.col("x") - k["x"], F.col("y") - k["y"]) <= radius) & (F.col("dx") * k["dx"] + F.col("dy") * k["dy"] > alike)
    return both.where(hit).select("image_id", name).distinct()
