"""Single linkage of points within a gap, and the heads recovered from groups of line ends.

Points lie in bins so small that two of one bin are always within the gap: bins are the nodes, and two bins within reach
are linked if some two of their points are. So a crowded place is one node, not all its pairs; only neighbouring bins compare
points, each place once. Components of the bins are found by taking the least label around and jumping to its label.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catchment.functions.materialise import cut
from catchment.operators import suppression

NODE = ["image_id", "bx", "by"]


def bin_links(places: DataFrame, gap: float) -> DataFrame:
    """image_id, a, b (structs bx, by) of neighbouring bins with points within the gap, both ways."""
    steps = [(dx, dy) for dx in range(0, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    shift = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])).alias("s")
    probe = places.select("image_id", F.struct("bx", "by").alias("a"), F.col("x").alias("px"), F.col("y").alias("py"), "bx", "by", shift)
    probe = probe.withColumns({"bx": F.col("bx") + F.col("s.dx"), "by": F.col("by") + F.col("s.dy")}).drop("s")
    near = probe.join(places, NODE).where((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 <= gap * gap)
    half = near.select("image_id", "a", F.struct("bx", "by").alias("b")).distinct()
    return half.union(half.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))


def linked(points: DataFrame, gap: float) -> DataFrame:
    """points (image_id, id, x, y, any others) with `cluster`, the least id that is reached by steps of at most `gap`."""
    if gap <= 0:
        raise ValueError("the gap must be over 0")
    side = gap / math.sqrt(2) * (1 - 1e-9)
    at = lambda c: F.floor(F.col(c) / side).cast("long")
    rows = cut(points.withColumns({"bx": at("x"), "by": at("y")}))
    places = cut(rows.select(*NODE, "x", "y").distinct())
    links = cut(bin_links(places, gap))
    label = cut(places.select("image_id", F.struct("bx", "by").alias("node")).distinct().withColumn("low", F.col("node")))
    while True:
        around = links.join(label.select("image_id", F.col("node").alias("b"), "low"), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("node")).agg(F.min("low").alias("near"))
        low = label.join(around, ["image_id", "node"], "left").select("image_id", "node", F.col("low").alias("was"), F.least("low", F.coalesce("near", "low")).alias("at"))
        far = label.select("image_id", F.col("node").alias("at"), F.col("low").alias("far"))
        new = cut(low.join(far, ["image_id", "at"]).select("image_id", "node", "was", F.least("at", "far").alias("low")))
        label = new.select("image_id", "node", "low")
        if new.where("low != was").isEmpty():
            break
    named = rows.join(label.select("image_id", "node.bx", "node.by", "low"), NODE)
    least = named.groupBy("image_id", "low").agg(F.min("id").alias("cluster"))
    return named.join(least, ["image_id", "low"]).drop("low", "bx", "by")


def recovered_heads(ends: DataFrame, gap: float, least: float = 0.58) -> DataFrame:
    """A head for each group of line ends that agree: image_id, cluster, members, x, y, dx, dy, score, area and the box.

    ends: image_id, id, x, y, dx, dy, score, area, xmin, ymin, xmax, ymax. Ends with a lower score than `least` are left out. Directions are
    averaged by score (0.05 at least). With two ends or more and a mean of length 0.30 or more the head points along the mean, and the ends
    within a cosine of 0.10 count, if they are two; else the best end stands for its group if its score is 0.80 and 0.985 of the image's best.
    The tip is that of the end that lies farthest ahead, with 4 pixels for a score of 1 (fixed values).
    """
    good = ends.where(F.col("score") >= least)
    rows = linked(good, gap).withColumn("best", F.max("score").over(Window.partitionBy("image_id")))
    length = F.hypot("dx", "dy")
    rows = cut(rows.where(length > 1e-6).withColumns({"ux": F.col("dx") / length, "uy": F.col("dy") / length, "weight": F.greatest("score", F.lit(0.05))}))
    group = ["image_id", "cluster"]
    order = F.struct(F.col("score"), -F.col("id"))
    means = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col("ux") * F.col("weight")).alias("wx"), F.sum(F.col("uy") * F.col("weight")).alias("wy"), F.sum("weight").alias("weights"), F.max_by(F.struct("id", "score", "ux", "uy"), order).alias("first"), F.max("best").alias("best"))
    means = means.withColumn("mean", F.hypot("wx", "wy") / F.greatest("weights", F.lit(1e-6)))
    agreed = (F.col("n") >= 2) & (F.col("mean") >= 0.30)
    means = means.withColumns({"ax": F.when(agreed, F.col("wx") / F.greatest(F.hypot("wx", "wy"), F.lit(1e-6))), "ay": F.when(agreed, F.col("wy") / F.greatest(F.hypot("wx", "wy"), F.lit(1e-6)))})
    both = rows.drop("best").join(means.select(*group, "n", "mean", "first", "best", "ax", "ay"), group)
    both = both.withColumn("along", F.col("ux") * F.col("ax") + F.col("uy") * F.col("ay") >= 0.10)
    enough = both.groupBy(*group).agg((F.count_if("along") >= 2).alias("together"))
    both = both.join(enough, group)
    alone = F.col("id") == F.col("first.id")
    strong = F.col("first.score") >= F.greatest(F.lit(0.80), F.col("best") * 0.985)
    both = both.where(F.when(F.col("together"), F.col("along")).otherwise(alone & strong))
    both = both.withColumns({"ax": F.when(F.col("together"), F.col("ax")).otherwise(F.col("first.ux")), "ay": F.when(F.col("together"), F.col("ay")).otherwise(F.col("first.uy"))})
    # products with the axis differ by a constant from those of the distances to the middle
    ahead = F.struct((F.col("x") * F.col("ax") + F.col("y") * F.col("ay") + 4.0 * F.col("score")).alias("reach"), (-F.col("id")).alias("first"))
    out = both.groupBy(*group).agg(
        F.count("*").alias("members"), F.max_by(F.struct("x", "y"), ahead).alias("tip"), F.first("ax").alias("dx"), F.first("ay").alias("dy"), F.max("score").alias("top"), F.first("mean").alias("mean"),
        F.sum(F.greatest(F.lit(1.0), F.col("area"))).alias("area"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
    )
    score = F.greatest(F.lit(0.05), F.least(F.lit(0.92), F.col("top") * 0.72 + F.col("mean") * 0.28))
    return out.select(*group, "members", "tip.x", "tip.y", "dx", "dy", score.alias("score"), "area", "xmin", "ymin", "xmax", "ymax")


def new_heads(recovered: DataFrame, known: DataFrame, span: float, most: int) -> DataFrame:
    """The best `most` recovered heads of each image by falling score, without those that point like a known or a better one (cosine over 0.45) within 0.72 cells."""
    columns = ["image_id", "x", "y", "dx", "dy", "score"]
    length = F.greatest(F.hypot("dx", "dy"), F.lit(1e-12))
    unit = {"dx": F.col("dx") / length, "dy": F.col("dy") / length}
    near = cut(recovered.select(*columns, "cluster").withColumns(unit))
    hidden = suppression.hidden(near, known.select(*columns).withColumns(unit), 0.72 * span, 0.45, "cluster")
    kept = suppression.suppressed(near.join(hidden, ["image_id", "cluster"], "left_anti"), 0.72 * span, 0.45, most)
    return recovered.join(kept.select("image_id", "cluster"), ["image_id", "cluster"], "left_semi")
