"""Drawings sampled around arrow heads: widths across the line, ink behind, beside and along it, and the score made of them.

heads: image_id, head_id, x, y (the tip), dx, dy (any length), span (a cell's side in pixels); pixels: image_id, x, y of the ink.
All samples of all heads are one frame that meets the pixels in an equi-join on the pixel (half to even); what is
collected for a head is bounded by its samples. Heads without a direction have no samples: widths and scores of 0.
Frames with rows for each head meet in sort-merge joins: what generators and aggregates make of a small table is far larger than
its estimate, so no heads are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = ["image_id", "head_id"]
#: Sample points in cells, as (distance ahead of the tip, offset to the side), and weights (fixed values).
AHEAD = tuple((d, o) for d in (0.35, 0.70, 1.05) for o in (-0.42, -0.24, 0.24, 0.42))
BEHIND = tuple((-d, o) for d in (0.25, 0.55, 0.85, 1.20) for o in (-0.14, 0.0, 0.14))
SHAFT = tuple((-d, o) for d in (0.85, 1.30, 1.85, 2.45, 3.10) for o in (-0.18, -0.08, 0.0, 0.08, 0.18))
#: Distances behind the tip, in cells, at which widths are taken.
TIP, MIDDLE, BASE, FRONT = 0.18, 0.62, 0.95, -0.48
HEAD_WIDTHS, FAR_WIDTHS = (0.62, 0.95, 1.35, 1.70), (2.40, 3.20, 4.00)
WEIGHTS = {"behind": 0.16, "clear": 0.10, "gain": 0.16, "taper": 0.13, "balance": 0.12, "shaft": 0.08, "steady": 0.08, "bulge": 0.17}


def directed(heads: DataFrame) -> DataFrame:
    """heads with a direction, as ux, uy, and step and half: the distance of neighbouring samples across and how far they reach."""
    length = F.hypot("dx", "dy")
    step = F.greatest(F.lit(1.0), F.col("span") / 10)
    out = heads.where(length > 1e-6).select(*HEAD, "x", "y", (F.col("dx") / length).alias("ux"), (F.col("dy") / length).alias("uy"), "span", step.alias("step"))
    return out.withColumn("half", F.greatest(F.lit(3.0), F.col("span") * 1.40))


def inked(samples: DataFrame, pixels: DataFrame) -> DataFrame:
    """The samples (image_id, at: struct x, y) that lie on ink."""
    place = samples.withColumns({"px": F.rint("at.x").cast("long"), "py": F.rint("at.y").cast("long")}).drop("at")
    ink = pixels.select("image_id", F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py")).distinct()
    return place.join(ink, ["image_id", "px", "py"], "left_semi")


def beside(distance: Column, offset: Column) -> Column:
    """The point at a distance ahead of the tip and an offset to the side, in pixels."""
    x = F.col("x") + F.col("ux") * distance - F.col("uy") * offset
    y = F.col("y") + F.col("uy") * distance + F.col("ux") * offset
    return F.struct(x.alias("x"), y.alias("y"))


def cross_sections(heads: DataFrame, pixels: DataFrame, distances: tuple[float, ...]) -> DataFrame:
    """image_id, head_id, distance, width, balance: the stretch of ink across the line at each distance (cells behind the tip), and how evenly it lies to both sides.

    The stretch is that of the ink nearest to the line; 0 where there is none within 2.5 samples or 0.18 cells.
    """
    own = directed(heads)
    last = F.ceil((2 * F.col("half") + 0.5 * F.col("step")) / F.col("step")) - 1
    rows = own.withColumn("distance", F.explode(F.array(*map(F.lit, distances)))).withColumn("k", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    rows = rows.withColumn("at", beside(-F.col("distance") * F.col("span"), -F.col("half") + F.col("k") * F.col("step")))
    hits = inked(rows.select(*HEAD, "distance", "k", "at"), pixels).groupBy(*HEAD, "distance").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    hits = hits.join(own.select(*HEAD, "span", "step", "half").hint("merge"), HEAD)
    offset = lambda k: -F.col("half") + k * F.col("step")
    below = F.floor(F.col("half") / F.col("step")).cast("int")
    middle = F.when(F.abs(offset(below)) <= F.abs(offset(below + 1)), below).otherwise(below + 1)
    hits = hits.withColumn("middle", middle)
    nearest = F.array_min(F.transform("ks", lambda k: F.struct(F.abs(k - F.col("middle")).alias("far"), k.alias("k"))))["k"]
    hits = hits.withColumn("anchor", nearest)
    # of sorted numbers, those of one run differ from their places by one number
    first = F.array_position("ks", F.col("anchor")).cast("int") - 1
    hits = hits.withColumn("shift", F.col("anchor") - first).withColumn("run", F.filter("ks", lambda k, i: k - i == F.col("shift")))
    low, high = offset(F.array_min("run")), offset(F.array_max("run"))
    less, more = F.abs(F.least(F.lit(0.0), low)), F.greatest(F.lit(0.0), high)
    near = F.abs(offset(F.col("anchor"))) <= F.greatest(F.col("step") * 2.5, F.col("span") * 0.18)
    found = hits.where(near).select(*HEAD, "distance", (high - low).alias("width"), (F.least(less, more) / F.greatest(less, more, F.lit(1e-6))).alias("balance"))
    every = heads.select(*HEAD).withColumn("distance", F.explode(F.array(*map(F.lit, distances))))
    return every.join(found.hint("merge"), [*HEAD, "distance"], "left").fillna(0.0, ["width", "balance"])


def supports(heads: DataFrame, pixels: DataFrame) -> DataFrame:
    """image_id, head_id, clear (share of the points beside the line ahead without ink), behind and shaft (shares with ink), steady (share of the shaft's distances with ink)."""
    kinds = {"ahead": AHEAD, "behind": BEHIND, "shaft": SHAFT}
    points = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(d).alias("d"), F.lit(o).alias("o")) for kind, several in kinds.items() for d, o in several])
    rows = directed(heads).withColumn("p", F.explode(points))
    rows = rows.select(*HEAD, "p.kind", "p.d", "p.o", beside(F.col("p.d") * F.col("span"), F.col("p.o") * F.col("span")).alias("at"))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    hits = inked(rows, pixels).groupBy(*HEAD).agg(n("ahead").alias("ahead"), n("behind").alias("back"), n("shaft").alias("along"), F.count_distinct(F.when(F.col("kind") == "shaft", F.col("d"))).alias("places"))
    out = directed(heads).select(*HEAD).join(hits.hint("merge"), HEAD, "left").fillna(0, ["ahead", "back", "along", "places"])
    return out.select(*HEAD, (1 - F.col("ahead") / len(AHEAD)).alias("clear"), (F.col("back") / len(BEHIND)).alias("behind"), (F.col("along") / len(SHAFT)).alias("shaft"), (F.col("places") / 5).alias("steady"))


def local_scores(heads: DataFrame, pixels: DataFrame) -> DataFrame:
    """image_id, head_id, score 0 to 1: how much the ink around a tip looks like an arrow head, a bulge that narrows to the front on a thinner shaft."""
    distances = tuple(sorted({TIP, MIDDLE, BASE, FRONT, *HEAD_WIDTHS, *FAR_WIDTHS}))
    wide = cross_sections(heads, pixels, distances)
    at = lambda d, c: F.max(F.when(F.col("distance") == d, F.col(c)))
    per = wide.groupBy(*HEAD).agg(
        at(TIP, "width").alias("tip"), at(FRONT, "width").alias("front"), F.greatest(at(MIDDLE, "balance"), at(BASE, "balance")).alias("balance"),
        F.max(F.when(F.col("distance").isin(*HEAD_WIDTHS), F.col("width"))).alias("head"), F.coalesce(F.min(F.when(F.col("distance").isin(*FAR_WIDTHS) & (F.col("width") > 0), F.col("width"))), F.lit(0.0)).alias("far"),
    )
    rows = heads.select(*HEAD, "span").join(per.hint("merge"), HEAD).join(supports(heads, pixels).hint("merge"), HEAD, "left").fillna(0.0, ["clear", "behind", "shaft", "steady"])
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    over = lambda a, b, share: clip((F.col(a) - F.col(b)) / F.greatest(F.col("span") * share, F.lit(1.0)))
    rows = rows.withColumns({"bulge": over("head", "far", 0.42), "gain": over("head", "tip", 0.34), "taper": over("head", "front", 0.34)})
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + weight * F.col(name)
    known = directed(heads).select(*HEAD, F.lit(True).alias("known"))
    rows = rows.join(known.hint("merge"), HEAD, "left")
    return rows.select(*HEAD, F.when(F.col("known"), clip(clip(score) * (0.28 + 0.72 * F.col("bulge")))).otherwise(0.0).alias("score"))
