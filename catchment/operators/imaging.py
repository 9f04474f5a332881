"""Drawings of arrows to direction grids: pixels, ink, thinned lines, heads, votes.

Images are rows of Spark's image source (BGR bytes). Work on one image is NumPy inside an Arrow function,
one image a row; everything after it (cells, votes, components) is DataFrame work. These are published
methods (Otsu's threshold, Zhang-Suen thinning, chamfer distance); they don't match a given imaging
library's rounding pixel for pixel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIXELS = "image_id string, y int, x int, height int, width int, ink boolean, line boolean, thick double"
HEADS = "image_id string, x double, y double, dx double, dy double, score double"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, height, width, channels, data (BGR)."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("image_id"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def gray_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return a[..., 0] if channels == 1 else 0.114 * a[..., 0] + 0.587 * a[..., 1] + 0.299 * a[..., 2]


def otsu(gray: np.ndarray) -> float:
    """Threshold with the largest variance between dark and light."""
    counts = np.bincount(np.clip(gray, 0, 255).astype(int).ravel(), minlength=256).astype(float)
    total, weight = counts.sum(), np.cumsum(counts)
    mean = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * weight / total - mean) ** 2 / (weight * (total - weight))
    return float(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def blur(gray: np.ndarray) -> np.ndarray:
    p = np.pad(gray, 1, mode="edge")
    p = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    return (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4


def neighbours8(mask: np.ndarray) -> np.ndarray:
    """Stack of the eight neighbours, clockwise from the north."""
    p = np.pad(mask, 1)
    h, w = mask.shape
    return np.stack([p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))])


def ink_mask(gray: np.ndarray) -> np.ndarray:
    """Strong ink by Otsu, grown into weak ink that touches it; single pixels go."""
    smooth = blur(gray)
    level = otsu(smooth)
    strong, weak = smooth <= level, smooth <= min(250.0, level + 20)
    for _ in range(3):
        strong = strong | (weak & neighbours8(strong).any(0))
    return strong & neighbours8(strong).any(0)


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning."""
    out = mask.copy()
    while True:
        changed = False
        for turn in (0, 1):
            n = neighbours8(out).astype(int)
            count = n.sum(0)
            rises = ((n == 0) & (np.roll(n, -1, 0) == 1)).sum(0)
            a, b = ((0, 2, 4), (2, 4, 6)) if turn == 0 else ((0, 2, 6), (0, 4, 6))
            drop = out & (count >= 2) & (count <= 6) & (rises == 1) & (n[list(a)].prod(0) == 0) & (n[list(b)].prod(0) == 0)
            if drop.any():
                out, changed = out & ~drop, True
        if not changed:
            return out


def thickness(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance (1, sqrt 2) of ink pixels to the background, by repeated relaxation."""
    dist = np.where(mask, 1e9, 0.0)
    costs = np.array([1, 2**0.5] * 4)[:, None, None]
    while True:
        p = np.minimum(dist, (neighbours8(np.where(dist > 1e8, 1e9, dist)) + costs).min(0))
        p = np.where(mask, p, 0.0)
        if np.array_equal(p, dist):
            return dist
        dist = p


def head_candidates(mask: np.ndarray, line: np.ndarray, thick: np.ndarray, least: float = 0.15):
    """(x, y, dx, dy, score) of arrow heads: thick places of the line that taper towards one side.

    At a local maximum of thickness the ink ahead narrows to a point and ends; behind it the stroke goes on. The
    direction is from the thickest place away from the stroke's centre of mass nearby.
    """
    out = []
    if not line.any():
        return out
    stroke = max(1.0, float(np.median(thick[line])))
    peak = mask & (thick >= neighbours8(thick).max(0)) & (thick >= 1.6 * stroke)
    for y, x in zip(*np.nonzero(peak)):
        r = int(round(3.5 * thick[y, x])) + 2
        y0, x0 = max(0, y - r), max(0, x - r)
        ys, xs = np.nonzero(line[y0 : y + r + 1, x0 : x + r + 1])
        if len(ys) < 3:
            continue
        vx, vy = x - (xs + x0).mean(), y - (ys + y0).mean()
        norm = np.hypot(vx, vy)
        if norm < 0.5:
            continue
        score = min(1.0, (thick[y, x] / stroke - 1) / 3) * min(1.0, norm / max(1.0, thick[y, x]))
        if score >= least:
            out.append((float(x), float(y), vx / norm, vy / norm, float(score)))
    return out


def pixels(images: DataFrame) -> DataFrame:
    """PIXELS of the ink of each image."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                gray = gray_of(row["data"], row["height"], row["width"], row["channels"])
                mask = ink_mask(gray)
                line, thick = thin(mask), thickness(mask)
                y, x = np.nonzero(mask)
                n = len(y)
                yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]] * n, pa.string()), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array([row["height"]] * n, pa.int32()), pa.array([row["width"]] * n, pa.int32()), pa.array([True] * n, pa.bool_()), pa.array(line[y, x]), pa.array(thick[y, x])], [c.split()[0] for c in PIXELS.split(", ")])

    return images.select("image_id", "height", "width", "channels", "data").mapInArrow(run, PIXELS)


def heads(images: DataFrame) -> DataFrame:
    """HEADS of each image."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                mask = ink_mask(gray_of(row["data"], row["height"], row["width"], row["channels"]))
                found = head_candidates(mask, thin(mask), thickness(mask))
                columns = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]] * len(found), pa.string()), *[pa.array(c, pa.float64()) for c in columns]], [c.split()[0] for c in HEADS.split(", ")])

    return images.select("image_id", "height", "width", "channels", "data").mapInArrow(run, HEADS)


def cell_of_pixel(rows: int, cols):
    cols = F.lit(cols) if isinstance(cols, int) else cols
    return F.floor(F.col("y") * rows / F.col("height")).cast("int"), F.floor(F.col("x") * cols / F.col("width")).cast("int")


def cell_means(ink: DataFrame, rows: int, cols: int) -> DataFrame:
    """image_id, r, c, n (ink pixels), share (of the cell's pixels)."""
    r, c = cell_of_pixel(rows, cols)
    area = F.col("height") * F.col("width") / (rows * cols)
    return ink.groupBy("image_id", "height", "width", r.alias("r"), c.alias("c")).agg(F.count("*").alias("n")).select("image_id", "r", "c", "n", (F.col("n") / area).alias("share"))


def occupied(means: DataFrame, share: float = 0.06, least: int = 5) -> DataFrame:
    """Cells with enough ink: by share, or by count and half the share."""
    return means.where((F.col("share") >= share) | ((F.col("n") >= least) & (F.col("share") >= share / 2))).select("image_id", "r", "c")


def axis_field(ink: DataFrame, rows: int, cols: int) -> DataFrame:
    """image_id, r, c, axis_x, axis_y, conf: principal axis of the thinned pixels in the 3 x 3 cells around, from five on.

    Moments are whole numbers, so they don't depend on the order of pixels, and an axis upright to the columns is always at 90 degrees, never at -90.
    """
    r, c = cell_of_pixel(rows, cols)
    step = F.sequence(F.lit(-1), F.lit(1))
    near = ink.where("line").select("image_id", "x", "y", r.alias("r"), c.alias("c")).withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    sums = {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}
    g = near.groupBy("image_id", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    moment = lambda both, one, two: (whole("n") * whole(both) - whole(one) * whole(two)).cast("double")  # noqa: E731  n * n times the (co)variance
    g = g.withColumns({"a": moment("sxx", "sx", "sx"), "b": moment("sxy", "sx", "sy"), "d": moment("syy", "sy", "sy")})
    gap = F.sqrt((F.col("a") - F.col("d")) ** 2 + 4 * F.col("b") ** 2)
    angle = 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("d"))  # in (-90, 90] degrees: the sign is fixed
    conf = F.coalesce(F.try_divide(gap, F.col("a") + F.col("d")), F.lit(0.0))
    return g.where(f"n >= 5 AND r BETWEEN 0 AND {rows - 1} AND c BETWEEN 0 AND {cols - 1}").select("image_id", "r", "c", F.cos(angle).alias("axis_x"), F.sin(angle).alias("axis_y"), F.when(conf > 0.03, conf).otherwise(0.0).alias("conf"))


def component_cells(ink: DataFrame, labels: DataFrame, rows: int, cols: int, least: int = 2) -> DataFrame:
    """image_id, r, c, component with most ink in the cell (the lowest wins ties); labels: image_id, y, x, component."""
    r, c = cell_of_pixel(rows, cols)
    counts = ink.join(labels, ["image_id", "y", "x"]).groupBy("image_id", r.alias("r"), c.alias("c"), "component").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).groupBy("image_id", "r", "c").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))


def directions(images: DataFrame, rows: int, cols: int) -> DataFrame:
    """grid_id, r, c, d: occupied cells directed along their axis, towards the head that scores best for them."""
    from catchment.operators import correction

    ink = pixels(images)
    cells = occupied(cell_means(ink, rows, cols), 0.02)
    axis = axis_field(ink, rows, cols)
    size = images.select("image_id", "height", "width")
    found = correction.suppress(heads(images), 4.0).join(size, "image_id")
    spots = found.select("image_id", (F.col("y") * rows / F.col("height")).alias("hr"), (F.col("x") * cols / F.col("width")).alias("hc"), "dx", "dy", "score")
    pairs = cells.join(axis, ["image_id", "r", "c"]).join(spots, "image_id")
    ahead = (F.col("hc") - F.col("c") - 0.5) * F.col("dx") + (F.col("hr") - F.col("r") - 0.5) * F.col("dy")
    aside = F.abs((F.col("hc") - F.col("c") - 0.5) * F.col("dy") - (F.col("hr") - F.col("r") - 0.5) * F.col("dx"))
    along = F.abs(F.col("axis_x") * F.col("dx") + F.col("axis_y") * F.col("dy"))
    value = F.col("score") * along * F.exp(-aside * aside / 2) * F.exp(-F.greatest(ahead, F.lit(0.0)) / 8)
    code = F.when(F.abs("dx") >= F.abs("dy"), F.when(F.col("dx") > 0, 1).otherwise(3)).otherwise(F.when(F.col("dy") > 0, 2).otherwise(4))
    votes = pairs.where((ahead >= -1.5) & (along > 0.1)).select(F.col("image_id").alias("grid_id"), "r", "c", code.alias("d"), value.alias("w"))
    return votes.where("w >= 0.005").groupBy("grid_id", "r", "c").agg(F.max_by("d", F.struct("w", -F.col("d"))).alias("d"))


def draw(matrix: np.ndarray, cell: int = 24) -> np.ndarray:
    """A white BGR canvas with a black arrow in each directed cell (test drawings)."""
    rows, cols = matrix.shape
    canvas = np.full((rows * cell, cols * cell, 3), 255, np.uint8)
    yy, xx = np.mgrid[0 : rows * cell, 0 : cols * cell]
    for r, c in zip(*np.nonzero(matrix)):
        dr, dc = {1: (0, 1), 2: (1, 0), 3: (0, -1), 4: (-1, 0)}[int(matrix[r, c])]
        u = (xx - (c + 0.5) * cell) * dc + (yy - (r + 0.5) * cell) * dr
        v = np.abs((xx - (c + 0.5) * cell) * dr - (yy - (r + 0.5) * cell) * dc)
        shaft = (np.abs(u) <= cell * 0.42) & (v <= 1.2)
        tip = (u <= cell * 0.42) & (u >= cell * 0.08) & (v <= (cell * 0.42 - u) * 0.7)
        canvas[shaft | tip] = 0
    return canvas


def component_near(tips: DataFrame, labels: DataFrame, radius: int = 4) -> DataFrame:
    """tip_id, label of the component at a tip's pixel, else the most frequent one within `radius` rows and columns (the smallest of equals), else 0.

    tips: image_id, tip_id, x, y; labels: image_id, x, y, label (labelled pixels only). A tip asks for the pixels of its window by an equi-join.
    """
    step = F.sequence(F.lit(-radius), F.lit(radius))
    asked = tips.select("image_id", "tip_id", F.rint("x").cast("int").alias("tx"), F.rint("y").cast("int").alias("ty")).withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    asked = asked.select("image_id", "tip_id", (F.col("tx") + F.col("dx")).alias("x"), (F.col("ty") + F.col("dy")).alias("y"), ((F.col("dx") == 0) & (F.col("dy") == 0)).alias("own"))
    found = asked.join(labels, ["image_id", "x", "y"]).groupBy("image_id", "tip_id", "label").agg(F.bool_or("own").alias("own"), F.count("*").alias("n"))
    best = found.groupBy("image_id", "tip_id").agg(F.max_by("label", F.struct("own", "n", -F.col("label"))).alias("label"))
    return tips.select("image_id", "tip_id").join(best, ["image_id", "tip_id"], "left").fillna(0, ["label"])


def fill_short_gaps(profiles: DataFrame, most: int = 3) -> DataFrame:
    """profiles (profile_id, i, v; v of 0 or less is a gap) with gaps of at most `most` places between positive values filled on a straight line."""
    w = Window.partitionBy("profile_id").orderBy("i")
    some = lambda c: F.when(F.col("v") > 0, F.col(c))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    sides = {"li": F.last(some("i"), True).over(before), "lv": F.last(some("v"), True).over(before), "ri": F.first(some("i"), True).over(after), "rv": F.first(some("v"), True).over(after)}
    line = F.col("lv") + (F.col("rv") - F.col("lv")) * (F.col("i") - F.col("li")) / (F.col("ri") - F.col("li"))
    fill = (F.col("v") <= 0) & (F.col("ri") - F.col("li") - 1 <= most)
    return profiles.withColumns(sides).withColumn("v", F.when(fill, line).otherwise(F.col("v"))).drop(*sides)


def assign_greedily(edges: DataFrame) -> DataFrame:
    """group_id, a, b, cost: one to one by rising cost (then a, then b), within each group. Each round takes the edges that are the best of both their ends, all at once, which is what taking them in order gives."""
    from catchment.functions.materialise import cut

    left, taken = cut(edges.select("group_id", "a", "b", "cost")), None
    while left.limit(1).count():
        order = F.struct("cost", "a", "b")
        best_a = left.groupBy("group_id", "a").agg(F.min(order).alias("m")).select("group_id", "a", F.col("m.b").alias("b"))
        best_b = left.groupBy("group_id", "b").agg(F.min(order).alias("m")).select("group_id", "b", F.col("m.a").alias("a"))
        now = cut(left.join(best_a, ["group_id", "a", "b"]).join(best_b, ["group_id", "a", "b"]))
        taken = now if taken is None else taken.unionByName(now)
        left = cut(left.join(now.select("group_id", "a"), ["group_id", "a"], "left_anti").join(now.select("group_id", "b"), ["group_id", "b"], "left_anti"))
    return left if taken is None else taken.select("group_id", "a", "b", "cost")
