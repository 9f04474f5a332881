"""Geometry to cells to votes to directions.

segments: feature_id, part, seg, x0, y0, x1, y1, start_h, end_h (heights may be null).
votes: grid_id, r, c, d, w (weights in millionths, as whole numbers: sums don't depend on their order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.functions import directions, geometry
from catchment.functions.materialise import cut

CELL = ["grid_id", "r", "c"]
#: Parts that the heads of each grid are dealt into.
DEALS = 64


def oriented(segments: DataFrame) -> DataFrame:
    """Segments turned round where both heights are known, not both 0, and the end lies higher."""
    known = segments.start_h.isNotNull() & segments.end_h.isNotNull() & ~((F.abs("start_h") <= 1e-9) & (F.abs("end_h") <= 1e-9))
    turn = F.coalesce(known & (F.col("start_h") < F.col("end_h")), F.lit(False))
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a)
    rule = F.when(segments.start_h.isNull() | segments.end_h.isNull(), "missing").when(~known, "zero").when(turn, "reversed").when(F.col("start_h") > F.col("end_h"), "forward").otherwise("equal")
    rest = [c for c in segments.columns if c not in ("x0", "y0", "x1", "y1")]
    return segments.select(*rest, swap("x0", "x1"), swap("y0", "y1"), swap("x1", "x0"), swap("y1", "y0"), rule.alias("height_rule"))


def line_cells(r0: Column, c0: Column, r1: Column, c1: Column, dx: Column, dy: Column) -> Column:
    """Array of (r, c) from one cell to another, four-connected.

    The integer line has a closed form: of its D + 1 places along the longer axis, place k is moved by
    floor((2 k m + D - 1) / (2 D)) along the shorter one (m cells long). Each diagonal step is bridged by a
    cell on the side of the larger source displacement.
    """
    dr, dc = F.abs(r1 - r0), F.abs(c1 - c0)
    wide = dc >= dr
    major, minor = F.greatest(dr, dc), F.least(dr, dc)
    sr, sc = F.signum((r1 - r0).cast("double")).cast("int"), F.signum((c1 - c0).cast("double")).cast("int")
    flat = F.abs(dx) >= F.abs(dy)

    def at(k: Column) -> tuple[Column, Column]:
        m = F.when(major > 0, F.floor(((2 * k * minor + major - 1) / F.greatest(2 * major, F.lit(1))))).otherwise(0).cast("int")
        return r0 + sr * F.when(wide, m).otherwise(k), c0 + sc * F.when(wide, k).otherwise(m)

    def place(k: Column) -> Column:
        r, c = at(k)
        pr, pc = at(k - 1)
        own = F.struct(r.alias("r"), c.alias("c"))
        bridge = F.struct(F.when(flat, pr).otherwise(r).alias("r"), F.when(flat, c).otherwise(pc).alias("c"))
        return F.when((k > 0) & (r != pr) & (c != pc), F.array(bridge, own)).otherwise(F.array(own))

    return F.flatten(F.transform(F.sequence(F.lit(0), major), place))


def segment_paths(segments: DataFrame, rows: int, cols, box) -> DataFrame:
    """segments with `path`, its cells."""
    r0, c0 = geometry.cell_of(F.col("x0"), F.col("y0"), rows, cols, box)
    r1, c1 = geometry.cell_of(F.col("x1"), F.col("y1"), rows, cols, box)
    ends = segments.select("*", r0.alias("_r0"), c0.alias("_c0"), r1.alias("_r1"), c1.alias("_c1"))
    path = line_cells(F.col("_r0"), F.col("_c0"), F.col("_r1"), F.col("_c1"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return ends.withColumn("path", path).drop("_r0", "_c0", "_r1", "_c1")


def segment_steps(segments: DataFrame, rows: int, cols, box) -> DataFrame:
    """One row for each step of the segments' cell paths (r, c, d) and one with terminal = true for each last cell.

    No path is built: place k of a line and the bridge behind it follow from k alone, so all of it is plain
    arithmetic on an exploded k. `steps` is the whole path's number of steps (longer axis plus diagonals).
    """
    r0, c0 = geometry.cell_of(F.col("x0"), F.col("y0"), rows, cols, box)
    r1, c1 = geometry.cell_of(F.col("x1"), F.col("y1"), rows, cols, box)
    ends = segments.select("*", r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"))
    dr, dc = F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0"))
    sign = lambda v: F.when(v > 0, 1).when(v < 0, -1).otherwise(0)
    ends = ends.select("*", F.greatest(dr, dc).alias("big"), F.least(dr, dc).alias("small"), (dc >= dr).alias("wide"), sign(F.col("r1") - F.col("r0")).alias("sr"), sign(F.col("c1") - F.col("c0")).alias("sc"))
    ends = ends.where("big > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("big"))).alias("k"))
    minor = lambda k: F.expr(f"cast((2 * ({k}) * small + big - 1) div (2 * big) as int)")
    at = ends.select("*", minor("k").alias("m"), minor("k + 1").alias("m1"), minor("k - 1").alias("m0"))
    row = lambda k, m: F.col("r0") + F.col("sr") * F.when(F.col("wide"), m).otherwise(k)
    col = lambda k, m: F.col("c0") + F.col("sc") * F.when(F.col("wide"), k).otherwise(m)
    k, m = F.col("k"), F.col("m")
    at = at.select("*", row(k, m).alias("r"), col(k, m).alias("c"), row(k + 1, F.col("m1")).alias("nr"), col(k + 1, F.col("m1")).alias("nc"))
    r, c, nr, nc = (F.col(x) for x in ("r", "c", "nr", "nc"))
    flat, last = F.abs(F.col("x1") - F.col("x0")) >= F.abs(F.col("y1") - F.col("y0")), k == F.col("big")
    bridged = (r != nr) & (c != nc)
    across, down = F.when(F.col("sc") > 0, 1).otherwise(3), F.when(F.col("sr") > 0, 2).otherwise(4)
    straight = F.when(c != nc, across).otherwise(down)
    # the last cell takes the last step's code: behind a bridge, the second half's
    before_bridged = m != F.col("m0")
    final = F.when(before_bridged, F.when(flat, down).otherwise(across)).otherwise(F.when(F.col("wide"), across).otherwise(down))
    step = lambda rr, cc, d, t: F.struct(rr.alias("r"), cc.alias("c"), d.alias("d"), F.lit(t).alias("terminal"))
    one = F.when(last, step(r, c, final, True)).otherwise(step(r, c, F.when(bridged, F.when(flat, across).otherwise(down)).otherwise(straight), False))
    two = F.when(~last & bridged, step(F.when(flat, r).otherwise(nr), F.when(flat, nc).otherwise(c), F.when(flat, down).otherwise(across), False))
    out = at.select(*segments.columns, (F.col("big") + F.col("small")).alias("steps"), F.explode(F.array(one, two)).alias("s")).where("s IS NOT NULL")
    return out.select(*segments.columns, "steps", "s.*")


def segment_votes(segments: DataFrame, rows: int, cols, box) -> DataFrame:
    """Each step votes on its source cell with max(length / steps, 1), the last cell gets 0.35 of that."""
    steps = segment_steps(segments, rows, cols, box)
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    weight = F.greatest(length / F.col("steps"), F.lit(1.0))
    w = F.rint(F.when(F.col("terminal"), weight * 0.35).otherwise(weight) * 1e6).cast("long")
    return steps.select("grid_id", "r", "c", "d", w.alias("w")).groupBy("grid_id", "r", "c", "d").agg(F.sum("w").alias("w"))


def argmax(votes: DataFrame) -> DataFrame:
    """cells: the code (1 to 4) with most weight; the lowest code wins ties.

    Each code's weight is a number of its own: an aggregate of structs would sort all votes, this one hashes cells.
    """
    best = votes.where("w > 0 AND d BETWEEN 1 AND 4").groupBy(*CELL).agg(*[F.max(F.when(F.col("d") == k, F.col("w"))).alias(f"_{k}") for k in (1, 2, 3, 4)])
    most = F.greatest("_1", "_2", "_3", "_4")
    code = F.when(F.col("_1") == most, 1).when(F.col("_2") == most, 2).when(F.col("_3") == most, 3).otherwise(4)
    return best.select(*CELL, code.cast(votes.schema["d"].dataType).alias("d"))


def confidence(votes: DataFrame) -> DataFrame:
    """grid_id, r, c, conf, overlap from the best, the second best and the sum of a cell's votes."""
    sums = [F.coalesce(F.sum(F.when(F.col("d") == k, F.col("w"))), F.lit(0)) for k in (1, 2, 3, 4)]
    four = votes.groupBy(*CELL).agg(F.sort_array(F.array(*sums), asc=False).alias("v")).where("v[0] > 0")
    best, second = F.col("v")[0].cast("double"), F.col("v")[1].cast("double")
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    overlap = F.size(F.filter("v", lambda x: x > F.col("v")[0] * 0.25)) >= 2
    conf = F.least(F.lit(1.0), 0.45 + 0.35 * best / total + 0.20 * (best - second) / best)
    return four.select(*CELL, F.when(overlap, conf * 0.82).otherwise(conf).alias("conf"), overlap.alias("overlap"))


def vote_strength(votes: DataFrame) -> DataFrame:
    """grid_id, r, c, strength: min(total / 4, 1) (0.6 best / total + 0.4 (best - second) / best), for votes in whole units."""
    v = votes.where("w > 0").groupBy(*CELL).agg(F.sort_array(F.collect_list(F.col("w").cast("double")), asc=False).alias("v"))
    total, best, second = F.aggregate("v", F.lit(0.0), lambda a, x: a + x), F.col("v")[0], F.coalesce(F.get("v", F.lit(1)), F.lit(0.0))
    return v.select(*CELL, F.least(F.lit(1.0), F.least(total / 4, F.lit(1.0)) * (0.6 * best / total + 0.4 * (best - second) / F.greatest(best, F.lit(1e-6)))).alias("strength"))


def rasterise(segments: DataFrame, rows: int, cols, box) -> DataFrame:
    """Flagship: segments to cells (grid_id, r, c, d)."""
    return argmax(segment_votes(oriented(segments), rows, cols, box))


def slope_cells(segments: DataFrame, rows: int, cols, box, unit: str = "meter", factor: float | None = None) -> DataFrame:
    """grid_id, r, c, slope: mean of the features' slopes |h0 - h1| / length, weighted by segment length per cell."""
    u, f = F.lit(unit), F.lit(factor).cast("double")
    length = geometry.length_in_metres(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), u, f)
    used = segments.where("start_h IS NOT NULL AND end_h IS NOT NULL AND NOT (abs(start_h) <= 1e-9 AND abs(end_h) <= 1e-9)").withColumn("length", length)
    whole = used.groupBy("grid_id", "feature_id").agg(F.sum("length").alias("whole")).where("whole > 1e-12")
    paths = segment_paths(used.join(whole, ["grid_id", "feature_id"]), rows, cols, box)
    slope = F.abs(F.col("start_h") - F.col("end_h")) / F.col("whole")
    weight = F.greatest(F.col("length") / F.size("path"), F.lit(1e-12))
    cells = paths.select("grid_id", slope.alias("slope"), weight.alias("weight"), F.explode("path").alias("cell"))
    return cells.groupBy("grid_id", F.col("cell.r").alias("r"), F.col("cell.c").alias("c")).agg((F.sum(F.col("slope") * F.col("weight")) / F.sum("weight")).alias("slope"))


def vote_object_paths(steps: DataFrame, weight: float | Column = 3.0, terminal: float | Column = 1.5) -> DataFrame:
    """Votes of arrow objects. steps: grid_id, object_id, k, r, c, own (the object's code; 0 for none).

    A step's code is the dominant one, or the object's own where they oppose; the last cell gets the last code. Weights may be columns
    of the steps. Sums are of millionths, so they don't depend on order.
    """
    rows = _coded_steps(steps, weight, terminal).where("d IS NOT NULL")
    return rows.groupBy("grid_id", "r", "c", "d").agg((F.sum("w") / 1e6).alias("w"))


def _coded_steps(steps: DataFrame, weight, terminal) -> DataFrame:
    w = Window.partitionBy("grid_id", "object_id").orderBy("k")
    moved = steps.select("*", F.lead("r").over(w).alias("nr"), F.lead("c").over(w).alias("nc"))
    step = (F.col("nr") - F.col("r"), F.col("nc") - F.col("c"))
    coded = moved.withColumns({"raw": F.when(F.col("nr").isNotNull(), F.nullif(directions.dominant_code(*step), F.lit(0))), "d": F.when(F.col("nr").isNotNull(), F.nullif(directions.object_code(*step, F.col("own")), F.lit(0)))})
    last = F.last("d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    share = lambda v: F.rint((v if isinstance(v, Column) else F.lit(v)) * 1e6).cast("long")
    end = F.col("nr").isNull()
    return coded.select("grid_id", "object_id", "r", "c", "nr", "nc", "raw", F.when(end, last).otherwise(F.col("d")).alias("d"), F.when(end, share(terminal)).otherwise(share(weight)).alias("w"))


def path_transitions(steps: DataFrame, weight: float = 3.0) -> DataFrame:
    """grid_id, r, c, nr, nc, t: weight of the steps between cells, of those whose code is that of the step itself."""
    rows = _coded_steps(steps, weight, 0.0).where("nr IS NOT NULL AND d = raw")
    return rows.groupBy(*CELL, "nr", "nc").agg((F.sum("w") / 1e6).alias("t"))


def rasterise_objects(steps: DataFrame) -> DataFrame:
    """grid_id, r, c, d, objects: cells of arrow objects (steps with a column score): the best code (0 without a vote) and how many objects touch a cell. Better objects weigh more."""
    weight = F.greatest(F.lit(0.25), F.least(F.lit(8.0), 1.0 + 4.2 * F.col("score")))
    votes = vote_object_paths(steps, weight, 0.5 * weight)
    best = argmax(votes.withColumn("w", F.rint(F.col("w") * 1e6).cast("long")))
    return object_counts(steps).join(best, CELL, "left").fillna(0, ["d"])


def cell_paths(pixels: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """grid_id, path_id, k, r, c: pixel paths (grid_id, path_id, k, x, y) as cells, consecutive repeats dropped; a step that isn't to a neighbour goes along the row first, then along the column."""
    at = lambda v, n, size: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(v) / (size / n)).cast("int")))
    w = Window.partitionBy("grid_id", "path_id").orderBy("k")
    cells = pixels.select("grid_id", "path_id", "k", at("y", rows, height).alias("r"), at("x", cols, width).alias("c"))
    kept = cells.select("*", F.lag("r").over(w).alias("pr"), F.lag("c").over(w).alias("pc")).where("pr IS NULL OR r <> pr OR c <> pc")

    def between(low: str, high: str) -> Column:
        """The places after low up to high, in order."""
        down = F.col(high) < F.col(low)
        return F.when(F.col(high) == F.col(low), F.array().cast("array<int>")).otherwise(F.sequence(F.col(low) + F.when(down, -1).otherwise(1), F.col(high)))

    along = F.transform(between("pc", "c"), lambda v: F.struct(F.col("pr").alias("r"), v.alias("c")))
    across = F.transform(between("pr", "r"), lambda v: F.struct(v.alias("r"), F.col("c").alias("c")))
    steps = F.when(F.col("pr").isNull(), F.array(F.struct("r", "c"))).otherwise(F.concat(along, across))
    out = kept.select("grid_id", "path_id", "k", F.posexplode(steps).alias("s", "p"))
    return out.select("grid_id", "path_id", (F.row_number().over(Window.partitionBy("grid_id", "path_id").orderBy("k", "s")) - 1).alias("k"), "p.r", "p.c")


def supported_paths(candidates: DataFrame, raw: DataFrame, tolerance: int = 1) -> DataFrame:
    """path_id, supported: whether each cell of a path lies within `tolerance` rows and columns (summed) of some cell of the raw path of the same id.

    The places around the candidates' own cells meet the raw cells, which stay as many as they are; both sides are shuffled, as an estimate of cells made by a window and a
    generator is far too low for a broadcast.
    """
    step = F.sequence(F.lit(-tolerance), F.lit(tolerance))
    own = candidates.select("path_id", "r", "c").distinct()
    places = own.withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step)).where(F.abs("dr") + F.abs("dc") <= tolerance)
    places = places.select("path_id", "r", "c", (F.col("r") + F.col("dr")).alias("nr"), (F.col("c") + F.col("dc")).alias("nc"))
    cells = raw.select("path_id", F.col("r").alias("nr"), F.col("c").alias("nc"), F.lit(True).alias("near")).distinct()
    met = places.join(cells.hint("merge"), ["path_id", "nr", "nc"], "left")
    found = met.groupBy("path_id", "r", "c").agg(F.bool_or(F.coalesce("near", F.lit(False))).alias("near"))
    return found.groupBy("path_id").agg(F.bool_and("near").alias("supported"))


def guided_votes(cells: DataFrame, heads: DataFrame, grids: DataFrame) -> DataFrame:
    """grid_id, r, c, d, w: for each occupied cell the vote of the head that fits it best.

    cells: grid_id, r, c, path (0 or 1), axis_x, axis_y, axis_conf. heads: grid_id, head_id, x, y, dx, dy, score. grids: grid_id, rows, cols, width,
    height. A head fits as far as the cell lies behind its tip, along its direction, close to its line, and the cell's own axis agrees. The
    lateral share falls under any use beyond a few cells, but heads have no bound along their line: a grid's cells meet its heads.
    """
    unit = F.hypot("dx", "dy")
    h = heads.where(unit > 1e-6).select("grid_id", "head_id", "x", "y", (F.col("dx") / unit).alias("ux"), (F.col("dy") / unit).alias("uy"), "score")
    h = cut(h.withColumn("deal", F.pmod(F.xxhash64("head_id", "x", "y"), F.lit(DEALS)).cast("int")))  # a grid's heads are dealt out: few grids may have all
    own = cut(cells.join(grids, "grid_id").join(h.select("grid_id").distinct(), "grid_id", "left_semi"))
    fits = _fits(own, h)
    best = cut(fits.groupBy(*CELL).agg(F.max("fit").alias("best")).where("best >= 0.03"))
    # the same expression again, for the heads that fit best: aggregates of numbers hash cells, one of structs would sort all pairs; no filter, which would compute it piece by piece
    first = F.when(F.col("fit") == F.col("best"), F.col("head_id"))
    found = _fits(own.join(best, CELL), h).groupBy(*CELL).agg(F.min_by("d", first).alias("d"), F.max("best").alias("best"))
    return found.where("d > 0").select(*CELL, "d", (0.7 + 2.2 * F.col("best")).alias("w"))


def _fits(cells: DataFrame, h: DataFrame) -> DataFrame:
    """cells with d and fit for each head of their grid that fits. The tables are small, their pairs many: as many tasks as parts."""
    key = ["grid_id", "deal"]
    dealt = cells.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))).repartition(DEALS, *key)
    rows = dealt.join(h.repartition(DEALS, *key).hint("shuffle_hash"), key)
    cx, cy = (F.col("c") + 0.5) * F.col("width") / F.col("cols"), (F.col("r") + 0.5) * F.col("height") / F.col("rows")
    scale = F.greatest(F.lit(1.0), F.hypot(F.col("height") / F.col("rows"), F.col("width") / F.col("cols")))
    rows = rows.withColumns({"tx": F.col("x") - cx, "ty": F.col("y") - cy, "size": scale})
    dist = F.hypot("tx", "ty")
    ahead = -(F.col("tx") * F.col("ux") + F.col("ty") * F.col("uy"))  # how far the cell lies in front of the tip
    aligned = -ahead / dist
    lateral = F.abs(F.col("ty") * F.col("ux") - F.col("tx") * F.col("uy"))
    agree = F.abs(F.col("axis_x") * F.col("ux") + F.col("axis_y") * F.col("uy"))
    known = F.col("axis_conf") > 0.08
    good = (dist > 1e-6) & (aligned > 0.10) & (ahead <= 1.2 * F.col("size")) & (~known | (agree >= 0.35))
    front = 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), ahead / (2.5 * F.col("size"))))
    side = lateral / (1.8 * F.col("size"))
    score = (0.30 + 0.70 * F.greatest("score", F.lit(0.0))) * aligned * F.exp(-side * side) * front * F.when(known, 0.25 + 0.75 * agree).otherwise(0.45) * F.when(F.col("path") == 1, 1.10).otherwise(1.0)
    code = directions.dominant_code(F.col("ty"), F.col("tx"))
    return rows.where(good).withColumns({"fit": score, "d": code})


def object_counts(steps: DataFrame) -> DataFrame:
    """grid_id, r, c, objects: how many objects touch a cell."""
    return steps.groupBy(*CELL).agg(F.count_distinct("object_id").alias("objects"))


def resolve_directions(votes: DataFrame, transitions: DataFrame, cells: DataFrame) -> DataFrame:
    """Direction of cells where objects overlap.

    votes grid_id, r, c, d, w; transitions grid_id, r, c, d, t (weight of moves from a cell along d); cells
    grid_id, r, c, objects, axis_x, axis_y, axis_conf. The best of (score, transition, vote, axis) wins.
    """
    joined = votes.join(transitions, ["grid_id", "r", "c", "d"], "left").join(cells, CELL, "left")
    t = F.coalesce("t", F.lit(0.0))
    along = F.when(F.col("d").isin(1, 3), F.abs("axis_x")).otherwise(F.abs("axis_y"))
    axis = F.coalesce(F.when(F.col("axis_conf") > 0.05, along), F.lit(0.0))
    objects = F.coalesce("objects", F.lit(0))
    score = F.round(t * (1.35 + 0.2 * F.least(objects, F.lit(3))) + 0.85 * F.col("w") + 0.2 * axis - F.when((objects > 1) & (t <= 1e-6), 0.35).otherwise(0.0), 9)
    return joined.groupBy(*CELL).agg(F.max_by("d", F.struct(score, t, "w", axis, -F.col("d"))).alias("d"))


def traversal(x0: Column, y0: Column, x1: Column, y1: Column, w: float, h: float) -> Column:
    """Array of (r, c) of the grid cells that a segment in pixels passes, in order, four-connected.

    The places where it crosses columns and rows are two sequences; sorted (a column first where both meet), each
    crossing moves on by one cell.
    """
    c0, c1, r0, r1 = (F.floor(v / s).cast("int") for v, s in ((x0, w), (x1, w), (y0, h), (y1, h)))

    def crossings(a: Column, b: Column, lo: Column, hi: Column, size: float, axis: int) -> Column:
        n = F.abs(hi - lo)
        k = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        line = lambda i: F.when(hi > lo, (lo + i) * size).otherwise((lo - i + 1) * size)
        return F.transform(k, lambda i: F.struct(F.coalesce(F.try_divide(line(i) - a, b - a), F.lit(0.0)).alias("t"), F.lit(axis).alias("axis")))

    moves = F.array_sort(F.concat(crossings(x0, x1, c0, c1, w, 0), crossings(y0, y1, r0, r1, h, 1)))
    sc, sr = F.when(c1 >= c0, 1).otherwise(-1), F.when(r1 >= r0, 1).otherwise(-1)
    start = F.array(F.struct(r0.alias("r"), c0.alias("c")))
    step = lambda path, m: F.concat(path, F.array(F.struct((F.element_at(path, -1)["r"] + F.when(m["axis"] == 1, sr).otherwise(0)).alias("r"), (F.element_at(path, -1)["c"] + F.when(m["axis"] == 0, sc).otherwise(0)).alias("c"))))
    return F.aggregate(moves, start, step)


def fallback_votes(links: DataFrame, votes: DataFrame, rows: int, cols: int) -> DataFrame:
    """Votes of 0.5 for cells without any, from the mean direction of their line pixels' neighbours.

    links: image_id, x, y, nx, ny (a pixel and its neighbour), height, width.
    """
    r, c = F.floor(F.col("y") * rows / F.col("height")).cast("int"), F.floor(F.col("x") * cols / F.col("width")).cast("int")
    sums = links.groupBy(F.col("image_id").alias("grid_id"), r.alias("r"), c.alias("c")).agg(F.sum(F.col("nx") - F.col("x")).alias("dx"), F.sum(F.col("ny") - F.col("y")).alias("dy"))
    code = directions.dominant_code(F.col("dy"), F.col("dx"))
    return sums.join(votes.select(*CELL).distinct(), CELL, "left_anti").select(*CELL, code.alias("d"), F.lit(0.5).alias("w")).where("d > 0")
