"""Cell features and the model's decision on each cell: ink in cells, context maps, vectors, patches, scores, override rules.

Cells are dense rows (grid_id, r, c, ...) where a map needs them; grids: grid_id, rows, cols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.operators import graph, masks

CELL = ["grid_id", "r", "c"]

#: Patches: channels, side; weights of the channels' means in a patch's signal (fixed values).
PATCH = (3, 16, 16)
SIGNAL = (0.55, 0.30, 0.15)

#: Weights of a cell's evidence of a pipe (fixed values).
EVIDENCE = {"bw": 0.36, "edges": 0.12, "skeleton": 0.18, "head": 0.16, "run": 0.10, "degree": 0.05, "incoming": 0.03}


def spans(count: Column, size: Column) -> Column:
    """Array of (i, low, high): the pixels of each of `count` cells over `size` pixels, ends rounded half to even, one pixel at least."""
    i = F.sequence(F.lit(0), count - 1)
    edge = lambda k: F.rint(k * size / count.cast("double")).cast("int")
    low = lambda k: F.greatest(F.lit(0), F.least(size - 1, edge(k)))
    return F.transform(i, lambda k: F.struct(k.alias("i"), low(k).alias("low"), F.greatest(low(k) + 1, F.least(size, edge(k + 1))).alias("high")))


def inked_cells(pixels: DataFrame, grids: DataFrame, least: int = 1) -> DataFrame:
    """grid_id, r, c, ink, area: cells with at least `least` of the given foreground pixels (grid_id, x, y). grids: grid_id, rows, cols, width, height.

    Neighbouring cells may share a pixel row where cells are smaller than a pixel.
    """

    def axis(count: str, size: str, name: str, at: str) -> DataFrame:
        rows = grids.select("grid_id", F.explode(spans(F.col(count), F.col(size))).alias("s"))
        return rows.select("grid_id", F.col("s.i").alias(name), (F.col("s.high") - F.col("s.low")).alias(f"n_{name}"), F.explode(F.sequence(F.col("s.low"), F.col("s.high") - 1)).alias(at))

    found = pixels.join(axis("rows", "height", "r", "y"), ["grid_id", "y"]).join(axis("cols", "width", "c", "x"), ["grid_id", "x"])
    return found.groupBy(*CELL, (F.col("n_r") * F.col("n_c")).alias("area")).agg(F.count("*").alias("ink")).where(F.col("ink") >= least).select(*CELL, "ink", "area")


def densities(cells: DataFrame, value: str, grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Share of set cells in each row (grid_id, r, row_<value>) and in each column."""
    some = cells.where(F.col(value) > 0).join(grids, "grid_id")
    rows = some.groupBy("grid_id", "r").agg((F.count("*") / F.first("cols")).alias(f"row_{value}"))
    return rows, some.groupBy("grid_id", "c").agg((F.count("*") / F.first("rows")).alias(f"col_{value}"))


def context_maps(cells: DataFrame, grids: DataFrame, steps: int = 6) -> DataFrame:
    """cells (grid_id, r, c, d, occ, head) with the maps of their surroundings: row and column densities of occupied cells and heads, share of the grid that
    the cell's component takes, share of `steps` that its flow goes on, neighbours and entering flows over the grid's largest."""
    cells = graph.cut(cells)
    occupied = cells.where("occ = 1")
    named = graph.components(occupied)
    sizes = named.groupBy("grid_id", "component").count().join(grids, "grid_id")
    ratio = named.join(sizes, ["grid_id", "component"]).select(*CELL, (F.col("count") / (F.col("rows") * F.col("cols"))).alias("component_ratio"))
    run = graph.run_lengths(occupied, steps).select(*CELL, (F.col("run") / steps).alias("run"))
    degree = graph.degrees(occupied).select(*CELL, F.col("degree_share").alias("degree"), F.col("incoming_share").alias("incoming"))
    out = cells
    for more in (ratio, run, degree):
        out = out.join(more.hint("merge"), CELL, "left")
    for value in ("occ", "head"):
        rows, cols = densities(cells, value, grids)
        out = out.join(rows, ["grid_id", "r"], "left").join(cols, ["grid_id", "c"], "left")
    return out.fillna(0.0, ["component_ratio", "run", "degree", "incoming", "row_occ", "col_occ", "row_head", "col_head"])


LOCAL = ("occ", "bw", "edges", "skeleton", "head", "conf")
GLOBAL = ("component_ratio", "run", "degree", "incoming", "row_occ", "col_occ", "row_head", "col_head")


#: Cells on a side of the tiles whose vectors one group makes.
TILE = 64


def feature_vectors(cells: DataFrame, grids: DataFrame, radius: int = 2) -> DataFrame:
    """grid_id, r, c, x: for the (2 radius + 1)^2 cells around, row by row, four flags of the direction and LOCAL (0 outside of the grid); then place in the grid and GLOBAL.

    A cell goes to its own tile and to those that it is near to, so a grid's size is no bound and a cell is shuffled once, not once for each cell around.
    """
    side, wide = 2 * radius + 1, TILE + 2 * radius
    own = [*[(F.col("d") == k).cast("double").alias(f"_l{k}") for k in (1, 2, 3, 4)], *[F.col(v).cast("double").alias(f"_l{k}") for k, v in enumerate(LOCAL, 5)]]
    place = [F.col("r") / F.greatest(F.lit(1), F.col("rows") - 1), F.col("c") / F.greatest(F.lit(1), F.col("cols") - 1)]
    rest = [v.alias(f"_g{k}") for k, v in enumerate([*place, *[F.col(v).cast("double") for v in GLOBAL]])]
    tiles = lambda v: F.sequence(F.floor((F.col(v) - radius) / TILE), F.floor((F.col(v) + radius) / TILE))
    rows = cells.join(grids.select("grid_id", "rows", "cols"), "grid_id").select(*CELL, *own, *rest)
    rows = rows.withColumn("tr", F.explode(tiles("r"))).withColumn("tc", F.explode(tiles("c")))
    kinds = [cells.schema[v].dataType.simpleString() for v in CELL]

    def tile(frame):
        import numpy as np
        import pyarrow as pa

        number = lambda name: frame.column(name).to_numpy()
        r, c = number("r").astype(np.int64), number("c").astype(np.int64)
        top, left = frame.column("tr")[0].as_py() * TILE, frame.column("tc")[0].as_py() * TILE
        mine = np.flatnonzero((r >= top) & (r < top + TILE) & (c >= left) & (c < left + TILE))
        near, far = ([n for n in frame.column_names if n.startswith(k)] for k in ("_l", "_g"))

        def vectors(of):
            """of(column's name) of the cells around, row by row, and the cell's own."""
            spots = np.zeros((wide, wide, len(near)), of(near[0]).dtype)
            spots[r - top + radius, c - left + radius] = np.stack([of(n) for n in near], 1)
            parts = [spots[r[mine] - top + a, c[mine] - left + b] for a in range(side) for b in range(side)]
            return np.concatenate([*parts, np.stack([of(n)[mine] for n in far], 1)], 1)

        x = vectors(number)
        none = vectors(lambda n: frame.column(n).is_null().to_numpy()).ravel() if any(frame.column(n).null_count for n in near + far) else None
        x = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64(), mask=none))
        return pa.Table.from_arrays([*(frame.column(n).take(pa.array(mine)).combine_chunks() for n in CELL), x], [*CELL, "x"])

    return rows.groupBy("grid_id", "tr", "tc").applyInArrow(tile, ", ".join(f"{n} {k}" for n, k in zip(CELL, kinds)) + ", x array<double>")


def checked_patch(patch: Column) -> Column:
    """A flat patch of channels x side x side values, clipped to 0..1; zeros where it is null, an error where its size is another."""
    size = PATCH[0] * PATCH[1] * PATCH[2]
    clipped = F.transform(patch, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double"))))
    wrong = F.raise_error(F.format_string("a patch has %d values", F.size(patch))).cast("array<double>")
    return F.when(patch.isNull(), F.array_repeat(F.lit(0.0), size)).when(F.size(patch) == size, clipped).otherwise(wrong)


def combined(x: Column, patch: Column) -> Column:
    """A cell's vector with its patch behind it, centred."""
    return F.concat(x, F.transform(patch, lambda v: v - 0.5))


def patch_signal(patch: Column) -> Column:
    """Weighted means of a patch's channels, 0..1."""
    n = PATCH[1] * PATCH[2]
    mean = lambda k: F.aggregate(F.slice(patch, k * n + 1, n), F.lit(0.0), lambda s, v: s + v) / n
    total = sum((w * mean(k) for k, w in enumerate(SIGNAL)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def pipe_evidence() -> Column:
    """Evidence of a pipe in a cell, 0..1."""
    total = sum((w * F.col(c) for c, w in EVIDENCE.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def directed_evidence() -> Column:
    """Whether anything in a cell tells a direction (limits are fixed values)."""
    return (F.col("head") >= 0.45) | (F.col("skeleton") >= 0.12) | (F.col("run") >= 0.38) | (F.col("degree") >= 0.60) | ((F.col("bw") >= 0.16) & (F.col("edges") >= 0.05))


def class_support(count: Column, code: Column, enough: int = 4) -> Column:
    """How far a class's samples carry a decision: its count over `enough` (half for the empty class), from a floor to 1; 0 without samples."""
    floor = F.when(code == 0, 0.20).otherwise(0.25)
    whole = F.when(code == 0, max(2, enough // 2)).otherwise(max(1, enough))
    return F.when(F.coalesce(count, F.lit(0)) <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(floor, count / whole)))


def closeness(dist: Column, scale: Column, limit: Column) -> tuple[Column, Column]:
    """exp(-d^2 / 2 sigma^2) of the nearest exemplar, and whether it is near enough to be trusted."""
    sigma = F.greatest(scale, F.lit(1e-3))
    known = dist.isNotNull() & ~F.isnan(dist) & (dist < float("inf"))
    near = F.when(known, F.exp(-dist * dist / (2 * sigma * sigma))).otherwise(0.0)
    return near, F.when(known, dist <= F.greatest(limit, sigma * 1.05)).otherwise(False)


#: Least values of each rule, for a restricted and for a full training set (fixed values): probability, lead over the code in place,
#: trust, closeness, class support.
LIMITS = {
    "direct": ((0.84, 0.76), (0.20, 0.15), (0.82, 0.72), (0.68, 0.56), (0.60, 0.45)),
    "fill": ((0.82, 0.74), (0.18, 0.14), (0.80, 0.70), (0.62, 0.52), (0.60, 0.45)),
    "strong": ((0.80, 0.72), (0.18, 0.12), (0.70, 0.62), (0.70, 0.58), (0.55, 0.42)),
    "exceptional": ((0.82, 0.78), (0.20, 0.16), (0.72, 0.64), (0.78, 0.68), (0.55, 0.45)),
    "blend": ((0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.65, 0.45)),
    "clear": ((0.72, 0.72), (0.20, 0.20), (0.70, 0.70), (0.0, 0.0), (0.50, 0.50)),
}
#: Restricted and full: doubt about the code in place, margin of trust over its confidence, least lead, least trust, raw ink for a plausible
#: fill (three limits), raw ink for a direct one.
DOUBT, MARGIN, LEAD, TRUST = (0.55, 0.72), (0.12, 0.05), (0.18, 0.10), (0.72, 0.60)
FILL_RAW, DIRECT_RAW, SILENT = ((0.16, 0.13), (0.20, 0.16), (0.18, 0.15)), (0.18, 0.14), 0.055


def decide(cells: DataFrame, restricted: bool, least: float = 0.6) -> DataFrame:
    """Predictions laid over detections, by rules in order; the first that holds decides.

    cells: d, conf, overlap, tier (support level; null without one), occ, raw (patch signal), probs (array by code), dist, scale, reach, counts
    (array by code), and the columns of EVIDENCE. Adds best, p, trust, ambiguous, candidate, rule, new_d, new_conf, applied.
    """
    mode = 0 if restricted else 1
    d, conf, raw, tier, overlap = (F.col(c) for c in ("d", "conf", "raw", "tier", "overlap"))
    p = F.array_max("probs")
    best = F.array_position("probs", p).cast("int") - 1
    near, trusted = closeness(F.col("dist"), F.col("scale"), F.col("reach"))
    rows = cells.withColumns({"best": best, "p": p, "own": F.get("probs", d), "near": near, "trusted": trusted, "evidence": pipe_evidence(), "directed": directed_evidence()})
    rows = rows.withColumn("carried", class_support(F.get("counts", F.col("best")), F.col("best")))
    rows = rows.withColumn("trust", F.col("p") * (0.45 + 0.55 * F.col("near")) * (0.35 + 0.65 * F.col("carried")))
    best, p, own, near, trusted, carried, trust = (F.col(c) for c in ("best", "p", "own", "near", "trusted", "carried", "trust"))
    ink = F.greatest("evidence", "raw")
    weak = F.coalesce(tier <= 1, F.lit(False))
    held = tier.isNull() | (tier >= 2)
    ambiguous = (d == 0) | (conf < DOUBT[mode]) | (overlap > 1) | weak
    doubted = F.when((d != 0) & (conf >= 0.45), (overlap > 1) | weak).otherwise(ambiguous) if restricted else ambiguous
    fill, relabel, clear = (d == 0) & (best != 0), (d != 0) & (best != 0) & (best != d), best == 0
    can_fill = fill & (held | (F.col("occ") == 1) | (overlap > 1) | (raw >= FILL_RAW[0][mode])) & (F.col("directed") | (raw >= FILL_RAW[1][mode])) & (ink >= FILL_RAW[2][mode]) & ((overlap > 1) | held)
    can_clear = clear & (d != 0) & (conf < 0.52) & (tier.isNull() | weak) & (F.col("head") < 0.5) & (F.col("bw") < 0.18) & (F.col("skeleton") < 0.16) & (F.col("run") < 0.35) & (F.col("incoming") < 0.55) & (raw < 0.11)

    def meets(rule: str, fixed: bool = False) -> Column:
        """The rule's least values; with fixed, without the general ones for lead and trust below them."""
        prob, lead, sure, close, support = (v[mode] for v in LIMITS[rule])
        return trusted & (p >= max(least, prob)) & (p >= own + max(LEAD[mode], lead)) & (trust >= max(TRUST[mode], sure)) & (near >= close) & (carried >= support)

    unsure = conf < DOUBT[mode]
    strong = relabel & ((overlap > 1) | weak | unsure) & meets("strong") & (ink >= 0.10) & (unsure | ((p >= 0.80) & (p >= own + 0.20) & (near >= 0.80)))
    rule = (
        F.when((F.col("occ") != 1) & (d == 0) & (raw < SILENT), "silent")
        .when((best == d) & trusted, "agreed")
        .when(can_fill & meets("direct") & (raw >= DIRECT_RAW[mode]), "direct")
        .when(can_fill & meets("fill"), "fill")
        .when((d == 0) & (best == 0) & (raw < SILENT) & (p >= 0.55), "empty")
        .when((d == 0) & (best != 0) & (raw < SILENT), "ignored")
        .when(strong | (relabel & meets("exceptional")), "relabel")
        .when(~clear & ~fill & doubted & meets("blend") & (trust >= conf + MARGIN[mode]), "blend")
        .when(can_clear & meets("clear") & (trust >= conf + max(MARGIN[mode], 0.10)), "clear")
        .otherwise("kept")
    )
    rows = rows.withColumns({"ambiguous": ambiguous, "candidate": ambiguous | (best != d), "rule": rule})
    changed = F.col("rule").isin("direct", "fill", "relabel", "blend", "clear")
    sure = F.when(F.col("rule").isin("agreed", "direct", "fill", "blend"), F.least(F.lit(0.98), trust)).when(F.col("rule") == "relabel", F.least(F.lit(0.98), p)).when(F.col("rule").isin("empty", "clear"), F.least(F.lit(0.95), trust)).otherwise(0.0)
    return rows.withColumns({"new_d": F.when(changed, best).otherwise(d), "new_conf": F.greatest(conf, sure), "applied": changed}).withColumn("candidate", F.col("candidate") & (F.col("rule") != "silent"))


def drawn_labels(cells: DataFrame, grids: DataFrame, most: int = 5000, zero_share: float = 0.35, seed: int = 0) -> DataFrame:
    """grid_id, r, c, d: at most `most` directed cells of each grid as samples (drawn by a hash), and empty ones (d 0) beside: `zero_share` of
    their number, drawn from the cells no directed one touches (from all empty ones if there are none)."""
    from pyspark.sql import Window

    draw = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(",", "grid_id", "r", "c", F.lit(seed))), "r", "c")))
    active = cells.where("d > 0").select(*CELL, "d")
    kept = draw(active, "grid_id").where(F.col("place") <= most).select(*CELL, "d")
    every = grids.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    empty = every.select(*CELL).join(active.select(*CELL), CELL, "left_anti")
    near = masks.dilate(active).withColumn("near", F.lit(True))
    empty = empty.join(near, CELL, "left").withColumn("near", F.coalesce("near", F.lit(False)))
    far = empty.groupBy("grid_id").agg(F.count_if(~F.col("near")).alias("far"))
    wanted = kept.groupBy("grid_id").agg(F.greatest(F.lit(1), F.rint(F.count("*") * max(0.0, zero_share)).cast("int")).alias("wanted"))
    pool = empty.join(far, "grid_id").where("NOT near OR far = 0").join(wanted, "grid_id", "left").fillna(1, ["wanted"])
    zeros = draw(pool, "grid_id").where("place <= wanted").select(*CELL, F.lit(0).alias("d"))
    return kept.unionByName(zeros)


def run_audit(layers: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each image and row count: cells set in each layer and their densities, centre-line coverage, objects by direction.

    layers: image, rows, r, c, d, object_d, object_support, centre, occ; runs: image, rows, cols, width, height, boxes, objects (array of codes).
    """
    n = lambda test: F.count_if(test)
    d, centre = F.col("d") > 0, F.col("centre") > 0
    sums = layers.groupBy("image", "rows").agg(n(d).alias("final_nonzero"), n(F.col("object_d") > 0).alias("object_nonzero"), n(F.col("object_support") > 0).alias("object_support_nonzero"), n(centre).alias("centre_nonzero"), n(centre & d).alias("centre_assigned"), n(F.col("occ") > 0).alias("occupied_nonzero"))
    counts = ["final_nonzero", "object_nonzero", "object_support_nonzero", "centre_nonzero", "centre_assigned", "occupied_nonzero"]
    out = runs.join(sums, ["image", "rows"], "left").fillna(0, counts)
    size = F.greatest(F.lit(1), F.col("rows") * F.col("cols"))
    density = {f"{k}_density": F.col(f"{k}_nonzero") / size for k in ("final", "object", "occupied")}
    codes = {f"dir_{k}": F.aggregate("objects", F.lit(0), _counting(k)) for k in (1, 2, 3, 4)}
    coverage = {"centre_coverage": F.col("centre_assigned") / F.greatest(F.lit(1), F.col("centre_nonzero")), "centre_unassigned": F.col("centre_nonzero") - F.col("centre_assigned"), "object_count": F.size("objects")}
    return out.withColumns({**density, **codes, **coverage}).drop("objects")


def _counting(code: int):
    return lambda n, v: n + F.when(v == code, 1).otherwise(0)


def head_overlap(a, b) -> Column:
    """Intersection over union of two heads' pixel boxes; a side counts one pixel at least."""
    width = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    height = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    area = lambda v: F.greatest(F.lit(1), v["xmax"] - v["xmin"]) * F.greatest(F.lit(1), v["ymax"] - v["ymin"])
    return F.when((width > 0) & (height > 0), width * height / (area(a) + area(b) - width * height)).otherwise(0.0)


def head_dot(a, b) -> Column:
    """Cosine of two heads' directions; 1 if one has none."""
    length = F.hypot(a["dx"], a["dy"]) * F.hypot(b["dx"], b["dy"])
    return F.when(length > 1e-12, (a["dx"] * b["dx"] + a["dy"] * b["dy"]) / length).otherwise(1.0)


def similar_heads(a, b, margin: int) -> Column:
    """Whether two arrow heads (structs x, y, dx, dy and a box) are one: never if they oppose, else by direction or overlap near a tip, or by much overlap (fixed values)."""
    near = (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 <= float(max(3, margin) ** 2)
    dot, share = head_dot(a, b), head_overlap(a, b)
    return F.when(dot < -0.55, False).otherwise((near & ((dot > 0.70) | (share > 0.18))) | (share > 0.52))


def at_border(x: Column, y: Column, width: Column, height: Column, margin: int = 1) -> Column:
    """Whether a tip lies within `margin` pixels of the image's border."""
    return (x <= margin) | (y <= margin) | (x >= width - 1 - margin) | (y >= height - 1 - margin)


def turned_head(head, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Another direction for a head, brought to length 1: the given one, else its own, else east."""
    length, own = F.hypot(dx, dy), F.hypot(head["dx"], head["dy"])
    pick = lambda new, old, none: F.when(length > 1e-6, new / length).when(own > 1e-6, old / own).otherwise(none)
    return pick(dx, head["dx"], 1.0), pick(dy, head["dy"], 0.0)


def layer_role(pipe: Column, boundary: Column, flood: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.when(pipe, "pipe"), F.when(boundary, "boundary"), F.when(flood, "flood"))), "/")


def looks_flooded(name: Column) -> Column:
    """Whether a layer's name tells of a flood (fixed words)."""
    return F.lower(F.trim(name)).rlike("침수|범람|flood|inundation")

