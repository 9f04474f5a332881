"""The workspace of a grid: LASSO and flood masks, outlets, edits, what an export keeps, and the state after a prediction.

Layers are rows (grid_id, r, c, ...); masks are rows (grid_id, r, c). A basin limits filling only; a LASSO limits
pipes, edits, outlets and exports too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.functions import geometry
from catchment.operators import graph, masks, spatial

CELL = ["grid_id", "r", "c"]


#: Tasks that the cells of few small rows spread over.
SPREAD = 200


def polygon_cells(corners: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells whose centre lies in a drawn polygon: corners grid_id, k, x, y in image pixels (rounded first, as drawn); grids grid_id, rows, cols, width, height."""
    ring = corners.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("k", F.rint("x").alias("x"), F.rint("y").alias("y")))).alias("p"))
    ring = ring.where("size(p) >= 3").select("grid_id", F.posexplode("p").alias("i", "a"), "p")
    edges = ring.select("grid_id", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.get("p", (F.col("i") + 1) % F.size("p")).alias("b"))
    edges = edges.select("grid_id", "x0", "y0", F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))
    rows = grids.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).repartition(SPREAD, "grid_id", "r")  # a grid's row is small, its cells and their tests are not
    cells = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    x, y = (F.col("c") + 0.5) * F.col("width") / F.col("cols"), (F.col("r") + 0.5) * F.col("height") / F.col("rows")
    near = cells.select(*CELL, x.alias("x"), y.alias("y")).join(edges, "grid_id")  # a hand-drawn ring has few corners
    point = [F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")]
    tests = near.groupBy(*CELL).agg(F.bool_or(geometry.on_segment(*point)).alias("edge"), F.count_if(geometry.crosses_ray(*point)).alias("n"))
    return tests.where("edge OR n % 2 = 1").select(*CELL)


def effective_mask(basin: DataFrame | None, lasso: DataFrame | None) -> DataFrame | None:
    """Cells that an area fill may take: the basin and the LASSO, where given."""
    return masks.intersect(basin, lasso)


def edit_mask(lasso: DataFrame | None, clip: DataFrame | None = None) -> DataFrame | None:
    """Cells that edits, outlets and exports may use: a LASSO, and a basin only if it was itself drawn as one (clip)."""
    return masks.intersect(lasso, clip)


def flood_cells(areas: list[DataFrame], support: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Support cells inside any flood area; with bounds (of a trimmed grid) areas lie on the whole grid and are moved first."""
    region = masks.union(*areas)
    if bounds is not None:
        region = masks.trim(region, bounds)
    return masks.within(support.select(*CELL), region)


def apply_lasso(layers: DataFrame, columns: list[str], outlets: DataFrame, lasso: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The aligned layers with all columns 0 outside, the outlets inside, and a row a grid with the number of cleared cells."""
    done = masks.zero_outside(layers, lasso, columns)
    counts = done.groupBy("grid_id").agg(F.count_if("dropped").alias("removed"))
    return done, masks.within(outlets, lasso), counts


def merge_region(previous: DataFrame, updated: DataFrame, region: DataFrame | None, value: str = "d") -> DataFrame:
    """An updated layer on the previous one's cells, 0 outside the region and where it has no value."""
    if region is not None:
        updated = masks.within(updated, region)
    return previous.select(*CELL).join(updated.select(*CELL, value), CELL, "left").fillna(0, [value])


def active_outlets(outlets: DataFrame, grids: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """grid_id, r, c, others: the outlet that an export takes (the requested one if it is set, else the smallest by row, column) and how many it drops; outlets outside of the grid don't count."""
    inside = outlets.select(*CELL).distinct().join(grids, "grid_id").where("r >= 0 AND c >= 0 AND r < rows AND c < cols")
    wanted = F.lit(False)
    if requested is not None:
        inside = inside.join(requested.select(*CELL, F.lit(True).alias("wanted")), CELL, "left")
        wanted = F.coalesce("wanted", F.lit(False))
    best = F.min(F.struct((~wanted).alias("other"), "r", "c"))
    return inside.groupBy("grid_id").agg(best.alias("best"), (F.count("*") - 1).alias("others")).select("grid_id", "best.r", "best.c", "others")


def sanitise(cells: DataFrame, outlets: DataFrame, lasso: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What an export keeps (cells inside the LASSO whose flow, after the cut, enters an outlet), and a row a grid: outside, unreachable."""
    cells = graph.cut(cells)
    inside = graph.cut(masks.within(cells, lasso)) if lasso is not None else cells
    kept = masks.within(inside, graph.reaching(inside, outlets))
    count = lambda df, name: df.groupBy("grid_id").agg(F.count("*").alias(name))
    n = count(cells, "all_n").join(count(inside, "in_n"), "grid_id", "left").join(count(kept, "kept_n"), "grid_id", "left").fillna(0)
    return kept, n.select("grid_id", (F.col("all_n") - F.col("in_n")).alias("outside"), (F.col("in_n") - F.col("kept_n")).alias("unreachable"))


def sanitise_note(outside: Column, unreachable: Column) -> Column:
    parts = F.array_compact(F.array(F.when(outside > 0, F.format_string("outside %d", outside)), F.when(unreachable > 0, F.format_string("unreachable %d", unreachable))))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("nothing removed")


def extent(layers: list[DataFrame], basin: DataFrame | None, lasso: DataFrame | None, grids: DataFrame) -> DataFrame:
    """Trim bounds of everything that is set in any support layer or in the effective basin."""
    region = effective_mask(basin, lasso)
    return masks.trim_bounds(masks.union(*layers, *([region] if region is not None else [])), grids)


def _checked_bounds() -> Column:
    good = (F.col("top") >= 0) & (F.col("top") < F.col("bottom")) & (F.col("bottom") <= F.col("rows")) & (F.col("left") >= 0) & (F.col("left") < F.col("right")) & (F.col("right") <= F.col("cols"))
    return F.when(good & (F.col("rows") > 0) & (F.col("cols") > 0), True).otherwise(F.raise_error(F.lit("bounds outside of the grid")).cast("boolean"))


def world_box(bounds: DataFrame, grids: DataFrame) -> DataFrame:
    """grid_id and the world box of trimmed bounds; grids: grid_id, rows, cols, xmin, ymin, xmax, ymax. Bounds outside of the grid are an error."""
    b = bounds.join(grids, "grid_id").where(_checked_bounds())
    x = lambda c: F.col("xmin") + F.col(c) / F.col("cols") * (F.col("xmax") - F.col("xmin"))
    y = lambda r: F.col("ymax") - F.col(r) / F.col("rows") * (F.col("ymax") - F.col("ymin"))
    return b.select("grid_id", x("left").alias("xmin"), y("bottom").alias("ymin"), x("right").alias("xmax"), y("top").alias("ymax"))


def pixel_box(bounds: DataFrame, grids: DataFrame) -> DataFrame:
    """grid_id, y0, y1, x0, x1: the image pixels (width, height) of trimmed bounds, half to even, one pixel at least."""
    b = bounds.join(grids, "grid_id").where(_checked_bounds())

    def span(low: str, high: str, size: str, count: str) -> tuple[Column, Column]:
        a, z = (F.rint(F.col(v) * F.col(size) / F.col(count)).cast("int") for v in (low, high))
        first = F.greatest(F.lit(0), F.least(a, F.col(size) - 1))
        return first, F.greatest(first + 1, F.least(z, F.col(size)))

    (y0, y1), (x0, x1) = span("top", "bottom", "height", "rows"), span("left", "right", "width", "cols")
    return b.select("grid_id", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"))


def image_world_box(rect, box, width: Column, height: Column) -> Column:
    """World box (struct) of a rectangle on an image, with corners in any order."""
    x = [box[0] + rect[k] / F.greatest(width, F.lit(1.0)) * (box[2] - box[0]) for k in (0, 2)]
    y = [box[3] - rect[k] / F.greatest(height, F.lit(1.0)) * (box[3] - box[1]) for k in (1, 3)]
    return F.struct(F.least(*x).alias("xmin"), F.least(*y).alias("ymin"), F.greatest(*x).alias("xmax"), F.greatest(*y).alias("ymax"))


def restore(base: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """A grid without its edits: the base cells, with the kept support (else the active cells)."""
    kept = (support if support is not None else base.where("d > 0")).select(*CELL, F.lit(1).alias("support"))
    return base.select(*CELL, "d").join(kept, CELL, "full").fillna(0, ["d", "support"]).withColumn("edited", F.lit(False))


def review_mask(grids: DataFrame, corrections: DataFrame, full: bool) -> tuple[DataFrame, DataFrame]:
    """Reviewed cells of a label (all, or the corrected ones inside of the grid; no row for a grid without any) and its counts."""
    counts = corrections.groupBy("grid_id").agg(F.count("*").alias("corrections"), F.count_if(F.col("d") == 0).alias("zero_corrections"))
    counts = grids.join(counts, "grid_id", "left").fillna(0, ["corrections", "zero_corrections"]).withColumn("scope", F.lit("full" if full else "corrected cells"))
    if full:
        cells = grids.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    else:
        cells = corrections.join(grids, "grid_id").where("r >= 0 AND c >= 0 AND r < rows AND c < cols")
    return cells.select(*CELL).distinct(), counts


def rotation(text: Column) -> Column:
    """Degrees of an input: no number, or not a finite one, is 0; clipped to one turn either way."""
    value = text.try_cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    turned = F.greatest(F.lit(-360.0), F.least(F.lit(360.0), value))
    return F.when(good & (F.abs(turned) >= 1e-9), turned).otherwise(0.0)


def learning_group(path: Column, degrees: Column, boundary: Column, field: Column, value: Column) -> Column:
    """Key of the samples that belong together: file and rotation, with a boundary's identity if one is chosen."""
    key = F.concat(path, F.format_string("|rot=%.4f", degrees))
    named = F.concat(key, F.lit("|boundary="), F.coalesce(boundary, F.lit("")), F.lit("|field="), F.coalesce(field, F.lit("")), F.lit("|value="), value)
    return F.when(path.isNull() | (path == ""), F.lit(None).cast("string")).when(F.coalesce(value, F.lit("")) != "", named).otherwise(key)


def after_prediction(layers: DataFrame) -> DataFrame:
    """Layers (d, detected, occ, path_occ, support, applied, conf) after a model's run: cells that the model emptied hold no pipe any more; support takes in every code."""
    emptied = (F.col("applied") == 1) & (F.col("d") == 0)
    some = ((F.col("d") > 0) | (F.col("detected") > 0)).cast("int")
    occ = F.when(emptied, 0).otherwise(F.greatest("occ", some))
    return layers.withColumns({"occ": occ, "path_occ": F.when(emptied, 0).otherwise(F.coalesce("path_occ", some)), "support": F.greatest((F.col("d") > 0).cast("int"), F.coalesce("support", some))})


def attention(layers: DataFrame) -> DataFrame:
    """grid_id, low_confidence, overlapping: directed cells under 0.55, and cells with more than one vote."""
    return layers.groupBy("grid_id").agg(F.count_if((F.col("d") > 0) & (F.col("conf") < 0.55)).alias("low_confidence"), F.count_if(F.col("overlap") > 1).alias("overlapping"))


def model_or_detector(detected: DataFrame, predicted: DataFrame | None) -> DataFrame:
    """Predicted codes where there are any, else the detector's, with the reason of the fallback."""
    if predicted is None:
        return detected.select(*CELL, "d", F.lit("no model").alias("reason"))
    both = detected.select(*CELL, F.col("d").alias("own")).join(predicted.select(*CELL, "d"), CELL, "full")
    return both.select(*CELL, F.coalesce("d", "own").alias("d"), F.when(F.col("d").isNull(), "no prediction").alias("reason"))


def clip_boundary(cells: DataFrame, boundary: DataFrame) -> DataFrame:
    """cells after a check that none lies outside of a hard boundary (else an error)."""
    out = masks.outside(cells, boundary).limit(1).count()
    if out:
        raise ValueError("active cells lie outside of the boundary")
    return cells


def outline(rings: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """Features whose box touches a window."""
    return spatial.window_features(spatial.boxes(rings, "feature_id"), window)
