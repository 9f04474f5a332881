"""Texts, axes and verbs on whole workspaces: scales of plots, labels, coarser shapes, the repair verb, checked training sets, a batch's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.operators import context, correction, graph, masks

CELL = ["grid_id", "r", "c"]

#: Columns of a batch's summary, in the order of its file (fixed values).
SUMMARY = ("excel_name", "status", "beta_a", "rows", "cols", "outlet_row", "outlet_col", "active_count", "connected_count", "disconnected_count", "elapsed_sec", "output_dir", "txt_path", "result_path", "fd_path", "ls_path", "width_functions_path", "warning", "error")


def axis_limits(values: DataFrame, by: str, value: str, zero: bool = False) -> DataFrame:
    """by, low, high of an axis: the finite values' range, wider by 6 % (by a tenth, or 1, where it is one value); 0 to 1 without any."""
    v = F.col(value)
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    out = values.groupBy(by).agg(F.min(finite).alias("a"), F.max(finite).alias("b"))
    if zero:
        out = out.select(by, F.least(F.coalesce("a", F.lit(0.0)), F.lit(0.0)).alias("a"), F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(0.0)).alias("b"))
    one = F.abs(F.col("b") - F.col("a")) <= 1e-9 * F.greatest(F.abs("a"), F.abs("b"))
    pad = F.when(one, F.greatest(F.abs("a") * 0.1, F.lit(1.0))).otherwise((F.col("b") - F.col("a")) * 0.06)
    none = F.col("a").isNull()
    return out.select(by, F.when(none, 0.0).otherwise(F.col("a") - pad).alias("low"), F.when(none, 1.0).otherwise(F.col("b") + pad).alias("high"))


def ticks(low: Column, high: Column, wanted: int = 6) -> Column:
    """Array of round places on an axis: multiples of 1, 2 or 5 times a power of ten, about `wanted` of them, 32 at most."""
    raw = (high - low) / wanted
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.when(raw <= power, power).when(raw <= 2 * power, 2 * power).when(raw <= 5 * power, 5 * power).otherwise(10 * power)
    first, last = F.ceil(low / step), F.floor(high / step + 1e-9)
    places = F.transform(F.sequence(first, F.least(last, first + 31)), lambda k: k * step)
    return F.when(F.abs(high - low) <= 1e-9 * F.greatest(F.abs(low), F.abs(high)), F.array(low)).when(last < first, F.array().cast("array<double>")).otherwise(places)


def distance_text(value: Column) -> Column:
    """A length in metres with its unit, from millimetres to kilometres."""
    v = F.abs(value)
    return F.when(v >= 1000, F.format_string("%.3f km", v / 1000)).when(v >= 1, F.format_string("%.2f m", v)).when(v >= 0.01, F.format_string("%.1f cm", v * 100)).otherwise(F.format_string("%.2f mm", v * 1000))


def cell_size_text(width: Column, height: Column, rows: Column, cols: Column, unit: Column) -> Column:
    """The size of a cell, with a mark where it is an approximation (degrees) or no metres."""
    metres = F.format_string("%s x %s, %d x %d%s", distance_text(width), distance_text(height), rows, cols, F.when(unit == "degree", " (approximate)").otherwise(""))
    plain = F.format_string("%.3f x %.3f units, %d x %d", width, height, rows, cols)
    return F.when(unit.isin("meter", "linear", "degree"), metres).otherwise(plain)


def layer_text(status: Column, source: Column, working: Column) -> Column:
    """What a list of layers shows of a layer's system."""
    return F.when(status == "invalid", "error in file").when(source.isNull(), "to be chosen").when(status == "reprojected", F.concat(source, F.lit(" -> "), working)).otherwise(source)


def coarse_shape(rows: Column, cols: Column, wanted: Column) -> Column:
    """Struct(rows, cols) of a grid on `wanted` rows: columns by its aspect, half to even, 2 at least and no more than it has; null where that is no smaller grid of 2 x 2 or more."""
    to = F.least(cols, F.greatest(F.lit(2), F.rint(wanted * cols / F.greatest(rows, F.lit(1))).cast("int")))
    good = (wanted >= 2) & (to >= 2) & (wanted <= rows) & ~((wanted == rows) & (to == cols))
    return F.when(good, F.struct(wanted.cast("int").alias("rows"), to.alias("cols")))


def compress_workspace(cells: DataFrame, outlets: DataFrame, shape: tuple[int, int], to: tuple[int, int], masks_by_centre: dict[str, DataFrame], flood: DataFrame | None = None, hard: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A workspace on a coarser grid: the cells (see graph.compress_to_outlet) and its masks by cell centres, a flood mask by any overlap.

    More than one outlet in a grid is an error, as is an active cell outside of the mask named by `hard`.
    """
    if outlets.groupBy("grid_id").count().where("count > 1").limit(1).count():
        raise ValueError("a grid has more than one outlet")
    done, _ = graph.compress_to_outlet(cells, outlets, shape, to)
    small = {name: masks.resample_centres(m, shape, to) for name, m in masks_by_centre.items()}
    if flood is not None:
        small["flood"] = masks.resample_any(flood, shape, to)
    if hard and masks.outside(done.where("d > 0"), small[hard]).limit(1).count():
        raise ValueError(f"active cells fall outside of {hard}")
    return done, small


def assist(cells: DataFrame, filled: DataFrame, basin: DataFrame, outlets: DataFrame) -> DataFrame:
    """The repair verb: an area fill is taken off, pipes are repaired by outlet, the basin is filled again, and what reaches no outlet goes.

    The order matters: filling after the repair lets pipes near an outlet keep their catchment. filled: cells of the earlier fill.
    outlets: grid_id, r, c, label. Returns grid_id, r, c, d, origin (kept, edited or filled).
    """
    outlets = graph.cut(outlets)
    pipes = graph.cut(masks.outside(cells, filled))
    labels = graph.partition_by_outlet(pipes.select(*CELL), outlets)
    # each step is written once, or the next ones would run the repair again for each time that they read it
    repaired = graph.cut(correction.correct_by_outlet(pipes, labels, outlets))
    good = graph.cut(masks.within(repaired.where("state <> 'unresolved'"), graph.reaching(repaired.where("d > 0").select(*CELL, "d"), outlets)))
    full = graph.cut(graph.fill_basin(good.where("d > 0").select(*CELL, "d"), masks.union(basin, good)))
    kept = masks.within(full, graph.reaching(full.select(*CELL, "d"), outlets))
    return kept.join(good.select(*CELL, "state"), CELL, "left").select(*CELL, "d", F.coalesce("state", F.lit("filled")).alias("origin"))


def checked_samples(samples: DataFrame, size: int, version: int = 5) -> DataFrame:
    """A training set read whole or not at all: rows of another version, of another vector size, with values that aren't finite or labels outside 0..4 are errors; a null group is its own."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    wrong = (F.col("version") != version) | (F.size("x") != size) | bad | ~F.col("label").between(0, 4) | F.col("label").isNull()
    told = F.raise_error(F.format_string("sample %s of the training set can't be used", F.col("sample_id").cast("string"))).cast("array<double>")
    return samples.withColumns({"x": F.when(F.coalesce(wrong, F.lit(True)), told).otherwise(F.col("x").cast("array<double>")), "group_id": F.coalesce(F.col("group_id").cast("long"), -F.col("sample_id") - 1), "patch": context.checked_patch(F.col("patch"))})


def synthetic_batch(labels: DataFrame, variants: int, features) -> DataFrame:
    """Samples of drawn variants of a grid: labels (grid_id, r, c, d) once a variant, joined with features(variants' keys) -> variant, grid_id, r, c, x, patch; the label is d, the group the variant's grid."""
    rows = labels.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    found = features(rows.select("grid_id", "variant").distinct())
    joined = rows.join(found, ["grid_id", "variant", "r", "c"])
    return joined.select(F.concat_ws("#", "grid_id", F.col("variant").cast("string")).alias("group_id"), "r", "c", F.col("d").alias("label"), "x", "patch")


def batch_summary(basins: DataFrame, runs: DataFrame, folder: str, beta: str, width: bool) -> DataFrame:
    """SUMMARY rows of a batch: workbooks' basins (see workbook.basins, with outlet_r, outlet_c) and their runs (grid_id, code, error, seconds)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    at = lambda end, on=True: F.concat(F.lit(folder + "/"), stem, F.lit(end)) if on else F.lit("")
    rows = basins.join(runs.withColumnRenamed("grid_id", "path"), "path", "left")
    good = F.coalesce((F.col("status") == "ok") & (F.col("code") == 0), F.lit(False))
    failure = F.when(F.col("status") != "ok", F.regexp_replace("status", "^error: ", "")).when(F.col("code").isNull(), F.coalesce("error", F.lit("not run"))).when(F.col("code") != 0, F.format_string("exit code %d", "code"))
    text = {"excel_name": name, "status": F.when(good, "ok").otherwise("error"), "beta_a": F.lit(beta), "rows": F.col("rows"), "cols": F.col("cols"), "outlet_row": F.col("outlet_r") + 1, "outlet_col": F.col("outlet_c") + 1, "active_count": F.col("cells"), "connected_count": F.col("connected"), "disconnected_count": F.col("disconnected"), "elapsed_sec": F.round("seconds", 6), "output_dir": F.lit(folder), "txt_path": at(".txt"), "result_path": at("_result.txt"), "fd_path": at("_FD.txt", width), "ls_path": at("_LS.txt", width), "width_functions_path": at("_width_functions.csv", width), "warning": F.when(good, F.coalesce(F.trim("error"), F.lit(""))).otherwise(""), "error": F.coalesce(F.when(~good, failure), F.lit(""))}
    return rows.select(*[text[c].alias(c) for c in SUMMARY])


def region_mark(mask: DataFrame) -> DataFrame:
    """grid_id, mark: a digest of a mask's cells, equal for equal masks in any order."""
    cells = F.array_sort(F.collect_set(F.struct("r", "c")))
    text = F.array_join(F.transform(cells, lambda p: F.concat_ws(",", p["r"].cast("string"), p["c"].cast("string"))), ";")
    return mask.groupBy("grid_id").agg(F.md5(text.cast("binary")).alias("mark"))


def result_key(image: Column, rows: Column, degrees: Column, mark: Column, *fields: Column) -> Column:
    """Key under which a detection or a layer's matrix may be kept: what it was made from, row count, rotation, region and chosen fields. Written tables named by it stand in for memory caches."""
    parts = [image, rows.cast("string"), F.format_string("%.4f", degrees), F.coalesce(mark, F.lit("whole")), *[F.coalesce(f, F.lit("")) for f in fields]]
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def system_meta(system: Column) -> Column:
    """A system's struct (see crs.parsed) as a map of texts for a layer's metadata; unknown entries are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in (("authority", F.when(system["code"].isNotNull(), "EPSG")), ("code", system["code"]), ("name", system["name"]), ("unit", system["unit"]), ("geographic", system["geographic"]), ("projected", system["projected"]))])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
