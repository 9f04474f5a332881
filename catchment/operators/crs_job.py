"""Coordinate systems of all layers of a map at once: the system is a column, so thousands of layers in any systems are one plan.

layers: layer, kind (polyline or boundary), ord (its place in the map), crs (the key of the system found beside its file), prj_error,
assigned (a key chosen earlier); choices: layer, key, ord (choices of the user in their order); points or segments: layer and
coordinates. A layer's source system is the last choice, else the one assigned before, else the one found. The project's system is that
which is given, else the first choice ever made (which sets it), else that of the first layer by `crs.project_choice`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.functions.materialise import cut
from catchment.operators import crs

KINDS = ("polyline", "boundary")
#: What of a system stands in an expression; a geographic one has geographic = 1 and neutral numbers.
FIELDS = ("geographic", "shifted", "lon0", "scale", "east", "north", "meridian", "radius", "a1", "a2", "a3", "a4", "b1", "b2", "b3", "b4", "e")


def numbers(system: crs.System) -> tuple[float, ...]:
    radius, alpha, beta, e = crs._series(system.ellipsoid)
    flat = system.lon0 is None
    return (float(flat), float(system.shifted), *((0.0, 1.0, 0.0, 0.0, 0.0) if flat else (system.lon0, system.scale, system.east, system.north, crs._meridian(system))), radius, *alpha, *beta, e)


def parameters(key: Column) -> Column:
    """Struct of FIELDS for the key of a known system (null for another)."""
    table = F.create_map(*[v for s in crs.SYSTEMS.values() for v in (F.lit(s.key), F.struct(*[F.lit(n).alias(f) for f, n in zip(FIELDS, numbers(s), strict=True)]))])
    return F.try_element_at(table, key)


def to_degrees(rows: DataFrame, p: str, x: str, y: str) -> DataFrame:
    """Columns x, y from the system in the struct column p to degrees on its datum."""
    s = F.col(p)
    out = rows.withColumns({"_xi": ((F.col(y) - s["north"]) / s["scale"] + s["meridian"]) / s["radius"], "_eta": (F.col(x) - s["east"]) / (s["scale"] * s["radius"])})
    xi, eta = F.col("_xi"), F.col("_eta")
    u, v = xi, eta
    for j, b in enumerate(("b1", "b2", "b3", "b4")):
        k = 2 * (j + 1)
        u, v = u - s[b] * F.sin(k * xi) * F.cosh(k * eta), v - s[b] * F.cos(k * xi) * F.sinh(k * eta)
    out = out.withColumns({"_u": u, "_v": v})
    out = out.withColumns({"_q": F.asinh(F.sin("_u") / F.sqrt(F.sinh("_v") ** 2 + F.cos("_u") ** 2)), "_lon": s["lon0"] + F.degrees(F.atan2(F.sinh("_v"), F.cos("_u")))})
    lat = F.atan(F.sinh("_q"))
    for _ in range(4):
        lat = F.asin(F.tanh(F.col("_q") + s["e"] * F.atanh(s["e"] * F.sin(lat))))
    flat = s["geographic"] == 1
    out = out.withColumns({x: F.when(flat, F.col(x)).otherwise(F.col("_lon")), y: F.when(flat, F.col(y)).otherwise(F.degrees(lat))})
    return out.drop("_xi", "_eta", "_u", "_v", "_q", "_lon")


def from_degrees(rows: DataFrame, p: str, x: str, y: str) -> DataFrame:
    """Columns x, y from degrees to the system in the struct column p."""
    s = F.col(p)
    sin = F.sin(F.radians(y))
    out = rows.withColumns({"_t": F.sinh(F.atanh(sin) - s["e"] * F.atanh(s["e"] * sin)), "_l": F.radians(F.col(x) - s["lon0"])})
    out = out.withColumns({"_xi": F.atan2("_t", F.cos("_l")), "_eta": F.asinh(F.sin("_l") / F.sqrt(F.col("_t") ** 2 + F.cos("_l") ** 2))})
    xi, eta = F.col("_xi"), F.col("_eta")
    east, north = eta, xi
    for j, a in enumerate(("a1", "a2", "a3", "a4")):
        k = 2 * (j + 1)
        east, north = east + s[a] * F.cos(k * xi) * F.sinh(k * eta), north + s[a] * F.sin(k * xi) * F.cosh(k * eta)
    flat = s["geographic"] == 1
    out = out.withColumns({x: F.when(flat, F.col(x)).otherwise(s["east"] + s["scale"] * s["radius"] * east), y: F.when(flat, F.col(y)).otherwise(s["north"] + s["scale"] * (s["radius"] * north - s["meridian"]))})
    return out.drop("_t", "_l", "_xi", "_eta")


def moved(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Columns x, y (degrees) from the datum of _source to that of _target."""
    plain = rows.withColumns({"_x0": F.col(x), "_y0": F.col(y)})
    newer = crs.shift(plain, True, x, y).withColumns({"_nx": F.col(x), "_ny": F.col(y), x: F.col("_x0"), y: F.col("_y0")})
    older = crs.shift(newer, False, x, y)
    up = (F.col("_source.shifted") == 1) & (F.col("_target.shifted") == 0)
    down = (F.col("_source.shifted") == 0) & (F.col("_target.shifted") == 1)
    pick = lambda new, old, own: F.when(up, F.col(new)).when(down, F.col(old)).otherwise(F.col(own))
    return older.withColumns({x: pick("_nx", x, "_x0"), y: pick("_ny", y, "_y0")}).drop("_x0", "_y0", "_nx", "_ny")


def transform(rows: DataFrame, source: str, target: str, *pairs: tuple[str, str]) -> DataFrame:
    """rows with each pair of columns x, y moved from the system whose key is in column source to that in column target. Equal keys change nothing; an unknown or null key gives nulls."""
    out = rows.withColumns({"_source": parameters(F.col(source)), "_target": parameters(F.col(target))})
    same = F.col(source) == F.col(target)
    for x, y in pairs:
        out = out.withColumns({"_ox": F.col(x), "_oy": F.col(y)})
        out = from_degrees(moved(to_degrees(out, "_source", x, y), x, y), "_target", x, y)
        known = F.col("_source").isNotNull() & F.col("_target").isNotNull()
        out = out.withColumns({x: F.when(same, F.col("_ox")).when(known, F.col(x)), y: F.when(same, F.col("_oy")).when(known, F.col(y))}).drop("_ox", "_oy")
    return out.drop("_source", "_target")


def sources(layers: DataFrame, choices: DataFrame) -> DataFrame:
    """layers with `source`, the key of each one's system, and `manual`, whether it was chosen; an error of the file counts no more then."""
    last = choices.groupBy("layer").agg(F.max_by("key", "ord").alias("chosen"))
    out = layers.join(last, "layer", "left")
    manual = F.coalesce("chosen", "assigned").isNotNull()
    return out.withColumns({"source": F.coalesce("chosen", "assigned", F.when(F.col("prj_error").isNull(), F.col("crs"))), "manual": manual, "prj_error": F.when(~manual, F.col("prj_error"))}).drop("chosen")


def project_system(layers: DataFrame, choices: DataFrame, project: str | None = None) -> str | None:
    """The key of the project's system (one value goes to the driver)."""
    if project is not None:
        return project
    first = choices.agg(F.min_by("key", "ord").alias("key")).first().key
    if first is not None:
        return first
    flat = F.create_map(*[F.lit(v) for s in crs.SYSTEMS.values() for v in (s.key, s.lon0 is not None)])
    rows = sources(layers, choices).select(F.col("source").alias("crs"), F.coalesce(F.try_element_at(flat, F.col("source")), F.lit(False)).alias("projected"), F.when(F.col("kind") == "polyline", "pipe").otherwise(F.col("kind")).alias("kind"), "ord")
    return crs.project_choice(rows).first().crs


def prepared(layers: DataFrame, segments: DataFrame, choices: DataFrame, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The state of each layer, and the segments (layer, x0, y0, x1, y1, any others) in the project's system.

    A state has layer, kind, source, project, status (native, reprojected, unassigned, unreferenced, invalid), ready, records, the working box and
    error. A layer that isn't ready keeps its own coordinates. Errors: no coordinates, an unknown kind or system, an end that can't be transformed
    (its layer's segments are left out).
    """
    key = project_system(layers, choices, project)
    rows = sources(layers, choices).withColumn("project", F.lit(key).cast("string"))
    known = F.col("source").isin(*crs.SYSTEMS)
    status = F.when(F.col("prj_error").isNotNull(), "invalid").when(F.col("source").isNull(), F.when(F.col("project").isNull(), "unreferenced").otherwise("unassigned")).when(F.col("project").isNull() | (F.col("source") == F.col("project")), "native").otherwise("reprojected")
    rows = rows.withColumns({"status": status, "ready": F.coalesce(known & F.col("kind").isin(*KINDS), F.lit(False)) | (F.col("project").isNull())})
    moving = (F.col("status") == "reprojected") & known
    own = segments.join(rows.select("layer", F.when(moving, F.col("source")).alias("_from"), F.when(moving, F.col("project")).alias("_to")), "layer")
    ends = [("x0", "y0"), ("x1", "y1")]
    still = own.where("_from IS NULL")
    # written: the states and the caller both read it, and what follows would repeat the long expressions
    work = cut(still.unionByName(transform(own.where("_from IS NOT NULL"), "_from", "_to", *ends)).drop("_from", "_to"))
    bad = F.lit(False)
    for c in ("x0", "y0", "x1", "y1"):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == math.inf)
    low = lambda *c: F.min(F.least(*c))
    high = lambda *c: F.max(F.greatest(*c))
    boxes = work.groupBy("layer").agg(F.count("*").alias("records"), F.count_if(bad).alias("lost"), low("x0", "x1").alias("xmin"), low("y0", "y1").alias("ymin"), high("x0", "x1").alias("xmax"), high("y0", "y1").alias("ymax"))
    rows = rows.join(boxes, "layer", "left").fillna(0, ["records", "lost"])
    error = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), F.concat(F.lit("unsupported kind: "), F.coalesce("kind", F.lit("none"))))
        .when(F.col("records") == 0, "no coordinates")
        .when(F.col("source").isNotNull() & ~known, F.concat(F.lit("unknown system: "), "source"))
        .when(F.col("lost") > 0, "a coordinate can't be transformed")
    )
    states = rows.withColumn("error", error).withColumn("ready", F.col("ready") & F.col("error").isNull())
    states = states.select("layer", "kind", "source", "project", "status", "ready", "records", "xmin", "ymin", "xmax", "ymax", "error")
    good = states.where("error IS NULL").select("layer")
    return states, work.join(good, "layer", "left_semi")


def active_pipe(states: DataFrame, selected: str | None, active: str | None) -> DataFrame:
    """One row: the pipe layer that an action works on (the selected one if it is of lines, else the active one if it is), and why there is none."""
    place = F.when(F.col("layer").cast("string") == F.lit(selected), 0).when(F.col("layer").cast("string") == F.lit(active), 1)
    lines = states.where(F.col("kind") == "polyline").withColumn("place", place).where("place IS NOT NULL")
    best = lines.agg(F.min_by(F.struct("layer", "ready", "error"), "place").alias("best"))
    error = F.when(F.col("best").isNull(), "no pipe layer").when(F.col("best.error").isNotNull(), F.col("best.error")).when(~F.col("best.ready"), "the layer has no coordinate system")
    return best.select(F.col("best.layer").alias("layer"), error.alias("error"))


def clipped(states: DataFrame, segments: DataFrame, rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pieces of all ready line layers inside polygons (rings in the project's system), with their layer, and a row for each layer: records, pieces and an error where nothing is left. segments: layer, feature_id, part, seg, x0, y0, x1, y1."""
    from catchment.operators import spatial

    ready = states.where("ready AND kind = 'polyline'").select("layer")
    lines = segments.join(ready, "layer", "left_semi").withColumn("grid_id", F.col("layer").cast("string"))
    pieces = spatial.clip_segments(lines, rings).withColumnRenamed("grid_id", "layer")
    counts = pieces.groupBy("layer").agg(F.count("*").alias("pieces"))
    told = states.where("kind = 'polyline'").select(F.col("layer").cast("string").alias("layer"), "records", "ready", "error").join(counts, "layer", "left").fillna(0, ["pieces"])
    error = F.coalesce("error", F.when(~F.col("ready"), "the layer has no coordinate system").when(F.col("pieces") == 0, "no line inside the boundary"))
    return pieces, told.select("layer", "records", "pieces", error.alias("error"))
