"""Coordinate systems: transverse Mercator in column expressions, box transforms, recommendation.

Systems are parameters of a projection on an ellipsoid; those on the older datum are moved to the newer
one by a seven-parameter shift through geocentric coordinates (public EPSG parameters).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.functions import geometry

GRS80, BESSEL = (6378137.0, 298.257222101), (6377397.155, 299.1528128)

#: Older datum to the newer one: metres, seconds of arc, parts per million (fixed values, EPSG 1987 / 5174 family).
SHIFT = (-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43)


@dataclass(frozen=True)
class System:
    key: str
    ellipsoid: tuple[float, float]
    lon0: float | None = None  # None: geographic
    lat0: float = 38.0
    scale: float = 1.0
    east: float = 200_000.0
    north: float = 500_000.0
    shifted: bool = False


#: Fixed values of the seven standard systems.
SYSTEMS = {
    s.key: s
    for s in (
        System("epsg5179", GRS80, 127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0),
        System("epsg5174", BESSEL, 127.0 + 10.405 / 3600, 38.0, 1.0, 200_000.0, 500_000.0, True),
        System("epsg2097", BESSEL, 127.0, 38.0, 1.0, 200_000.0, 500_000.0, True),
        System("epsg5178", BESSEL, 127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0, True),
        System("epsg5181", GRS80, 127.0, 38.0, 1.0, 200_000.0, 500_000.0),
        System("epsg5186", GRS80, 127.0, 38.0, 1.0, 200_000.0, 600_000.0),
        System("epsg4326", GRS80),
    )
}


def _series(ellipsoid):
    a, inverse = ellipsoid
    f = 1 / inverse
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    e = math.sqrt(f * (2 - f))
    return radius, alpha, beta, e


def _meridian(system: System) -> float:
    """Northing of the origin's parallel."""
    radius, alpha, _, e = _series(system.ellipsoid)
    lat = math.radians(system.lat0)
    t = math.sinh(math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat)))
    xi = math.atan(t)
    return radius * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(alpha)))


def project(points: DataFrame, system: System, x: str = "x", y: str = "y") -> DataFrame:
    """Columns x, y from degrees to easting and northing (series in the third flattening, to the fourth order).

    Each step is a column of its own, so that no long expression is repeated inside another.
    """
    if system.lon0 is None:
        return points
    radius, alpha, _, e = _series(system.ellipsoid)
    sin = F.sin(F.radians(y))
    out = points.withColumns({"_t": F.sinh(F.atanh(sin) - e * F.atanh(e * sin)), "_l": F.radians(F.col(x) - system.lon0)})
    out = out.withColumns({"_xi": F.atan2("_t", F.cos("_l")), "_eta": F.asinh(F.sin("_l") / F.sqrt(F.col("_t") ** 2 + F.cos("_l") ** 2))})
    xi, eta = F.col("_xi"), F.col("_eta")
    east, north = eta, xi
    for j, a in enumerate(alpha):
        k = 2 * (j + 1)
        east, north = east + a * F.cos(k * xi) * F.sinh(k * eta), north + a * F.sin(k * xi) * F.cosh(k * eta)
    out = out.withColumns({x: system.east + system.scale * radius * east, y: system.north + system.scale * (radius * north - _meridian(system))})
    return out.drop("_t", "_l", "_xi", "_eta")


def unproject(points: DataFrame, system: System, x: str = "x", y: str = "y") -> DataFrame:
    """Columns x, y from easting and northing to degrees."""
    if system.lon0 is None:
        return points
    radius, _, beta, e = _series(system.ellipsoid)
    out = points.withColumns({"_xi": ((F.col(y) - system.north) / system.scale + _meridian(system)) / radius, "_eta": (F.col(x) - system.east) / (system.scale * radius)})
    xi, eta = F.col("_xi"), F.col("_eta")
    u, v = xi, eta
    for j, b in enumerate(beta):
        k = 2 * (j + 1)
        u, v = u - b * F.sin(k * xi) * F.cosh(k * eta), v - b * F.cos(k * xi) * F.sinh(k * eta)
    out = out.withColumns({"_u": u, "_v": v})
    out = out.withColumns({"_q": F.asinh(F.sin("_u") / F.sqrt(F.sinh("_v") ** 2 + F.cos("_u") ** 2)), x: system.lon0 + F.degrees(F.atan2(F.sinh("_v"), F.cos("_u")))})
    lat = F.atan(F.sinh("_q"))
    for _ in range(4):  # each use of the latitude before is one, so the expression grows by a constant
        lat = F.asin(F.tanh(F.col("_q") + e * F.atanh(e * F.sin(lat))))
    return out.withColumn(y, F.degrees(lat)).drop("_xi", "_eta", "_u", "_v", "_q")


def shift(points: DataFrame, forward: bool, x: str = "x", y: str = "y") -> DataFrame:
    """Degrees on the older datum to the newer (forward) or back, by a position-vector shift."""
    sign = 1 if forward else -1
    (a, inverse), (to, to_inverse) = (BESSEL, GRS80) if forward else (GRS80, BESSEL)
    e2, to_e2 = (2 - 1 / inverse) / inverse, (2 - 1 / to_inverse) / to_inverse
    dx, dy, dz = (sign * v for v in SHIFT[:3])
    rx, ry, rz = (sign * math.radians(v / 3600) for v in SHIFT[3:6])
    m = 1 + sign * SHIFT[6] * 1e-6
    out = points.withColumns({"_p": F.radians(y), "_l": F.radians(x)}).withColumn("_n", a / F.sqrt(1 - e2 * F.sin("_p") ** 2))
    out = out.withColumns({"_x": F.col("_n") * F.cos("_p") * F.cos("_l"), "_y": F.col("_n") * F.cos("_p") * F.sin("_l"), "_z": F.col("_n") * (1 - e2) * F.sin("_p")})
    px, py, pz = F.col("_x"), F.col("_y"), F.col("_z")
    out = out.withColumns({"_x": dx + m * (px - rz * py + ry * pz), "_y": dy + m * (rz * px + py - rx * pz), "_z": dz + m * (-ry * px + rx * py + pz)})
    out = out.withColumn("_h", F.hypot("_x", "_y")).withColumn("_p", F.atan2("_z", F.col("_h") * (1 - to_e2)))
    for _ in range(5):
        out = out.withColumn("_p", F.atan2(F.col("_z") + to_e2 * to / F.sqrt(1 - to_e2 * F.sin("_p") ** 2) * F.sin("_p"), F.col("_h")))
    return out.withColumns({x: F.degrees(F.atan2("_y", "_x")), y: F.degrees("_p")}).drop("_p", "_l", "_n", "_x", "_y", "_z", "_h")


def transform(points: DataFrame, source: System, target: System, x: str = "x", y: str = "y") -> DataFrame:
    """Columns x, y (in this order in every system) from one system to another; equal systems change nothing."""
    if source == target:
        return points
    out = unproject(points, source, x, y)
    if source.shifted != target.shifted:
        out = shift(out, source.shifted, x, y)
    return project(out, target, x, y)


def reproject(segments: DataFrame, source: System, target: System) -> DataFrame:
    """Segments with both ends transformed; an end that can't be is an error."""
    out = transform(transform(segments, source, target, "x0", "y0"), source, target, "x1", "y1")
    bad = F.isnan("x0") | F.isnan("y0") | F.isnan("x1") | F.isnan("y1")
    return out.withColumn("x0", F.when(bad, F.raise_error(F.lit("a coordinate can't be transformed")).cast("double")).otherwise(F.col("x0")))


def transform_box(boxes: DataFrame, key: str, source: System, target: System) -> DataFrame:
    """key, xmin, ymin, xmax, ymax of boxes as the boxes of their nine transformed corner, side and middle points."""
    across = F.explode(F.array("xmin", (F.col("xmin") + F.col("xmax")) / 2, "xmax"))
    up = F.explode(F.array("ymin", (F.col("ymin") + F.col("ymax")) / 2, "ymax"))
    points = transform(boxes.withColumn("x", across).withColumn("y", up).select(key, "x", "y"), source, target)
    return points.groupBy(key).agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def signature_scores() -> Column:
    """Array of (key, score) by the ranges in which a box's numbers lie (fixed values)."""
    x0, y0, x1, y1 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    degrees = x0.between(-180, 180) & x1.between(-180, 180) & y0.between(-90, 90) & y1.between(-90, 90)
    unified = (x0 >= 500_000) & (x0 <= x1) & (x1 <= 1_500_000) & (y0 >= 1_000_000) & (y0 <= y1) & (y1 <= 3_000_000)
    middle = (x0 >= 50_000) & (x0 <= x1) & (x1 <= 500_000) & (y0 >= 200_000) & (y0 <= y1) & (y1 <= 800_000)
    rules = [(degrees, "epsg4326", 0.80), (unified, "epsg5179", 0.58), (unified, "epsg5178", 0.52), (middle, "epsg5174", 0.42), (middle, "epsg2097", 0.38), (middle, "epsg5181", 0.34), (middle, "epsg5186", 0.30)]
    return F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.when(test, s).otherwise(0.0).alias("score")) for test, k, s in rules]), lambda r: r["score"] > 0)


#: Order of candidates with equal scores, and the systems that a year in a layer's name speaks for (fixed values).
PRIORITY = {"project": 0, "epsg5179": 1, "epsg5174": 2, "epsg2097": 3, "epsg5178": 4}
NEWER, OLDER = ("epsg5179", "epsg5181", "epsg5186"), ("epsg5178", "epsg5174", "epsg2097")


def recommend(layers: DataFrame, project: System | None = None, project_box: tuple[float, ...] | None = None) -> DataFrame:
    """layer, key, score, confidence, alternatives of each layer (layer, name, xmin, ymin, xmax, ymax); null key: none.

    A system found beside a file (column detected, if there is one) is confirmed, one that was assigned before (column assigned) comes
    next. Otherwise scores come from number ranges, from overlap and closeness with the project's box after a trial transform,
    and from the year in the name. Under 0.25 there is no recommendation.
    """
    valid = (F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax")) & ((F.col("xmin") < F.col("xmax")) | (F.col("ymin") < F.col("ymax")))
    scored = layers.where(valid).select("layer", "name", F.explode(signature_scores()).alias("s")).select("layer", "name", "s.key", "s.score")
    if project is not None:
        box = tuple(F.lit(float(v)) for v in project_box)
        for name, s in [("project", project), *((s.key, s) for s in SYSTEMS.values())]:
            trial = layers.where(valid) if name == "project" else transform_box(layers.where(valid), "layer", s, project).join(layers.select("layer", "name"), "layer")
            own = tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
            score = F.coalesce(0.72 * geometry.overlap_share(own, box) + 0.18 * geometry.centre_closeness(own, box), F.lit(0.0))
            scored = scored.unionByName(trial.select("layer", "name", F.lit(name).alias("key"), F.when(F.isnan(score), 0.0).otherwise(score).alias("score")))
    best = scored.groupBy("layer", "name", "key").agg(F.max("score").alias("score"))
    year = F.regexp_extract("name", r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int")
    bonus = F.when((year >= 2002) & F.col("key").isin(*NEWER), 0.04).when((year < 2002) & F.col("key").isin(*OLDER), 0.04).otherwise(0.0)
    best = best.withColumn("score", F.least(F.lit(1.0), F.col("score") + bonus))
    first = F.create_map(*[F.lit(v) for pair in PRIORITY.items() for v in pair])
    order = Window.partitionBy("layer").orderBy(F.desc("score"), F.coalesce(F.try_element_at(first, F.col("key")), F.lit(20)), "key")
    ranked = best.withColumn("place", F.row_number().over(order))
    top = ranked.groupBy("layer").agg(F.min_by("key", "place").alias("key"), F.max("score").alias("score"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"), F.array_sort(F.collect_list(F.when(F.col("place").between(2, 4), F.struct("place", "key", "score")))).alias("next"))
    good = F.col("score") >= 0.25
    margin = F.col("score") - F.coalesce("second", F.lit(0.0))
    out = top.select("layer", F.when(good, F.col("key")).alias("key"), F.when(good, F.col("score")).alias("score"), F.when(good, F.when((F.col("score") >= 0.62) & (margin >= 0.05), "medium").otherwise("low")).alias("confidence"), F.when(good, F.array_join(F.transform(F.filter("next", lambda n: F.col("score") - n["score"] < 0.12), lambda n: n["key"]), ",")).alias("alternatives"))
    known = {c: F.col(c) if c in layers.columns else F.lit(None).cast("string") for c in ("detected", "assigned")}
    out = layers.select("layer", *[c.alias(k) for k, c in known.items()]).join(out, "layer", "left")
    sure = lambda detected, assigned, other: F.when(F.col("detected").isNotNull(), detected).when(F.col("assigned").isNotNull(), assigned).otherwise(other)
    return out.select("layer", sure("detected", "assigned", F.col("key")).alias("key"), sure(1.0, 0.98, F.col("score")).alias("score"), sure("confirmed", "high", F.col("confidence")).alias("confidence"), sure("", "", F.col("alternatives")).alias("alternatives"))


def project_choice(layers: DataFrame) -> DataFrame:
    """One row: the system of the first projected pipe layer, else of any projected, any pipe, any layer (crs, projected, kind, ord)."""
    rank = F.when(F.col("projected") & (F.col("kind") == "pipe"), 0).when(F.col("projected"), 1).when(F.col("kind") == "pipe", 2).otherwise(3)
    return layers.where("crs IS NOT NULL").agg(F.min_by("crs", F.struct(rank, "ord")).alias("crs"))


def unit_of(prj: Column) -> Column:
    """Struct(name, factor, kind) of the last UNIT in a projection's text: meter, linear, degree or unknown."""
    names = F.regexp_extract_all(prj, F.lit(r'(?i)UNIT\s*\[\s*"([^"]*)"\s*,\s*([-+0-9.eE]+)'), F.lit(1))
    factors = F.regexp_extract_all(prj, F.lit(r'(?i)UNIT\s*\[\s*"([^"]*)"\s*,\s*([-+0-9.eE]+)'), F.lit(2))
    name, factor = F.lower(F.try_element_at(names, F.lit(-1))), F.try_element_at(factors, F.lit(-1)).try_cast("double")
    kind = F.when(name.contains("degree"), "degree").when(name.rlike("met(er|re)") & (F.abs(factor - 1) < 1e-9), "meter").when(factor.isNotNull(), "linear").otherwise("unknown")
    return F.struct(name.alias("name"), factor.alias("factor"), kind.alias("kind"))


def parsed(text: Column) -> Column:
    """Struct(code, name, geographic, projected, unit) of a system's text: an authority code (EPSG:5179, as such or in a projection's text), a name, its kind and its unit.

    A text that is neither a code of a known system nor a projection's text has a null name.
    """
    t = F.trim(text)
    known = F.create_map(*[F.lit(v) for key, s in SYSTEMS.items() for v in (key[4:], key)])
    bare = F.regexp_extract(t, r"(?i)^epsg\s*:\s*(\d+)$", 1)
    named = F.regexp_extract_all(t, F.lit(r'(?i)(?:AUTHORITY|ID)\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]\s*\]\s*$'), F.lit(1))
    code = F.when(bare != "", bare).otherwise(F.try_element_at(named, F.lit(-1)))
    name = F.regexp_extract(t, r'(?i)^(?:PROJCS|GEOGCS|PROJCRS|GEOGCRS|GEODCRS)\s*\[\s*"([^"]*)"', 1)
    geographic = t.rlike(r"(?i)^(GEOGCS|GEOGCRS|GEODCRS)") | (F.coalesce(code, F.lit("")) == "4326")
    projected = t.rlike(r"(?i)^(PROJCS|PROJCRS)") | ((bare != "") & F.try_element_at(known, bare).isNotNull() & (bare != "4326"))
    unit = F.when(geographic, "degree").when(bare != "", "meter").otherwise(unit_of(t)["kind"])
    good = (name != "") | F.try_element_at(known, bare).isNotNull()
    return F.struct(F.when(code != "", code).alias("code"), F.when(good, F.when(name != "", name).otherwise(F.concat(F.lit("EPSG:"), bare))).alias("name"), geographic.alias("geographic"), projected.alias("projected"), unit.alias("unit"))


def same_system(first: Column, second: Column) -> Column:
    """Whether two texts name one system: equal authority codes, else equal projection texts but for names, authorities, axes, case and white space."""
    a, b = parsed(first)["code"], parsed(second)["code"]

    def bare(t: Column) -> Column:
        out = F.regexp_replace(F.lower(t), r'(?:,\s*)?(?:authority|id|axis)\s*\[[^\[\]]*\]', "")
        out = F.regexp_replace(out, r'(projcs|geogcs|projcrs|geogcrs|datum|spheroid|primem|unit)\s*\[\s*"[^"]*"', "$1[")
        return F.regexp_replace(out, r"\s+", "")

    return F.coalesce(a == b, F.lit(False)) | (bare(first) == bare(second))


def project_recommendation(pipe: Column, pipe_projected: Column, current: Column, current_projected: Column) -> Column:
    """Struct(key, confidence, score) for a project: the pipes' projected system, the current projected one, then either as it is, else a general one (fixed values)."""
    pick = lambda key, confidence, score: F.struct(F.lit(key).alias("key"), F.lit(confidence).alias("confidence"), F.lit(score).alias("score"))
    some = lambda c, flag: c.isNotNull() & F.coalesce(flag, F.lit(False))
    return (
        F.when(some(pipe, pipe_projected), pick("pipe", "high", 1.0))
        .when(some(current, current_projected), pick("current", "high", 0.96))
        .when(current.isNotNull(), pick("current", "medium", 0.70))
        .when(pipe.isNotNull(), pick("pipe", "medium", 0.68))
        .otherwise(pick("epsg5179", "low", 0.35))
    )
