"""Rules on map layers: readiness, compatibility, reference extents. layers: layer, kind, crs, prj_error, assigned, ready, xmin, ymin, xmax, ymax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.functions import geometry
from catchment.operators import crs

#: Layers of a map: what is broadcast, checked first.
MAX_LAYERS = 1000


def status(project: str | None) -> Column:
    """native, reprojected, unassigned, invalid or unreferenced."""
    own = F.coalesce("assigned", "crs")
    return F.when(F.col("prj_error").isNotNull() & F.col("assigned").isNull(), "invalid").when(own.isNull(), "unassigned" if project else "unreferenced").when(F.lit(project).isNull() | (own == project), "native").otherwise("reprojected")


def compatible(pipes: DataFrame, areas: DataFrame) -> DataFrame:
    """pipe, area, verdict: an error for bad, differing or disjoint systems, a warning if one is missing."""
    p = pipes.select(F.col("layer").alias("pipe"), *[F.col(c).alias(f"p_{c}") for c in ("crs", "prj_error", "xmin", "ymin", "xmax", "ymax")])
    a = areas.select(F.col("layer").alias("area"), *[F.col(c).alias(f"a_{c}") for c in ("crs", "prj_error", "xmin", "ymin", "xmax", "ymax")])
    box = lambda s: tuple(F.col(f"{s}_{c}") for c in ("xmin", "ymin", "xmax", "ymax"))
    verdict = (
        F.when(F.col("p_prj_error").isNotNull() | F.col("a_prj_error").isNotNull(), "error: projection can't be read")
        .when(F.col("p_crs") != F.col("a_crs"), "error: systems differ")
        .when(~geometry.boxes_touch(box("p"), box("a")), "error: extents are apart")
        .when(F.col("p_crs").isNull() | F.col("a_crs").isNull(), "warning: a system is missing")
        .otherwise("ok")
    )
    if areas.limit(MAX_LAYERS + 1).count() > MAX_LAYERS:
        raise ValueError(f"a map has {MAX_LAYERS} layers at most")
    return p.join(F.broadcast(a), how="cross").select("pipe", "area", verdict.alias("verdict"))  # every pipe layer against every area layer, MAX_LAYERS at most


def reference_box(layers: DataFrame, without: str | None = None) -> DataFrame:
    """One row: the extent of all ready layers with an area, but for one."""
    good = layers.where("ready AND xmax > xmin AND ymax > ymin")
    if without is not None:
        good = good.where(F.col("layer") != without)
    return good.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def working_copy(segments: DataFrame, source: str, project: str) -> DataFrame:
    """Segments in the project's system; the source stays as it was."""
    return crs.reproject(segments, crs.SYSTEMS[source], crs.SYSTEMS[project])


def point_counts(parts: DataFrame) -> DataFrame:
    """layer, part, points (vertices of a part, an array column) and layer_points (of its whole layer)."""
    counts = parts.select("layer", "part", F.size("points").cast("long").alias("points"))
    whole = counts.groupBy("layer").agg(F.sum("points").alias("layer_points"))
    return counts.join(whole, "layer").select("layer", "part", "points", "layer_points")
