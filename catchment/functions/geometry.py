"""Scalar expressions on points, boxes and segments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def boxes_touch(a, b) -> Column:
    """Whether two boxes (xmin, ymin, xmax, ymax) overlap; touching counts."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_holds(box, x: Column, y: Column, slack: float = 1e-9) -> Column:
    return x.between(box[0] - slack, box[2] + slack) & y.between(box[1] - slack, box[3] + slack)


def box_area(box) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def overlap_share(a, b) -> Column:
    """Overlap over the smaller area, 0 to 1."""
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(width * height, F.least(box_area(a), box_area(b)))), F.lit(0.0))


def centre_closeness(a, b) -> Column:
    """1 less the distance of the centres over twice the diagonal of b, at least 0."""
    distance = F.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
    return F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(distance, 2 * F.hypot(b[2] - b[0], b[3] - b[1])), F.lit(1.0)))


def intersection_over_union(a, b) -> Column:
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return F.coalesce(F.try_divide(width * height, box_area(a) + box_area(b) - width * height), F.lit(0.0))


def on_segment(x, y, x0, y0, x1, y1, tolerance: float = 1e-9) -> Column:
    dx, dy = x1 - x0, y1 - y0
    cross = (x - x0) * dy - (y - y0) * dx
    near = F.abs(cross) <= tolerance * F.greatest(F.abs(dx), F.abs(dy), F.lit(1.0))
    return near & x.between(F.least(x0, x1) - tolerance, F.greatest(x0, x1) + tolerance) & y.between(F.least(y0, y1) - tolerance, F.greatest(y0, y1) + tolerance)


def crosses_ray(x, y, x0, y0, x1, y1) -> Column:
    """Whether the ray from (x, y) to the east crosses the edge."""
    return F.coalesce(((y0 > y) != (y1 > y)) & (x < x0 + (x1 - x0) * F.try_divide(y - y0, y1 - y0)), F.lit(False))


def segment_parameter(x0, y0, x1, y1, x2, y2, x3, y3) -> Column:
    """Place 0..1 on segment 0-1 where edge 2-3 meets it; null if they are parallel or apart."""
    rx, ry, sx, sy = x1 - x0, y1 - y0, x3 - x2, y3 - y2
    den = rx * sy - ry * sx
    t = F.try_divide((x2 - x0) * sy - (y2 - y0) * sx, den)
    u = F.try_divide((x2 - x0) * ry - (y2 - y0) * rx, den)
    return F.when((F.abs(den) > 1e-12) & t.between(-1e-10, 1 + 1e-10) & u.between(-1e-10, 1 + 1e-10), F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))


def rotated(x: Column, y: Column, cx: Column, cy: Column, degrees: float) -> tuple[Column, Column]:
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return cx + (x - cx) * cos - (y - cy) * sin, cy + (x - cx) * sin + (y - cy) * cos


def metres_per_degree(latitude: Column) -> tuple[Column, Column]:
    """Of longitude and of latitude: the usual series in the latitude (fixed values)."""
    a = F.radians(latitude)
    return 111412.84 * F.cos(a) - 93.5 * F.cos(3 * a), 111132.92 - 559.82 * F.cos(2 * a) + 1.175 * F.cos(4 * a)


def length_in_metres(x0, y0, x1, y1, unit: Column, factor: Column) -> Column:
    """Length by unit: meter, linear (times factor), degree; otherwise the raw length."""
    lon, lat = metres_per_degree((y0 + y1) / 2)
    raw = F.hypot(x1 - x0, y1 - y0)
    return F.when(unit == "meter", raw).when((unit == "linear") & factor.isNotNull(), raw * factor).when(unit == "degree", F.hypot((x1 - x0) * lon, (y1 - y0) * lat)).otherwise(raw)


def metric(unit: Column, factor: Column) -> Column:
    return unit.isin("meter", "degree") | ((unit == "linear") & factor.isNotNull())


def grid_cols(rows: int, width: Column, height: Column) -> Column:
    """Columns from the aspect ratio (0.05 to 20), half to even, at least 2."""
    aspect = F.least(F.lit(20.0), F.greatest(F.lit(0.05), F.try_divide(width, height)))
    return F.when(height <= 1e-9, rows).when(width <= 1e-9, 2).otherwise(F.greatest(F.lit(2), F.rint(rows * aspect).cast("int")))


def cell_of(x, y, rows, cols, box) -> tuple[Column, Column]:
    """Row and column of a point, clipped to the grid; rows count downwards."""
    rows, cols = (F.lit(v) if isinstance(v, int) else v for v in (rows, cols))
    w = F.greatest((box[2] - box[0]) / F.greatest(cols.cast("double"), F.lit(1.0)), F.lit(1e-12))
    h = F.greatest((box[3] - box[1]) / F.greatest(rows.cast("double"), F.lit(1.0)), F.lit(1e-12))
    row = F.floor((box[3] - y) / h).cast("int")
    col = F.floor((x - box[0]) / w).cast("int")
    return F.least(rows - 1, F.greatest(F.lit(0), row)), F.least(cols - 1, F.greatest(F.lit(0), col))
