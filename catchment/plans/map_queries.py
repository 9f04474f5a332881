"""Queries on the layers of a map, in one plan for all of them, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import crs_job
from catchment.plans import fixtures as fx

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


#: A layer for each customer: degrees near 127 east for most, others already in the project's system or in none.
LAYERS = """SELECT c_custkey AS layer, c_custkey AS ord, CASE WHEN c_custkey % 17 = 0 THEN 'image' WHEN c_custkey % 4 = 0 THEN 'boundary' ELSE 'polyline' END AS kind,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'epsg5186' WHEN c_custkey % 13 = 0 THEN 'epsg1' ELSE 'epsg4326' END AS crs, CASE WHEN c_custkey % 19 = 0 THEN 'bad text' END AS prj_error, CAST(CASE WHEN c_custkey % 23 = 0 THEN 'epsg4326' END AS {text}) AS assigned FROM {customer}"""
#: Choices: the first one made sets the project's system.
CHOICES = "SELECT c_custkey AS layer, CASE WHEN c_custkey % 5 = 0 THEN 'epsg4326' ELSE 'epsg5186' END AS key, CASE WHEN c_custkey % 5 = 0 THEN 1000000000 ELSE 0 END + c_nationkey * 1000000 - c_custkey AS ord FROM {customer} WHERE c_custkey % 35 = 0 OR c_custkey % 77 = 0"
#: Two lines a layer, of numbers that are degrees, or metres in layers of the plane system.
LINES = """SELECT l_layer AS layer, l_layer AS feature_id, 0 AS part, CAST(seg AS INT) AS seg, CASE WHEN plane THEN 200000 + l_layer % 100 * 50 + seg * 10 ELSE 127 + (l_layer % 80 - 40) / 100e0 + seg / 1000e0 END AS x0, CASE WHEN plane THEN 600000 + l_layer % 90 * 40 ELSE 38 + (l_layer % 60 - 30) / 100e0 END AS y0,
  CASE WHEN plane THEN 200000 + l_layer % 100 * 50 + seg * 10 + 10 ELSE 127 + (l_layer % 80 - 40) / 100e0 + (seg + 1) / 1000e0 END AS x1, CASE WHEN plane THEN 600000 + l_layer % 90 * 40 + 25 ELSE 38 + (l_layer % 60 - 30) / 100e0 + 0.001e0 END AS y1
FROM (SELECT c_custkey AS l_layer, seg, c_custkey % 11 = 0 AND c_custkey % 7 > 0 AND c_custkey % 23 > 0 AS plane FROM {customer} CROSS JOIN (VALUES (0), (1)) s(seg) WHERE c_custkey % 29 > 0)"""

#: Transverse Mercator by the series in longitude and eccentricity, to the plane system 5186.
TM = """e AS (SELECT 6378137e0 AS a, (2 - 1 / 298.257222101e0) / 298.257222101e0 AS e2),
k AS (SELECT a, e2, e2 / (1 - e2) AS ep2, 1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256 - 175 * e2 ** 4 / 16384 AS a0, 3e0 / 8 * (e2 + e2 ** 2 / 4 + 15 * e2 ** 3 / 128 - 455 * e2 ** 4 / 4096) AS a2, 15e0 / 256 * (e2 ** 2 + 3 * e2 ** 3 / 4 - 77 * e2 ** 4 / 128) AS a4, 35e0 / 3072 * (e2 ** 3 - 41 * e2 ** 4 / 32) AS a6, -315 * e2 ** 4 / 131072 AS a8 FROM e),
degrees_in AS (SELECT layer, seg, n, x, y FROM (SELECT layer, seg, 0 AS n, x0 AS x, y0 AS y FROM moving UNION ALL SELECT layer, seg, 1, x1, y1 FROM moving)),
t AS (SELECT d.*, k.*, radians(y) AS p, radians(x - 127) * cos(radians(y)) AS l, tan(radians(y)) ** 2 AS tt, ep2 * cos(radians(y)) ** 2 AS c, a / sqrt(1 - e2 * sin(radians(y)) ** 2) AS nn, radians(38e0) AS p0 FROM degrees_in d, k),
m AS (SELECT *, a * (a0 * p - a2 * sin(2 * p) + a4 * sin(4 * p) - a6 * sin(6 * p) + a8 * sin(8 * p)) - a * (a0 * p0 - a2 * sin(2 * p0) + a4 * sin(4 * p0) - a6 * sin(6 * p0) + a8 * sin(8 * p0)) AS arc FROM t),
plane_out AS (SELECT layer, seg, n, 200000 + nn * (l + (1 - tt + c) * l ** 3 / 6 + (5 - 18 * tt + tt ** 2 + 72 * c - 58 * ep2) * l ** 5 / 120) AS x,
  600000 + arc + nn * tan(p) * (l ** 2 / 2 + (5 - tt + 9 * c + 4 * c ** 2) * l ** 4 / 24 + (61 - 58 * tt + tt ** 2 + 600 * c - 330 * ep2) * l ** 6 / 720) AS y FROM m)"""
STATES = f"""layers AS ({LAYERS.format(text='VARCHAR', customer='customer')}), choices AS ({CHOICES.format(customer='customer')}), lines AS ({LINES.format(customer='customer')}),
last AS (SELECT layer, arg_max(key, ord) AS chosen FROM choices GROUP BY 1), project AS (SELECT arg_min(key, ord) AS project FROM choices),
src AS (SELECT layers.layer, kind, coalesce(chosen, assigned) IS NULL AND prj_error IS NOT NULL AS bad, coalesce(chosen, assigned, CASE WHEN prj_error IS NULL THEN crs END) AS source, project FROM layers LEFT JOIN last USING (layer), project),
st AS (SELECT *, CASE WHEN bad THEN 'invalid' WHEN source IS NULL THEN 'unassigned' WHEN source = project THEN 'native' ELSE 'reprojected' END AS status, source IN ('epsg4326', 'epsg5186') AS known FROM src),
moving AS (SELECT lines.* FROM lines JOIN st USING (layer) WHERE status = 'reprojected' AND known), {TM},
work AS (SELECT layer, x, y FROM plane_out UNION ALL SELECT layer, x0, y0 FROM lines WHERE layer NOT IN (SELECT layer FROM moving) UNION ALL SELECT layer, x1, y1 FROM lines WHERE layer NOT IN (SELECT layer FROM moving)),
box AS (SELECT layer, count(*) // 2 AS records, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM work GROUP BY 1),
errors AS (SELECT st.*, coalesce(records, 0) AS records, xmin, ymin, xmax, ymax, CASE WHEN kind = 'image' THEN 'unsupported kind: image' WHEN records IS NULL THEN 'no coordinates' WHEN source IS NOT NULL AND NOT known THEN 'unknown system: ' || source END AS error FROM st LEFT JOIN box USING (layer))"""


def _job(spark, sf_dir):
    customer = fx.read(spark, sf_dir, "customer")
    layers = spark.sql(LAYERS.replace("{text}", "STRING"), customer=customer)
    lines = spark.sql(LINES, customer=customer)
    return crs_job.prepared(layers, lines, spark.sql(CHOICES, customer=customer))


@query(f"WITH {STATES} SELECT layer, kind, source, project, status, coalesce(known, false) AND kind != 'image' AND error IS NULL AS ready, records, round(xmin, 1) AS xmin, round(ymin, 1) AS ymin, round(xmax, 1) AS xmax, round(ymax, 1) AS ymax, error FROM errors")
def crs_states(spark, sf_dir):
    """The state of each layer of a map after the user's choices: its system, the project's (set by the first choice), whether it is ready, its working box, its error."""
    states, _ = _job(spark, sf_dir)
    return states.select(*[F.round(c, 1).alias(c) if c in ("xmin", "ymin", "xmax", "ymax") else c for c in states.columns])


@query(f"WITH {STATES}, o AS (SELECT layer, seg, max(x) FILTER (n = 0) AS x0, max(y) FILTER (n = 0) AS y0, max(x) FILTER (n = 1) AS x1, max(y) FILTER (n = 1) AS y1 FROM plane_out GROUP BY 1, 2) SELECT layer, seg, round(x0, 2) AS x0, round(y0, 2) AS y0, round(x1, 2) AS x1, round(y1, 2) AS y1 FROM o JOIN errors USING (layer) WHERE error IS NULL")
def crs_lines(spark, sf_dir):
    """The lines of all layers that were moved, in the project's plane system, against another series of the projection."""
    states, work = _job(spark, sf_dir)
    moved = work.join(states.where("status = 'reprojected'").select("layer"), "layer", "left_semi")
    return moved.select("layer", "seg", *[F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")])


SQUARE = "SELECT 0 AS feature_id, 0 AS ring, e AS edge, CASE e WHEN 0 THEN 195000e0 WHEN 1 THEN 205000e0 WHEN 2 THEN 205000e0 ELSE 195000e0 END AS x0, CASE e WHEN 0 THEN 595000e0 WHEN 1 THEN 595000e0 WHEN 2 THEN 605000e0 ELSE 605000e0 END AS y0, CASE e WHEN 0 THEN 205000e0 WHEN 1 THEN 205000e0 WHEN 2 THEN 195000e0 ELSE 195000e0 END AS x1, CASE e WHEN 0 THEN 595000e0 WHEN 1 THEN 605000e0 WHEN 2 THEN 605000e0 ELSE 595000e0 END AS y1 FROM (VALUES (0), (1), (2), (3)) t(e)"


@query(f"""WITH {STATES}, o AS (SELECT layer, seg, max(x) FILTER (n = 0) AS x0, max(y) FILTER (n = 0) AS y0, max(x) FILTER (n = 1) AS x1, max(y) FILTER (n = 1) AS y1 FROM plane_out GROUP BY 1, 2 UNION ALL SELECT layer, seg, x0, y0, x1, y1 FROM lines WHERE layer NOT IN (SELECT layer FROM moving)),
seen AS (SELECT layer, count(*) AS pieces FROM o WHERE least(x0, x1) < 205000 AND greatest(x0, x1) > 195000 AND least(y0, y1) < 605000 AND greatest(y0, y1) > 595000 AND greatest((CASE WHEN x1 != x0 THEN least((195000 - x0) / (x1 - x0), (205000 - x0) / (x1 - x0)) ELSE 0 END), (CASE WHEN y1 != y0 THEN least((595000 - y0) / (y1 - y0), (605000 - y0) / (y1 - y0)) ELSE 0 END), 0) < least((CASE WHEN x1 != x0 THEN greatest((195000 - x0) / (x1 - x0), (205000 - x0) / (x1 - x0)) ELSE 1 END), (CASE WHEN y1 != y0 THEN greatest((595000 - y0) / (y1 - y0), (605000 - y0) / (y1 - y0)) ELSE 1 END), 1) GROUP BY 1),
r AS (SELECT *, coalesce(known, false) AND error IS NULL AS ready FROM errors WHERE kind = 'polyline')
SELECT layer::VARCHAR AS layer, records, CASE WHEN ready THEN coalesce(pieces, 0) ELSE 0 END AS pieces, coalesce(error, CASE WHEN NOT ready THEN 'the layer has no coordinate system' WHEN pieces IS NULL THEN 'no line inside the boundary' END) AS error FROM r LEFT JOIN seen USING (layer)""")
def crs_clips(spark, sf_dir):
    """All line layers clipped to a boundary in the project's system; a layer of which nothing is left is a row with an error."""
    states, work = _job(spark, sf_dir)
    return crs_job.clipped(states, work, spark.sql(SQUARE))[1]
