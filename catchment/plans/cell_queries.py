"""Queries on ink in cells, steps along an axis, grid shapes, extents and workbooks' basins, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.functions import directions, geometry
from catchment.operators import imaging, layers
from catchment.plans import fixtures as fx
from catchment.sources import workbook, writers

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


VECTORS = "SELECT o_orderkey AS k, CAST(o_custkey % 41 - 20 AS DOUBLE) AS dx, CAST(o_orderkey % 37 - 18 AS DOUBLE) AS dy FROM {orders}"


@query(f"SELECT k, CASE WHEN dx = 0 AND dy = 0 THEN 0 WHEN abs(dx) >= abs(dy) AND dx > 0 THEN 1 WHEN abs(dx) >= abs(dy) THEN 3 WHEN dy > 0 THEN 2 ELSE 4 END AS code, greatest(abs(dx), abs(dy)) >= 1.8 * greatest(least(abs(dx), abs(dy)), 1e-6) AS clear FROM ({VECTORS.format(orders='orders')})")
def vector_codes(spark, sf_dir):
    """The code of each vector, and whether one axis clearly dominates it."""
    v = spark.sql(VECTORS, orders=fx.read(spark, sf_dir, "orders"))
    return v.select("k", directions.dominant_code(F.col("dy"), F.col("dx")).alias("code"), directions.axis_dominant(F.col("dx"), F.col("dy")).alias("clear"))


@query("SELECT k, CAST(CASE WHEN h <= 1e-9 THEN 40 WHEN w <= 1e-9 THEN 2 ELSE greatest(2, round_even(40 * least(20.0, greatest(0.05, w / h)), 0)) END AS INT) AS cols FROM (SELECT c_custkey AS k, CAST(c_custkey % 83 AS DOUBLE) AS w, CAST(c_custkey % 29 AS DOUBLE) / 4 AS h FROM customer)")
def grid_columns(spark, sf_dir):
    """Columns of a grid of 40 rows over boxes of all shapes, empty ones too."""
    k = F.col("c_custkey")
    return fx.read(spark, sf_dir, "customer").select(k.alias("k"), geometry.grid_cols(40, (k % 83).cast("double"), (k % 29).cast("double") / 4).alias("cols"))


INK = "SELECT DISTINCT l_returnflag AS image_id, CAST(l_orderkey * 5 % 333 AS INT) AS x, CAST(l_partkey % 217 AS INT) AS y, 217 AS height, 333 AS width, (l_orderkey + l_partkey) % 3 > 0 AS line FROM {lineitem}"
_AT = "CAST(floor(y * 20 / height) AS INT) AS r, CAST(floor(x * 30 / width) AS INT) AS c"


def _ink(spark, sf_dir):
    return spark.sql(INK, lineitem=fx.read(spark, sf_dir, "lineitem"))


@query(f"WITH i AS ({INK.format(lineitem='lineitem')}), m AS (SELECT image_id, {_AT}, count(*) AS n, count(*) / any_value(height * width / 600) AS share FROM i GROUP BY ALL) SELECT image_id, r, c, n, round(share, 9) AS share, share >= 0.3 OR (n >= 30 AND share >= 0.15) AS occupied FROM m")
def ink_shares(spark, sf_dir):
    """Ink in each cell, and which cells count as occupied."""
    means = imaging.cell_means(_ink(spark, sf_dir), 20, 30)
    occupied = imaging.occupied(means, 0.3, 30).withColumn("occupied", F.lit(True))
    return means.join(occupied, ["image_id", "r", "c"], "left").select("image_id", "r", "c", "n", F.round("share", 9).alias("share"), F.coalesce("occupied", F.lit(False)).alias("occupied"))


@query(f"WITH i AS (SELECT *, x // 25 + y // 35 AS component FROM ({INK.format(lineitem='lineitem')})), n AS (SELECT image_id, {_AT}, component, count(*) AS n FROM i GROUP BY ALL HAVING count(*) >= 2) SELECT image_id, r, c, CAST(component AS INT) AS component FROM n QUALIFY row_number() OVER (PARTITION BY image_id, r, c ORDER BY n DESC, component) = 1")
def ink_components(spark, sf_dir):
    """The component with most ink in each cell."""
    ink = _ink(spark, sf_dir)
    labels = ink.select("image_id", "y", "x", (F.floor(F.col("x") / 25) + F.floor(F.col("y") / 35)).cast("int").alias("component")).distinct()
    return imaging.component_cells(ink, labels, 20, 30)


@query(f"""WITH i AS ({INK.format(lineitem='lineitem')}), p AS (SELECT image_id, x, y, {_AT} FROM i WHERE line), near AS (SELECT image_id, r + a AS r, c + b AS c, x, y FROM p, range(-1, 2) s(a), range(-1, 2) t(b)),
g AS (SELECT image_id, r, c, count(*) AS n, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS d FROM near GROUP BY ALL HAVING count(*) >= 5), q AS (SELECT *, 0.5 * atan2(2 * b, a - d) AS angle, CASE WHEN a + d > 0 THEN sqrt((a - d) * (a - d) + 4 * b * b) / (a + d) ELSE 0 END AS conf FROM g WHERE r BETWEEN 0 AND 19 AND c BETWEEN 0 AND 29)
SELECT image_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CASE WHEN conf > 0.03 THEN round(cos(angle), 5) + 0.0 END AS axis_x, CASE WHEN conf > 0.03 THEN round(sin(angle), 5) + 0.0 END AS axis_y, CASE WHEN conf > 0.03 THEN round(conf, 6) ELSE 0 END AS conf FROM q""")
def ink_axes(spark, sf_dir):
    """The principal axis of the thinned pixels around each cell, where there is one."""
    out = imaging.axis_field(_ink(spark, sf_dir), 20, 30)
    axis = lambda c: F.when(F.col("conf") > 0, F.round(c, 5) + 0.0).alias(c)
    return out.select("image_id", "r", "c", axis("axis_x"), axis("axis_y"), F.round("conf", 6).alias("conf"))


EXTENTS = "SELECT c_custkey AS layer, c_custkey % 3 > 0 AS ready, CAST(c_custkey % 91 AS DOUBLE) AS xmin, CAST(c_custkey % 53 AS DOUBLE) AS ymin, CAST(c_custkey % 91 + c_custkey % 7 AS DOUBLE) AS xmax, CAST(c_custkey % 53 + c_custkey % 5 AS DOUBLE) AS ymax FROM {customer}"


@query(f"SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM ({EXTENTS.format(customer='customer')}) WHERE ready AND xmax > xmin AND ymax > ymin AND layer != 91")
def reference_extent(spark, sf_dir):
    """The extent of all ready layers with an area, but for one."""
    return layers.reference_box(spark.sql(EXTENTS, customer=fx.read(spark, sf_dir, "customer")), "91")


@query(f"""WITH RECURSIVE {fx.cells_cte()}, walk AS (SELECT grid_id, r AS sr, c AS sc, r, c, nr, nc FROM cells UNION ALL SELECT w.grid_id, sr, sc, a.r, a.c, a.nr, a.nc FROM walk w JOIN cells a ON a.grid_id = w.grid_id AND a.r = w.nr AND a.c = w.nc),
done AS (SELECT w.grid_id, sr, sc, w.r, w.c FROM walk w ANTI JOIN cells a ON a.grid_id = w.grid_id AND a.r = w.nr AND a.c = w.nc),
s AS (SELECT grid_id, count(*) FILTER (sr = r AND sc = c) AS sinks, min(r * 1000 + c) AS first FROM done GROUP BY 1), k AS (SELECT d.grid_id, count(*) AS connected FROM done d JOIN s ON s.grid_id = d.grid_id AND d.r * 1000 + d.c = first GROUP BY 1),
z AS (SELECT grid_id, CAST(max(r) - min(r) + 1 AS INT) AS rows, CAST(max(c) - min(c) + 1 AS INT) AS cols, count(*) AS cells FROM cells GROUP BY 1)
SELECT z.grid_id || '.xlsx' AS path, rows, cols, cells, sinks, connected, cells - connected AS disconnected, CASE WHEN sinks = 1 THEN 'ok' ELSE 'error: ' || sinks || ' sinks' END AS status FROM z JOIN s USING (grid_id) JOIN k USING (grid_id)""")
def workbook_basins(spark, sf_dir):
    """Extent, sinks and connected cells of each workbook's grid."""
    cells = fx.cells(spark, sf_dir).withColumn("path", F.concat("grid_id", F.lit(".xlsx")))
    return workbook.basins(workbook.read_cells(writers.workbooks(cells)))
