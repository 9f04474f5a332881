"""Queries on reports and whole-workspace verbs, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import reports
from catchment.operators.graph import cut
from catchment.plans import fixtures as fx
from catchment.plans.grid_queries import _full, _outlets

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


LIMITS = "l AS (SELECT user_id, min(value) AS a, max(value) AS b FROM events GROUP BY 1), x AS (SELECT user_id, CASE WHEN a = b THEN a - greatest(abs(a) * 0.1, 1.0) ELSE a - (b - a) * 0.06 END AS low, CASE WHEN a = b THEN b + greatest(abs(b) * 0.1, 1.0) ELSE b + (b - a) * 0.06 END AS high FROM l)"


@query(f"WITH {LIMITS} SELECT user_id, round(low, 6) AS low, round(high, 6) AS high FROM x")
def plot_limits(spark, sf_dir):
    """Axis limits of each user's values."""
    out = reports.axis_limits(fx.read(spark, sf_dir, "events"), "user_id", "value")
    return out.select("user_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH {LIMITS}, p AS (SELECT *, pow(10.0, floor(log10((high - low) / 6))) AS p, (high - low) / 6 AS raw FROM x), s AS (SELECT *, CASE WHEN raw <= p THEN p WHEN raw <= 2 * p THEN 2 * p WHEN raw <= 5 * p THEN 5 * p ELSE 10 * p END AS step FROM p)
SELECT user_id, CAST(k - CAST(ceil(low / step) AS BIGINT) AS INT) AS place, round(k * step, 6) + 0.0 AS tick FROM (SELECT *, unnest(range(CAST(ceil(low / step) AS BIGINT), CAST(floor(high / step + 1e-9) AS BIGINT) + 1)) AS k FROM s)""")
def plot_ticks(spark, sf_dir):
    """Round places on each user's axis."""
    out = reports.axis_limits(fx.read(spark, sf_dir, "events"), "user_id", "value")
    out = out.select("user_id", F.posexplode(reports.ticks(F.col("low"), F.col("high"))).alias("place", "tick"))
    return out.select("user_id", "place", (F.round("tick", 6) + 0.0).alias("tick"))


@query("""SELECT c_custkey AS grid_id, CASE c_custkey % 4 WHEN 3 THEN printf('%.3f x %.3f units, %d x %d', w, h, c_custkey % 90 + 2, c_custkey % 70 + 2) ELSE concat(CASE WHEN w >= 1000 THEN printf('%.3f km', w / 1000) WHEN w >= 1 THEN printf('%.2f m', w) WHEN w >= 0.01 THEN printf('%.1f cm', w * 100) ELSE printf('%.2f mm', w * 1000) END, ' x ',
  CASE WHEN h >= 1000 THEN printf('%.3f km', h / 1000) WHEN h >= 1 THEN printf('%.2f m', h) WHEN h >= 0.01 THEN printf('%.1f cm', h * 100) ELSE printf('%.2f mm', h * 1000) END, printf(', %d x %d', c_custkey % 90 + 2, c_custkey % 70 + 2), CASE WHEN c_custkey % 4 = 2 THEN ' (approximate)' ELSE '' END) END AS label
FROM (SELECT c_custkey, c_custkey % 7 * 375.5 + 0.06171 AS w, c_custkey % 11 * 0.12537 + 0.00383 AS h FROM customer)""")
def cell_size_labels(spark, sf_dir):
    k = F.col("c_custkey")
    unit = F.element_at(F.array(*map(F.lit, ("meter", "linear", "degree", "unknown"))), (k % 4 + 1).cast("int"))
    text = reports.cell_size_text(k % 7 * 375.5 + 0.06171, k % 11 * 0.12537 + 0.00383, (k % 90 + 2).cast("int"), (k % 70 + 2).cast("int"), unit)
    return fx.read(spark, sf_dir, "customer").select(k.alias("grid_id"), text.alias("label"))


@query("SELECT n_nationkey AS layer, CASE WHEN n_nationkey % 5 = 0 THEN 'error in file' WHEN n_nationkey % 3 = 0 THEN 'to be chosen' WHEN n_nationkey % 2 = 0 THEN concat('EPSG:', n_nationkey, ' -> EPSG:5179') ELSE concat('EPSG:', n_nationkey) END AS label FROM nation")
def layer_labels(spark, sf_dir):
    k = F.col("n_nationkey")
    status = F.when(k % 5 == 0, "invalid").when(k % 2 == 0, "reprojected").otherwise("native")
    source = F.when(k % 3 != 0, F.concat(F.lit("EPSG:"), k.cast("string")))
    return fx.read(spark, sf_dir, "nation").select(k.alias("layer"), reports.layer_text(status, source, F.lit("EPSG:5179")).alias("label"))


@query("""WITH g AS (SELECT c_custkey, c_custkey % 60 + 1 AS rows, c_custkey % 80 + 1 AS cols, c_custkey % 37 AS wanted FROM customer), t AS (SELECT *, least(cols, greatest(2, CAST(round_even(wanted * cols / rows, 0) AS INT))) AS tc FROM g)
SELECT c_custkey AS grid_id, CAST(CASE WHEN good THEN wanted ELSE -1 END AS INT) AS rows, CAST(CASE WHEN good THEN tc ELSE -1 END AS INT) AS cols FROM (SELECT *, wanted >= 2 AND tc >= 2 AND wanted <= rows AND NOT (wanted = rows AND tc = cols) AS good FROM t)""")
def coarse_shapes(spark, sf_dir):
    """The shape of a coarser grid (-1: none)."""
    k = F.col("c_custkey")
    shape = reports.coarse_shape((k % 60 + 1).cast("int"), (k % 80 + 1).cast("int"), (k % 37).cast("int"))
    return fx.read(spark, sf_dir, "customer").select(k.alias("grid_id"), shape.alias("s")).select("grid_id", "s.rows", "s.cols").fillna(-1)


@query()
def assisted_workspace(spark, sf_dir):
    """A filled workspace repaired and filled again (sequential plans, so no SQL)."""
    cells = cut(fx.cells(spark, sf_dir, 4, keep="r % 3 = 0 OR c % 5 = 0"))
    filled = cells.where("r % 3 <> 0 AND c % 10 = 0")
    stops = _outlets(cells).withColumn("label", F.col("r") * 100 + F.col("c"))
    return reports.assist(cells, filled, _full(cells).where("r BETWEEN 2 AND 37 AND c BETWEEN 2 AND 47"), stops)


@query("SELECT vec_id AS sample_id, CAST(label % 5 AS INT) AS label, CASE WHEN vec_id % 6 = 0 THEN -vec_id - 1 ELSE vec_id % 12 END AS group_id, 64 AS size FROM embeddings")
def training_snapshot(spark, sf_dir):
    """A training set whose every row was checked."""
    s = fx.samples(spark, sf_dir).withColumns({"version": F.lit(5), "patch": F.lit(None).cast("array<double>"), "group_id": F.when(F.col("sample_id") % 6 != 0, F.col("group_id"))})
    return reports.checked_samples(s, 64).select("sample_id", "label", "group_id", F.size("x").alias("size"))


@query("""WITH b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'error: 2 sinks' ELSE 'ok' END AS status, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 3 END AS code FROM customer)
SELECT concat('b', k, '.xlsx') AS excel_name, CASE WHEN status = 'ok' AND code = 0 THEN 'ok' ELSE 'error' END AS status, 'out/b' || k || '.txt' AS txt_path, 'out/b' || k || '_width_functions.csv' AS width_functions_path, CAST(k % 30 + 1 AS INT) AS outlet_row,
CASE WHEN status <> 'ok' THEN '2 sinks' WHEN code IS NULL THEN 'not run' WHEN code <> 0 THEN concat('exit code ', code) ELSE '' END AS error FROM b""")
def batch_summaries(spark, sf_dir):
    """Rows of a batch's summary."""
    k = F.col("c_custkey")
    c = fx.read(spark, sf_dir, "customer")
    path = F.concat(F.lit("in/b"), k.cast("string"), F.lit(".xlsx"))
    basins = c.select(path.alias("path"), F.lit(40).alias("rows"), F.lit(50).alias("cols"), (k % 30).cast("int").alias("outlet_r"), (k % 20).cast("int").alias("outlet_c"), F.lit(9).alias("cells"), F.lit(8).alias("connected"), F.lit(1).alias("disconnected"), F.when(k % 4 == 0, "error: 2 sinks").otherwise("ok").alias("status"))
    runs = c.where("c_custkey % 5 <> 0").select(path.alias("grid_id"), (k % 3).cast("int").alias("code"), F.lit(None).cast("string").alias("error"), F.lit(1.5).alias("seconds"))
    out = reports.batch_summary(basins, runs, "out", "0.1", True)
    return out.select("excel_name", "status", "txt_path", "width_functions_path", "outlet_row", "error")


@query(f"""WITH {fx.cells_cte(4)}, m AS (SELECT grid_id, dense_rank() OVER (ORDER BY grid_id) - 1 AS i, count(*) OVER () AS grids, md5(array_to_string(list(concat(r, ',', c) ORDER BY r, c), ';')) AS mark FROM cells GROUP BY 1)
SELECT c_custkey AS image, m.grid_id, sha256(concat_ws('|', c_name, c_custkey % 40 + 2, printf('%.4f', c_custkey % 9 * 22.5), CASE WHEN c_custkey % 5 = 0 THEN 'whole' ELSE mark END, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'H' || c_nationkey END)) AS key FROM customer JOIN m ON m.i = c_custkey % m.grids""")
def result_keys(spark, sf_dir):
    """Keys of kept results."""
    from pyspark.sql import Window

    marks = reports.region_mark(fx.cells(spark, sf_dir, 4))
    marks = marks.withColumn("i", F.row_number().over(Window.orderBy("grid_id")) - 1)  # a row a grid
    k = F.col("c_custkey")
    rows = fx.read(spark, sf_dir, "customer").withColumn("i", k % max(1, marks.count())).join(marks, "i")
    field = F.when(k % 4 != 0, F.concat(F.lit("H"), F.col("c_nationkey").cast("string")))
    return rows.select(k.alias("image"), "grid_id", reports.result_key(F.col("c_name"), (k % 40 + 2).cast("int"), k % 9 * 22.5, F.when(k % 5 != 0, F.col("mark")), field).alias("key"))


@query("SELECT c_custkey AS layer, CASE c_custkey % 10 WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 7 THEN 6 WHEN 2 THEN 5 WHEN 3 THEN 3 WHEN 9 THEN 3 ELSE 4 END AS entries, CASE c_custkey % 10 WHEN 0 THEN '5179' WHEN 1 THEN '4326' WHEN 2 THEN '99999' WHEN 7 THEN '5179' END AS code FROM customer")
def system_metas(spark, sf_dir):
    """Systems as maps for a layer's metadata."""
    from catchment.operators import crs
    from catchment.plans.text_queries import _systems

    rows = _systems(spark, sf_dir).select("layer", reports.system_meta(crs.parsed(F.col("text"))).alias("m"))
    return rows.select("layer", F.size("m").alias("entries"), F.try_element_at("m", F.lit("code")).alias("code"))
