"""Queries on files made from the test tables and read back, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.plans import fixtures as fx
from catchment.sources import labels, shapefile, texts, workbook, writers

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


#: A file for each kind of event, a record for each user, one part; points in order of time.
TRACKS = """SELECT concat(event_type, '.shp') AS path, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) - 1 AS INT) AS record, 0 AS part, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS INT) AS seq,
  CAST(floor(value * 100) AS DOUBLE) AS x, CAST(event_id % 1000 AS DOUBLE) / 8 AS y, user_id FROM {events}"""
TABLE = "SELECT DISTINCT concat(substr(path, 1, length(path) - 4), '.dbf') AS path, record, user_id % 7 = 0 AS deleted, CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('é', CAST(user_id % 4 AS {text})) END AS name, CASE WHEN user_id % 5 = 0 THEN '****' ELSE CAST(user_id AS {text}) END AS height FROM tracks"


def _tracks(spark, sf_dir):
    return spark.sql(TRACKS, events=fx.read(spark, sf_dir, "events"))


def _table(spark, sf_dir):
    return spark.sql(TABLE.replace("{text}", "STRING").replace("FROM tracks", "FROM {tracks}"), tracks=_tracks(spark, sf_dir))


def _fields(spark, sf_dir):
    rows = _table(spark, sf_dir).select("path", "record", "deleted", F.array("name", "height").alias("values"))
    return writers.tables(rows, ["NAME", "HEIGHT"])


SQL = f"tracks AS ({TRACKS.format(events='events')}), dbf AS ({TABLE.format(text='VARCHAR')})"


@query(f"WITH {SQL} SELECT path, 3 AS kind, min(x) OVER f AS xmin, min(y) OVER f AS ymin, max(x) OVER f AS xmax, max(y) OVER f AS ymax, record, part, seq, x, y FROM tracks WINDOW f AS (PARTITION BY path)")
def polyline_points(spark, sf_dir):
    """Points of shapefiles."""
    return shapefile.read_points(writers.shapefiles(_tracks(spark, sf_dir)))


@query(f"WITH {SQL} SELECT path, 3 AS kind, 'line' AS kind_name, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, CAST(NULL AS VARCHAR) AS error FROM tracks GROUP BY 1 UNION ALL SELECT 'bad.shp', -1, NULL, NULL, NULL, NULL, NULL, 'not a shapefile'")
def shape_headers(spark, sf_dir):
    """Kind and box of shapefiles from their headers; a bad file is a row with its error."""
    files = writers.shapefiles(_tracks(spark, sf_dir))
    bad = fx.read(spark, sf_dir, "events").limit(1).select(F.lit("bad.shp").alias("path"), F.lit("no shapefile").cast("binary").alias("content"))
    return shapefile.inspect(files.unionByName(bad)).fillna(-1, ["kind"])


@query(f"WITH {SQL} SELECT path, record, deleted, name, height FROM dbf")
def table_fields(spark, sf_dir):
    """Rows of dBASE tables, with letters outside of ASCII."""
    out = shapefile.read_fields(_fields(spark, sf_dir))
    return out.select("path", "record", "deleted", F.col("attributes")["NAME"].alias("name"), F.col("attributes")["HEIGHT"].alias("height"))


@query(f"WITH {SQL}, n AS (SELECT path, count(*) AS records, greatest(1, max(strlen(encode(name)))) AS a, greatest(1, max(strlen(height))) AS b FROM (SELECT *, 1 FROM dbf) GROUP BY 1) SELECT path, 0 AS place, 'NAME' AS name, CAST(a AS INT) AS width, records FROM n UNION ALL SELECT path, 1, 'HEIGHT', CAST(b AS INT), records FROM n".replace("strlen(encode(name))", "octet_length(encode(name))"))
def table_columns(spark, sf_dir):
    """Columns of dBASE tables from their headers."""
    return shapefile.field_names(_fields(spark, sf_dir))


@query(f"""WITH {SQL}, s AS (SELECT t.path AS grid_id, CAST(t.record AS BIGINT) AS feature_id, part, seq AS seg, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, CASE WHEN height <> '****' THEN CAST(height AS DOUBLE) END AS start_h FROM tracks t JOIN dbf ON dbf.path = replace(t.path, '.shp', '.dbf') AND dbf.record = t.record AND NOT deleted WINDOW w AS (PARTITION BY t.path, t.record ORDER BY seq))
SELECT grid_id, feature_id, part, seg, x0, y0, x1, y1, start_h FROM s WHERE x1 IS NOT NULL""".replace("CASE WHEN height <> '****' THEN CAST(height AS DOUBLE) END", "TRY_CAST(height AS DOUBLE)"))
def polyline_layer(spark, sf_dir):
    """Segments of a layer with heights from its table; deleted rows are left out."""
    points = shapefile.read_points(writers.shapefiles(_tracks(spark, sf_dir)))
    out = shapefile.segments(shapefile.layer(points, shapefile.read_fields(_fields(spark, sf_dir), ["HEIGHT"])), "HEIGHT")
    return out.drop("end_h")


@query(f"WITH {SQL} SELECT path, record, CASE WHEN name <> '' THEN name ELSE height END AS label FROM dbf")
def feature_labels(spark, sf_dir):
    """The label of each feature: the preferred field, else any value."""
    out = shapefile.read_fields(_fields(spark, sf_dir))
    return out.select("path", "record", shapefile.feature_label(F.col("attributes"), F.col("record"), "NAME").alias("label"))


@query(f"""WITH {fx.rings_cte()} SELECT feature_id, ring, edge, x0, y0, x1, y1 FROM rings WHERE feature_id % 5 = 2""")
def selected_rings(spark, sf_dir):
    """Edges of the polygons with one attribute value, through files."""
    rings = fx.rings(spark, sf_dir)
    points = rings.select(F.lit("areas.shp").alias("path"), F.col("feature_id").alias("record"), F.col("ring").alias("part"), F.col("edge").alias("seq"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    rows = rings.select(F.lit("areas.dbf").alias("path"), F.col("feature_id").alias("record"), F.lit(False).alias("deleted"), F.array(F.concat(F.lit("zone "), (F.col("feature_id") % 5).cast("string"))).alias("values")).distinct()
    layer = shapefile.layer(shapefile.read_points(writers.shapefiles(points, 5), shapefile.POLYGONS), shapefile.read_fields(writers.tables(rows, ["ZONE"])))
    return shapefile.selected_rings(layer, "ZONE", "zone 2")


@query(f"WITH {fx.cells_cte(4)} SELECT grid_id || '.xlsx' AS path, r, c, d FROM cells")
def workbook_cells(spark, sf_dir):
    """Grids written to workbooks and read back."""
    cells = fx.cells(spark, sf_dir, 4).withColumn("path", F.concat("grid_id", F.lit(".xlsx")))
    return workbook.read_cells(writers.workbooks(cells)).where("error IS NULL").drop("error")


@query(f"WITH RECURSIVE {fx.cells_cte(4)}, f AS (SELECT grid_id || '.npz' AS path, max(r) AS mr, max(c) AS mc FROM cells GROUP BY 1) SELECT f.path, CAST(a.i AS INT) AS r, CAST(b.i AS INT) AS c, CAST(coalesce(d, 0) AS INT) AS d, coalesce(cells.r % 3 = 0, false) AS reviewed FROM f JOIN range(40) a(i) ON a.i <= mr JOIN range(50) b(i) ON b.i <= mc LEFT JOIN cells ON f.path = cells.grid_id || '.npz' AND cells.r = a.i AND cells.c = b.i")
def label_files(spark, sf_dir):
    """Labels written to archives and read back."""
    cells = fx.cells(spark, sf_dir, 4).withColumns({"path": F.concat("grid_id", F.lit(".npz")), "reviewed": F.col("r") % 3 == 0})
    return labels.read_npz(writers.label_archives(cells)).where("error IS NULL").drop("error")


@query(f"WITH {fx.cells_cte(4)}, f AS (SELECT grid_id, count(*) FILTER (r = 0) AS w FROM cells GROUP BY 1) SELECT grid_id AS path, CAST(r AS INT) AS r, CAST(row_number() OVER (PARTITION BY grid_id, r ORDER BY c) - 1 AS INT) AS c, d FROM cells")
def engine_results(spark, sf_dir):
    """Matrices of an engine's output text, up to the first line that isn't numbers."""
    cells = fx.cells(spark, sf_dir, 4)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "d"))), lambda x: x["d"].cast("string")), " ")
    rows = cells.groupBy("grid_id", "r").agg(line.alias("line"))
    every = cells.select("grid_id").distinct().select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("r")).join(rows, ["grid_id", "r"], "left")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("line", F.lit("0")).alias("line")))), lambda x: x["line"]), "\n")
    files = every.groupBy("grid_id").agg(body.alias("body")).select(F.col("grid_id").alias("path"), F.concat(F.lit("log 1\nFinal Direction Matrix D\n"), F.col("body"), F.lit("\ndone\n9 9 9")).alias("text"))
    out = texts.parse_result(files)
    return out.where("d > 0")


@query("SELECT concat('d', c_nationkey, '/', c_custkey, '_width_functions.csv') AS path, CASE WHEN c_custkey % 3 = 0 THEN concat('d', c_nationkey, '/', c_custkey, '_NSE.txt') WHEN n = 1 THEN sole END AS nse FROM customer LEFT JOIN (SELECT c_nationkey, count(*) AS n, min(concat('d', c_nationkey, '/', c_custkey, '_NSE.txt')) AS sole FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1) USING (c_nationkey)")
def companion_files(spark, sf_dir):
    """The result file beside each curve table."""
    c = fx.read(spark, sf_dir, "customer")
    stem = F.concat(F.lit("d"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string"))
    names = c.select(F.concat(stem, F.lit("_width_functions.csv")).alias("path")).unionByName(c.where("c_custkey % 3 = 0").select(F.concat(stem, F.lit("_NSE.txt")).alias("path")))
    return labels.companion(names)


@query("SELECT o_orderkey AS line_no, CASE o_orderkey % 3 WHEN 0 THEN 'Done' WHEN 1 THEN 'NSE saved' ELSE 'Saved' END AS name, concat('out/', o_custkey, '.txt') AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def saved_files(spark, sf_dir):
    """Paths that an engine's output names; the last line of a name counts."""
    o = fx.read(spark, sf_dir, "orders")
    name = F.element_at(F.array(*map(F.lit, ("Done", "NSE saved", "Saved"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    line = F.concat(F.lit("  "), name, F.lit(": out/"), F.col("o_custkey").cast("string"), F.lit(".txt "))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n")
    files = o.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(body.alias("text"))
    found = texts.saved_paths(files)
    last = o.groupBy(F.col("o_custkey").cast("string").alias("path"), name.alias("name")).agg(F.max("o_orderkey").alias("line_no"))
    return found.join(last, ["path", "name"]).select("line_no", "name", "value")
