"""Queries on engine texts, coordinate systems, layers and training sets, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import crs, evaluate, graph, layers, learning
from catchment.plans import fixtures as fx
from catchment.plans.grid_queries import CHAINS
from catchment.sources import texts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


#: An engine's output for each customer: a title, a header, rows of five or seven fields, a saved file and a row behind it.
ROWS = """SELECT o_custkey AS cust, o_orderkey AS k, concat(CAST(o_orderkey % 9 - 4 AS {text}), '  ', CAST(o_orderkey % 100 AS {text}), 'e-2 ', CAST(o_orderkey % 7 AS {text}), '/7 ', CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE concat('0.', CAST(100 + o_orderkey % 900 AS {text})) END,
  CASE WHEN o_custkey % 2 = 0 THEN concat(' 0.1', CAST(o_orderkey % 10 AS {text}), ' 0.9 ') ELSE ' ' END, '0.5', CAST(o_orderkey % 10 AS {text})) AS line FROM {orders}"""
HEAD = "concat('start', {n}, CASE WHEN {k} % 3 = 0 THEN '[Summary by beta]' ELSE 'k beta ok meanNSE(run) NSE(mean_q)' END, {n}, 'k beta ok', {n}, '', {n}, "
TAIL = ", {n}, CASE WHEN {k} % 2 = 0 THEN 'NSE saved: x.txt' ELSE 'Saved: a_width_functions.csv' END, {n}, '1 2 3 4 5')"


def _outputs(spark, sf_dir):
    lines = spark.sql(ROWS.replace("{text}", "STRING"), orders=fx.read(spark, sf_dir, "orders"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    whole = lines.groupBy("cust").agg(body.alias("body"))
    put = {"n": "'\\n'", "k": "cust"}
    return whole.select(F.col("cust").cast("string").alias("path"), F.expr(HEAD.format(**put) + "body" + TAIL.format(**put)).alias("text"))


SUMMARY = f"""WITH o AS ({ROWS.format(text='VARCHAR', orders='orders')}), f AS (SELECT cust, k, row_number() OVER (PARTITION BY cust ORDER BY k) + 3 AS line_no, string_split_regex(line, ' +') AS f FROM o),
rows AS (SELECT CAST(cust AS VARCHAR) AS path, CAST(line_no AS INT) AS line_no, f[1] AS k, f[2] AS beta, f[3] AS ok_total, f[4] AS mean_run, CASE WHEN len(f) >= 7 THEN f[5] END AS low, CASE WHEN len(f) >= 7 THEN f[6] END AS high, CASE WHEN len(f) >= 7 THEN f[7] ELSE f[5] END AS mean_q FROM f)"""


@query(SUMMARY + " SELECT * FROM rows")
def beta_summary(spark, sf_dir):
    """Rows of an engine's table by beta."""
    return texts.parse_summary(_outputs(spark, sf_dir))


@query(SUMMARY + " SELECT path, beta, mean_run FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CAST(mean_run AS DOUBLE) DESC, line_no) AS n FROM rows WHERE mean_run <> 'n/a') WHERE n = 1")
def best_run(spark, sf_dir):
    return texts.best_run(texts.parse_summary(_outputs(spark, sf_dir)))


NOTES = "CASE o_orderkey % 6 WHEN 0 THEN concat('k=-', CAST(o_orderkey % 5 AS {text}), ' beta 1e-', CAST(o_orderkey % 7 AS {text})) WHEN 1 THEN concat('Run = ', CAST(o_orderkey AS {text})) WHEN 2 THEN '   ' WHEN 3 THEN 'Batch completed. k 3' WHEN 4 THEN concat('beta=0.', CAST(o_orderkey AS {text}), ' run 7') ELSE concat('line ', repeat('x', 130), CAST(o_orderkey AS {text})) END"


@query(f"""SELECT o_orderkey AS line_id, CASE o_orderkey % 6 WHEN 0 THEN concat('k=-', o_orderkey % 5, ' / beta=1e-', o_orderkey % 7) WHEN 1 THEN concat('run=', o_orderkey) WHEN 3 THEN 'k=3 / batch completed' WHEN 4 THEN concat('beta=0.', o_orderkey, ' / run=7') WHEN 5 THEN substr({NOTES.format(text='VARCHAR')}, 1, 120) END AS note FROM orders""")
def progress_notes(spark, sf_dir):
    """What the lines of a running engine tell."""
    o = fx.read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("line_id"), texts.progress_note(F.expr(NOTES.format(text="STRING"))).alias("note"))


@query(CHAINS + """, p AS (SELECT grid_id, length, CAST(row_number() OVER (PARTITION BY grid_id ORDER BY length DESC, start_r, start_c) AS INT) AS place, length / sum(length) OVER (PARTITION BY grid_id) AS share FROM chains) SELECT grid_id, place, printf('%d,%d,%.10f', place, length, share) AS line FROM p""")
def flow_length_lines(spark, sf_dir):
    """The table of flow-line lengths as text."""
    return texts.length_lines(graph.flowlines(fx.cells(spark, sf_dir)))


@query(CHAINS + """, g AS (SELECT grid_id, CAST(sum(length) AS BIGINT) AS cells, count(*) AS chains, max(length) AS longest, sum(length * length) / sum(length) AS centre FROM chains GROUP BY 1)
SELECT grid_id, printf('cells=%d\nchains=%d\nlongest=%d\ncentre=%.10f\ngamma=%.10f', cells, chains, longest, centre, centre / longest) AS text FROM g""")
def gamma_report(spark, sf_dir):
    return texts.gamma_report(graph.gamma_index(graph.flowlines(fx.cells(spark, sf_dir))))


_GEO = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
_PROJ = 'PROJCS["{name}",' + _GEO + ',PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",{east}],UNIT["{unit}",{factor}]{end}]'
SYSTEM_TEXTS = (
    "EPSG:5179", " epsg:4326 ", "EPSG:99999", "nonsense", _GEO,
    _PROJ.format(name="A", east="200000.0", unit="Meter", factor="1.0", end=""), _PROJ.format(name="B", east="200000.0", unit="Metre", factor="1.0", end=""),
    _PROJ.format(name="C", east="200000.0", unit="Foot", factor="0.3048", end=',AUTHORITY["EPSG","5179"]'), _PROJ.format(name="D", east="1.0", unit="Meter", factor="1.0", end=""), "",
)
#: index -> code, name, geographic, projected, unit
_PARSED = ((0, "5179", "EPSG:5179", False, True, "meter"), (1, "4326", "EPSG:4326", True, False, "degree"), (2, "99999", None, False, False, "meter"), (3, None, None, False, False, "unknown"), (4, None, "GCS_WGS_1984", True, False, "degree"), (5, None, "A", False, True, "meter"), (6, None, "B", False, True, "meter"), (7, "5179", "C", False, True, "linear"), (8, None, "D", False, True, "meter"), (9, None, None, False, False, "unknown"))
_q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def _systems(spark, sf_dir):
    pick = F.element_at(F.array(*map(F.lit, SYSTEM_TEXTS)), (F.col("c_custkey") % 10 + 1).cast("int"))
    return fx.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("layer"), pick.alias("text"))


@query(f"SELECT c_custkey AS layer, p.code, p.name, p.geographic, p.projected, p.unit FROM customer JOIN (VALUES {', '.join('(' + ', '.join(map(_q, p)) + ')' for p in _PARSED)}) p(i, code, name, geographic, projected, unit) ON p.i = c_custkey % 10")
def parsed_systems(spark, sf_dir):
    """Authority code, name, kind and unit of coordinate systems' texts."""
    return _systems(spark, sf_dir).select("layer", crs.parsed(F.col("text")).alias("p")).select("layer", "p.*")


@query("SELECT c_custkey AS layer, c_custkey % 10 = c_custkey * 3 % 10 OR (c_custkey % 10, c_custkey * 3 % 10) IN ((0, 7), (7, 0), (5, 6), (6, 5)) AS same FROM customer")
def same_systems(spark, sf_dir):
    """Whether two texts name one system."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, SYSTEM_TEXTS)), (k % 10 + 1).cast("int"))
    k = F.col("c_custkey")
    return fx.read(spark, sf_dir, "customer").select(k.alias("layer"), crs.same_system(pick(k), pick(k * 3)).alias("same"))


@query("SELECT c_custkey AS layer, CASE WHEN c_custkey % 5 = 0 THEN 'detected' WHEN c_custkey % 7 = 0 THEN 'assigned' ELSE 'project' END AS key, CASE WHEN c_custkey % 5 = 0 THEN 'confirmed' WHEN c_custkey % 7 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN c_custkey % 5 = 0 THEN 1.0 WHEN c_custkey % 7 = 0 THEN 0.98 ELSE round(0.72 + 0.18 * greatest(0, 1 - sqrt(dx * dx + dy * dy) / (2 * sqrt(200e0 * 200 + 150e0 * 150))), 6) END AS score FROM (SELECT c_custkey, c_custkey % 50 + 25 - 100 AS dx, c_custkey % 40 + 20 - 75 AS dy FROM customer)")
def layer_choices(spark, sf_dir):
    """The system of each layer: found, assigned before, or recommended against the project's extent (low: its own system is a candidate beside it)."""
    k = F.col("c_custkey")
    x, y = 955_000.0 + k % 50, 1_950_000.0 + k % 40
    rows = fx.read(spark, sf_dir, "customer").select(k.alias("layer"), F.lit("pipes").alias("name"), x.cast("double").alias("xmin"), y.cast("double").alias("ymin"), (x + 50).cast("double").alias("xmax"), (y + 40).cast("double").alias("ymax"), F.when(k % 5 == 0, "epsg5186").alias("detected"), F.when(k % 7 == 0, "epsg5174").alias("assigned"))
    out = crs.recommend(rows, crs.SYSTEMS["epsg5179"], (955_000.0, 1_950_000.0, 955_200.0, 1_950_150.0))
    return out.select("layer", "key", "confidence", F.round("score", 6).alias("score"))


@query("SELECT c_custkey AS project, CASE WHEN k % 3 > 0 AND k % 2 = 0 THEN 'pipe' WHEN k % 5 > 0 THEN 'current' WHEN k % 3 > 0 THEN 'pipe' ELSE 'epsg5179' END AS key, CASE WHEN k % 3 > 0 AND k % 2 = 0 THEN 'high' WHEN k % 5 > 0 AND k % 4 = 0 THEN 'high' WHEN k % 5 > 0 THEN 'medium' WHEN k % 3 > 0 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN k % 3 > 0 AND k % 2 = 0 THEN 1.0 WHEN k % 5 > 0 AND k % 4 = 0 THEN 0.96 WHEN k % 5 > 0 THEN 0.7 WHEN k % 3 > 0 THEN 0.68 ELSE 0.35 END AS score FROM (SELECT c_custkey, c_custkey AS k FROM customer)")
def project_choices(spark, sf_dir):
    """The system recommended for a project."""
    k = F.col("c_custkey")
    pick = crs.project_recommendation(F.when(k % 3 > 0, "a"), k % 2 == 0, F.when(k % 5 > 0, "b"), k % 4 == 0)
    return fx.read(spark, sf_dir, "customer").select(k.alias("project"), pick.alias("p")).select("project", "p.*")


@query("SELECT arg_min('c' || n_nationkey, CASE WHEN n_nationkey % 3 = 1 AND n_nationkey % 4 = 2 THEN 0 WHEN n_nationkey % 3 = 1 THEN 100 WHEN n_nationkey % 4 = 2 THEN 200 ELSE 300 END + n_nationkey) AS crs FROM nation WHERE n_nationkey % 5 > 0")
def first_project_system(spark, sf_dir):
    """The system of the first projected pipe layer, or the next best."""
    k = F.col("n_nationkey")
    rows = fx.read(spark, sf_dir, "nation").select(F.when(k % 5 > 0, F.concat(F.lit("c"), k.cast("string"))).alias("crs"), (k % 3 == 1).alias("projected"), F.when(k % 4 == 2, "pipe").otherwise("area").alias("kind"), k.alias("ord"))
    return crs.project_choice(rows)


@query("SELECT user_id AS layer, event_type AS part, count(*) AS points, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS BIGINT) AS layer_points FROM events GROUP BY 1, 2")
def layer_points(spark, sf_dir):
    """Vertices of each part and layer."""
    e = fx.read(spark, sf_dir, "events")
    parts = e.groupBy(F.col("user_id").alias("layer"), F.col("event_type").alias("part")).agg(F.collect_list("value").alias("points"))
    return layers.point_counts(parts)


@query("""WITH n AS (SELECT vec_id % 12 AS group_id, vec_id AS sample_id, label % 5 AS label, hash FROM (SELECT *, md5(CAST(round(embedding[1], 2) AS VARCHAR)) AS hash FROM embeddings)),
k AS (SELECT vec_id, label % 5 AS label, vec_id % 12 AS group_id, CAST(vec_id % 97 AS BIGINT) AS identity FROM embeddings)
SELECT CAST(max(vec_id) AS BIGINT) AS sample_id, identity, CAST(arg_max(label, vec_id) AS INT) AS label FROM k GROUP BY identity""")
def appended_samples(spark, sf_dir):
    """A training set with a batch appended: the last sample of each identity stays."""
    s = fx.samples(spark, sf_dir).select("sample_id", (F.col("sample_id") % 97).alias("identity"), "label", "group_id")
    kept, _ = learning.append_samples(s.where("sample_id % 2 = 0"), s.where("sample_id % 2 = 1"), "identity", "sample_id")
    return kept.select("sample_id", "identity", "label")


@query(f"""WITH {fx.cells_cte(4)}, a AS (SELECT grid_id, r, c FROM cells WHERE r % 10 = 5 AND c % 12 = 6), n AS (SELECT a.grid_id, a.r AS ar, a.c AS ac, x.r, x.c, CASE WHEN (x.r + x.c) % 3 = 0 THEN 0 ELSE x.d END AS d, (x.r * 3 + x.c * 7) % 20 AS score
  FROM a JOIN cells x ON x.grid_id = a.grid_id AND abs(x.r - a.r) <= 2 AND abs(x.c - a.c) <= 2 WHERE NOT EXISTS (FROM a q WHERE q.grid_id = x.grid_id AND q.r = x.r AND q.c = x.c)),
k AS (SELECT *, row_number() OVER (PARTITION BY grid_id, ar, ac, d > 0 ORDER BY score DESC, r, c) AS p FROM n)
SELECT grid_id, r, c, CAST(any_value(d) AS INT) AS d, CAST(max(score) AS INT) AS score FROM k WHERE p <= 2 GROUP BY 1, 2, 3""")
def reliable_context(spark, sf_dir):
    """Trusted neighbours of corrected cells."""
    cells = fx.cells(spark, sf_dir, 4)
    r, c = F.col("r"), F.col("c")
    rated = cells.withColumns({"d": F.when((r + c) % 3 == 0, 0).otherwise(F.col("d")), "score": (r * 3 + c * 7) % 20})
    return learning.reliable_context(cells.where("r % 10 = 5 AND c % 12 = 6"), rated)


@query("SELECT o_custkey AS image_hash, CAST(count(*) AS BIGINT) AS labels, strftime(max(o_orderdate), '%Y%m%d') AS latest FROM orders GROUP BY 1")
def label_history(spark, sf_dir):
    """Labels of each image and the latest one's date."""
    o = fx.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_hash"), F.date_format("o_orderdate", "yyyyMMdd").alias("created_at"), F.col("o_orderkey").alias("label"))
    newest = evaluate.latest(o, "image_hash").select("image_hash", F.col("created_at").alias("latest"))
    return newest.join(o.groupBy("image_hash").agg(F.count("*").alias("labels")), "image_hash")


@query("SELECT vec_id AS sample_id, vec_id % 12 AS group_id, CAST(label % 5 AS INT) AS label, ('0x' || md5((vec_id % 12)::VARCHAR)[1:8])::BIGINT % 1000 < 400 AS validation FROM embeddings")
def group_split(spark, sf_dir):
    """A split by whole groups: the side of each sample."""
    return learning.group_split(fx.samples(spark, sf_dir), 0.4).select("sample_id", "group_id", "label", "validation")
