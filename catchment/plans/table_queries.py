"""Queries on masks, spatial joins, evaluation, learning, parsers and coordinate systems, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.functions import geometry
from catchment.operators import crs, evaluate, learning, masks, spatial
from catchment.plans import fixtures as fx
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


def _grids(cells):
    return cells.select("grid_id").distinct().select("grid_id", F.lit(fx.ROWS).alias("rows"), F.lit(fx.COLS).alias("cols"))


# masks

@query(f"WITH {fx.cells_cte(keep='r BETWEEN 5 AND 30 AND c BETWEEN 8 AND 44')} SELECT grid_id, greatest(0, min(r) - 1) AS top, least(40, max(r) + 2) AS bottom, greatest(0, min(c) - 1) AS left, least(50, max(c) + 2) AS right FROM cells GROUP BY 1")
def trim_bounds(spark, sf_dir):
    cells = fx.cells(spark, sf_dir, keep="r BETWEEN 5 AND 30 AND c BETWEEN 8 AND 44")
    return masks.trim_bounds(cells, _grids(cells))


@query(f"WITH {fx.cells_cte(keep='r BETWEEN 5 AND 30 AND c BETWEEN 8 AND 44')}, b AS (SELECT grid_id, greatest(0, min(r) - 1) AS top, greatest(0, min(c) - 1) AS lft FROM cells GROUP BY 1) SELECT grid_id, r - top AS r, c - lft AS c, d FROM cells JOIN b USING (grid_id)")
def trim_cells(spark, sf_dir):
    cells = fx.cells(spark, sf_dir, keep="r BETWEEN 5 AND 30 AND c BETWEEN 8 AND 44")
    return masks.trim(cells, masks.trim_bounds(cells, _grids(cells)))


@query(f"WITH {fx.cells_cte()} SELECT grid_id, r, c FROM cells WHERE d = 1 AND r < 25 AND (r + c) % 3 = 0")
def region_intersect(spark, sf_dir):
    cells = fx.cells(spark, sf_dir)
    return masks.intersect(cells.where("d = 1"), cells.where("r < 25"), cells.where("(r + c) % 3 = 0"), None)


@query(f"WITH {fx.cells_cte(keep='d = 1')} SELECT DISTINCT grid_id, CAST(y.i AS INT) AS r, CAST(x.i AS INT) AS c FROM range(17) y(i), range(23) x(i), cells WHERE cells.r = least(39, floor((y.i + 0.5) * (40 / 17))) AND cells.c = least(49, floor((x.i + 0.5) * (50 / 23)))")
def resample_mask(spark, sf_dir):
    return masks.resample_centres(fx.cells(spark, sf_dir, keep="d = 1"), (fx.ROWS, fx.COLS), (17, 23))


@query(f"WITH {fx.cells_cte(keep='(r * c) % 11 = 5')} SELECT DISTINCT grid_id, CAST(y.i AS INT) AS r, CAST(x.i AS INT) AS c FROM range(17) y(i), range(23) x(i), cells WHERE cells.r * 17 < (y.i + 1) * 40 AND (cells.r + 1) * 17 > y.i * 40 AND cells.c * 23 < (x.i + 1) * 50 AND (cells.c + 1) * 23 > x.i * 50")
def resample_any(spark, sf_dir):
    return masks.resample_any(fx.cells(spark, sf_dir, keep="(r * c) % 11 = 5"), (fx.ROWS, fx.COLS), (17, 23))


@query(f"WITH {fx.cells_cte()}, e AS (SELECT grid_id, r, c, CASE WHEN (r + c) % 2 = 0 THEN 0 ELSE 4 END AS d FROM cells WHERE (r * 3 + c) % 17 = 0 AND c < 40) SELECT grid_id, r, c, CAST(coalesce(e.d, cells.d) AS INT) AS d, e.d IS NOT NULL AS edited FROM cells LEFT JOIN e USING (grid_id, r, c)")
def apply_edits(spark, sf_dir):
    cells = fx.cells(spark, sf_dir)
    edits = cells.where("(r * 3 + c) % 17 = 0").withColumn("d", F.when((F.col("r") + F.col("c")) % 2 == 0, 0).otherwise(4))
    return masks.apply_edits(cells, edits, cells.where("c < 40"))


@query(f"WITH {fx.cells_cte()}, {fx.cells_cte(weight='l_extendedprice', name='other')} SELECT cells.grid_id, cells.r, cells.c, cells.d FROM cells LEFT JOIN other USING (grid_id, r, c) WHERE cells.d <> coalesce(other.d, 0) OR cells.r = 7")
def corrected_cells(spark, sf_dir):
    cells = fx.cells(spark, sf_dir)
    return masks.corrections(cells, fx.cells(spark, sf_dir, weight="l_extendedprice"), cells.where("r = 7"))


@query(f"WITH {fx.cells_cte(keep='(r * 5 + c) % 13 = 0')} SELECT DISTINCT grid_id, CAST(r + y.i AS INT) AS r, CAST(c + x.i AS INT) AS c FROM cells, range(-1, 2) y(i), range(-1, 2) x(i)")
def head_halo(spark, sf_dir):
    return masks.dilate(fx.cells(spark, sf_dir, keep="(r * 5 + c) % 13 = 0"))


@query(f"""WITH {fx.cells_cte(keep='(r + c) % 2 = 0')}, k AS (SELECT DISTINCT grid_id, CAST(r + y.i AS INT) AS r, CAST(c + x.i AS INT) AS c FROM cells, range(-1, 2) y(i), range(-1, 2) x(i)),
e AS (SELECT * FROM k ANTI JOIN cells USING (grid_id, r, c))
SELECT DISTINCT e.grid_id, e.r, e.c FROM e JOIN cells a ON a.grid_id = e.grid_id AND abs(a.r - e.r) <= 1 AND abs(a.c - e.c) <= 1 JOIN cells b ON b.grid_id = e.grid_id AND b.r - e.r = e.r - a.r AND b.c - e.c = e.c - a.c""")
def hole_bridges(spark, sf_dir):
    return masks.bridges(fx.cells(spark, sf_dir, keep="(r + c) % 2 = 0"))


# spatial joins

@query(f"""WITH {fx.segments_cte()}, {fx.rings_cte()}, s AS (SELECT feature_id, min(least(x0, x1)) AS xa, min(least(y0, y1)) AS ya, max(greatest(x0, x1)) AS xb, max(greatest(y0, y1)) AS yb FROM segments GROUP BY 1),
p AS (SELECT feature_id AS point_id, (xa + xb) / 2 % 300 AS x, (ya + yb) / 2 % 300 AS y FROM s), r AS (SELECT feature_id, min(x0) AS xa, min(y0) AS ya, max(x0) AS xb, max(y0) AS yb FROM rings GROUP BY 1)
SELECT point_id, feature_id FROM p JOIN r ON x - 5 <= xb AND x + 5 >= xa AND y - 5 <= yb AND y + 5 >= ya""")
def bbox_bin_join(spark, sf_dir):
    s = spatial.boxes(fx.segments(spark, sf_dir), "feature_id")
    x, y = (F.col("xmin") + F.col("xmax")) / 2 % 300, (F.col("ymin") + F.col("ymax")) / 2 % 300
    near = s.select(F.col("feature_id").alias("point_id"), (x - 5).alias("xmin"), (y - 5).alias("ymin"), (x + 5).alias("xmax"), (y + 5).alias("ymax"))
    return spatial.box_join(near, spatial.boxes(fx.rings(spark, sf_dir), "feature_id"), "point_id", "feature_id")


PIP = f"""{fx.rings_cte()}, points AS ({fx.POINTS.format(customer='customer')}),
hits AS (SELECT point_id, feature_id FROM points, rings GROUP BY 1, 2
  HAVING bool_or(abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) <= 1e-9 * greatest(abs(x1 - x0), abs(y1 - y0), 1) AND x BETWEEN least(x0, x1) - 1e-9 AND greatest(x0, x1) + 1e-9 AND y BETWEEN least(y0, y1) - 1e-9 AND greatest(y0, y1) + 1e-9)
  OR count(*) FILTER ((y0 > y) <> (y1 > y) AND x < x0 + (x1 - x0) * ((y - y0) / nullif(y1 - y0, 0))) % 2 = 1)"""


@query(f"WITH {PIP} SELECT point_id, feature_id FROM hits")
def pip_join(spark, sf_dir):
    return spatial.point_features(fx.points(spark, sf_dir), fx.rings(spark, sf_dir))


@query(f"WITH {PIP}, a AS (SELECT feature_id, (max(x0) - min(x0)) * (max(y0) - min(y0)) AS area FROM rings GROUP BY 1) SELECT point_id, arg_min(feature_id, area * 1000 + feature_id) AS feature_id FROM hits JOIN a USING (feature_id) GROUP BY 1")
def pip_smallest(spark, sf_dir):
    return spatial.smallest_feature(fx.points(spark, sf_dir), fx.rings(spark, sf_dir))


@query(f"""WITH {fx.rings_cte()}, points AS (SELECT r, c, 5 + (c + 0.5) * 5.6 AS x, 285 - (r + 0.5) * 7.0 AS y FROM range(40) a(r), range(50) b(c)),
h AS (SELECT r, c, feature_id FROM points, rings GROUP BY 1, 2, 3 HAVING count(*) FILTER ((y0 > y) <> (y1 > y) AND x < x0 + (x1 - x0) * ((y - y0) / nullif(y1 - y0, 0))) % 2 = 1
 OR bool_or(abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) <= 1e-9 * greatest(abs(x1 - x0), abs(y1 - y0), 1) AND x BETWEEN least(x0, x1) - 1e-9 AND greatest(x0, x1) + 1e-9 AND y BETWEEN least(y0, y1) - 1e-9 AND greatest(y0, y1) + 1e-9))
SELECT DISTINCT 'basin' AS grid_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM h""")
def basin_mask(spark, sf_dir):
    grids = spark.range(1).select(F.lit("basin").alias("grid_id"), F.lit(fx.ROWS).alias("rows"), F.lit(fx.COLS).alias("cols"), F.lit(5.0).alias("xmin"), F.lit(5.0).alias("ymin"), F.lit(285.0).alias("xmax"), F.lit(285.0).alias("ymax"))
    return spatial.basin_mask(fx.rings(spark, sf_dir), grids)


SHORT = "SELECT 'lines' AS grid_id, c_custkey AS feature_id, 0 AS part, 0 AS seg, CAST(c_custkey * 7 % 270 AS DOUBLE) AS x0, CAST(c_custkey * 13 % 271 AS DOUBLE) AS y0, CAST(c_custkey * 29 % 272 AS DOUBLE) AS x1, CAST(c_custkey * 31 % 273 AS DOUBLE) AS y1 FROM {customer}"


@query(f"""WITH {fx.rings_cte()}, s AS ({SHORT.format(customer='customer')}),
t AS (SELECT s.feature_id, r.feature_id AS boundary_id, s.x0, s.y0, s.x1, s.y1, (s.x1 - s.x0) * (r.y1 - r.y0) - (s.y1 - s.y0) * (r.x1 - r.x0) AS den,
  (r.x0 - s.x0) * (r.y1 - r.y0) - (r.y0 - s.y0) * (r.x1 - r.x0) AS tn, (r.x0 - s.x0) * (s.y1 - s.y0) - (r.y0 - s.y0) * (s.x1 - s.x0) AS un FROM s, rings r),
p AS (SELECT feature_id, boundary_id, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1,
  list_sort(list_distinct([0.0::DOUBLE, 1.0::DOUBLE] || coalesce(list(greatest(0.0, least(1.0, tn / den))) FILTER (abs(den) > 1e-12 AND tn / den BETWEEN -1e-10 AND 1 + 1e-10 AND un / den BETWEEN -1e-10 AND 1 + 1e-10), []))) AS ts FROM t GROUP BY 1, 2),
k AS (SELECT *, unnest(range(1, len(ts))) AS i FROM p),
m AS (SELECT feature_id, boundary_id, i, x0 + (x1 - x0) * ts[i] AS ax, y0 + (y1 - y0) * ts[i] AS ay, x0 + (x1 - x0) * ts[i + 1] AS bx, y0 + (y1 - y0) * ts[i + 1] AS by_, x0 + (x1 - x0) * ((ts[i] + ts[i + 1]) / 2) AS x, y0 + (y1 - y0) * ((ts[i] + ts[i + 1]) / 2) AS y FROM k WHERE ts[i + 1] - ts[i] > 1e-9),
h AS (SELECT m.feature_id, boundary_id, i, ax, ay, bx, by_ FROM m JOIN rings r ON r.feature_id = boundary_id GROUP BY m.feature_id, boundary_id, i, ax, ay, bx, by_, x, y
  HAVING count(*) FILTER ((r.y0 > y) <> (r.y1 > y) AND x < r.x0 + (r.x1 - r.x0) * ((y - r.y0) / nullif(r.y1 - r.y0, 0))) % 2 = 1 OR bool_or(abs((x - r.x0) * (r.y1 - r.y0) - (y - r.y0) * (r.x1 - r.x0)) <= 1e-9 * greatest(abs(r.x1 - r.x0), abs(r.y1 - r.y0), 1) AND x BETWEEN least(r.x0, r.x1) - 1e-9 AND greatest(r.x0, r.x1) + 1e-9 AND y BETWEEN least(r.y0, r.y1) - 1e-9 AND greatest(r.y0, r.y1) + 1e-9))
SELECT feature_id, boundary_id, count(*) AS pieces, round(sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 4) AS length FROM h GROUP BY 1, 2""")
def clip_segments(spark, sf_dir):
    short = spark.sql(SHORT, customer=fx.read(spark, sf_dir, "customer"))
    pieces = spatial.clip_segments(short, fx.rings(spark, sf_dir))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return pieces.groupBy("feature_id", "boundary_id").agg(F.count("*").alias("pieces"), F.round(F.sum(length), 4).alias("length"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS place, n_name AS value FROM nation WHERE n_nationkey % 2 = 0")
def boundary_values(spark, sf_dir):
    from pyspark.sql import Window

    n = fx.read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    return n.select(F.row_number().over(Window.orderBy("n_nationkey")).alias("place"), F.col("n_name").alias("value"))  # 25 rows


# evaluation

PAIRS = f"{fx.cells_cte(4, name='gold')}, {fx.cells_cte(4, weight='l_extendedprice', keep='(r + c) % 7 > 0', name='pred')}, full_grid AS (SELECT grid_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM (SELECT DISTINCT grid_id FROM gold), range(40) a(r), range(50) b(c) WHERE (r * c) % 5 <> 1), pairs AS (SELECT f.grid_id, coalesce(g.d, 0) AS gold, coalesce(p.d, 0) AS pred FROM full_grid f LEFT JOIN gold g USING (grid_id, r, c) LEFT JOIN pred p USING (grid_id, r, c))"


def _pairs(spark, sf_dir):
    from catchment.plans.grid_queries import _full

    gold = fx.cells(spark, sf_dir, 4)
    pred = fx.cells(spark, sf_dir, 4, weight="l_extendedprice", keep="(r + c) % 7 > 0")
    return evaluate.aligned(pred, gold, _full(gold).where("(r * c) % 5 <> 1"))


@query(f"WITH {PAIRS} SELECT grid_id, CAST(gold AS INT) AS gold, CAST(pred AS INT) AS pred, count(*) AS n FROM pairs GROUP BY 1, 2, 3")
def confusion(spark, sf_dir):
    return evaluate.confusion(_pairs(spark, sf_dir))


def _f1_sql(k):
    tp, fp, fn = f"count(*) FILTER (gold = {k} AND pred = {k})", f"count(*) FILTER (gold <> {k} AND pred = {k})", f"count(*) FILTER (gold = {k} AND pred <> {k})"
    return f"coalesce(2.0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)"


METRICS = f"""WITH {PAIRS}, n AS (SELECT grid_id, count(*) AS reviewed, count(*) FILTER (gold > 0 AND pred > 0) AS tp, count(*) FILTER (gold = 0 AND pred > 0) AS fp, count(*) FILTER (gold > 0 AND pred = 0) AS fn,
  count(*) FILTER (gold = 0 AND pred = 0) AS tn, count(*) FILTER (gold > 0 AND pred = gold) AS exact, ({' + '.join(map(_f1_sql, (1, 2, 3, 4)))}) / 4 AS macro FROM pairs GROUP BY 1),
m AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS q FROM n)
SELECT grid_id, reviewed, tp, fp, fn, tn, exact, round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / (p + q), 6) AS f1, round(exact / tp, 6) AS accuracy, round(exact / (tp + fn), 6) AS strict_recall, round(macro, 6) AS macro_f1 FROM m"""


@query(METRICS)
def label_metrics(spark, sf_dir):
    m = evaluate.metrics(_pairs(spark, sf_dir))
    shares = ("precision", "recall", "f1", "accuracy", "strict_recall", "macro_f1")
    return m.select(*[c for c in m.columns if c not in shares], *[F.round(c, 6).alias(c) for c in shares])


@query(f"WITH m AS ({METRICS}) SELECT grid_id, printf('pipe P=%.4f R=%.4f F1=%.4f | direction acc=%.4f strict=%.4f macro=%.4f', precision, recall, f1, accuracy, strict_recall, macro_f1) AS line FROM m")
def metric_report(spark, sf_dir):
    return evaluate.report(label_metrics(spark, sf_dir))


@query(f"""WITH {fx.cells_cte(4, name='a')}, {fx.cells_cte(4, weight='l_extendedprice', keep='(r + c) % 7 > 0', name='b')},
x AS (SELECT coalesce(a.grid_id, b.grid_id) AS grid_id, coalesce(a.d, 0) AS x, coalesce(b.d, 0) AS y FROM a FULL JOIN b ON a.grid_id = b.grid_id AND a.r = b.r AND a.c = b.c)
SELECT grid_id, round(100.0 * (2000 - count(*) FILTER (x <> y)) / 2000, 6) AS exact, round(100.0 * count(*) FILTER (x > 0 AND y > 0) / count(*) FILTER (x > 0 OR y > 0), 6) AS iou, round(100.0 * count(*) FILTER (x > 0 AND x = y) / count(*) FILTER (x > 0 AND y > 0), 6) AS direction FROM x GROUP BY 1""")
def match_rates(spark, sf_dir):
    m = evaluate.match(fx.cells(spark, sf_dir, 4), fx.cells(spark, sf_dir, 4, weight="l_extendedprice", keep="(r + c) % 7 > 0"), fx.ROWS * fx.COLS)
    return m.select("grid_id", *[F.round(c, 6).alias(c) for c in ("exact", "iou", "direction")])


RUNS = "SELECT o_orderpriority AS image, o_orderstatus AS run, count(*) AS object_count, CAST(count(*) AS DOUBLE) / 2000 AS final_density, CAST(count(*) % 100 AS DOUBLE) / 100 AS coverage FROM {orders} GROUP BY 1, 2"


@query(f"""SELECT image, max(object_count) - min(object_count) AS object_span, round(max(object_count) / greatest(1.0, min(object_count)), 6) AS object_ratio, round(max(final_density) - min(final_density), 6) AS density_span,
round(max(final_density) / greatest(1e-9, min(final_density)), 6) AS density_ratio, min(coverage) AS least_coverage, (max(object_count) - min(object_count) >= 8 OR max(object_count) / greatest(1.0, min(object_count)) >= 2) AS unstable,
max(final_density) / greatest(1e-9, min(final_density)) >= 2 AS density_warning, min(coverage) < 0.7 AS coverage_warning FROM ({RUNS.format(orders='orders')}) GROUP BY 1""")
def audit_summary(spark, sf_dir):
    a = evaluate.audit(spark.sql(RUNS, orders=fx.read(spark, sf_dir, "orders")))
    return a.select(*[F.round(c, 6).alias(c) if c in ("object_ratio", "density_span", "density_ratio") else c for c in a.columns])


@query("SELECT o_custkey AS image_hash, CAST(arg_max(o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || printf('%012d', o_orderkey)) AS BIGINT) AS label FROM orders GROUP BY 1")
def gold_latest(spark, sf_dir):
    o = fx.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_hash"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("created_at"), F.col("o_orderkey").alias("label"))
    return evaluate.latest(o, "image_hash").select("image_hash", "label")


@query(f"""WITH {fx.cells_cte(4, name='a')}, {fx.cells_cte(4, weight='l_extendedprice', keep='(r + c) % 3 > 0', name='b')},
x AS (SELECT coalesce(a.grid_id, b.grid_id) AS grid_id, coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, a.d AS od, coalesce(a.r % 2 = 0, false) AS orv, b.d AS nd, coalesce(b.c % 2 = 0, false) AS nrv FROM a FULL JOIN b ON a.grid_id = b.grid_id AND a.r = b.r AND a.c = b.c)
SELECT grid_id, r, c, CASE WHEN orv AND NOT nrv THEN od ELSE coalesce(nd, od) END AS d, orv OR nrv AS reviewed FROM x""")
def gold_upsert(spark, sf_dir):
    old = fx.cells(spark, sf_dir, 4).withColumn("reviewed", F.col("r") % 2 == 0)
    new = fx.cells(spark, sf_dir, 4, weight="l_extendedprice", keep="(r + c) % 3 > 0").withColumn("reviewed", F.col("c") % 2 == 0)
    return evaluate.upsert(old, new, ["grid_id", "r", "c"])


# learning

@query("SELECT max(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def dedupe_keep_last(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events").withColumn("label", F.floor(F.col("value")))
    kept, _ = evaluate.dedupe_keep_last(e, F.concat_ws("|", "user_id", "event_type"), "event_id", "label")
    return kept.select("event_id", "user_id", "event_type")


@query("WITH w AS (SELECT event_id, lead(event_id) OVER k AS nxt, floor(value) AS label, lag(floor(value)) OVER k AS was FROM events WINDOW k AS (PARTITION BY user_id, event_type ORDER BY event_id)) SELECT count(*) FILTER (nxt IS NOT NULL) AS removed, count(*) FILTER (was <> label) AS conflicts FROM w")
def dedupe_conflicts(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events").withColumn("label", F.floor(F.col("value")))
    return evaluate.dedupe_keep_last(e, F.concat_ws("|", "user_id", "event_type"), "event_id", "label")[1]


@query("WITH u AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), s AS (SELECT i, avg(v::DOUBLE) AS m, CASE WHEN stddev_pop(v::DOUBLE) < 1e-6 THEN 1.0 ELSE stddev_pop(v::DOUBLE) END AS s FROM u GROUP BY 1) SELECT vec_id AS sample_id, round(sum((v - m) / s), 2) AS z_sum, round(sum(((v - m) / s) * ((v - m) / s)), 2) AS z_square FROM u JOIN s USING (i) GROUP BY 1")
def standardize(spark, sf_dir):
    s = fx.samples(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v.cast("double")))
    z = learning.standardise(s, learning.moments(s))
    total = lambda f: F.round(F.aggregate(F.transform("x", f), F.lit(0.0), lambda a, v: a + v), 2)
    return z.select("sample_id", total(lambda v: v).alias("z_sum"), total(lambda v: v * v).alias("z_square"))


KNN = "e AS (SELECT vec_id, label % 5 AS label, embedding::DOUBLE[64] AS x FROM embeddings), d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, array_distance(a.x, b.x) AS dist FROM e a, e b WHERE a.vec_id <> b.vec_id AND a.vec_id % 5 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS n FROM d)"


@query(f"WITH {KNN} SELECT query_id, CAST(l.i AS INT) AS label, round(coalesce(sum(exp(-dist * dist / 2)) FILTER (label = l.i), 0) / sum(exp(-dist * dist / 2)), 4) AS p FROM k, range(5) l(i) WHERE n <= 7 GROUP BY 1, 2")
def knn_vote(spark, sf_dir):
    s = fx.samples(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v.cast("double")))
    near = learning.nearest(s.where("sample_id % 5 = 0").select(F.col("sample_id").alias("query_id"), "x"), s, 7)
    return learning.vote(near, 1.0).select("query_id", "label", F.round("p", 4).alias("p"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS x FROM embeddings), d AS (SELECT a.vec_id, min(array_distance(a.x, b.x)) AS dist FROM e a, e b WHERE a.vec_id <> b.vec_id AND array_distance(a.x, b.x) > 1e-8 GROUP BY 1) SELECT round(quantile_cont(dist, 0.5), 4) AS sigma, round(greatest(1.35 * quantile_cont(dist, 0.85), 1.25 * quantile_cont(dist, 0.5), 0.001), 4) AS reach, CAST(least(9, greatest(3, round_even(sqrt(count(*)), 0))) AS INT) AS k FROM d")
def nn_scale(spark, sf_dir):
    s = fx.samples(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v.cast("double")))
    return learning.scale(s).select(F.round("sigma", 4).alias("sigma"), F.round("reach", 4).alias("reach"), "k")


@query(f"WITH {fx.cells_cte(4, keep='(r * c) % 3 > 0')} SELECT a.grid_id, a.r, a.c, CAST(sum(b.d * ((b.r - a.r + 2) * 5 + b.c - a.c + 3)) AS BIGINT) AS code, count(*) AS filled FROM cells a JOIN cells b ON a.grid_id = b.grid_id AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY 1, 2, 3")
def offset_features(spark, sf_dir):
    x = learning.offsets(fx.cells(spark, sf_dir, 4, keep="(r * c) % 3 > 0"), "d")
    code = F.aggregate(F.transform("x", lambda v, i: (v * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return x.select("grid_id", "r", "c", code.alias("code"), F.size(F.filter("x", lambda v: v > 0)).cast("long").alias("filled"))


@query("WITH c AS (SELECT label % 5 AS label, count(*) AS n FROM embeddings GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS samples, count(*) AS classes, min(n) AS smallest, (SELECT count(DISTINCT vec_id % 12) FROM embeddings) AS groups, CASE WHEN sum(n) >= 96 AND count(*) >= 5 AND min(n) >= 6 THEN 'network' ELSE 'exemplar' END AS mode FROM c")
def stratified_counts(spark, sf_dir):
    return learning.coverage(fx.samples(spark, sf_dir))


@query("SELECT label % 5 AS label, count(*) AS n, CAST(count(*) FILTER (v) AS BIGINT) AS validation FROM (SELECT label, row_number() OVER (PARTITION BY label % 5 ORDER BY vec_id) <= round_even(count(*) OVER (PARTITION BY label % 5) * 0.2, 0) AS v FROM embeddings) GROUP BY 1")
def stratified_split(spark, sf_dir):
    s = learning.stratified_split(fx.samples(spark, sf_dir))
    return s.groupBy("label").agg(F.count("*").alias("n"), F.count_if("validation").alias("validation"))


SAMPLED = f"""WITH {fx.cells_cte(4)}, s AS (SELECT grid_id, r, c, d AS label, CASE WHEN r % 2 = 0 THEN d ELSE 1 END AS detected, r % 3 AS overlap, c % 10 * 0.11 AS conf, CASE WHEN c % 4 > 0 THEN r % 4 END AS tier, CASE WHEN r % 5 > 0 THEN d END AS reference FROM cells),
t AS (SELECT *, CASE WHEN overlap > 1 OR conf < 0.55 OR coalesce(tier <= 1, false) OR coalesce(reference <> detected, false) THEN least(4, 2 + 1 + CASE WHEN overlap > 1 THEN 1 ELSE 0 END) ELSE 2 END AS times FROM s)"""


def _sampled(spark, sf_dir):
    r, c, d = F.col("r"), F.col("c"), F.col("d")
    return fx.cells(spark, sf_dir, 4).withColumns({"label": d, "detected": F.when(r % 2 == 0, d).otherwise(1), "overlap": r % 3, "conf": c % 10 * 0.11, "tier": F.when(c % 4 > 0, r % 4), "reference": F.when(r % 5 > 0, d)})


@query(SAMPLED + " SELECT grid_id, r, c, label, CAST(unnest(range(1, times + 1)) AS INT) AS copy FROM t")
def hard_examples(spark, sf_dir):
    """Corrected samples, hard ones repeated."""
    return learning.repeat_hard(_sampled(spark, sf_dir), 2).select("grid_id", "r", "c", "label", "copy")


@query(SAMPLED + """, k AS (SELECT grid_id, r, c, label, unnest(range(1, times + 1)) AS copy FROM t WHERE (r + c) % 7 = 0 UNION ALL SELECT grid_id, r, c, label, 1 FROM s WHERE (r + c) % 7 = 3 AND overlap <= 1 AND (tier IS NULL OR tier >= 2))
SELECT grid_id, r, c, label, CAST(copy AS INT) AS copy, r * 100 + c AS code FROM k""")
def training_samples(spark, sf_dir):
    """Samples of corrected and trusted cells with their vectors."""
    cells = _sampled(spark, sf_dir)
    vectors = cells.select("grid_id", "r", "c", F.array("r", "c").alias("x"))
    out = learning.training_samples(cells.where("(r + c) % 7 = 0"), cells.drop("d", "label"), vectors, cells.where("(r + c) % 7 = 3"), 2)
    return out.select("grid_id", "r", "c", "label", "copy", (F.col("x")[0] * 100 + F.col("x")[1]).alias("code"))


@query(f"""WITH {fx.cells_cte(4)}, x AS (SELECT grid_id, r, c, CASE WHEN r % 4 = 0 THEN 0 ELSE d END AS d, (r + c) % 5 AS best, ((r * 7 + c * 3) % 100) / 100.0 AS p, c % 3 > 0 AS near, (r * c) % 2 = 0 AS support FROM cells)
SELECT grid_id, r, c, CASE WHEN NOT near THEN 'untrusted' WHEN d = 0 AND best > 0 AND p >= 0.6 AND support THEN 'filled' WHEN d > 0 AND best > 0 AND best <> d AND p >= 0.7 THEN 'relabelled' WHEN d > 0 AND best = 0 AND p >= 0.8 AND NOT support THEN 'cleared' ELSE 'kept' END AS rule FROM x""")
def override_rules(spark, sf_dir):
    c = fx.cells(spark, sf_dir, 4)
    r, col = F.col("r"), F.col("c")
    x = c.select("grid_id", "r", "c", F.when(r % 4 == 0, 0).otherwise(F.col("d")).alias("d"), ((r + col) % 5).alias("best"), (((r * 7 + col * 3) % 100) / 100.0).alias("p"), F.when(col % 3 > 0, 0.5).otherwise(2.0).alias("dist"), F.lit(1.0).alias("reach"), ((r * col) % 2 == 0).alias("support"))
    return learning.override(x).select("grid_id", "r", "c", "rule")


# parsers

def _matrix_files(spark, sf_dir):
    cells = fx.cells(spark, sf_dir)
    grids = cells.select("grid_id").distinct().select("grid_id", F.lit(fx.ROWS).alias("rows"), F.lit(fx.COLS).alias("cols"), F.lit(39).alias("outlet_r"), F.lit(49).alias("outlet_c"))
    return texts.format_matrix(cells, grids)


EXPORT = f"WITH {fx.cells_cte()}, f AS (SELECT g.grid_id, y.i AS r, x.i AS c, coalesce(d, 0) AS d FROM (SELECT DISTINCT grid_id FROM cells) g, range(40) y(i), range(50) x(i) LEFT JOIN cells ON cells.grid_id = g.grid_id AND cells.r = y.i AND cells.c = x.i), l AS (SELECT grid_id, r, string_agg(CAST(d AS VARCHAR), ' ' ORDER BY c) AS line FROM f GROUP BY 1, 2)"


@query(EXPORT + " SELECT grid_id, '40 50' || chr(10) || '40 50' || chr(10) || string_agg(line, chr(10) ORDER BY r) AS text FROM l GROUP BY 1")
def export_text(spark, sf_dir):
    return _matrix_files(spark, sf_dir)


@query(f"WITH {fx.cells_cte()} SELECT grid_id, 40 AS rows, 50 AS cols, 39 AS outlet_r, 49 AS outlet_c, CAST(count(*) AS INT) AS active FROM cells GROUP BY 1")
def matrix_parse(spark, sf_dir):
    """The text export read back (a round trip)."""
    files = _matrix_files(spark, sf_dir).withColumnRenamed("grid_id", "path")
    return texts.parse_matrix(files).select("grid_id", "rows", "cols", "outlet_r", "outlet_c", F.size("cells").alias("active"))


def _nse_files(spark, sf_dir):
    o = fx.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("path"), (F.col("o_custkey") % 9 - 4).alias("k"), F.col("o_orderstatus").alias("ok")).agg(F.count("*").alias("n"))
    line = F.concat_ws("  ", F.col("k").cast("string"), F.concat(F.lit("1e"), F.col("k").cast("string")), F.concat_ws("/", "n", F.lit(100)), (F.col("n") / 4).cast("string"), (F.col("n") / 8).cast("string"))
    return o.groupBy("path").agg(F.concat(F.lit("k beta ok run mean\n[note]\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))


@query("SELECT o_orderpriority AS path, CAST(o_custkey % 9 - 4 AS INT) AS k, printf('%d/100', count(*)) AS ok_total, count(*) / 4 AS mean_nse, count(*) / 8 AS nse_mean FROM orders GROUP BY o_orderpriority, o_custkey % 9 - 4, o_orderstatus")
def nse_parse(spark, sf_dir):
    return texts.parse_nse(_nse_files(spark, sf_dir)).select("path", "k", "ok_total", "mean_nse", "nse_mean")


@query("WITH n AS (SELECT o_orderpriority AS path, CAST(o_custkey % 9 - 4 AS INT) AS k, count(*) / 4 AS mean_nse FROM orders GROUP BY o_orderpriority, o_custkey % 9 - 4, o_orderstatus) SELECT path, k, mean_nse FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mean_nse DESC, k) AS p FROM n) WHERE p = 1")
def beta_best(spark, sf_dir):
    return texts.best_beta(texts.parse_nse(_nse_files(spark, sf_dir))).select("path", "k", "mean_nse")


def _width_files(spark, sf_dir):
    o = fx.read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("path"), (F.col("o_custkey") % 10).cast("int").alias("xi"))
    sums = o.agg(*[F.count_if(F.col("o_orderkey") % 6 == k).alias(f"r{k}") for k in range(6)])
    line = F.concat_ws(",", "xi", F.col("xi") * 2, *[f"r{k}" for k in range(6)])
    head = "distance,original,10^-1_a,10^-1_b,10^0_a,10^0_b,10^0_c,10^1_a"
    return sums.groupBy("path").agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("xi", line.alias("line")))), lambda x: x["line"]), "\n")).alias("text"))


@query("""WITH o AS (SELECT o_orderstatus AS path, CAST(o_custkey % 10 AS INT) AS xi, o_orderkey % 6 AS run, count(*) AS n FROM orders GROUP BY 1, 2, 3), g AS (SELECT p.path, p.xi, r.i AS run, (SELECT coalesce(sum(n), 0) FROM o WHERE o.path = p.path AND o.xi = p.xi AND o.run = r.i) AS n FROM (SELECT DISTINCT path, xi FROM o) p, range(6) r(i)), b AS (SELECT *, CASE WHEN run < 2 THEN 0 WHEN run < 5 THEN 1 ELSE 2 END AS block FROM g)
SELECT path, CAST(block AS INT) AS block, CAST(block - 1 AS INT) AS k, CAST(xi AS DOUBLE) AS xi, CAST(xi * 2 AS DOUBLE) AS original, round(avg(n), 6) AS mean, CAST(min(n) AS DOUBLE) AS low, CAST(max(n) AS DOUBLE) AS high, count(*) AS runs FROM b GROUP BY 1, 2, 3, 4, 5""")
def width_blocks(spark, sf_dir):
    return texts.width_blocks(_width_files(spark, sf_dir)).select("path", "block", "k", "xi", "original", F.round("mean", 6).alias("mean"), "low", "high", "runs")


@query("SELECT n_nationkey || '_' || n_name || '.xlsx' AS name, n_nationkey AS number FROM nation WHERE n_nationkey BETWEEN 3 AND 17 AND n_nationkey % 4 > 0")
def file_select(spark, sf_dir):
    n = fx.read(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("~$"), key.cast("string"), F.lit(".xlsx"))).otherwise(F.concat(key.cast("string"), F.lit("_"), F.col("n_name"), F.lit(".xlsx")))
    return texts.select_workbooks(n.select(name.alias("name")), 3, 17)


# coordinate systems and scalar geometry

BOXES = "SELECT CAST(c_custkey AS {text}) AS layer, 'layer ' || CAST(1990 + c_custkey % 30 AS {text}) AS name, bx AS xmin, ay AS ymin, bx + CAST(10 + c_custkey % 7 AS DOUBLE) * w AS xmax, ay + CAST(5 + c_custkey % 11 AS DOUBLE) * w AS ymax FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 126.0 WHEN 1 THEN 900000.0 WHEN 2 THEN 190000.0 ELSE 5000000.0 END + c_custkey % 13 AS bx, CASE c_custkey % 4 WHEN 0 THEN 36.0 WHEN 1 THEN 1900000.0 WHEN 2 THEN 440000.0 ELSE 7000000.0 END AS ay, CASE c_custkey % 4 WHEN 0 THEN 0.1 ELSE 100.0 END AS w FROM {customer})"


@query(f"""WITH b AS ({BOXES.format(customer='customer', text='VARCHAR')}), s AS (SELECT *, CAST(split_part(name, ' ', 2) AS INT) AS y FROM b)
SELECT layer, CASE WHEN xmin < 200 THEN 'epsg4326' WHEN xmin >= 500000 AND xmin < 1500000 THEN CASE WHEN y < 2002 AND 0.52 + 0.04 > 0.58 THEN 'epsg5178' ELSE 'epsg5179' END WHEN xmin < 500000 THEN 'epsg5174' END AS key,
       round(CASE WHEN xmin < 200 THEN 0.8 WHEN xmin >= 500000 AND xmin < 1500000 THEN 0.58 + CASE WHEN y >= 2002 THEN 0.04 ELSE 0 END WHEN xmin < 500000 THEN 0.42 + CASE WHEN y < 2002 THEN 0.04 ELSE 0 END END, 4) AS score FROM s""")
def crs_signature(spark, sf_dir):
    b = spark.sql(BOXES.replace("{text}", "STRING"), customer=fx.read(spark, sf_dir, "customer"))
    return crs.recommend(b).select("layer", "key", F.round("score", 4).alias("score"))


@query(f"WITH b AS ({BOXES.format(customer='customer', text='VARCHAR')}) SELECT a.layer, round(greatest(0, least(a.xmax, c.xmax) - greatest(a.xmin, c.xmin)) * greatest(0, least(a.ymax, c.ymax) - greatest(a.ymin, c.ymin)) / least((a.xmax - a.xmin) * (a.ymax - a.ymin), (c.xmax - c.xmin) * (c.ymax - c.ymin)), 6) AS share FROM b a, b c WHERE c.layer = '1'")
def bbox_overlap(spark, sf_dir):
    b = spark.sql(BOXES.replace("{text}", "STRING"), customer=fx.read(spark, sf_dir, "customer"))
    one = b.where("layer = '1'").select(*[F.col(c).alias("o" + c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return b.join(F.broadcast(one)).select("layer", F.round(geometry.overlap_share(spatial.box_of(), spatial.box_of("o")), 6).alias("share"))  # one is one row


@query(f"WITH b AS ({BOXES.format(customer='customer', text='VARCHAR')}), c AS (SELECT *, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, (xmax - xmin) / 2 AS w, (ymax - ymin) / 2 AS h FROM b) SELECT layer, round(cx - w * cos(radians(30.0)) - h * sin(radians(30.0)), 4) AS xmin, round(cx + w * cos(radians(30.0)) + h * sin(radians(30.0)), 4) AS xmax, round(cy - w * sin(radians(30.0)) - h * cos(radians(30.0)), 4) AS ymin, round(cy + w * sin(radians(30.0)) + h * cos(radians(30.0)), 4) AS ymax FROM c")
def rotate_bbox(spark, sf_dir):
    b = spark.sql(BOXES.replace("{text}", "STRING"), customer=fx.read(spark, sf_dir, "customer"))
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    corners = [geometry.rotated(F.col(x), F.col(y), cx, cy, 30.0) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    xs, ys = zip(*corners)
    return b.select("layer", F.round(F.least(*xs), 4).alias("xmin"), F.round(F.greatest(*xs), 4).alias("xmax"), F.round(F.least(*ys), 4).alias("ymin"), F.round(F.greatest(*ys), 4).alias("ymax"))


@query(f"WITH b AS ({BOXES.format(customer='customer', text='VARCHAR')}), m AS (SELECT *, radians((ymin + ymax) / 2) AS a FROM b WHERE xmin < 200) SELECT layer, round((xmax - xmin) / 50 * (111412.84 * cos(a) - 93.5 * cos(3 * a)), 4) AS width_m, round((ymax - ymin) / 40 * (111132.92 - 559.82 * cos(2 * a) + 1.175 * cos(4 * a)), 4) AS height_m FROM m")
def cell_size_m(spark, sf_dir):
    b = spark.sql(BOXES.replace("{text}", "STRING"), customer=fx.read(spark, sf_dir, "customer")).where("xmin < 200")
    lon, lat = geometry.metres_per_degree((F.col("ymin") + F.col("ymax")) / 2)
    return b.select("layer", F.round((F.col("xmax") - F.col("xmin")) / fx.COLS * lon, 4).alias("width_m"), F.round((F.col("ymax") - F.col("ymin")) / fx.ROWS * lat, 4).alias("height_m"))


@query("SELECT c_custkey AS point_id, round(126.0 + c_custkey % 40 / 10.0, 6) AS lon, round(34.0 + c_custkey % 37 / 10.0, 6) AS lat FROM customer")
def crs_round_trip(spark, sf_dir):
    """Degrees to the shifted plane system and back again."""
    k = F.col("c_custkey")
    p = fx.read(spark, sf_dir, "customer").select(k.alias("point_id"), (126.0 + k % 40 / 10.0).alias("lon"), (34.0 + k % 37 / 10.0).alias("lat"))
    plane, degrees = crs.SYSTEMS["epsg5174"], crs.SYSTEMS["epsg4326"]
    back = crs.transform(crs.transform(p, degrees, plane, "lon", "lat"), plane, degrees, "lon", "lat")
    return back.select("point_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
