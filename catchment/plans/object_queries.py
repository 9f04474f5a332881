"""Queries on arrow objects, paths, heads and profiles, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import imaging, learning, raster, spatial
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


#: Objects: a user's events in order, as cells; own is the object's code, score its quality.
STEPS = "SELECT 'tracks' AS grid_id, user_id AS object_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS k, CAST(event_id * 7 % 40 AS INT) AS r, CAST(event_id * 11 % 50 AS INT) AS c, CAST(user_id % 5 AS INT) AS own, user_id % 10 / 10e0 AS score FROM {events}"


def _steps(spark, sf_dir):
    return spark.sql(STEPS, events=fx.read(spark, sf_dir, "events"))


CODED = f"""s AS ({STEPS.format(events='events')}),
m AS (SELECT *, lead(r) OVER w - r AS dr, lead(c) OVER w - c AS dc, lead(r) OVER w AS nr, lead(c) OVER w AS nc FROM s WINDOW w AS (PARTITION BY object_id ORDER BY k)),
raw AS (SELECT *, CASE WHEN dr IS NULL OR (dr = 0 AND dc = 0) THEN NULL WHEN abs(dc) >= abs(dr) THEN CASE WHEN dc > 0 THEN 1 ELSE 3 END WHEN dr > 0 THEN 2 ELSE 4 END AS raw FROM m),
coded AS (SELECT *, CASE WHEN own > 0 AND raw = (own + 1) % 4 + 1 THEN own ELSE raw END AS code FROM raw),
ended AS (SELECT *, CASE WHEN dr IS NULL THEN last_value(code IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE code END AS d, dr IS NULL AS last FROM coded)"""


@query(f"WITH {CODED} SELECT grid_id, r, c, CAST(d AS INT) AS d, sum(CASE WHEN last THEN 1.5e0 ELSE 3e0 END) AS w FROM ended WHERE d IS NOT NULL GROUP BY 1, 2, 3, 4")
def object_votes(spark, sf_dir):
    """Votes of arrow objects along their paths."""
    return raster.vote_object_paths(_steps(spark, sf_dir))


@query(f"WITH {CODED} SELECT grid_id, r, c, nr, nc, sum(3e0) AS t FROM ended WHERE nr IS NOT NULL AND d = raw GROUP BY 1, 2, 3, 4, 5")
def object_transitions(spark, sf_dir):
    """Weights of the steps between cells."""
    return raster.path_transitions(_steps(spark, sf_dir))


@query(f"WITH {CODED}, v AS (SELECT grid_id, r, c, d, sum(CAST(round_even((CASE WHEN last THEN 0.5 ELSE 1 END) * greatest(0.25, least(8.0, 1 + 4.2 * score)) * 1e6, 0) AS BIGINT)) AS w FROM ended WHERE d IS NOT NULL GROUP BY 1, 2, 3, 4), b AS (SELECT grid_id, r, c, arg_max(d, w * 10 - d) AS d FROM v GROUP BY 1, 2, 3) SELECT grid_id, r, c, count(DISTINCT object_id) AS objects, CAST(coalesce(any_value(b.d), 0) AS INT) AS d FROM s LEFT JOIN b USING (grid_id, r, c) GROUP BY 1, 2, 3")
def object_cells(spark, sf_dir):
    """Cells of arrow objects: best code and number of objects."""
    return raster.rasterise_objects(_steps(spark, sf_dir))


PIXELS = "SELECT 'tracks' AS grid_id, user_id AS path_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS k, CAST(event_id * 3 % 333 AS INT) AS x, CAST(event_id * 5 % 217 AS INT) AS y FROM {events}"
CELLS = f"""p AS ({PIXELS.format(events='events')}),
q AS (SELECT path_id, k, CAST(floor(y / (217 / 40e0)) AS INT) AS r, CAST(floor(x / (333 / 50e0)) AS INT) AS c FROM p),
n AS (SELECT *, lag(r) OVER w AS pr, lag(c) OVER w AS pc FROM q WINDOW w AS (PARTITION BY path_id ORDER BY k)),
steps AS (SELECT path_id, k, unnest(CASE WHEN pr IS NULL THEN [{{'s': 0, 'r': r, 'c': c}}] ELSE list_transform(range(1, abs(c - pc) + 1), lambda i: {{'s': i, 'r': pr, 'c': pc + sign(c - pc) * i}}) || list_transform(range(1, abs(r - pr) + 1), lambda i: {{'s': 1000 + i, 'r': pr + sign(r - pr) * i, 'c': c}}) END) AS s FROM n WHERE pr IS NULL OR r <> pr OR c <> pc),
cells AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY k, s.s) - 1 AS k, s.r AS r, s.c AS c FROM steps)"""


def _cell_paths(spark, sf_dir):
    return raster.cell_paths(spark.sql(PIXELS, events=fx.read(spark, sf_dir, "events")), 40, 50, 217, 333)


@query(f"WITH {CELLS} SELECT path_id, count(*) AS cells, CAST(sum(r * (k % 97)) AS BIGINT) AS by_r, CAST(sum(c * (k % 89)) AS BIGINT) AS by_c FROM cells GROUP BY 1")
def pixel_cell_paths(spark, sf_dir):
    """Pixel paths as connected cells."""
    out = _cell_paths(spark, sf_dir)
    return out.groupBy("path_id").agg(F.count("*").alias("cells"), F.sum((F.col("r") * (F.col("k") % 97)).cast("long")).alias("by_r"), F.sum((F.col("c") * (F.col("k") % 89)).cast("long")).alias("by_c"))


@query(f"WITH {CELLS}, s AS (SELECT user_id AS path_id, event_id * 7 % 40 AS r, event_id * 11 % 50 AS c FROM events WHERE event_id % 10 = 0) SELECT path_id, bool_and(EXISTS (FROM cells x WHERE x.path_id = s.path_id AND abs(x.r - s.r) + abs(x.c - s.c) <= 2)) AS supported FROM s GROUP BY 1")
def supported_paths(spark, sf_dir):
    """Whether paths keep to the raw ones."""
    some = _steps(spark, sf_dir)
    own = fx.read(spark, sf_dir, "events").where("event_id % 10 = 0").select(F.col("user_id").alias("path_id"), (F.col("event_id") * 7 % 40).cast("int").alias("r"), (F.col("event_id") * 11 % 50).cast("int").alias("c"))
    return raster.supported_paths(own.join(some.select(F.col("object_id").alias("path_id")).distinct(), "path_id", "left_semi"), _cell_paths(spark, sf_dir), 2)


HEADS = "SELECT l_returnflag AS grid_id, CAST(min(l_orderkey) AS BIGINT) AS head_id, CAST(l_partkey % 333 AS DOUBLE) AS x, CAST(l_suppkey * 3 % 217 AS DOUBLE) AS y, CAST(l_partkey % 7 - 3 AS DOUBLE) AS dx, CAST(l_suppkey % 5 - 2 AS DOUBLE) AS dy, l_suppkey % 10 / 10e0 AS score FROM {lineitem} WHERE l_linenumber = 7 AND l_orderkey % 20 = 0 GROUP BY ALL"
GUIDE = {"path": "(r + c) % 2", "axis_x": "(r % 5 - 2) / 2e0", "axis_y": "(c % 5 - 2) / 2e0", "axis_conf": "r * c % 10 / 10e0"}


@query(f"""WITH {fx.cells_cte(4)}, h AS (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM ({HEADS.format(lineitem='lineitem')})), a AS (SELECT grid_id, r, c, {', '.join(f'{e} AS {k}' for k, e in GUIDE.items())}, (c + 0.5e0) * 333 / 50 AS cx, (r + 0.5e0) * 217 / 40 AS cy FROM cells),
p AS (SELECT a.*, head_id, x - cx AS tx, y - cy AS ty, dx / n AS ux, dy / n AS uy, score, sqrt((217 / 40e0) * (217 / 40e0) + (333 / 50e0) * (333 / 50e0)) AS size FROM a JOIN h USING (grid_id) WHERE n > 1e-6),
q AS (SELECT *, sqrt(tx * tx + ty * ty) AS dist, -(tx * ux + ty * uy) AS ahead, abs(ty * ux - tx * uy) / (1.8 * size) AS side, abs(axis_x * ux + axis_y * uy) AS agree FROM p),
f AS (SELECT *, (0.3 + 0.7 * greatest(score, 0)) * (-ahead / dist) * exp(-side * side) * (1 - greatest(0, least(1, ahead / (2.5 * size)))) * CASE WHEN axis_conf > 0.08 THEN 0.25 + 0.75 * agree ELSE 0.45 END * CASE WHEN path = 1 THEN 1.1 ELSE 1 END AS fit FROM q WHERE dist > 1e-6 AND -ahead / dist > 0.1 AND ahead <= 1.2 * size AND (axis_conf <= 0.08 OR agree >= 0.35)),
b AS (SELECT *, row_number() OVER (PARTITION BY grid_id, r, c ORDER BY fit DESC, head_id) AS k FROM f)
SELECT grid_id, r, c, CASE WHEN abs(tx) >= abs(ty) THEN CASE WHEN tx > 0 THEN 1 ELSE 3 END WHEN ty > 0 THEN 2 ELSE 4 END AS d, round(0.7 + 2.2 * fit, 5) AS w FROM b WHERE k = 1 AND fit >= 0.03""")
def head_guided_votes(spark, sf_dir):
    """The vote of the head that fits each cell best."""
    cells = fx.cells(spark, sf_dir, 4).withColumns({k: F.expr(e) for k, e in GUIDE.items()})
    grids = cells.select("grid_id").distinct().withColumns({"rows": F.lit(40), "cols": F.lit(50), "width": F.lit(333), "height": F.lit(217)})
    heads = spark.sql(HEADS, lineitem=fx.read(spark, sf_dir, "lineitem"))
    out = raster.guided_votes(cells.drop("d"), heads, grids)
    return out.select("grid_id", "r", "c", "d", F.round("w", 5).alias("w"))


@query("""WITH t AS (SELECT c_custkey AS tip_id, c_nationkey AS image_id, c_custkey * 7 % 60 AS x, c_custkey * 11 % 40 AS y FROM customer), l AS (SELECT DISTINCT n_nationkey AS image_id, a.i AS x, b.i AS y, (a.i // 9 + b.i // 7 + n_nationkey) % 4 AS label FROM nation, range(60) a(i), range(40) b(i) WHERE (a.i * b.i + n_nationkey) % 5 < 2 AND (a.i // 9 + b.i // 7 + n_nationkey) % 4 > 0),
n AS (SELECT t.image_id, tip_id, label, bool_or(l.x = t.x AND l.y = t.y) AS own, count(*) AS n FROM t JOIN l ON l.image_id = t.image_id AND abs(l.x - t.x) <= 2 AND abs(l.y - t.y) <= 2 GROUP BY 1, 2, 3),
b AS (SELECT image_id, tip_id, label, row_number() OVER (PARTITION BY tip_id ORDER BY own DESC, n DESC, label) AS k FROM n) SELECT t.image_id, t.tip_id, CAST(coalesce(label, 0) AS INT) AS label FROM t LEFT JOIN b ON b.tip_id = t.tip_id AND k = 1""")
def tip_components(spark, sf_dir):
    """The component at or near each tip."""
    k = F.col("c_custkey")
    tips = fx.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image_id"), k.alias("tip_id"), (k * 7 % 60).cast("double").alias("x"), (k * 11 % 40).cast("double").alias("y"))
    labels = spark.sql("SELECT image_id, x, y, cast(label as int) AS label FROM (SELECT n_nationkey AS image_id, x, y, (x div 9 + y div 7 + n_nationkey) % 4 AS label FROM {nation} LATERAL VIEW explode(sequence(0, 59)) a AS x LATERAL VIEW explode(sequence(0, 39)) b AS y WHERE (x * y + n_nationkey) % 5 < 2) WHERE label > 0", nation=fx.read(spark, sf_dir, "nation"))
    return imaging.component_near(tips, labels, 2)


@query("""WITH p AS (SELECT user_id AS profile_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_id % 7 < 3 THEN floor(value) ELSE 0 END AS v FROM events),
s AS (SELECT *, last_value(CASE WHEN v > 0 THEN i END IGNORE NULLS) OVER a AS li, last_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) OVER a AS lv, first_value(CASE WHEN v > 0 THEN i END IGNORE NULLS) OVER b AS ri, first_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) OVER b AS rv FROM p
  WINDOW a AS (PARTITION BY profile_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY profile_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT profile_id, i, round(CASE WHEN v <= 0 AND ri - li - 1 <= 3 THEN lv + (rv - lv) * (i - li) / (ri - li) ELSE v END, 6) AS v FROM s""")
def filled_profiles(spark, sf_dir):
    """Profiles with short gaps filled on a straight line."""
    p = spark.sql("SELECT user_id AS profile_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) as long) AS i, CASE WHEN event_id % 7 < 3 THEN cast(floor(value) as double) ELSE 0D END AS v FROM {events}", events=fx.read(spark, sf_dir, "events"))
    return imaging.fill_short_gaps(p).select("profile_id", "i", F.round("v", 6).alias("v"))


PAIRS = "SELECT l_returnflag AS group_id, CAST(l_partkey % 30 AS INT) AS a, CAST(l_suppkey % 40 AS INT) AS b, CAST(min(l_orderkey) AS BIGINT) AS cost FROM {lineitem} WHERE l_orderkey % 3 = 0 GROUP BY 1, 2, 3"


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY cost, a, b) AS n FROM ({PAIRS.format(lineitem='lineitem')})),
g AS (SELECT group_id, 0::BIGINT AS n, []::INT[] AS la, []::INT[] AS lb, NULL::INT AS a, NULL::INT AS b, NULL::BIGINT AS cost FROM (SELECT DISTINCT group_id FROM e)
  UNION ALL SELECT g.group_id, e.n, CASE WHEN list_contains(la, e.a) OR list_contains(lb, e.b) THEN la ELSE list_append(la, e.a) END, CASE WHEN list_contains(la, e.a) OR list_contains(lb, e.b) THEN lb ELSE list_append(lb, e.b) END,
    CASE WHEN list_contains(la, e.a) OR list_contains(lb, e.b) THEN NULL ELSE e.a END, e.b, e.cost FROM g JOIN e ON e.group_id = g.group_id AND e.n = g.n + 1)
SELECT group_id, a, b, cost FROM g WHERE a IS NOT NULL""")
def greedy_assignment(spark, sf_dir):
    """One-to-one pairs by rising cost."""
    return imaging.assign_greedily(spark.sql(PAIRS, lineitem=fx.read(spark, sf_dir, "lineitem")))


@query("""WITH n AS (SELECT s_suppkey AS node_id, s_suppkey * 17 % 101 AS x, s_suppkey * 23 % 103 AS y FROM supplier), t AS (SELECT c_custkey AS target_id, c_custkey * 7 % 101 AS x, c_custkey * 13 % 103 AS y FROM customer),
p AS (SELECT target_id, node_id, row_number() OVER (PARTITION BY target_id ORDER BY (n.x - t.x) * (n.x - t.x) + (n.y - t.y) * (n.y - t.y), node_id) AS k FROM t JOIN n ON (n.x - t.x) * (n.x - t.x) + (n.y - t.y) * (n.y - t.y) <= 225) SELECT target_id, node_id FROM p WHERE k = 1""")
def nearest_nodes(spark, sf_dir):
    """The nearest node within reach, by bins."""
    s, k = F.col("s_suppkey"), F.col("c_custkey")
    nodes = fx.read(spark, sf_dir, "supplier").select(s.alias("node_id"), (s * 17 % 101).cast("double").alias("x"), (s * 23 % 103).cast("double").alias("y"))
    targets = fx.read(spark, sf_dir, "customer").select(k.alias("target_id"), (k * 7 % 101).cast("double").alias("x"), (k * 13 % 103).cast("double").alias("y"))
    return spatial.nearest_nodes(targets, nodes, 5.0, 15.0)


@query("""WITH p AS (SELECT user_id AS feature_id, CAST(row_number() OVER w AS INT) AS seg, event_id % 3 = 0 AS apart, lag(event_id) OVER w IS NULL AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT feature_id, seg, CAST(sum(CASE WHEN apart OR first THEN 1 ELSE 0 END) OVER (PARTITION BY feature_id ORDER BY seg) AS INT) AS run FROM p""")
def piece_runs(spark, sf_dir):
    """Consecutive pieces whose ends meet."""
    p = spark.sql("SELECT 'g' AS grid_id, 1 AS boundary_id, user_id AS feature_id, 0 AS part, 0 AS piece, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) as int) AS seg, event_id % 3 = 0 AS apart FROM {events}", events=fx.read(spark, sf_dir, "events"))
    seg = F.col("seg").cast("double")
    p = p.withColumns({"x0": seg - 1 + F.when(F.col("apart"), 0.5).otherwise(0.0), "y0": seg - 1, "x1": seg, "y1": seg})
    return spatial.merge_pieces(p).select("feature_id", "seg", "run")


@query(f"""WITH {fx.cells_cte(4)}, v AS (SELECT * FROM (SELECT grid_id, r, c, x.d AS d, (r * 3 + c * 5 + x.d * 7) % 11 / 2e0 AS w, (r * 7 + c + x.d * 3) % 6 / 2e0 AS t FROM cells, (VALUES (1), (2), (3), (4)) x(d)) WHERE w > 1),
s AS (SELECT *, CASE WHEN r * c % 10 / 10e0 > 0.05 THEN CASE WHEN d IN (1, 3) THEN abs((r % 5 - 2) / 2e0) ELSE abs((c % 5 - 2) / 2e0) END ELSE 0 END AS axis, (r + c) % 4 AS n FROM v),
z AS (SELECT *, t * (1.35 + 0.2 * least(n, 3)) + 0.85 * w + 0.2 * axis - CASE WHEN n > 1 AND t <= 1e-6 THEN 0.35 ELSE 0 END AS score FROM s)
SELECT grid_id, r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, r, c ORDER BY round(score, 9) DESC, t DESC, w DESC, axis DESC, d) AS k FROM z) WHERE k = 1""")
def resolved_overlaps(spark, sf_dir):
    """Directions where objects overlap."""
    cells = fx.cells(spark, sf_dir, 4)
    four = cells.select("grid_id", "r", "c", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("d"))
    r, c, d = F.col("r"), F.col("c"), F.col("d")
    votes = four.withColumn("w", (r * 3 + c * 5 + d * 7) % 11 / 2).where("w > 1")
    moves = four.withColumn("t", (r * 7 + c + d * 3) % 6 / 2)
    extra = cells.select("grid_id", "r", "c", ((r + c) % 4).alias("objects"), ((r % 5 - 2) / 2).alias("axis_x"), ((c % 5 - 2) / 2).alias("axis_y"), (r * c % 10 / 10).alias("axis_conf"))
    return raster.resolve_directions(votes, moves, extra)


@query("SELECT CAST(label % 5 AS INT) AS label, count(*) AS n, round(avg(CASE WHEN label % 5 = vec_id % 5 THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM embeddings GROUP BY 1")
def class_accuracy(spark, sf_dir):
    rows = fx.samples(spark, sf_dir).withColumn("pred", F.col("sample_id") % 5)
    return learning.class_accuracy(rows).select("label", "n", F.round("accuracy", 6).alias("accuracy"))


@query("SELECT round(avg(accuracy), 6) AS macro FROM (SELECT label % 5 AS label, avg(CASE WHEN label % 5 = vec_id % 5 THEN 1e0 ELSE 0e0 END) AS accuracy FROM embeddings GROUP BY 1)")
def macro_accuracy(spark, sf_dir):
    rows = fx.samples(spark, sf_dir).withColumn("pred", F.col("sample_id") % 5)
    return learning.class_accuracy(rows).agg(F.round(F.avg("accuracy"), 6).alias("macro"))


@query("""WITH RECURSIVE p AS (SELECT c_nationkey AS image_id, c_custkey AS k, c_custkey * 7 % 100 AS x, c_custkey * 13 % 90 AS y, c_custkey * 31 % 97 AS score FROM customer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, x, y, k) AS n FROM p),
taken AS (SELECT image_id, 0::BIGINT AS n, []::STRUCT(k BIGINT, x BIGINT, y BIGINT)[] AS kept FROM p GROUP BY 1
  UNION ALL SELECT r.image_id, r.n, CASE WHEN len(list_filter(kept, lambda o: (o.x - r.x) * (o.x - r.x) + (o.y - r.y) * (o.y - r.y) <= 25)) = 0 THEN list_append(kept, {'k': r.k, 'x': r.x, 'y': r.y}) ELSE kept END
  FROM taken t JOIN ranked r ON r.image_id = t.image_id AND r.n = t.n + 1),
done AS (SELECT image_id, arg_max(kept, n) AS kept FROM taken GROUP BY 1)
SELECT image_id, o.k, o.x, o.y FROM (SELECT image_id, unnest(kept) AS o FROM done)""")
def suppressed_heads(spark, sf_dir):
    """Heads left by greedy suppression."""
    from catchment.operators import suppression

    k = F.col("c_custkey")
    heads = fx.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image_id"), k.alias("k"), (k * 7 % 100).cast("double").alias("x"), (k * 13 % 90).cast("double").alias("y"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), (k * 31 % 97).cast("double").alias("score"))
    out = suppression.suppressed(heads, 5.0)
    return out.select("image_id", "k", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
