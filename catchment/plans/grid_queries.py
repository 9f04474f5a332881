"""Queries on rasterisation and on the flow graph, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.functions import directions
from catchment.operators import graph, raster
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


# DuckDB: steps of every segment's cell path, as the closed form of the line with bridged diagonals
PATHS = f"""
{fx.segments_cte()},
box AS (SELECT min(least(x0, x1)) AS xa, min(least(y0, y1)) AS ya, max(greatest(x0, x1)) AS xb, max(greatest(y0, y1)) AS yb FROM segments),
turned AS (
  SELECT *, CASE WHEN start_h IS NOT NULL AND end_h IS NOT NULL AND NOT (abs(start_h) <= 1e-9 AND abs(end_h) <= 1e-9) AND start_h < end_h THEN true ELSE false END AS turn FROM segments),
lines AS (
  SELECT grid_id, feature_id, part, seg, start_h, end_h, turn, CASE WHEN turn THEN x1 ELSE x0 END AS x0, CASE WHEN turn THEN y1 ELSE y0 END AS y0,
         CASE WHEN turn THEN x0 ELSE x1 END AS x1, CASE WHEN turn THEN y0 ELSE y1 END AS y1 FROM turned),
ends AS (
  SELECT l.*, greatest(0, least({fx.ROWS - 1}, CAST(floor((yb - y0) / ((yb - ya) / {float(fx.ROWS)})) AS INT))) AS r0, greatest(0, least({fx.COLS - 1}, CAST(floor((x0 - xa) / ((xb - xa) / {float(fx.COLS)})) AS INT))) AS c0,
         greatest(0, least({fx.ROWS - 1}, CAST(floor((yb - y1) / ((yb - ya) / {float(fx.ROWS)})) AS INT))) AS r1, greatest(0, least({fx.COLS - 1}, CAST(floor((x1 - xa) / ((xb - xa) / {float(fx.COLS)})) AS INT))) AS c1
  FROM lines l, box),
ks AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS big, least(abs(r1 - r0), abs(c1 - c0)) AS small FROM ends),
every AS (SELECT *, unnest(range(big + 1)) AS k FROM ks),
on_line AS (
  SELECT *, CASE WHEN big = 0 THEN 0 ELSE (2 * k * small + big - 1) // (2 * big) END AS m FROM every),
placed AS (
  SELECT *, r0 + sign(r1 - r0) * CASE WHEN abs(c1 - c0) >= abs(r1 - r0) THEN m ELSE k END AS r, c0 + sign(c1 - c0) * CASE WHEN abs(c1 - c0) >= abs(r1 - r0) THEN k ELSE m END AS c FROM on_line),
before AS (SELECT *, lag(r) OVER s AS pr, lag(c) OVER s AS pc FROM placed WINDOW s AS (PARTITION BY grid_id, feature_id, part, seg ORDER BY k)),
path AS (
  SELECT grid_id, feature_id, part, seg, x0, y0, x1, y1, start_h, end_h, 2 * k AS k, r, c FROM before
  UNION ALL
  SELECT grid_id, feature_id, part, seg, x0, y0, x1, y1, start_h, end_h, 2 * k - 1, CASE WHEN abs(x1 - x0) >= abs(y1 - y0) THEN pr ELSE r END, CASE WHEN abs(x1 - x0) >= abs(y1 - y0) THEN c ELSE pc END
  FROM before WHERE k > 0 AND r <> pr AND c <> pc)"""

VOTES = f"""{PATHS},
moves AS (
  SELECT *, lead(r) OVER s AS nr, lead(c) OVER s AS nc, lag(r) OVER s AS br, lag(c) OVER s AS bc, count(*) OVER (PARTITION BY grid_id, feature_id, part, seg) AS n
  FROM path WINDOW s AS (PARTITION BY grid_id, feature_id, part, seg ORDER BY k)),
coded AS (
  SELECT *, coalesce(nr, r) - CASE WHEN nr IS NULL THEN br ELSE r END AS dr, coalesce(nc, c) - CASE WHEN nr IS NULL THEN bc ELSE c END AS dc FROM moves WHERE n > 1),
seg_votes AS (
  SELECT grid_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CASE WHEN dc > 0 THEN 1 WHEN dr > 0 THEN 2 WHEN dc < 0 THEN 3 ELSE 4 END AS d,
         CAST(sum(CAST(round_even(greatest(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / greatest(n - 1, 1), 1.0) * CASE WHEN nr IS NULL THEN 0.35 ELSE 1 END * 1e6, 0) AS BIGINT)) AS BIGINT) AS w
  FROM coded GROUP BY 1, 2, 3, 4)"""


def _paths(spark, sf_dir):
    s = fx.segments(spark, sf_dir)
    return raster.segment_paths(raster.oriented(s), fx.ROWS, fx.COLS, fx.extent(s))


@query(f"WITH {PATHS} SELECT feature_id, seg, count(*) AS cells, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(c) AS BIGINT) AS sum_c FROM path GROUP BY 1, 2")
def line_cells(spark, sf_dir):
    sums = [F.aggregate(F.transform("path", field), F.lit(0).cast("long"), lambda a, x: a + x).alias(name) for name, field in (("sum_r", lambda p: p["r"]), ("sum_c", lambda p: p["c"]))]
    return _paths(spark, sf_dir).select("feature_id", "seg", F.size("path").cast("long").alias("cells"), *sums)


@query(f"WITH {VOTES} SELECT grid_id, r, c, d, round(w / 1e6, 3) AS w FROM seg_votes")
def raster_votes(spark, sf_dir):
    s = fx.segments(spark, sf_dir)
    return raster.segment_votes(raster.oriented(s), fx.ROWS, fx.COLS, fx.extent(s)).select("grid_id", "r", "c", "d", F.round(F.col("w") / 1e6, 3).alias("w"))


@query(f"WITH {VOTES} SELECT grid_id, r, c, CAST(arg_max(d, w * 10 - d) AS INT) AS d FROM seg_votes GROUP BY 1, 2, 3")
def raster_argmax(spark, sf_dir):
    s = fx.segments(spark, sf_dir)
    return raster.rasterise(s, fx.ROWS, fx.COLS, fx.extent(s))


@query("SELECT feature_id, seg, CASE WHEN start_h IS NULL OR end_h IS NULL THEN 'missing' WHEN abs(start_h) <= 1e-9 AND abs(end_h) <= 1e-9 THEN 'zero' WHEN start_h < end_h THEN 'reversed' WHEN start_h > end_h THEN 'forward' ELSE 'equal' END AS height_rule FROM (" + fx.SEGMENTS.replace("{minutes}", "epoch_us(ts) // 60000000").replace("{events}", "events") + ")")
def height_rules(spark, sf_dir):
    """What the heights say of each segment's direction."""
    return raster.oriented(fx.segments(spark, sf_dir)).select("feature_id", "seg", "height_rule")


@query(f"WITH {fx.cells_cte()} SELECT grid_id, r, c, d FROM cells")
def argmax_dir(spark, sf_dir):
    return fx.cells(spark, sf_dir)


@query(f"""
WITH v AS ({fx.votes_sql(4).format(lineitem="lineitem")}), p AS (SELECT grid_id, r, c, list_reverse_sort(list(w)) AS v, CAST(sum(w) AS DOUBLE) AS t FROM v GROUP BY 1, 2, 3),
q AS (SELECT *, CAST(v[1] AS DOUBLE) AS b, coalesce(CAST(v[2] AS DOUBLE), 0.0) AS s FROM p),
o AS (SELECT *, len(list_filter(v, lambda x: x > b * 0.25)) >= 2 AS overlap FROM q)
SELECT grid_id, r, c, round(least(1.0, 0.45 + 0.35 * b / t + 0.2 * (b - s) / b) * CASE WHEN overlap THEN 0.82 ELSE 1 END, 6) AS conf, overlap FROM o""")
def confidence_overlap(spark, sf_dir):
    return raster.confidence(fx.votes(spark, sf_dir, 4)).select("grid_id", "r", "c", F.round("conf", 6).alias("conf"), "overlap")


@query(f"""
WITH v AS ({fx.votes_sql(4).format(lineitem="lineitem")}), p AS (SELECT grid_id, r, c, list_reverse_sort(list(w)) AS v, sum(w) / 300.0 AS t FROM v GROUP BY 1, 2, 3)
SELECT grid_id, r, c, round(least(t / 4, 1.0) * (0.6 * v[1] / 300.0 / t + 0.4 * (v[1] - coalesce(v[2], 0)) / v[1]) * pi(), 5) AS strength FROM p""")
def vote_strength(spark, sf_dir):
    v = fx.votes(spark, sf_dir, 4).withColumn("w", F.col("w") / 300)
    return raster.vote_strength(v).select("grid_id", "r", "c", F.round(F.col("strength") * F.pi(), 5).alias("strength"))


@query(f"""
WITH {PATHS}, lens AS (SELECT grid_id, feature_id, seg, x0, y0, x1, y1, start_h, end_h, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, count(*) AS n, list({{'r': r, 'c': c}}) AS cells
  FROM path WHERE start_h IS NOT NULL AND end_h IS NOT NULL AND NOT (abs(start_h) <= 1e-9 AND abs(end_h) <= 1e-9) GROUP BY ALL),
slopes AS (SELECT feature_id, abs(any_value(start_h) - any_value(end_h)) / sum(len) AS slope FROM lens GROUP BY 1),
u AS (SELECT grid_id, slope, greatest(len / n, 1e-12) AS weight, unnest(cells) AS cell FROM lens JOIN slopes USING (feature_id)),
per AS (SELECT grid_id, cell.r, cell.c, sum(slope * weight) / sum(weight) AS slope FROM u GROUP BY 1, 2, 3)
SELECT grid_id, count(*) AS cells, round(avg(slope), 5) AS slope, round(avg(slope) * 100, 3) AS percent, round(avg(slope) * 1000, 2) AS per_mille FROM per GROUP BY 1""")
def slope_mean(spark, sf_dir):
    s = fx.segments(spark, sf_dir)
    per = raster.slope_cells(raster.oriented(s), fx.ROWS, fx.COLS, fx.extent(s))
    m = F.avg("slope")
    return per.groupBy("grid_id").agg(F.count("*").alias("cells"), F.round(m, 5).alias("slope"), F.round(m * 100, 3).alias("percent"), F.round(m * 1000, 2).alias("per_mille"))


@query(f"""
WITH {PATHS}, lens AS (SELECT grid_id, feature_id, seg, x0, y0, x1, y1, start_h, end_h, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, count(*) AS n, list({{'r': r, 'c': c}}) AS cells
  FROM path WHERE start_h IS NOT NULL AND end_h IS NOT NULL AND NOT (abs(start_h) <= 1e-9 AND abs(end_h) <= 1e-9) GROUP BY ALL),
slopes AS (SELECT feature_id, abs(any_value(start_h) - any_value(end_h)) / sum(len) AS slope FROM lens GROUP BY 1),
u AS (SELECT grid_id, slope, greatest(len / n, 1e-12) AS weight, unnest(cells) AS cell FROM lens JOIN slopes USING (feature_id)),
per AS (SELECT grid_id, cell.r, cell.c, sum(slope * weight) / sum(weight) AS slope FROM u GROUP BY 1, 2, 3)
SELECT grid_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(slope, 6) AS slope FROM per""")
def slope_cells(spark, sf_dir):
    """Slope of each cell."""
    s = fx.segments(spark, sf_dir)
    return raster.slope_cells(raster.oriented(s), fx.ROWS, fx.COLS, fx.extent(s)).select("grid_id", "r", "c", F.round("slope", 6).alias("slope"))


# DuckDB: depth of each cell by walking up from the cells whose flow leaves the grid
UP = """ends AS (SELECT a.* FROM cells a LEFT JOIN cells b ON a.grid_id = b.grid_id AND a.nr = b.r AND a.nc = b.c WHERE b.r IS NULL),
up AS (SELECT grid_id, r, c, r AS sink_r, c AS sink_c, 0 AS depth FROM ends
       UNION ALL SELECT a.grid_id, a.r, a.c, u.sink_r, u.sink_c, u.depth + 1 FROM up u JOIN cells a ON a.grid_id = u.grid_id AND a.nr = u.r AND a.nc = u.c)"""


@query(f"WITH RECURSIVE {fx.cells_cte()}, {UP} SELECT grid_id, r, c, sink_r, sink_c, CAST(depth AS BIGINT) AS depth FROM up")
def sink_depth(spark, sf_dir):
    t = graph.trace(fx.cells(spark, sf_dir)).where("sink IS NOT NULL")
    return t.select("grid_id", graph.row_of("id").alias("r"), graph.col_of("id").alias("c"), graph.row_of("sink").alias("sink_r"), graph.col_of("sink").alias("sink_c"), "depth")


@query(f"""WITH RECURSIVE {fx.cells_cte(4)}, {UP}, n AS (SELECT grid_id, sink_r AS r, sink_c AS c, count(*) AS cells FROM up GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grid_id ORDER BY cells DESC, r, c) AS INT) AS place FROM n) WHERE place <= 12""")
def outlet_rank(spark, sf_dir):
    return graph.rank_outlets(fx.cells(spark, sf_dir, 4))


@query(f"WITH RECURSIVE {fx.cells_cte()}, {UP} SELECT grid_id, CAST(depth AS BIGINT) AS distance, count(*) AS cells FROM up GROUP BY 1, 2")
def width_function(spark, sf_dir):
    """Cells by their distance to the outlet."""
    t = graph.trace(fx.cells(spark, sf_dir)).where("sink IS NOT NULL")
    return t.groupBy("grid_id", F.col("depth").alias("distance")).agg(F.count("*").alias("cells"))


OUTLETS = f"outlets AS (SELECT DISTINCT grid_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM cells, (VALUES (7, 9), (20, 31), (39, 49), (12, 3)) AS o(r, c))".replace("cells,", "(SELECT DISTINCT grid_id FROM cells),")


def _outlets(cells):
    spots = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((7, 9), (20, 31), (39, 49), (12, 3))])
    return cells.select("grid_id").distinct().select("grid_id", F.explode(spots).alias("o")).select("grid_id", "o.r", "o.c")


REACH = f"""WITH RECURSIVE {{cells}}, {OUTLETS},
reach AS (SELECT grid_id, r, c FROM outlets UNION SELECT a.grid_id, a.r, a.c FROM reach u JOIN cells a ON a.grid_id = u.grid_id AND a.nr = u.r AND a.nc = u.c)"""


@query(REACH.format(cells=fx.cells_cte(4)) + " SELECT grid_id, r, c FROM reach")
def reach_outlet(spark, sf_dir):
    cells = fx.cells(spark, sf_dir, 4)
    return graph.reaching(cells, _outlets(cells))


@query(REACH.format(cells=fx.cells_cte(4)) + """,
m AS (SELECT a.*, b.r IS NOT NULL AS onward, a.nr BETWEEN 0 AND 39 AND a.nc BETWEEN 0 AND 49 AS inside FROM cells a ANTI JOIN outlets o ON a.grid_id = o.grid_id AND a.r = o.r AND a.c = o.c
      LEFT JOIN cells b ON a.grid_id = b.grid_id AND a.nr = b.r AND a.nc = b.c),
w AS (SELECT grid_id, r AS sr, c AS sc, nr AS r, nc AS c FROM m WHERE onward
      UNION SELECT w.grid_id, sr, sc, m.nr, m.nc FROM w JOIN m ON m.grid_id = w.grid_id AND m.r = w.r AND m.c = w.c WHERE m.onward),
deg AS (SELECT grid_id, nr AS r, nc AS c, count(*) AS n FROM m WHERE onward GROUP BY 1, 2, 3),
a AS (SELECT cells.grid_id, count(*) AS active, count(*) FILTER (n IS NULL) AS sources, count(*) FILTER (n >= 2) AS junctions, count(*) FILTER (h.r IS NOT NULL) AS connected
      FROM cells LEFT JOIN deg USING (grid_id, r, c) LEFT JOIN reach h ON h.grid_id = cells.grid_id AND h.r = cells.r AND h.c = cells.c GROUP BY 1)
SELECT a.grid_id, active, sources, junctions, connected, active - connected AS unreachable,
       (SELECT count(*) FROM m WHERE m.grid_id = a.grid_id AND inside AND NOT onward) AS dead_ends, (SELECT count(*) FROM m WHERE m.grid_id = a.grid_id AND NOT inside) AS exits,
       (SELECT count(*) FROM w WHERE w.grid_id = a.grid_id AND sr = w.r AND sc = w.c) AS cycle_cells, (SELECT count(*) FROM outlets o WHERE o.grid_id = a.grid_id) AS outlets
FROM a""")
def inspect_counts(spark, sf_dir):
    cells = graph.cut(fx.cells(spark, sf_dir, 4))
    grids = cells.select("grid_id").distinct().select("grid_id", F.lit(fx.ROWS).alias("rows"), F.lit(fx.COLS).alias("cols"))
    return graph.inspect(cells, grids, _outlets(cells))


@query(REACH.format(cells=fx.cells_cte(4, keep="(r + c) % 9 > 0")) + """
SELECT grid_id, count(*) FILTER (NOT (r >= 2 AND c < 45)) AS outside, count(*) FILTER (r >= 2 AND c < 45 AND NOT EXISTS (FROM reach h WHERE h.grid_id = cells.grid_id AND h.r = cells.r AND h.c = cells.c)) AS unreachable
FROM cells GROUP BY 1""")
def sanitize_counts(spark, sf_dir):
    """What an export drops: cells outside the workspace mask, and cells inside that reach no outlet."""
    cells = fx.cells(spark, sf_dir, 4, keep="(r + c) % 9 > 0")
    inside = (F.col("r") >= 2) & (F.col("c") < 45)
    good = graph.reaching(cells, _outlets(cells)).withColumn("good", F.lit(True))
    return cells.join(good, ["grid_id", "r", "c"], "left").groupBy("grid_id").agg(F.count_if(~inside).alias("outside"), F.count_if(inside & F.col("good").isNull()).alias("unreachable"))


CHAINS = f"""WITH RECURSIVE {fx.cells_cte()}, {UP},
main AS (SELECT grid_id, sink_r, sink_c FROM (SELECT grid_id, sink_r, sink_c, row_number() OVER (PARTITION BY grid_id ORDER BY count(*) DESC, sink_c, sink_r) AS k FROM up GROUP BY 1, 2, 3) WHERE k = 1),
basin AS (SELECT cells.*, depth FROM up JOIN main USING (grid_id, sink_r, sink_c) JOIN cells USING (grid_id, r, c)),
walk AS (SELECT grid_id, r AS sr, c AS sc, r, c, nr, nc, 0 AS n FROM basin
         UNION ALL SELECT w.grid_id, sr, sc, b.r, b.c, b.nr, b.nc, n + 1 FROM walk w JOIN basin b ON b.grid_id = w.grid_id AND b.r = w.nr AND b.c = w.nc),
best AS (SELECT grid_id, r, c, any_value(nr) AS nr, any_value(nc) AS nc, max(n) AS n, arg_max(sr, n * 1000000 - sc * 1000 - sr) AS sr, arg_max(sc, n * 1000000 - sc * 1000 - sr) AS sc FROM walk GROUP BY 1, 2, 3),
rated AS (SELECT *, row_number() OVER (PARTITION BY grid_id, nr, nc ORDER BY n DESC, sc, sr) AS k, EXISTS (FROM basin b WHERE b.grid_id = best.grid_id AND b.r = best.nr AND b.c = best.nc) AS onward FROM best),
chains AS (SELECT grid_id, r, c, CAST(n + 1 AS BIGINT) AS length, sr AS start_r, sc AS start_c FROM rated WHERE k > 1 OR NOT onward)"""


@query(CHAINS + " SELECT grid_id, r, c, length, start_r, start_c FROM chains")
def gamma_chains(spark, sf_dir):
    chains = graph.flowlines(fx.cells(spark, sf_dir))
    return chains.select("grid_id", graph.row_of("head").alias("r"), graph.col_of("head").alias("c"), "length", graph.row_of("start").alias("start_r"), graph.col_of("start").alias("start_c"))


@query(CHAINS + """, p AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY length DESC) AS k, count(*) OVER (PARTITION BY grid_id) AS n FROM chains)
SELECT grid_id, CAST(sum(length) AS BIGINT) AS cells, count(*) AS chains, max(length) AS longest, round(sum(length * length) / sum(length), 6) AS centre, round(avg(length), 6) AS mean,
       round(coalesce(stddev_samp(length), 0), 6) AS deviation, round(sum(length) FILTER (k <= greatest(1, ceil(n * 0.1))) / sum(length), 6) AS top_share,
       round(sum(length * length) / sum(length) / max(length), 6) AS gamma FROM p GROUP BY 1""")
def gamma_index(spark, sf_dir):
    g = graph.gamma_index(graph.flowlines(fx.cells(spark, sf_dir)))
    return g.select("grid_id", "cells", "chains", "longest", *[F.round(c, 6).alias(c) for c in ("centre", "mean", "deviation", "top_share", "gamma")])


SEEDS = "(r * 7 + c * 3) % 41 = 0"
FULL = f"full_grid AS (SELECT grid_id, r, c FROM (SELECT DISTINCT grid_id FROM cells), range({fx.ROWS}) a(r), range({fx.COLS}) b(c))"


def _full(cells):
    grids = cells.select("grid_id").distinct()
    return grids.select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(fx.ROWS - 1))).alias("r")).select("grid_id", "r", F.explode(F.sequence(F.lit(0), F.lit(fx.COLS - 1))).alias("c"))


@query(f"WITH {fx.cells_cte(2, keep=SEEDS)}, {FULL} SELECT f.grid_id, CAST(f.r AS INT) AS r, CAST(f.c AS INT) AS c, CAST(min(abs(f.r - s.r) + abs(f.c - s.c)) AS INT) AS dist FROM full_grid f JOIN cells s USING (grid_id) GROUP BY 1, 2, 3")
def fill_distance(spark, sf_dir):
    cells = fx.cells(spark, sf_dir, 2, keep=SEEDS)
    return graph.fill_basin(cells, _full(cells)).select("grid_id", "r", "c", "dist")


@query(f"""WITH {fx.cells_cte(2, keep=SEEDS)}, {FULL},
near AS (SELECT f.grid_id, f.r, f.c, min(abs(f.r - s.r) + abs(f.c - s.c)) AS dist FROM full_grid f JOIN cells s USING (grid_id) GROUP BY 1, 2, 3)
SELECT grid_id, count(*) FILTER (dist = 0) AS seeds, count(*) FILTER (dist > 0) AS filled, count(*) FILTER (dist > 0) AS downhill FROM near GROUP BY 1""")
def fill_direction(spark, sf_dir):
    """Seeds, filled cells, and filled cells whose direction leads to a cell one step nearer (all must)."""
    cells = fx.cells(spark, sf_dir, 2, keep=SEEDS)
    filled = graph.fill_basin(cells, _full(cells))
    ahead = filled.select("grid_id", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("dist").alias("ahead"))
    out = graph.target(filled).join(ahead, ["grid_id", "nr", "nc"], "left")
    new = F.col("dist") > 0
    return out.groupBy("grid_id").agg(F.count_if(~new).alias("seeds"), F.count_if(new).alias("filled"), F.count_if(new & (F.col("ahead") == F.col("dist") - 1)).alias("downhill"))


@query(f"WITH {fx.cells_cte()}, {FULL}, {OUTLETS} SELECT f.grid_id, CAST(f.r AS INT) AS r, CAST(f.c AS INT) AS c, CAST(min(abs(f.r - s.r) + abs(f.c - s.c)) AS INT) AS dist FROM full_grid f JOIN outlets s USING (grid_id) GROUP BY 1, 2, 3")
def nearest_outlet(spark, sf_dir):
    cells = fx.cells(spark, sf_dir)
    stops = _outlets(cells).withColumn("label", F.col("r") * 100 + F.col("c"))
    return graph.partition_by_outlet(_full(cells), stops).select("grid_id", "r", "c", "dist")


@query(f"""WITH RECURSIVE {fx.cells_cte(2, keep='d = 1')},
reach AS (SELECT grid_id, r, c, r AS ar, c AS ac FROM cells UNION SELECT x.grid_id, b.r, b.c, ar, ac FROM reach x JOIN cells b ON b.grid_id = x.grid_id AND abs(b.r - x.r) + abs(b.c - x.c) = 1 AND (b.r * 1000 + b.c) >= (ar * 1000 + ac) WHERE ar * 1000 + ac <= 100000000),
lows AS (SELECT grid_id, r, c, min(ar * 1000 + ac) AS low FROM reach GROUP BY 1, 2, 3)
SELECT grid_id, r, c, CAST(dense_rank() OVER (PARTITION BY grid_id ORDER BY low) - 1 AS INT) AS component FROM lows""")
def components4(spark, sf_dir):
    return graph.components(fx.cells(spark, sf_dir, 2, keep="d = 1"))


@query(f"""WITH {fx.cells_cte(4, keep="(r * c) % 3 > 0")},
x AS (SELECT a.grid_id, a.r, a.c, (SELECT count(*) FROM cells b WHERE b.grid_id = a.grid_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1) AS degree, (SELECT count(*) FROM cells b WHERE b.grid_id = a.grid_id AND b.nr = a.r AND b.nc = a.c) AS incoming FROM cells a)
SELECT grid_id, r, c, degree, incoming, round(coalesce(degree / nullif(max(degree) OVER g, 0), 0), 6) AS degree_share, round(coalesce(incoming / nullif(max(incoming) OVER g, 0), 0), 6) AS incoming_share FROM x WINDOW g AS (PARTITION BY grid_id)""")
def degree_maps(spark, sf_dir):
    d = graph.degrees(fx.cells(spark, sf_dir, 4, keep="(r * c) % 3 > 0"))
    return d.select("grid_id", "r", "c", "degree", "incoming", F.round("degree_share", 6).alias("degree_share"), F.round("incoming_share", 6).alias("incoming_share"))


@query(f"""WITH RECURSIVE {fx.cells_cte(4, keep="(r * c) % 3 > 0")},
w AS (SELECT grid_id, r AS sr, c AS sc, nr, nc, 0 AS n FROM cells UNION ALL SELECT w.grid_id, sr, sc, a.nr, a.nc, n + 1 FROM w JOIN cells a ON a.grid_id = w.grid_id AND a.r = w.nr AND a.c = w.nc WHERE n < 6)
SELECT grid_id, sr AS r, sc AS c, CAST(max(n) AS INT) AS run FROM w GROUP BY 1, 2, 3""")
def run_length6(spark, sf_dir):
    return graph.run_lengths(fx.cells(spark, sf_dir, 4, keep="(r * c) % 3 > 0"))


@query(f"""WITH RECURSIVE {fx.cells_cte()},
w AS (SELECT grid_id, r AS sr, c AS sc, r, c, nr, nc FROM cells UNION ALL SELECT w.grid_id, sr, sc, a.r, a.c, a.nr, a.nc FROM w JOIN cells a ON a.grid_id = w.grid_id AND a.r = w.nr AND a.c = w.nc)
SELECT grid_id, r, c, count(*) AS passing FROM w GROUP BY 1, 2, 3""")
def flow_accumulation(spark, sf_dir):
    return graph.through_counts(fx.cells(spark, sf_dir))


@query(f"""WITH RECURSIVE {fx.cells_cte()},
w AS (SELECT grid_id, r AS sr, c AS sc, r, c, nr, nc FROM cells UNION ALL SELECT w.grid_id, sr, sc, a.r, a.c, a.nr, a.nc FROM w JOIN cells a ON a.grid_id = w.grid_id AND a.r = w.nr AND a.c = w.nc),
t AS (SELECT grid_id, r // 4 AS r, c // 5 AS c, CASE WHEN nc // 5 > c // 5 THEN 1 WHEN nr // 4 > r // 4 THEN 2 END AS d, count(*) AS t FROM w WHERE nr < 40 AND nc < 50 GROUP BY 1, 2, 3, 4 HAVING d IS NOT NULL),
v AS (SELECT grid_id, r // 4 AS r, c // 5 AS c, d, count(*) AS w FROM cells GROUP BY 1, 2, 3, 4),
s AS (SELECT grid_id, r, c FROM v UNION SELECT grid_id, r + CASE d WHEN 2 THEN 1 ELSE 0 END, c + CASE d WHEN 1 THEN 1 ELSE 0 END FROM t),
o AS (SELECT s.*, d, r + [0, 1, 0, -1][d] AS nr, c + [1, 0, -1, 0][d] AS nc FROM s, (VALUES (1), (2), (3), (4)) k(d)),
p AS (SELECT o.*, coalesce(t, 0) AS t, coalesce(w / sum(w) OVER g, 0) AS vote, coalesce(t / sum(t) OVER g, 0) AS move FROM o LEFT JOIN t USING (grid_id, r, c, d) LEFT JOIN v USING (grid_id, r, c, d) WINDOW g AS (PARTITION BY o.grid_id, o.r, o.c)),
e AS (SELECT *, CASE WHEN move <= 0 AND vote <= 0 THEN 3.0 ELSE least(3.0, greatest(0.12, 1.75 - 1.15 * move - 0.5 * vote - CASE WHEN move > 0.55 THEN 0.2 ELSE 0 END)) END AS cost FROM p WHERE EXISTS (FROM s WHERE s.grid_id = p.grid_id AND s.r = p.nr AND s.c = p.nc))
SELECT grid_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(d AS INT) AS d, round(least(1.0, 0.25 + 0.45 * move + 0.3 * vote), 3) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, r, c ORDER BY cost, t DESC, vote DESC, d) AS k FROM e) WHERE k = 1""")
def compress_votes(spark, sf_dir):
    return graph.compress(fx.cells(spark, sf_dir), (fx.ROWS, fx.COLS), (10, 10)).select("grid_id", "r", "c", "d", F.round("conf", 3).alias("conf"))
