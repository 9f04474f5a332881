"""Further queries on the flow graph: coarsening towards an outlet, gaps, guides, progress, removal order, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import graph
from catchment.plans import fixtures as fx
from catchment.plans.grid_queries import CHAINS, OUTLETS, _outlets

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


AT = (20, 31)
SPARSE = "(r * c) % 5 <> 1"

# every start's walk up to the outlet, a repeated cell, an empty cell or the border, and its steps between coarse cells
COARSE = f"""WITH RECURSIVE {fx.cells_cte(4, keep=SPARSE)},
walk AS (SELECT grid_id, r AS sr, c AS sc, r, c, 0 AS k, [r * 1000 + c] AS seen, false AS over FROM cells
  UNION ALL SELECT w.grid_id, sr, sc, a.nr, a.nc, k + 1, list_append(seen, a.nr * 1000 + a.nc), list_contains(seen, a.nr * 1000 + a.nc) FROM walk w JOIN cells a ON a.grid_id = w.grid_id AND a.r = w.r AND a.c = w.c
  WHERE NOT over AND NOT (w.r = {AT[0]} AND w.c = {AT[1]}) AND a.nr BETWEEN 0 AND 39 AND a.nc BETWEEN 0 AND 49),
fate AS (SELECT grid_id, sr, sc, CASE WHEN bool_or(r = {AT[0]} AND c = {AT[1]}) THEN 1.0 ELSE 0.35 END AS share FROM walk GROUP BY 1, 2, 3),
steps AS (SELECT w.grid_id, w.r // 4 AS r, w.c // 5 AS c, lead(w.r // 4) OVER p AS nr, lead(w.c // 5) OVER p AS nc, share, k FROM walk w JOIN fate USING (grid_id, sr, sc) WINDOW p AS (PARTITION BY w.grid_id, sr, sc ORDER BY k)),
moves AS (SELECT grid_id, r, c, CASE WHEN nc > c THEN 1 WHEN nr > r THEN 2 WHEN nc < c THEN 3 ELSE 4 END AS d, sum(share) AS t FROM steps WHERE nr IS NOT NULL AND (nr <> r OR nc <> c) GROUP BY 1, 2, 3, 4),
hits AS (SELECT grid_id, r, c, sum(share) AS hits FROM (SELECT grid_id, r, c, share FROM steps WHERE k = 0 UNION ALL SELECT grid_id, nr, nc, share FROM steps WHERE nr IS NOT NULL AND (nr <> r OR nc <> c)) GROUP BY 1, 2, 3),
votes AS (SELECT grid_id, r // 4 AS r, c // 5 AS c, d, count(*) AS w FROM cells GROUP BY 1, 2, 3, 4),
counts AS (SELECT grid_id, r, c, sum(w) AS n FROM votes GROUP BY 1, 2, 3),
support AS (SELECT grid_id, r, c FROM counts FULL JOIN hits USING (grid_id, r, c) WHERE n >= 1.6 OR round(hits, 6) >= 0.95 UNION SELECT DISTINCT grid_id, {AT[0] // 4}, {AT[1] // 5} FROM cells),
far AS (SELECT DISTINCT grid_id, {AT[0] // 4} AS r, {AT[1] // 5} AS c, 0 AS n FROM cells UNION SELECT s.grid_id, s.r, s.c, n + 1 FROM far f JOIN support s ON s.grid_id = f.grid_id AND abs(s.r - f.r) + abs(s.c - f.c) = 1 WHERE n < 60),
dist AS (SELECT grid_id, r, c, min(n) AS dist FROM far GROUP BY 1, 2, 3),
options AS (SELECT a.grid_id, a.r, a.c, d, b.dist, abs(b.r - {AT[0] // 4}) + abs(b.c - {AT[1] // 5}) AS away FROM dist a, (VALUES (1, 0, 1), (2, 1, 0), (3, 0, -1), (4, -1, 0)) k(d, dr, dc), dist b WHERE b.grid_id = a.grid_id AND b.r = a.r + dr AND b.c = a.c + dc AND a.dist > 0),
rated AS (SELECT o.*, coalesce(t, 0) AS t, coalesce(w / (SELECT sum(v.w) FROM votes v WHERE v.grid_id = o.grid_id AND v.r = o.r AND v.c = o.c), 0) AS vote, coalesce(t / (SELECT sum(m.t) FROM moves m WHERE m.grid_id = o.grid_id AND m.r = o.r AND m.c = o.c), 0) AS move
  FROM options o LEFT JOIN moves USING (grid_id, r, c, d) LEFT JOIN votes USING (grid_id, r, c, d)),
costs AS (SELECT *, CASE WHEN move <= 0 AND vote <= 0 THEN 3.0 ELSE least(3.0, greatest(0.12, 1.75 - 1.15 * move - 0.5 * vote - CASE WHEN move > 0.55 THEN 0.2 ELSE 0 END)) END AS cost FROM rated)"""


def _coarse(spark, sf_dir):
    cells = graph.cut(fx.cells(spark, sf_dir, 4, keep=SPARSE))
    outlets = cells.select("grid_id").distinct().select("grid_id", F.lit(AT[0]).alias("r"), F.lit(AT[1]).alias("c"))
    return graph.compress_to_outlet(cells, outlets, (fx.ROWS, fx.COLS), (10, 10))


@query(COARSE + f""" SELECT grid_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(d AS INT) AS d, round(least(1.0, 0.25 + 0.45 * move + 0.3 * vote), 3) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, r, c ORDER BY dist, round(cost, 9), round(t, 6) DESC, round(vote, 9) DESC, away, d) AS k FROM costs) WHERE k = 1
UNION ALL SELECT DISTINCT grid_id, {AT[0] // 4}, {AT[1] // 5}, 0, 1.0 FROM cells""")
def compress_outlet(spark, sf_dir):
    """A grid with an outlet on 10 x 10 cells."""
    return _coarse(spark, sf_dir)[0].select("grid_id", "r", "c", "d", F.round("conf", 3).alias("conf"))


@query(COARSE + f" SELECT s.grid_id, {AT[0] // 4} AS outlet_r, {AT[1] // 5} AS outlet_c, count(*) - (SELECT count(*) FROM dist x WHERE x.grid_id = s.grid_id) AS dropped FROM support s GROUP BY 1")
def compress_dropped(spark, sf_dir):
    """The coarse outlet, and the cells that can't reach it."""
    return _coarse(spark, sf_dir)[1]


GAPS = "(r + 2 * c) % 7 > 0"


@query(f"""WITH {fx.cells_cte(4, name='whole')}, cells AS (SELECT * FROM whole WHERE {GAPS}),
n AS (SELECT e.grid_id, e.r, e.c, k, back, a.d AS own FROM whole e, (VALUES (-1, 0, 2, 0), (1, 0, 4, 1), (0, -1, 1, 2), (0, 1, 3, 3)) x(dr, dc, back, k), cells a WHERE NOT ((e.r + 2 * e.c) % 7 > 0) AND a.grid_id = e.grid_id AND a.r = e.r + dr AND a.c = e.c + dc),
o AS (SELECT *, row_number() OVER (PARTITION BY grid_id, r, c ORDER BY k) AS i FROM n),
w AS (SELECT s.grid_id, s.r, s.c, CASE WHEN s.own = s.back THEN 1 ELSE 0 END + CASE WHEN t.own = (t.back + 1) % 4 + 1 THEN 1 ELSE 0 END AS agree, least(s.i, t.i) AS i, greatest(s.i, t.i) AS j, CASE WHEN s.i < t.i THEN 0 ELSE 1 END AS way, (t.back + 1) % 4 + 1 AS d FROM o s JOIN o t USING (grid_id, r, c) WHERE s.i <> t.i)
SELECT grid_id, r, c, CAST(d AS INT) AS d FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, r, c ORDER BY agree DESC, i, j, way) AS n FROM w) WHERE n = 1""")
def gap_fills(spark, sf_dir):
    """Directions for one-cell gaps between directed neighbours."""
    whole = fx.cells(spark, sf_dir, 4)
    return graph.gap_fills(whole.where(GAPS), whole)


@query(f"""WITH RECURSIVE {fx.cells_cte(4, name='whole')}, cells AS (SELECT * FROM whole WHERE {GAPS}), {OUTLETS},
routes AS (SELECT grid_id, r, c FROM whole UNION SELECT grid_id, r, c FROM outlets),
far AS (SELECT grid_id, r, c, 0 AS n FROM outlets UNION SELECT s.grid_id, s.r, s.c, n + 1 FROM far f JOIN routes s ON s.grid_id = f.grid_id AND abs(s.r - f.r) + abs(s.c - f.c) = 1 WHERE n < 80 AND s.r BETWEEN 0 AND 39),
dist AS (SELECT grid_id, r, c, min(n) AS dist FROM far GROUP BY 1, 2, 3),
near AS (SELECT e.grid_id, e.r, e.c, e.dist, code, k, b.dist AS next, CASE WHEN b.dist = 0 OR EXISTS (FROM cells x WHERE x.grid_id = b.grid_id AND x.r = b.r AND x.c = b.c) THEN 0 ELSE 1 END AS free
  FROM dist e, (VALUES (-1, 0, 4, 0), (1, 0, 2, 1), (0, -1, 3, 2), (0, 1, 1, 3)) x(dr, dc, code, k), dist b WHERE b.grid_id = e.grid_id AND b.r = e.r + dr AND b.c = e.c + dc AND b.dist < e.dist AND NOT EXISTS (FROM cells x WHERE x.grid_id = e.grid_id AND x.r = e.r AND x.c = e.c))
SELECT grid_id, r, c, CAST(code AS INT) AS d, CAST(dist AS INT) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, r, c ORDER BY next, free, k) AS n FROM near) WHERE n = 1""")
def guided_zeros(spark, sf_dir):
    """Empty support cells led downhill to the outlets."""
    whole = graph.cut(fx.cells(spark, sf_dir, 4))
    return graph.guide_to_outlet(whole.where(GAPS), whole, _outlets(whole))


@query(f"""WITH RECURSIVE {fx.cells_cte(4, keep='(r * c) % 3 > 0')}, {OUTLETS},
walk AS (SELECT grid_id, r AS sr, c AS sc, r, c, 0 AS n FROM cells UNION ALL SELECT w.grid_id, sr, sc, a.nr, a.nc, n + 1 FROM walk w JOIN cells a ON a.grid_id = w.grid_id AND a.r = w.r AND a.c = w.c
  ANTI JOIN outlets o ON o.grid_id = w.grid_id AND o.r = w.r AND o.c = w.c WHERE n < 4 AND (EXISTS (FROM cells x WHERE x.grid_id = a.grid_id AND x.r = a.nr AND x.c = a.nc) OR EXISTS (FROM outlets x WHERE x.grid_id = a.grid_id AND x.r = a.nr AND x.c = a.nc)))
SELECT w.grid_id, sr AS r, sc AS c, CAST(CASE WHEN bool_or(o.r IS NOT NULL AND n < 4) THEN 4 ELSE max(n) END AS INT) AS steps FROM walk w LEFT JOIN outlets o ON o.grid_id = w.grid_id AND o.r = w.r AND o.c = w.c GROUP BY 1, 2, 3""")
def forward_progress(spark, sf_dir):
    """Steps that each flow goes on, four at the most."""
    cells = fx.cells(spark, sf_dir, 4, keep="(r * c) % 3 > 0")
    return graph.progress(cells, _outlets(cells))


@query(CHAINS + ' SELECT grid_id, r, c, length, CAST(sum(length) OVER (PARTITION BY grid_id) - coalesce(sum(length) OVER (PARTITION BY grid_id ORDER BY length DESC, start_r, start_c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "left" FROM chains')
def removal_order(spark, sf_dir):
    """Cells left of the main basin before each flow line is removed."""
    out = graph.remaining(graph.flowlines(fx.cells(spark, sf_dir)))
    return out.select("grid_id", graph.row_of("head").alias("r"), graph.col_of("head").alias("c"), "length", "left")


@query()
def component_path(spark, sf_dir):
    """A shortest path through the cells of one direction and those beside (ties by search order, so no SQL)."""
    cells = graph.cut(fx.cells(spark, sf_dir, 2, keep="d = 1 OR r % 5 = 0"))
    ends = cells.groupBy("grid_id").agg(F.min(graph.cell_id()).alias("a"), F.max(graph.cell_id()).alias("b"))
    ends = ends.select("grid_id", graph.row_of("a").alias("r0"), graph.col_of("a").alias("c0"), graph.row_of("b").alias("r1"), graph.col_of("b").alias("c1"))
    return graph.shortest_path(cells, ends)


@query()
def backbone_path(spark, sf_dir):
    """A longest shortest path of a mask (ties by search order, so no SQL)."""
    return graph.backbone(fx.cells(spark, sf_dir, 2, keep="r % 5 = 0 OR c % 7 = 0"))
