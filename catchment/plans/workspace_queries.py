"""Queries on the workspace of a grid, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.functions import geometry
from catchment.operators import graph, masks, spatial, workspace
from catchment.plans import fixtures as fx
from catchment.plans.grid_queries import OUTLETS, _full, _outlets

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


#: A drawn polygon in image pixels (500 x 400), corners in order.
CORNERS = ((60.4, 50.0), (430.0, 30.6), (470.0, 210.0), (300.0, 170.0), (310.0, 380.0), (90.0, 330.0))
WIDTH, HEIGHT = 500, 400


def _corners(cells):
    ring = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate(CORNERS)])
    return cells.select("grid_id").distinct().select("grid_id", F.explode(ring).alias("p")).select("grid_id", "p.*")


def _grids(cells):
    return cells.select("grid_id").distinct().select("grid_id", F.lit(fx.ROWS).alias("rows"), F.lit(fx.COLS).alias("cols"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def _lasso(cells):
    return workspace.polygon_cells(_corners(cells), _grids(cells))


_RING = ", ".join(f"({round(x)}.0, {round(y)}.0, {round(CORNERS[(k + 1) % len(CORNERS)][0])}.0, {round(CORNERS[(k + 1) % len(CORNERS)][1])}.0)" for k, (x, y) in enumerate(CORNERS))
LASSO = f"""grids AS (SELECT DISTINCT grid_id FROM cells), lasso AS (
  SELECT grid_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM (SELECT grid_id, r, c, (c + 0.5) * {WIDTH / fx.COLS} AS x, (r + 0.5) * {HEIGHT / fx.ROWS} AS y FROM grids, range({fx.ROWS}) a(r), range({fx.COLS}) b(c)),
    (VALUES {_RING}) e(x0, y0, x1, y1) GROUP BY 1, 2, 3
  HAVING count(*) FILTER ((y0 > y) <> (y1 > y) AND x < x0 + (x1 - x0) * ((y - y0) / nullif(y1 - y0, 0))) % 2 = 1
    OR bool_or(abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) <= 1e-9 * greatest(abs(x1 - x0), abs(y1 - y0), 1) AND x BETWEEN least(x0, x1) - 1e-9 AND greatest(x0, x1) + 1e-9 AND y BETWEEN least(y0, y1) - 1e-9 AND greatest(y0, y1) + 1e-9))"""


@query(f"WITH {fx.cells_cte(4)}, {LASSO} SELECT grid_id, r, c FROM lasso")
def lasso_cells(spark, sf_dir):
    """Cells inside a drawn polygon."""
    return _lasso(fx.cells(spark, sf_dir, 4))


@query(f"WITH {fx.cells_cte(4)}, {LASSO} SELECT grid_id, r, c, CASE WHEN l.r IS NULL THEN 0 ELSE d END AS d, CASE WHEN l.r IS NULL THEN 0 ELSE (r * 7 + c) % 5 END AS conf, l.r IS NULL AS dropped FROM cells LEFT JOIN (SELECT * FROM lasso) l USING (grid_id, r, c)".replace("l.r IS NULL", "l.one IS NULL").replace("(SELECT * FROM lasso) l", "(SELECT *, 1 AS one FROM lasso) l"))
def lasso_layers(spark, sf_dir):
    """Aligned layers, cleared outside the LASSO."""
    cells = fx.cells(spark, sf_dir, 4)
    layers = cells.withColumn("conf", (F.col("r") * 7 + F.col("c")) % 5)
    return workspace.apply_lasso(layers, ["d", "conf"], _outlets(cells), _lasso(cells))[0]


@query(f"WITH {fx.cells_cte(4)}, {LASSO}, {OUTLETS}, kept AS (SELECT o.* FROM outlets o SEMI JOIN lasso l ON o.grid_id = l.grid_id AND o.r = l.r AND o.c = l.c) SELECT grid_id, CAST(min(r * 1000 + c) // 1000 AS INT) AS r, CAST(min(r * 1000 + c) % 1000 AS INT) AS c, count(*) - 1 AS others FROM kept GROUP BY 1")
def lasso_outlets(spark, sf_dir):
    """The outlets that the LASSO leaves: the one that an export takes, and how many it drops."""
    cells = fx.cells(spark, sf_dir, 4)
    return workspace.active_outlets(masks.within(_outlets(cells), _lasso(cells)), _grids(cells))


SANE = f"""WITH RECURSIVE {fx.cells_cte(4, keep='(r + c) % 9 > 0')}, {LASSO}, {OUTLETS},
held AS (SELECT cells.* FROM cells SEMI JOIN lasso l ON cells.grid_id = l.grid_id AND cells.r = l.r AND cells.c = l.c),
reach AS (SELECT grid_id, r, c FROM outlets UNION SELECT a.grid_id, a.r, a.c FROM reach u JOIN held a ON a.grid_id = u.grid_id AND a.nr = u.r AND a.nc = u.c),
kept AS (SELECT held.grid_id, held.r, held.c, held.d FROM held SEMI JOIN reach h ON h.grid_id = held.grid_id AND h.r = held.r AND h.c = held.c)"""


@query(SANE + " SELECT * FROM kept")
def sanitised_matrix(spark, sf_dir):
    """The cells that an export keeps."""
    cells = graph.cut(fx.cells(spark, sf_dir, 4, keep="(r + c) % 9 > 0"))
    return workspace.sanitise(cells, _outlets(cells), _lasso(cells))[0].select("grid_id", "r", "c", "d")


@query(SANE + """, n AS (SELECT g.grid_id, (SELECT count(*) FROM cells x WHERE x.grid_id = g.grid_id) AS a, (SELECT count(*) FROM held x WHERE x.grid_id = g.grid_id) AS b, (SELECT count(*) FROM kept x WHERE x.grid_id = g.grid_id) AS k FROM grids g)
SELECT grid_id, a - b AS outside, b - k AS unreachable, printf('outside %d, unreachable %d', a - b, b - k) AS note FROM n""")
def sanitised_counts(spark, sf_dir):
    cells = graph.cut(fx.cells(spark, sf_dir, 4, keep="(r + c) % 9 > 0"))
    counts = workspace.sanitise(cells, _outlets(cells), _lasso(cells))[1]
    return counts.withColumn("note", workspace.sanitise_note(F.col("outside"), F.col("unreachable")))


@query(f"WITH {fx.cells_cte(4, keep='r BETWEEN 9 AND 30 AND c BETWEEN 12 AND 44')}, {LASSO}, m AS (SELECT grid_id, r, c FROM cells WHERE d = 1 UNION SELECT grid_id, r, c FROM cells WHERE d = 3 UNION SELECT grid_id, r, c FROM lasso WHERE r > 20) SELECT grid_id, CAST(greatest(0, min(r) - 1) AS INT) AS top, CAST(least(40, max(r) + 2) AS INT) AS bottom, CAST(greatest(0, min(c) - 1) AS INT) AS left, CAST(least(50, max(c) + 2) AS INT) AS right FROM m GROUP BY 1")
def workspace_extent(spark, sf_dir):
    """Bounds of all support layers and the effective basin."""
    cells = fx.cells(spark, sf_dir, 4, keep="r BETWEEN 9 AND 30 AND c BETWEEN 12 AND 44")
    return workspace.extent([cells.where("d = 1"), cells.where("d = 3")], _full(cells).where("r > 20"), _lasso(cells), _grids(cells))


@query(f"WITH {fx.cells_cte(4)}, {LASSO} SELECT grid_id, r, c, r < 25 AS fill, c % 3 > 0 AS edit FROM lasso WHERE r < 25 OR c % 3 > 0")
def region_masks(spark, sf_dir):
    """What a fill and what an edit may touch: a basin limits the fill only, a drawn clip the edits too."""
    cells = fx.cells(spark, sf_dir, 4)
    lasso = _lasso(cells)
    fill = workspace.effective_mask(_full(cells).where("r < 25"), lasso).withColumn("fill", F.lit(True))
    edit = workspace.edit_mask(lasso, _full(cells).where("c % 3 > 0")).withColumn("edit", F.lit(True))
    return fill.join(edit, ["grid_id", "r", "c"], "full").fillna(False, ["fill", "edit"])


TRIM = f"WITH {fx.cells_cte(keep='r BETWEEN 5 AND 30 AND c BETWEEN 8 AND 44')}, b AS (SELECT grid_id, greatest(0, min(r) - 1) AS top, least(40, max(r) + 2) AS bottom, greatest(0, min(c) - 1) AS lft, least(50, max(c) + 2) AS rgt FROM cells GROUP BY 1)"


def _trimmed(spark, sf_dir):
    cells = fx.cells(spark, sf_dir, keep="r BETWEEN 5 AND 30 AND c BETWEEN 8 AND 44")
    return masks.trim_bounds(cells, _grids(cells)), _grids(cells)


@query(TRIM + " SELECT grid_id, round(127.0 + lft / 50 * 0.5, 9) AS xmin, round(37.75 - bottom / 40 * 0.25, 9) AS ymin, round(127.0 + rgt / 50 * 0.5, 9) AS xmax, round(37.75 - top / 40 * 0.25, 9) AS ymax FROM b")
def trimmed_world_box(spark, sf_dir):
    bounds, grids = _trimmed(spark, sf_dir)
    box = grids.withColumns({"xmin": F.lit(127.0), "ymin": F.lit(37.5), "xmax": F.lit(127.5), "ymax": F.lit(37.75)})
    out = workspace.world_box(bounds, box)
    return out.select("grid_id", *[F.round(c, 9).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(TRIM + " SELECT grid_id, CAST(round_even(top * 400 / 40.0, 0) AS INT) AS y0, CAST(round_even(bottom * 400 / 40.0, 0) AS INT) AS y1, CAST(round_even(lft * 500 / 50.0, 0) AS INT) AS x0, CAST(round_even(rgt * 500 / 50.0, 0) AS INT) AS x1 FROM b")
def trimmed_pixels(spark, sf_dir):
    return workspace.pixel_box(*_trimmed(spark, sf_dir))


@query("SELECT c_custkey AS point_id, round(least(x0, x1), 6) AS xmin, round(least(y0, y1), 6) AS ymin, round(greatest(x0, x1), 6) AS xmax, round(greatest(y0, y1), 6) AS ymax FROM (SELECT c_custkey, 127 + (c_custkey % 500) / 500.0 * 0.5 AS x0, 127 + (c_custkey * 7 % 500) / 500.0 * 0.5 AS x1, 37.75 - (c_custkey % 400) / 400.0 * 0.25 AS y0, 37.75 - (c_custkey * 3 % 400) / 400.0 * 0.25 AS y1 FROM customer)")
def picked_world_box(spark, sf_dir):
    """World boxes of rectangles drawn on an image, corners in any order."""
    k = F.col("c_custkey")
    rect = (k % 500, k % 400, k * 7 % 500, k * 3 % 400)
    box = workspace.image_world_box(rect, tuple(F.lit(v) for v in (127.0, 37.5, 127.5, 37.75)), F.lit(500.0), F.lit(400.0))
    out = fx.read(spark, sf_dir, "customer").select(k.alias("point_id"), box.alias("b"))
    return out.select("point_id", *[F.round(f"b.{c}", 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _area(sql_where: str) -> str:
    return f"""SELECT DISTINCT r, c FROM (SELECT r, c, feature_id FROM (SELECT r, c, 5 + (c + 0.5) * 5.6 AS x, 285 - (r + 0.5) * 7.0 AS y FROM range(40) a(r), range(50) b(c)), rings WHERE {sql_where} GROUP BY 1, 2, 3
  HAVING count(*) FILTER ((y0 > y) <> (y1 > y) AND x < x0 + (x1 - x0) * ((y - y0) / nullif(y1 - y0, 0))) % 2 = 1
    OR bool_or(abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) <= 1e-9 * greatest(abs(x1 - x0), abs(y1 - y0), 1) AND x BETWEEN least(x0, x1) - 1e-9 AND greatest(x0, x1) + 1e-9 AND y BETWEEN least(y0, y1) - 1e-9 AND greatest(y0, y1) + 1e-9))"""


@query(f"WITH {fx.cells_cte(4, keep='r BETWEEN 5 AND 30 AND c BETWEEN 8 AND 44')}, {fx.rings_cte()}, areas AS ({_area('feature_id % 3 = 0')} UNION {_area('feature_id % 3 = 1')}), b AS (SELECT grid_id, greatest(0, min(r) - 1) AS top, greatest(0, min(c) - 1) AS lft FROM cells GROUP BY 1) SELECT grid_id, r - top AS r, c - lft AS c FROM cells JOIN b USING (grid_id) SEMI JOIN areas a ON a.r = cells.r AND a.c = cells.c")
def flood_cells(spark, sf_dir):
    """Cells of a trimmed grid inside any of two flood layers, which lie on the whole grid."""
    cells = fx.cells(spark, sf_dir, 4, keep="r BETWEEN 5 AND 30 AND c BETWEEN 8 AND 44")
    bounds = masks.trim_bounds(cells, _grids(cells))
    rings = fx.rings(spark, sf_dir)
    box = cells.select("grid_id").distinct().withColumns({"rows": F.lit(fx.ROWS), "cols": F.lit(fx.COLS), "xmin": F.lit(5.0), "ymin": F.lit(5.0), "xmax": F.lit(285.0), "ymax": F.lit(285.0)})
    areas = [spatial.basin_mask(rings.where(f"feature_id % 3 = {k}"), box) for k in (0, 1)]
    return workspace.flood_cells(areas, masks.trim(cells, bounds), bounds)


@query(f"WITH {fx.cells_cte(4, name='a')}, {fx.cells_cte(4, weight='l_extendedprice', keep='(r + c) % 7 > 0', name='b')} SELECT a.grid_id, a.r, a.c, CASE WHEN a.r < 25 THEN coalesce(b.d, 0) ELSE 0 END AS d FROM a LEFT JOIN b USING (grid_id, r, c)")
def merged_region(spark, sf_dir):
    """An updated layer inside a region, 0 elsewhere."""
    a = fx.cells(spark, sf_dir, 4)
    return workspace.merge_region(a, fx.cells(spark, sf_dir, 4, weight="l_extendedprice", keep="(r + c) % 7 > 0"), _full(a).where("r < 25"))


@query(f"""WITH {fx.cells_cte(4)}, e AS (SELECT grid_id, r, c, CASE WHEN (r + c) % 2 = 0 THEN 0 ELSE 4 END AS d FROM cells WHERE (r * 3 + c) % 17 = 0),
m AS (SELECT cells.*, coalesce(e.d, cells.d) AS edited_d FROM cells LEFT JOIN e USING (grid_id, r, c) WHERE NOT (cells.r = 20 AND cells.c > 30))
SELECT c.grid_id, c.r, c.c, c.d, CAST(CASE WHEN c.d > 0 THEN 1 ELSE 0 END AS INT) AS support, false AS edited, CAST(coalesce(m.edited_d, 0) AS INT) AS edited_d FROM cells c LEFT JOIN m USING (grid_id, r, c)""")
def restored_grid(spark, sf_dir):
    """A stored grid, edited and with a stretch deleted in its next version, restored from the version before; edited_d is what the edits had made of each cell."""
    from catchment.functions.materialise import folder
    from catchment.sources.snapshots import Snapshots

    base = fx.cells(spark, sf_dir, 4)
    table = Snapshots(spark, folder(spark))
    table.append(base.select("grid_id", "r", "c", "d"), "baseline")
    edits = base.where("(r * 3 + c) % 17 = 0").withColumn("d", F.when((F.col("r") + F.col("c")) % 2 == 0, 0).otherwise(4))
    edited = masks.apply_edits(table.read(), edits).where("NOT (r = 20 AND c > 30)")
    table.replace(edited.select("grid_id", "r", "c", F.col("d").cast("int").alias("d")), table.version(), "edits")
    now = table.read().select("grid_id", "r", "c", F.col("d").alias("edited_d"))
    return workspace.restore(table.read(0)).join(now, ["grid_id", "r", "c"], "left").fillna(0, ["edited_d"])


EDITS = "SELECT l_returnflag AS grid_id, CAST(l_partkey % 47 AS INT) AS r, CAST(l_suppkey % 53 AS INT) AS c, CAST(max(l_linenumber % 5) AS INT) AS d FROM {lineitem} WHERE l_orderkey % 9 = 0 GROUP BY 1, 2, 3"


@query(f"WITH e AS ({EDITS.format(lineitem='lineitem')}) SELECT grid_id, r, c FROM e WHERE r < 40 AND c < 50")
def reviewed_cells(spark, sf_dir):
    """The review mask of a label of corrected cells; corrections outside of the grid don't count."""
    e = spark.sql(EDITS, lineitem=fx.read(spark, sf_dir, "lineitem"))
    return workspace.review_mask(_grids(e), e, False)[0]


@query(f"WITH e AS ({EDITS.format(lineitem='lineitem')}) SELECT grid_id, 40 AS rows, 50 AS cols, count(*) AS corrections, count(*) FILTER (d = 0) AS zero_corrections, 'corrected cells' AS scope FROM e GROUP BY 1")
def review_counts(spark, sf_dir):
    e = spark.sql(EDITS, lineitem=fx.read(spark, sf_dir, "lineitem"))
    return workspace.review_mask(_grids(e).drop("width", "height"), e, False)[1]


@query("""SELECT c_custkey AS sample_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'd/' || c_name || printf('|rot=%.4f', rot) || CASE WHEN c_custkey % 3 = 0 THEN '|boundary=b.shp|field=|value=' || c_nationkey ELSE '' END END AS key FROM (
  SELECT *, CASE c_custkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 360.0 WHEN 2 THEN -12.25 WHEN 3 THEN 0.0 ELSE 0.0 END AS rot FROM customer)""")
def group_keys(spark, sf_dir):
    """Learning groups: file, rotation (of texts, some no numbers), boundary."""
    k = F.col("c_custkey")
    typed = F.element_at(F.array(*map(F.lit, ("abc", "1e9", "-12.25", "NaN", "1e-12"))), (k % 5 + 1).cast("int"))
    value = F.when(k % 3 == 0, F.col("c_nationkey").cast("string"))
    key = workspace.learning_group(F.when(k % 11 != 0, F.concat(F.lit("d/"), F.col("c_name"))), workspace.rotation(typed), F.lit("b.shp"), F.lit(None).cast("string"), value)
    return fx.read(spark, sf_dir, "customer").select(k.alias("sample_id"), key.alias("key"))


AFTER = f"WITH {fx.cells_cte(4)}, l AS (SELECT grid_id, r, c, CASE WHEN (r + c) % 6 = 0 THEN 0 ELSE d END AS d, CASE WHEN r % 2 = 0 THEN d ELSE 0 END AS detected, CASE WHEN c % 4 = 0 THEN 1 ELSE 0 END AS occ, CASE WHEN c % 5 = 0 THEN NULL ELSE c % 2 END AS path_occ, CASE WHEN c % 7 = 0 THEN NULL ELSE r % 2 END AS support, CASE WHEN r % 3 = 0 THEN 1 ELSE 0 END AS applied, (r * 13 + c * 7) % 100 / 100.0 AS conf, (r + 2 * c) % 4 AS overlap FROM cells)"


def _after(spark, sf_dir):
    r, c = F.col("r"), F.col("c")
    d = F.col("d")
    new = {"d": F.when((r + c) % 6 == 0, 0).otherwise(d), "detected": F.when(r % 2 == 0, d).otherwise(0), "occ": (c % 4 == 0).cast("int"), "path_occ": F.when(c % 5 != 0, c % 2), "support": F.when(c % 7 != 0, r % 2), "applied": (r % 3 == 0).cast("int"), "conf": (r * 13 + c * 7) % 100 / 100, "overlap": (r + 2 * c) % 4}
    return fx.cells(spark, sf_dir, 4).withColumns(new)


@query(AFTER + " SELECT grid_id, r, c, d, CASE WHEN applied = 1 AND d = 0 THEN 0 ELSE greatest(occ, CASE WHEN d > 0 OR detected > 0 THEN 1 ELSE 0 END) END AS occ, CASE WHEN applied = 1 AND d = 0 THEN 0 ELSE coalesce(path_occ, CASE WHEN d > 0 OR detected > 0 THEN 1 ELSE 0 END) END AS path_occ, greatest(CASE WHEN d > 0 THEN 1 ELSE 0 END, coalesce(support, CASE WHEN d > 0 OR detected > 0 THEN 1 ELSE 0 END)) AS support FROM l")
def predicted_layers(spark, sf_dir):
    """Support layers after a model's run."""
    return workspace.after_prediction(_after(spark, sf_dir)).select("grid_id", "r", "c", "d", "occ", "path_occ", "support")


@query(AFTER + " SELECT grid_id, count(*) FILTER (d > 0 AND conf < 0.55) AS low_confidence, count(*) FILTER (overlap > 1) AS overlapping FROM l GROUP BY 1")
def attention_counts(spark, sf_dir):
    return workspace.attention(_after(spark, sf_dir))


@query(f"WITH {fx.cells_cte(4, name='a')}, {fx.cells_cte(4, weight='l_extendedprice', keep='(r + c) % 3 > 0', name='b')} SELECT coalesce(a.grid_id, b.grid_id) AS grid_id, coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, coalesce(b.d, a.d) AS d, CASE WHEN b.d IS NULL THEN 'no prediction' END AS reason FROM a FULL JOIN b ON a.grid_id = b.grid_id AND a.r = b.r AND a.c = b.c")
def model_fallback(spark, sf_dir):
    return workspace.model_or_detector(fx.cells(spark, sf_dir, 4), fx.cells(spark, sf_dir, 4, weight="l_extendedprice", keep="(r + c) % 3 > 0"))


@query(f"WITH {fx.rings_cte()} SELECT feature_id, min(least(x0, x1)) AS xmin, min(least(y0, y1)) AS ymin, max(greatest(x0, x1)) AS xmax, max(greatest(y0, y1)) AS ymax FROM rings GROUP BY 1 HAVING min(least(x0, x1)) <= 120 AND max(greatest(x0, x1)) >= 60 AND min(least(y0, y1)) <= 130 AND max(greatest(y0, y1)) >= 45")
def window_areas(spark, sf_dir):
    """Features whose box touches a window."""
    return workspace.outline(fx.rings(spark, sf_dir), (60.0, 45.0, 120.0, 130.0))


@query(f"WITH {fx.rings_cte()}, b AS (SELECT feature_id, min(least(x0, x1)) AS xa, min(least(y0, y1)) AS ya, max(greatest(x0, x1)) AS xb, max(greatest(y0, y1)) AS yb FROM rings GROUP BY 1), i AS (SELECT *, greatest(0, least(xb, 120) - greatest(xa, 20)) * greatest(0, least(yb, 150) - greatest(ya, 30)) AS n FROM b) SELECT feature_id, round(n / ((xb - xa) * (yb - ya) + 12000 - n), 9) AS iou FROM i")
def box_iou(spark, sf_dir):
    areas = spatial.boxes(fx.rings(spark, sf_dir), "feature_id")
    iou = geometry.intersection_over_union(spatial.box_of(), tuple(F.lit(v) for v in (20.0, 30.0, 120.0, 150.0)))
    return areas.select("feature_id", F.round(iou, 9).alias("iou"))


@query(f"WITH RECURSIVE {fx.cells_cte(4)}, {OUTLETS}, reach AS (SELECT grid_id, r, c FROM outlets UNION SELECT a.grid_id, a.r, a.c FROM reach u JOIN cells a ON a.grid_id = u.grid_id AND a.nr = u.r AND a.nc = u.c) SELECT cells.grid_id, cells.r, cells.c, cells.d FROM cells SEMI JOIN reach h ON h.grid_id = cells.grid_id AND h.r = cells.r AND h.c = cells.c")
def bounded_cells(spark, sf_dir):
    """Connected cells, checked against a hard boundary (the whole grid)."""
    cells = fx.cells(spark, sf_dir, 4)
    good = masks.within(cells, graph.reaching(cells, _outlets(cells)))
    return workspace.clip_boundary(good, _full(cells)).select("grid_id", "r", "c", "d")
