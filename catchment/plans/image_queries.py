"""Queries on pixel graphs, heads and guidance, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import raster, skeleton
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


LINE = "SELECT DISTINCT l_returnflag AS image_id, CAST(l_orderkey % 160 AS INT) AS x, CAST((l_orderkey % 160) * 3 % 120 + l_linenumber % 4 AS INT) AS y FROM {lineitem}"


def _line(spark, sf_dir):
    return spark.sql(LINE, lineitem=fx.read(spark, sf_dir, "lineitem"))


def _grids(line):
    return line.select("image_id").distinct().withColumns({"rows": F.lit(40), "cols": F.lit(50), "width": F.lit(160), "height": F.lit(124)})


LINKS = f"l AS ({LINE.format(lineitem='lineitem')}), k AS (SELECT a.image_id, a.x, a.y, b.x AS nx, b.y AS ny FROM l a JOIN l b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y))"


@query(f"WITH {LINKS} SELECT image_id, x, y, nx, ny FROM k")
def pixel_links(spark, sf_dir):
    """Touching pixels of thinned lines."""
    return skeleton.pixel_links(_line(spark, sf_dir))


@query(f"WITH {LINKS}, d AS (SELECT l.image_id, l.x, l.y, count(nx) AS degree FROM l LEFT JOIN k USING (image_id, x, y) GROUP BY 1, 2, 3) SELECT *, CASE WHEN degree <= 1 THEN 'end' WHEN degree = 2 THEN 'path' ELSE 'branch' END AS kind FROM d")
def pixel_kinds(spark, sf_dir):
    """Ends, paths and branches."""
    return skeleton.pixel_kinds(_line(spark, sf_dir))


@query(f"""WITH {LINKS}, d AS (SELECT l.image_id, l.x, l.y, count(nx) AS degree FROM l LEFT JOIN k USING (image_id, x, y) GROUP BY 1, 2, 3),
n AS (SELECT image_id, x // 40 AS label, count(*) FILTER (degree <= 1) AS ends, count(*) FILTER (degree > 2) AS branches FROM d GROUP BY 1, 2), m AS (SELECT image_id, max(ends) AS ends, max(branches) AS branches, CASE image_id WHEN 'A' THEN 0 WHEN 'N' THEN 3 ELSE 60 END AS heads FROM n GROUP BY 1)
SELECT image_id, (ends >= 8 OR branches >= 8) AND (heads < 2 OR (ends >= 24 AND branches >= 60 AND heads < least(48, greatest(8, round_even(ends * 0.5, 0))))) AS more FROM m""")
def scale_needs(spark, sf_dir):
    """Images whose heads should be looked for on further scales."""
    line = _line(spark, sf_dir)
    labels = line.withColumn("label", F.expr("x div 40"))
    heads = line.select("image_id").distinct().withColumn("heads", F.when(F.col("image_id") == "A", 0).when(F.col("image_id") == "N", 3).otherwise(60))
    return skeleton.needs_more_scales(line, labels, heads)


@query(f"""WITH {LINKS}, c AS (SELECT *, least(39, CAST(floor(y / (124 / 40e0)) AS INT)) AS r, least(49, CAST(floor(x / (160 / 50e0)) AS INT)) AS c, least(39, CAST(floor(ny / (124 / 40e0)) AS INT)) AS nr, least(49, CAST(floor(nx / (160 / 50e0)) AS INT)) AS nc FROM k WHERE (y, x) < (ny, nx))
SELECT image_id AS grid_id, least(39, CAST(floor(y / (124 / 40e0)) AS INT)) AS r, least(49, CAST(floor(x / (160 / 50e0)) AS INT)) AS c FROM l UNION SELECT image_id, r, nc FROM c WHERE r <> nr AND c <> nc""")
def line_support(spark, sf_dir):
    """Four-connected cells under thinned lines."""
    line = _line(spark, sf_dir)
    return skeleton.line_support(line, _grids(line))


@query(f"""WITH {LINKS}, s AS (SELECT image_id AS grid_id, CAST(floor(y * 40 / 124e0) AS INT) AS r, CAST(floor(x * 50 / 160e0) AS INT) AS c, sum(nx - x) AS dx, sum(ny - y) AS dy FROM k WHERE (x + 2 * y) % 3 > 0 GROUP BY 1, 2, 3)
SELECT grid_id, r, c, CASE WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx > 0 THEN 1 ELSE 3 END WHEN dy > 0 THEN 2 ELSE 4 END AS d, 0.5e0 AS w FROM s WHERE (dx <> 0 OR dy <> 0) AND (r + c) % 4 > 0""")
def fallback_votes(spark, sf_dir):
    """Votes from the mean direction of line pixels, for cells without any."""
    line = _line(spark, sf_dir)
    links = skeleton.pixel_links(line).where("(x + 2 * y) % 3 > 0").withColumns({"height": F.lit(124), "width": F.lit(160)})
    voted = skeleton.line_support(line, _grids(line)).where("(r + c) % 4 = 0").withColumns({"d": F.lit(1), "w": F.lit(1.0)})
    every = line.select(F.col("image_id").alias("grid_id")).distinct().select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("r")).select("grid_id", "r", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("c"))
    return raster.fallback_votes(links, voted.select("grid_id", "r", "c").unionByName(every.where("(r + c) % 4 = 0")), 40, 50)


@query("""WITH w AS (SELECT vec_id, list_transform(embedding[1 : vec_id % 12], lambda v: abs(v)::DOUBLE * 3) AS w FROM embeddings), p AS (SELECT vec_id, len(w) AS n, w[1] AS tip, w[2 : least(len(w), 8)] AS inside, least(len(w), 8) AS m FROM w)
SELECT vec_id AS sample_id, round(CASE WHEN n >= 3 THEN 0.6 * greatest(0, least(1, (list_avg(inside) - tip) / greatest(list_avg(inside), 0.75))) + 0.25 * greatest(0, least(1, (list_max(inside) - tip) / 2.5)) + 0.15 * greatest(0, least(1, (m - 2) / 6)) ELSE 0 END, 5) AS taper FROM p""")
def head_tapers(spark, sf_dir):
    """Scores of heads from the widths along a line."""
    s = fx.samples(spark, sf_dir)
    widths = F.transform(F.slice("x", F.lit(1), (F.col("sample_id") % 12).cast("int")), lambda v: F.abs(v.cast("double")) * 3)
    return s.select("sample_id", F.round(skeleton.taper(widths), 5).alias("taper"))


@query("""WITH p AS (SELECT user_id AS path_id, list({'x': event_id * 7 % 50, 'y': event_id * 11 % 40} ORDER BY ts, event_id) AS p FROM events GROUP BY 1), q AS (SELECT path_id, p[len(p)] AS h, p[greatest(1, len(p) - 4)] AS a, path_id % 5 - 2 AS dx, path_id % 3 - 1 AS dy, len(p) AS n FROM p),
v AS (SELECT *, h.x - a.x AS vx, h.y - a.y AS vy FROM q), z AS (SELECT *, sqrt(vx * vx + vy * vy) * sqrt(dx * dx + dy * dy) AS len FROM v) SELECT path_id, round(CASE WHEN n >= 2 AND len > 1e-9 THEN (vx * dx + vy * dy) / len ELSE 0 END, 6) + 0.0 AS cosine FROM z""")
def path_headings(spark, sf_dir):
    """Cosine of a path's end with a direction."""
    e = fx.read(spark, sf_dir, "events").select(F.col("user_id").alias("path_id"), F.struct("ts", "event_id", (F.col("event_id") * 7 % 50).alias("x"), (F.col("event_id") * 11 % 40).alias("y")).alias("p"))
    paths = e.groupBy("path_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return paths.select("path_id", (F.round(skeleton.heading(F.col("p"), F.col("path_id") % 5 - 2, F.col("path_id") % 3 - 1), 6) + 0.0).alias("cosine"))


@query("WITH t AS (SELECT DISTINCT l_returnflag AS grid_id, least(39, CAST(floor((l_partkey % 124) / (124 / 40e0)) AS INT)) AS r, least(49, CAST(floor((l_suppkey * 3 % 160) / (160 / 50e0)) AS INT)) AS c FROM lineitem WHERE l_orderkey % 97 = 0) SELECT DISTINCT grid_id, CAST(r + i AS INT) AS r, CAST(c + j AS INT) AS c FROM t, range(-1, 2) a(i), range(-1, 2) b(j) WHERE r + i BETWEEN 0 AND 39 AND c + j BETWEEN 0 AND 49")
def head_halo(spark, sf_dir):
    """Cells of heads and around."""
    heads = fx.read(spark, sf_dir, "lineitem").where("l_orderkey % 97 = 0").select(F.col("l_returnflag").alias("image_id"), (F.col("l_suppkey") * 3 % 160 + 0.25).alias("x"), (F.col("l_partkey") % 124 - 0.25).alias("y"))
    return skeleton.head_cells(heads, _grids(heads))[1]


@query(f"""WITH {fx.cells_cte(4, keep='(r * 3 + c * 5) % 11 > 4')}, seeds AS (SELECT grid_id, r, c, CASE WHEN (r + c) % 5 = 0 THEN 0 ELSE r // 10 + 1 END AS component, d = 1 OR d = 2 AS directed FROM cells WHERE d < 4),
b AS (SELECT DISTINCT s.grid_id, (s.r + t.r) // 2 AS r, (s.c + t.c) // 2 AS c FROM seeds s JOIN seeds t ON s.grid_id = t.grid_id AND s.component = t.component AND (t.r - s.r, t.c - s.c) IN ((2, 0), (0, 2), (2, 2), (2, -2)))
SELECT grid_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM b WHERE NOT EXISTS (FROM seeds x WHERE x.grid_id = b.grid_id AND x.r = b.r AND x.c = b.c)""")
def guidance_bridges(spark, sf_dir):
    """Empty cells that may be filled between seeds of one component."""
    cells = fx.cells(spark, sf_dir, 4, keep="(r * 3 + c * 5) % 11 > 4")
    components = cells.withColumn("component", F.when((F.col("r") + F.col("c")) % 5 != 0, F.expr("cast(r div 10 as int) + 1")).otherwise(0))
    return skeleton.guidance(cells.where("d IN (1, 2)"), cells.where("d = 3"), cells, components)[1]
