"""Queries on cell features, scores and the model's decisions, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import context, graph
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


def _grids(cells):
    return cells.select("grid_id").distinct().select("grid_id", F.lit(fx.ROWS).alias("rows"), F.lit(fx.COLS).alias("cols"))


PIXELS = "SELECT DISTINCT l_returnflag AS grid_id, CAST(l_suppkey * 7 % 333 AS INT) AS x, CAST(l_partkey * 3 % 217 AS INT) AS y FROM {lineitem} WHERE l_linenumber = 1"


def _spans(count, size, name):
    return f"{name} AS (SELECT i, a, greatest(a + 1, least({size}, b)) AS z FROM (SELECT i, greatest(0, least({size - 1}, CAST(round_even(i * {size} / {float(count)}, 0) AS INT))) AS a, CAST(round_even((i + 1) * {size} / {float(count)}, 0) AS INT) AS b FROM range({count}) t(i)))"


@query(f"WITH p AS ({PIXELS.format(lineitem='lineitem')}), {_spans(40, 217, 'rr')}, {_spans(50, 333, 'cc')} SELECT grid_id, CAST(rr.i AS INT) AS r, CAST(cc.i AS INT) AS c, count(*) AS ink, CAST(any_value((rr.z - rr.a) * (cc.z - cc.a)) AS INT) AS area FROM p JOIN rr ON y >= rr.a AND y < rr.z JOIN cc ON x >= cc.a AND x < cc.z GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def inked_cells(spark, sf_dir):
    """Cells with two foreground pixels or more."""
    pixels = spark.sql(PIXELS, lineitem=fx.read(spark, sf_dir, "lineitem"))
    return context.inked_cells(pixels, _grids(pixels).withColumns({"width": F.lit(333), "height": F.lit(217)}), 2)


KEEP = "(r * c) % 3 > 0"
MAPS = f"""WITH RECURSIVE {fx.cells_cte(4, name='every')}, cells AS (SELECT * FROM every WHERE {KEEP}),
links AS (SELECT a.grid_id, a.r * 1000 + a.c AS a, b.r * 1000 + b.c AS b FROM cells a JOIN cells b ON a.grid_id = b.grid_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
low AS (SELECT grid_id, r * 1000 + c AS a, r * 1000 + c AS b FROM cells UNION SELECT low.grid_id, low.a, links.b FROM low JOIN links ON links.grid_id = low.grid_id AND links.a = low.b),
comp AS (SELECT grid_id, a // 1000 AS r, a % 1000 AS c, count(*) / 2000 AS component_ratio FROM low GROUP BY grid_id, a),
walk AS (SELECT grid_id, r AS sr, c AS sc, nr, nc, 0 AS n FROM cells UNION ALL SELECT w.grid_id, sr, sc, a.nr, a.nc, n + 1 FROM walk w JOIN cells a ON a.grid_id = w.grid_id AND a.r = w.nr AND a.c = w.nc WHERE n < 6),
run AS (SELECT grid_id, sr AS r, sc AS c, max(n) / 6 AS run FROM walk GROUP BY 1, 2, 3),
deg AS (SELECT a.grid_id, a.r, a.c, (SELECT count(*) FROM cells b WHERE b.grid_id = a.grid_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1) AS degree, (SELECT count(*) FROM cells b WHERE b.grid_id = a.grid_id AND b.nr = a.r AND b.nc = a.c) AS incoming FROM cells a),
share AS (SELECT grid_id, r, c, coalesce(degree / nullif(max(degree) OVER g, 0), 0) AS degree, coalesce(incoming / nullif(max(incoming) OVER g, 0), 0) AS incoming FROM deg WINDOW g AS (PARTITION BY grid_id)),
flags AS (SELECT grid_id, r, c, d, CASE WHEN {KEEP} THEN 1 ELSE 0 END AS occ, CASE WHEN (r + 2 * c) % 7 = 0 THEN 1 ELSE 0 END AS head FROM every),
maps AS (SELECT f.*, coalesce(component_ratio, 0) AS component_ratio, coalesce(run, 0) AS run, coalesce(degree, 0) AS degree, coalesce(incoming, 0) AS incoming,
  sum(occ) OVER (PARTITION BY grid_id, r) / 50 AS row_occ, sum(occ) OVER (PARTITION BY grid_id, c) / 40 AS col_occ, sum(head) OVER (PARTITION BY grid_id, r) / 50 AS row_head, sum(head) OVER (PARTITION BY grid_id, c) / 40 AS col_head
  FROM flags f LEFT JOIN comp USING (grid_id, r, c) LEFT JOIN run USING (grid_id, r, c) LEFT JOIN share USING (grid_id, r, c))"""
_NAMES = ("component_ratio", "run", "degree", "incoming", "row_occ", "col_occ", "row_head", "col_head")


def _maps(spark, sf_dir):
    cells = fx.cells(spark, sf_dir, 4).withColumns({"occ": F.expr(f"cast({KEEP} as int)"), "head": F.expr("cast((r + 2 * c) % 7 = 0 as int)")})
    return context.context_maps(cells, _grids(cells)), _grids(cells)


@query(MAPS + f" SELECT grid_id, r, c, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM maps")
def context_maps(spark, sf_dir):
    """Maps of each cell's surroundings; occupied are two thirds of the cells."""
    return _maps(spark, sf_dir)[0].select("grid_id", "r", "c", *[F.round(n, 6).alias(n) for n in _NAMES])


INK = {"bw": "(r * 13 + c * 7) % 50 / 100e0", "edges": "(r * 3 + c * 11) % 20 / 100e0", "skeleton": "(r * 5 + c * 3) % 30 / 100e0", "conf": "(r * 17 + c * 29) % 100 / 100e0", "occ": "CASE WHEN (r * c) % 3 > 0 THEN 1 ELSE 0 END", "head": "CASE WHEN (r + 2 * c) % 7 = 0 THEN 1 ELSE 0 END"}
PLAIN = {"component_ratio": "r / 40e0", "run": "(r + c) % 7 / 6e0", "degree": "c % 5 / 4e0", "incoming": "r % 5 / 4e0", "row_occ": "r % 9 / 9e0", "col_occ": "c % 9 / 9e0", "row_head": "r % 4 / 4e0", "col_head": "c % 4 / 4e0"}


def _inked(cells):
    number = lambda e: F.expr(e).cast("double")
    return cells.withColumns({k: number(e) for k, e in {**INK, **PLAIN}.items()})


@query(f"""WITH {fx.cells_cte(4)}, f AS (SELECT grid_id, r, c, d, {', '.join(f'{e} AS {k}' for k, e in {**INK, **PLAIN}.items())} FROM cells),
v AS (SELECT *, [CASE WHEN d = 1 THEN 1.0 ELSE 0.0 END, CASE WHEN d = 2 THEN 1.0 ELSE 0.0 END, CASE WHEN d = 3 THEN 1.0 ELSE 0.0 END, CASE WHEN d = 4 THEN 1.0 ELSE 0.0 END, occ, bw, edges, skeleton, head, conf]::DOUBLE[] AS v FROM f),
w AS (SELECT grid_id, r, c, list_sum(v) AS s, list_sum(list_transform(v, lambda x, i: x * i)) AS t FROM v)
SELECT a.grid_id, a.r, a.c, 260 AS size, round(sum(((b.r - a.r + 2) * 5 + b.c - a.c + 2) * 10 * b.s + b.t) + any_value(251 * a.r / 39 + 252 * a.c / 49 + {' + '.join(f'{253 + k} * x.{n}' for k, n in enumerate(context.GLOBAL))}), 4) AS code
FROM w a JOIN w b ON a.grid_id = b.grid_id AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 JOIN f x ON x.grid_id = a.grid_id AND x.r = a.r AND x.c = a.c GROUP BY 1, 2, 3""")
def feature_vectors(spark, sf_dir):
    """Vectors of 260 numbers a cell, as a sum weighted by place."""
    cells = _inked(graph.cut(fx.cells(spark, sf_dir, 4)))
    x = context.feature_vectors(cells, _grids(cells))
    code = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return x.select("grid_id", "r", "c", F.size("x").alias("size"), F.round(code, 4).alias("code"))


@query("""WITH p AS (SELECT vec_id, list_transform(range(768), lambda i: greatest(0.0, least(1.0, embedding[i % 64 + 1]::DOUBLE))) AS p FROM embeddings)
SELECT vec_id AS sample_id, 770 AS size, round(list_sum(p) - 384.0 + 3.0, 5) AS total, round(0.55 * list_avg(p[1:256]) + 0.3 * list_avg(p[257:512]) + 0.15 * list_avg(p[513:768]), 6) AS signal FROM p""")
def patch_vectors(spark, sf_dir):
    """Patches clipped, centred and put behind a cell's vector; their signal."""
    tiled = F.transform(F.sequence(F.lit(0), F.lit(767)), lambda i: F.element_at("x", i % 64 + 1))
    rows = fx.samples(spark, sf_dir).select("sample_id", context.checked_patch(tiled).alias("p"))
    whole = context.combined(F.array(F.lit(1.0), F.lit(2.0)), F.col("p"))
    return rows.select("sample_id", F.size(whole).alias("size"), F.round(F.aggregate(whole, F.lit(0.0), lambda s, v: s + v), 5).alias("total"), F.round(context.patch_signal(F.col("p")), 6).alias("signal"))


@query("""SELECT c_custkey AS sample_id, round(CASE WHEN n <= 0 THEN 0.0 ELSE least(1.0, greatest(CASE WHEN code = 0 THEN 0.2 ELSE 0.25 END, n / CASE WHEN code = 0 THEN 2.0 ELSE 4.0 END)) END, 6) AS support,
round(coalesce(exp(-dist * dist / 2.88), 0), 6) AS close, coalesce(dist <= 1.4, false) AS trusted FROM (SELECT c_custkey, c_custkey % 5 AS code, c_nationkey % 7 - 1 AS n, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 40 / 10.0 END AS dist FROM customer)""")
def decision_scores(spark, sf_dir):
    """How far a class's samples and the nearest exemplar carry a decision."""
    k = F.col("c_custkey")
    near, trusted = context.closeness(F.when(k % 13 != 0, (k % 40) / 10), F.lit(1.2), F.lit(1.4))
    return fx.read(spark, sf_dir, "customer").select(k.alias("sample_id"), F.round(context.class_support(F.col("c_nationkey") % 7 - 1, k % 5), 6).alias("support"), F.round(near, 6).alias("close"), trusted.alias("trusted"))


DECIDE = {"overlap": "(r + 2 * c) % 4", "raw": "(r * 31 + c * 17) % 40 / 100e0", "dist": "(r * 7 + c * 5) % 15 / 10e0", "q": "(r * 11 + c * 13) % 100", "now": "CASE WHEN (r + c) % 3 = 0 THEN 0 ELSE d END", "pick": "(r * 3 + c * 5 + d) % 5"}


def _rules_sql(mode: int) -> str:
    lim = {k: [v[mode] for v in x] for k, x in context.LIMITS.items()}

    def meets(rule):
        prob, lead, sure, close, support = lim[rule]
        return f"trusted AND p >= {max(0.6, prob)} AND p >= own + {max(context.LEAD[mode], lead)} AND trust >= {max(context.TRUST[mode], sure)} AND near >= {close} AND carried >= {support}"

    doubt, margin = context.DOUBT[mode], context.MARGIN[mode]
    (f0, f1, f2), direct = [v[mode] for v in context.FILL_RAW], context.DIRECT_RAW[mode]
    weak, held = "coalesce(tier <= 1, false)", "(tier IS NULL OR tier >= 2)"
    unsure = f"conf < {doubt}"
    amb = f"(now = 0 OR {unsure} OR overlap > 1 OR {weak})"
    doubted = f"CASE WHEN now <> 0 AND conf >= 0.45 THEN overlap > 1 OR {weak} ELSE {amb} END" if mode == 0 else amb
    fill = f"now = 0 AND best <> 0 AND ({held} OR occ = 1 OR overlap > 1 OR raw >= {f0}) AND (directed OR raw >= {f1}) AND greatest(evidence, raw) >= {f2} AND (overlap > 1 OR {held})"
    relabel = "now <> 0 AND best <> 0 AND best <> now"
    return f"""WITH {fx.cells_cte(4)}, f AS (SELECT grid_id, r, c, d, {', '.join(f'{e} AS {k}' for k, e in {**INK, **PLAIN, **DECIDE}.items())}, CASE WHEN r % 4 = 3 THEN NULL ELSE r % 4 END AS tier FROM cells),
s AS (SELECT *, pick AS best, 0.25 + 0.75 * q / 100e0 AS p, CASE WHEN now = pick THEN 0.25 + 0.75 * q / 100e0 ELSE (1.0 - (0.25 + 0.75 * q / 100e0)) / 4 END AS own,
  exp(-dist * dist / 2) AS near, dist <= 1.1 AS trusted, least(1, greatest(0, 0.36 * bw + 0.12 * edges + 0.18 * skeleton + 0.16 * head + 0.1 * run + 0.05 * degree + 0.03 * incoming)) AS evidence,
  (head >= 0.45 OR skeleton >= 0.12 OR run >= 0.38 OR degree >= 0.6 OR (bw >= 0.16 AND edges >= 0.05)) AS directed, [1.0, 0.5, 1.0, 0.75, 0.25][pick + 1] AS carried FROM f),
t AS (SELECT *, p * (0.45 + 0.55 * near) * (0.35 + 0.65 * carried) AS trust FROM s),
u AS (SELECT *, CASE WHEN occ <> 1 AND now = 0 AND raw < 0.055 THEN 'silent' WHEN best = now AND trusted THEN 'agreed' WHEN {fill} AND {meets('direct')} AND raw >= {direct} THEN 'direct' WHEN {fill} AND {meets('fill')} THEN 'fill'
  WHEN now = 0 AND best = 0 AND raw < 0.055 AND p >= 0.55 THEN 'empty' WHEN now = 0 AND best <> 0 AND raw < 0.055 THEN 'ignored'
  WHEN ({relabel} AND (overlap > 1 OR {weak} OR {unsure}) AND {meets('strong')} AND greatest(evidence, raw) >= 0.1 AND ({unsure} OR (p >= 0.8 AND p >= own + 0.2 AND near >= 0.8))) OR ({relabel} AND {meets('exceptional')}) THEN 'relabel'
  WHEN best <> 0 AND now <> 0 AND ({doubted}) AND {meets('blend')} AND trust >= conf + {margin} THEN 'blend'
  WHEN best = 0 AND now <> 0 AND conf < 0.52 AND (tier IS NULL OR {weak}) AND head < 0.5 AND bw < 0.18 AND skeleton < 0.16 AND run < 0.35 AND incoming < 0.55 AND raw < 0.11 AND {meets('clear')} AND trust >= conf + {max(margin, 0.1)} THEN 'clear' ELSE 'kept' END AS rule FROM t)
SELECT grid_id, r, c, rule, CAST(CASE WHEN rule IN ('direct', 'fill', 'relabel', 'blend', 'clear') THEN best ELSE now END AS INT) AS new_d, rule <> 'silent' AND ({amb} OR best <> now) AS candidate,
round(greatest(conf, CASE WHEN rule IN ('agreed', 'direct', 'fill', 'blend') THEN least(0.98, trust) WHEN rule = 'relabel' THEN least(0.98, p) WHEN rule IN ('empty', 'clear') THEN least(0.95, trust) ELSE 0 END), 6) AS new_conf FROM u"""


def _decided(spark, sf_dir, restricted):
    cells = _inked(fx.cells(spark, sf_dir, 4)).withColumns({k: F.expr(e) for k, e in DECIDE.items()})
    top = 0.25 + 0.75 * F.col("q") / 100.0
    probs = F.transform(F.array(*map(F.lit, range(5))), lambda k: F.when(k == F.col("pick"), top).otherwise((1.0 - top) / 4))
    rows = cells.withColumns({"probs": probs, "tier": F.when(F.col("r") % 4 != 3, F.col("r") % 4), "raw": F.col("raw").cast("double"), "dist": F.col("dist").cast("double"), "scale": F.lit(1.0), "reach": F.lit(1.1), "counts": F.array(*map(F.lit, (2, 2, 4, 3, 1)))}).withColumn("d", F.col("now").cast("int"))
    out = context.decide(rows, restricted)
    return out.select("grid_id", "r", "c", "rule", "new_d", "candidate", F.round("new_conf", 6).alias("new_conf"))


@query(_rules_sql(0))
def decisions_restricted(spark, sf_dir):
    """What a model of few samples changes, and by which rule."""
    return _decided(spark, sf_dir, True)


@query(_rules_sql(1))
def decisions_full(spark, sf_dir):
    return _decided(spark, sf_dir, False)


@query(f"""WITH {fx.cells_cte(4)}, {{keep}}, kept AS (SELECT grid_id, r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY md5(concat_ws(',', grid_id, r, c, 0)), r, c) AS p FROM held) WHERE p <= 120),
sizes AS (SELECT grid_id, count(*) AS n FROM kept GROUP BY 1),
every AS (SELECT grid_id, CAST(y.i AS INT) AS r, CAST(x.i AS INT) AS c FROM (SELECT DISTINCT grid_id FROM cells), range(40) y(i), range(50) x(i)),
touched AS (SELECT DISTINCT grid_id, r + y.i AS r, c + x.i AS c FROM held, range(-1, 2) y(i), range(-1, 2) x(i)),
spare AS (SELECT e.*, t.r IS NOT NULL AS near FROM every e ANTI JOIN held h ON h.grid_id = e.grid_id AND h.r = e.r AND h.c = e.c LEFT JOIN touched t ON t.grid_id = e.grid_id AND t.r = e.r AND t.c = e.c),
far AS (SELECT grid_id, count(*) FILTER (NOT near) AS far FROM spare GROUP BY 1),
zeros AS (SELECT s.grid_id, r, c, row_number() OVER (PARTITION BY s.grid_id ORDER BY md5(concat_ws(',', s.grid_id, r, c, 0)), r, c) AS p, greatest(1, round_even(coalesce(n, 0) * 0.35, 0)) AS wanted FROM spare s JOIN far USING (grid_id) LEFT JOIN sizes USING (grid_id) WHERE NOT near OR far = 0)
SELECT grid_id, r, c, d FROM kept UNION ALL SELECT grid_id, r, c, 0 FROM zeros WHERE p <= wanted""".replace("{keep}", "held AS (SELECT * FROM cells WHERE NOT (r BETWEEN 8 AND 19 AND c BETWEEN 10 AND 31))"))
def drawn_labels(spark, sf_dir):
    """Labels drawn from grids with a hole: directed cells, and empty ones that no directed one touches."""
    cells = fx.cells(spark, sf_dir, 4)
    return context.drawn_labels(cells.where("NOT (r BETWEEN 8 AND 19 AND c BETWEEN 10 AND 31)"), _grids(cells), 120)


@query(f"""WITH {fx.cells_cte(4)}, l AS (SELECT grid_id AS image, 40 AS rows, d, CASE WHEN r % 2 = 0 THEN d ELSE 0 END AS object_d, r % 3 AS support, c % 2 AS centre, (r + c) % 2 AS occ, CASE WHEN c % 5 = 0 THEN 0 ELSE d END AS final FROM cells),
s AS (SELECT image, rows, count(*) FILTER (final > 0) AS a, count(*) FILTER (object_d > 0) AS b, count(*) FILTER (support > 0) AS e, count(*) FILTER (centre > 0) AS f, count(*) FILTER (centre > 0 AND final > 0) AS g, count(*) FILTER (occ > 0) AS h FROM l GROUP BY 1, 2)
SELECT image, rows, 50 AS cols, a AS final_nonzero, b AS object_nonzero, e AS object_support_nonzero, f AS centre_nonzero, g AS centre_assigned, h AS occupied_nonzero, round(a / 2000, 6) AS final_density, round(b / 2000, 6) AS object_density, round(h / 2000, 6) AS occupied_density, 2 AS dir_1, 1 AS dir_2, 0 AS dir_3, 3 AS dir_4, round(g / greatest(1, f), 6) AS centre_coverage, f - g AS centre_unassigned, 6 AS object_count FROM s""")
def run_audit(spark, sf_dir):
    """Counts and densities of every image and row count."""
    r, c = F.col("r"), F.col("c")
    cells = fx.cells(spark, sf_dir, 4)
    layers = cells.select(F.col("grid_id").alias("image"), F.lit(40).alias("rows"), "r", "c", F.when(c % 5 != 0, F.col("d")).otherwise(0).alias("d"), F.when(r % 2 == 0, F.col("d")).otherwise(0).alias("object_d"), (r % 3).alias("object_support"), (c % 2).alias("centre"), ((r + c) % 2).alias("occ"))
    runs = cells.select(F.col("grid_id").alias("image")).distinct().select("image", F.lit(40).alias("rows"), F.lit(50).alias("cols"), F.array(*map(F.lit, (1, 4, 4, 2, 1, 4))).alias("objects"))
    out = context.run_audit(layers, runs)
    return out.select(*[F.round(k, 6).alias(k) if k.endswith(("density", "coverage")) else k for k in out.columns])


HEADS = "SELECT c_custkey AS k, CAST(c_custkey * 7 % 40 AS DOUBLE) AS x, CAST(c_custkey * 11 % 30 AS DOUBLE) AS y, CAST(c_custkey % 5 - 2 AS DOUBLE) AS dx, CAST(c_custkey % 7 - 3 AS DOUBLE) AS dy FROM {customer}"


@query(f"""WITH h AS ({HEADS.format(customer='customer')}), p AS (SELECT a.k, a.x, a.y, a.dx, a.dy, b.x AS bx, b.y AS by_, b.dx AS bdx, b.dy AS bdy FROM h a JOIN h b ON b.k = a.k + 3),
q AS (SELECT *, greatest(0, least(x, bx) + 6 - greatest(x, bx)) * greatest(0, least(y, by_) + 4 - greatest(y, by_)) AS n, sqrt(dx * dx + dy * dy) * sqrt(bdx * bdx + bdy * bdy) AS len FROM p),
z AS (SELECT *, n / (48 - n) AS iou, CASE WHEN len > 1e-12 THEN (dx * bdx + dy * bdy) / len ELSE 1.0 END AS dot FROM q)
SELECT k, round(iou, 6) AS iou, round(dot, 6) + 0.0 AS dot, CASE WHEN dot < -0.55 THEN false ELSE ((x - bx) * (x - bx) + (y - by_) * (y - by_) <= 225 AND (dot > 0.7 OR iou > 0.18)) OR iou > 0.52 END AS same, x <= 1 OR y <= 1 OR x >= 38 OR y >= 28 AS border,
round(CASE WHEN bdx * bdx + bdy * bdy > 1e-12 THEN bdx / sqrt(bdx * bdx + bdy * bdy) WHEN dx * dx + dy * dy > 1e-12 THEN dx / sqrt(dx * dx + dy * dy) ELSE 1.0 END, 6) + 0.0 AS turned FROM z""")
def head_pairs(spark, sf_dir):
    """Arrow heads compared with others: overlap, cosine, sameness, border, another direction."""
    h = spark.sql(HEADS, customer=fx.read(spark, sf_dir, "customer"))
    box = lambda p: F.struct(F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y"), F.col(f"{p}.dx").alias("dx"), F.col(f"{p}.dy").alias("dy"), F.col(f"{p}.x").alias("xmin"), F.col(f"{p}.y").alias("ymin"), (F.col(f"{p}.x") + 6).alias("xmax"), (F.col(f"{p}.y") + 4).alias("ymax"))
    both = h.alias("a").join(h.alias("b"), F.col("b.k") == F.col("a.k") + 3).select(F.col("a.k").alias("k"), box("a").alias("a"), box("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    turned, _ = context.turned_head(a, b["dx"], b["dy"])
    return both.select("k", F.round(context.head_overlap(a, b), 6).alias("iou"), (F.round(context.head_dot(a, b), 6) + 0.0).alias("dot"), context.similar_heads(a, b, 15).alias("same"), context.at_border(a["x"], a["y"], F.lit(40), F.lit(30)).alias("border"), (F.round(turned, 6) + 0.0).alias("turned"))


@query("SELECT n_nationkey AS layer, concat_ws('/', CASE WHEN n_nationkey = 3 THEN 'pipe' END, CASE WHEN n_nationkey % 5 = 3 THEN 'boundary' END, CASE WHEN n_nationkey % 2 = 1 THEN 'flood' END) AS role, n_nationkey % 4 = 0 AS flooded FROM nation")
def layer_roles(spark, sf_dir):
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, F.concat(F.lit(" Flooding 2011 "), "n_name")).otherwise(F.col("n_name"))
    return fx.read(spark, sf_dir, "nation").select(k.alias("layer"), context.layer_role(k == 3, k % 5 == 3, k % 2 == 1).alias("role"), context.looks_flooded(name).alias("flooded"))
