"""Queries on the ink around arrow heads and on groups of line ends, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import linkage, sections
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


INK = "SELECT DISTINCT l_returnflag AS image_id, CAST(l_orderkey * 5 % 333 AS INT) AS x, CAST(l_partkey % 217 AS INT) AS y FROM {lineitem}"
TIPS = """SELECT CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS image_id, c_custkey AS head_id, c_custkey * 7 % 333 + 0.137e0 AS x, c_custkey * 3 % 217 + 0.291e0 AS y,
  CAST(c_custkey % 5 - 2 AS DOUBLE) AS dx, CAST(c_custkey % 7 - 3 AS DOUBLE) AS dy, 6.66e0 + c_custkey % 4 AS span FROM {customer}"""
DISTANCES = tuple(sorted({sections.TIP, sections.MIDDLE, sections.BASE, sections.FRONT, *sections.HEAD_WIDTHS, *sections.FAR_WIDTHS}))


def _values(*rows):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}e0" for v in r) + ")" for r in rows) + ")"


SECTIONS = f"""ink AS ({INK.format(lineitem='lineitem')}), heads AS ({TIPS.format(customer='customer')}),
u AS (SELECT *, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy, greatest(1.0, span / 10) AS step, greatest(3.0, span * 1.40e0) AS half FROM heads WHERE dx != 0 OR dy != 0),
s AS (SELECT u.*, d AS distance, k, -half + k * step AS o, CAST(round_even(x + ux * (-d * span) - uy * (-half + k * step), 0) AS BIGINT) AS px, CAST(round_even(y + uy * (-d * span) + ux * (-half + k * step), 0) AS BIGINT) AS py
  FROM u, {_values(*[(d,) for d in DISTANCES])} t(d), range(0, 60) r(k) WHERE k < ceil((2 * half + 0.5 * step) / step)),
mid AS (SELECT head_id, arg_min(k, abs(o) * 1000 + k * 1e-9) AS middle FROM s GROUP BY 1),
hit AS (SELECT s.*, k - row_number() OVER (PARTITION BY head_id, distance ORDER BY k) AS island FROM s SEMI JOIN ink i ON i.image_id = s.image_id AND i.x = s.px AND i.y = s.py),
anchor AS (SELECT head_id, distance, arg_min(k, abs(k - middle) * 1000 + k) AS anchor FROM hit JOIN mid USING (head_id) GROUP BY 1, 2),
sel AS (SELECT h.head_id, h.distance, min(h.o) AS low, max(h.o) AS high FROM hit h JOIN anchor a USING (head_id, distance) JOIN hit c ON c.head_id = h.head_id AND c.distance = h.distance AND c.k = a.anchor AND c.island = h.island WHERE abs(c.o) <= greatest(2.5 * c.step, 0.18 * c.span) GROUP BY 1, 2),
wide AS (SELECT heads.image_id, heads.head_id, d AS distance, coalesce(high - low, 0) AS width, coalesce(least(abs(least(0, low)), greatest(0, high)) / greatest(abs(least(0, low)), greatest(0, high), 1e-6), 0) AS balance
  FROM heads CROSS JOIN {_values(*[(d,) for d in DISTANCES])} t(d) LEFT JOIN sel ON sel.head_id = heads.head_id AND sel.distance = d)"""
_POINTS = [(kind, d, o) for kind, several in (("ahead", sections.AHEAD), ("behind", sections.BEHIND), ("shaft", sections.SHAFT)) for d, o in several]
SUPPORTS = f"""p AS (SELECT u.image_id, head_id, kind, d, CAST(round_even(x + ux * (d * span) - uy * (o * span), 0) AS BIGINT) AS px, CAST(round_even(y + uy * (d * span) + ux * (o * span), 0) AS BIGINT) AS py FROM u, {_values(*_POINTS)} t(kind, d, o)),
near AS (SELECT head_id, count(*) FILTER (kind = 'ahead') AS a, count(*) FILTER (kind = 'behind') AS b, count(*) FILTER (kind = 'shaft') AS c, count(DISTINCT CASE WHEN kind = 'shaft' THEN d END) AS e FROM p SEMI JOIN ink i ON i.image_id = p.image_id AND i.x = p.px AND i.y = p.py GROUP BY 1),
held AS (SELECT u.head_id, 1 - coalesce(a, 0) / {len(sections.AHEAD)} AS clear, coalesce(b, 0) / {len(sections.BEHIND)} AS behind, coalesce(c, 0) / {len(sections.SHAFT)} AS shaft, coalesce(e, 0) / 5 AS steady FROM u LEFT JOIN near USING (head_id))"""


def _drawing(spark, sf_dir):
    return spark.sql(TIPS, customer=fx.read(spark, sf_dir, "customer")), spark.sql(INK, lineitem=fx.read(spark, sf_dir, "lineitem"))


@query(f"WITH {SECTIONS} SELECT image_id, head_id, distance, round(width, 6) AS width, round(balance, 6) AS balance FROM wide")
def head_sections(spark, sf_dir):
    """Width and balance of the ink across each head's line at nine distances."""
    out = sections.cross_sections(*_drawing(spark, sf_dir), DISTANCES)
    return out.withColumns({c: F.round(c, 6) for c in ("width", "balance")})


@query(f"WITH {SECTIONS}, {SUPPORTS} SELECT image_id, head_id, round(clear, 6) AS clear, round(behind, 6) AS behind, round(shaft, 6) AS shaft, round(steady, 6) AS steady FROM u JOIN held USING (head_id)")
def head_supports(spark, sf_dir):
    """Shares of ink beside, behind and along each head."""
    return sections.supports(*_drawing(spark, sf_dir)).select("image_id", "head_id", *[F.round(c, 6).alias(c) for c in ("clear", "behind", "shaft", "steady")])


def _at(d, c):
    return f"max({c}) FILTER (abs(distance - {d}) < 1e-9)"


def _among(ds):
    return " OR ".join(f"abs(distance - {d}) < 1e-9" for d in ds)


@query(f"""WITH {SECTIONS}, {SUPPORTS}, w AS (SELECT image_id, head_id, {_at(sections.TIP, 'width')} AS tip, {_at(sections.FRONT, 'width')} AS front, greatest({_at(sections.MIDDLE, 'balance')}, {_at(sections.BASE, 'balance')}) AS balance, max(width) FILTER ({_among(sections.HEAD_WIDTHS)}) AS head, coalesce(min(width) FILTER (width > 0 AND ({_among(sections.FAR_WIDTHS)})), 0) AS far FROM wide GROUP BY 1, 2),
q AS (SELECT w.*, held.* EXCLUDE (head_id), least(1, greatest(0, (head - far) / greatest(span * 0.42e0, 1))) AS bulge, least(1, greatest(0, (head - tip) / greatest(span * 0.34e0, 1))) AS gain, least(1, greatest(0, (head - front) / greatest(span * 0.34e0, 1))) AS taper FROM w JOIN heads USING (image_id, head_id) LEFT JOIN held USING (head_id))
SELECT image_id, head_id, round(CASE WHEN clear IS NULL THEN 0 ELSE least(1, greatest(0, least(1, greatest(0, 0.16e0 * behind + 0.10e0 * clear + 0.16e0 * gain + 0.13e0 * taper + 0.12e0 * balance + 0.08e0 * shaft + 0.08e0 * steady + 0.17e0 * bulge)) * (0.28e0 + 0.72e0 * bulge))) END, 6) AS score FROM q""")
def head_scores(spark, sf_dir):
    """How much the ink around each tip looks like an arrow head."""
    return sections.local_scores(*_drawing(spark, sf_dir)).withColumn("score", F.round("score", 6))


ENDS = """SELECT c_nationkey AS image_id, c_custkey AS id, CAST(c_custkey * 7 % 100 AS DOUBLE) AS x, CAST(c_custkey * 13 % 90 AS DOUBLE) AS y, CAST(c_custkey % 5 - 2 AS DOUBLE) AS dx, CAST(c_custkey % 7 - 2 AS DOUBLE) AS dy, 0.4e0 + c_custkey * 31 % 97 / 160e0 AS score, CAST(c_custkey % 13 AS DOUBLE) AS area FROM {customer}"""
CLUSTERS = f"""ends AS (SELECT *, x - 2 AS xmin, y - 3 AS ymin, x + 4 AS xmax, y + 1 AS ymax FROM ({ENDS.format(customer='customer')}) WHERE score >= 0.58),
reach AS (SELECT image_id, id, id AS o FROM ends UNION SELECT r.image_id, r.id, b.id FROM reach r JOIN ends a ON a.id = r.o JOIN ends b ON b.image_id = a.image_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 64),
named AS (SELECT id, min(o) AS cluster FROM reach GROUP BY 1)"""


def _ends(spark, sf_dir):
    ends = spark.sql(ENDS, customer=fx.read(spark, sf_dir, "customer"))
    return ends.withColumns({"xmin": F.col("x") - 2, "ymin": F.col("y") - 3, "xmax": F.col("x") + 4, "ymax": F.col("y") + 1})


@query(f"WITH RECURSIVE {CLUSTERS} SELECT image_id, id, cluster FROM ends JOIN named USING (id)")
def end_clusters(spark, sf_dir):
    """Groups of line ends by single linkage."""
    return linkage.linked(_ends(spark, sf_dir).where("score >= 0.58"), 8.0).select("image_id", "id", "cluster")


@query(f"""WITH RECURSIVE {CLUSTERS}, r AS (SELECT e.*, cluster, max(score) OVER (PARTITION BY image_id) AS best FROM ends e JOIN named USING (id)),
d AS (SELECT *, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy, greatest(score, 0.05) AS w FROM r WHERE dx != 0 OR dy != 0),
g AS (SELECT image_id, cluster, count(*) AS n, sum(ux * w) AS wx, sum(uy * w) AS wy, sum(w) AS ws, arg_max(id, score * 1000000000 - id) AS first, max(score) AS top_score, any_value(best) AS best FROM d GROUP BY 1, 2),
a AS (SELECT *, sqrt(wx * wx + wy * wy) / ws AS mean FROM g),
b AS (SELECT d.*, a.n, a.mean, a.first, a.top_score, CASE WHEN n >= 2 AND mean >= 0.30 THEN wx / sqrt(wx * wx + wy * wy) END AS ax, CASE WHEN n >= 2 AND mean >= 0.30 THEN wy / sqrt(wx * wx + wy * wy) END AS ay FROM d JOIN a USING (image_id, cluster)),
c AS (SELECT *, coalesce(count(*) FILTER (ux * ax + uy * ay >= 0.10) OVER (PARTITION BY image_id, cluster), 0) >= 2 AS together FROM b),
k AS (SELECT *, max(CASE WHEN id = first THEN ux END) OVER (PARTITION BY image_id, cluster) AS fx, max(CASE WHEN id = first THEN uy END) OVER (PARTITION BY image_id, cluster) AS fy FROM c),
m AS (SELECT *, CASE WHEN together THEN ax ELSE fx END AS hx, CASE WHEN together THEN ay ELSE fy END AS hy FROM k WHERE CASE WHEN together THEN ux * ax + uy * ay >= 0.10 ELSE id = first AND top_score >= greatest(0.80, best * 0.985) END)
SELECT image_id, cluster, count(*) AS members, arg_max(x, row(round(x * hx + y * hy + 4 * score, 9), -id)) AS x, arg_max(y, row(round(x * hx + y * hy + 4 * score, 9), -id)) AS y, round(any_value(hx), 6) + 0.0 AS dx, round(any_value(hy), 6) + 0.0 AS dy, round(greatest(0.05, least(0.92, max(score) * 0.72 + any_value(mean) * 0.28)), 6) AS score, sum(greatest(1, area)) AS area, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax
FROM m GROUP BY 1, 2""")
def recovered_heads(spark, sf_dir):
    """A head for each group of line ends that agree."""
    out = linkage.recovered_heads(_ends(spark, sf_dir), 8.0)
    return out.withColumns({"dx": F.round("dx", 6) + 0.0, "dy": F.round("dy", 6) + 0.0, "score": F.round("score", 6)})
