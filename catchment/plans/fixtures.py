"""Grids, lines, rings and labels derived from the test tables by SQL that Spark and DuckDB both run.

ROWS x COLS is the size of the derived grids; grid_id is the line items' return flag and, beyond the first
ORDERS order keys, the number of their block: the number of grids grows with the data (segments: one grid).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.operators import raster

ROWS, COLS = 40, 50
ORDERS = 15_000
GRID = f"CASE WHEN l_orderkey < {ORDERS} THEN l_returnflag ELSE concat(l_returnflag, '-', CAST(floor(l_orderkey / {float(ORDERS)}) AS INT)) END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def votes_sql(codes: int, weight: str = "l_quantity") -> str:
    """Votes with codes 1..`codes`; 2 codes (east, south) make an acyclic grid."""
    return f"""
SELECT {GRID} AS grid_id, CAST(l_partkey % {ROWS} AS INT) AS r, CAST(l_suppkey % {COLS} AS INT) AS c,
       CAST((l_orderkey + l_linenumber) % {codes} + 1 AS INT) AS d, CAST(SUM(CAST(FLOOR({weight}) AS BIGINT)) AS BIGINT) AS w
FROM {{lineitem}} GROUP BY 1, 2, 3, 4"""


def votes(spark: SparkSession, sf_dir: str, codes: int, weight: str = "l_quantity") -> DataFrame:
    return spark.sql(votes_sql(codes, weight), lineitem=read(spark, sf_dir, "lineitem"))


def cells(spark: SparkSession, sf_dir: str, codes: int = 2, weight: str = "l_quantity", keep: str = "true") -> DataFrame:
    return raster.argmax(votes(spark, sf_dir, codes, weight)).where(keep)


def cells_cte(codes: int = 2, weight: str = "l_quantity", keep: str = "true", name: str = "cells") -> str:
    """DuckDB: the same cells as a common table expression, with the cell that each one points to."""
    v = votes_sql(codes, weight).format(lineitem="lineitem")
    return f"""{name} AS (SELECT *, r + CASE d WHEN 2 THEN 1 WHEN 4 THEN -1 ELSE 0 END AS nr, c + CASE d WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS nc
  FROM (SELECT grid_id, r, c, CAST(arg_max(d, w * 10 - d) AS INT) AS d FROM ({v}) GROUP BY 1, 2, 3) WHERE {keep})"""


SEGMENTS = """
SELECT 'tracks' AS grid_id, user_id AS feature_id, 0 AS part, seg, x0, y0, x1, y1,
       CAST(CASE WHEN user_id % 5 = 0 THEN NULL ELSE h0 END AS DOUBLE) AS start_h, CAST(h1 AS DOUBLE) AS end_h
FROM (SELECT user_id, CAST(row_number() OVER w AS INT) AS seg, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1,
             first_value(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS h0,
             last_value(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS h1
      FROM (SELECT user_id, ts, event_id, CAST(floor(value * 100) AS DOUBLE) AS x, CAST({minutes} AS DOUBLE) AS y FROM {events})
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE x1 IS NOT NULL"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEGMENTS.replace("{minutes}", "unix_micros(cast(ts as timestamp)) div 60000000"), events=read(spark, sf_dir, "events"))


def segments_cte() -> str:
    return f"segments AS ({SEGMENTS.replace('{minutes}', 'epoch_us(ts) // 60000000').replace('{events}', 'events')})"


def extent(frame: DataFrame):
    """Box of all segments as literals (one row to the driver)."""
    row = frame.agg(F.min(F.least("x0", "x1")), F.min(F.least("y0", "y1")), F.max(F.greatest("x0", "x1")), F.max(F.greatest("y0", "y1"))).first()
    return tuple(F.lit(float(v)) for v in row)


RINGS = """
SELECT feature_id, ring, edge, x0, y0, x1, y1 FROM (
  SELECT feature_id, ring, edge,
         lo_x + CASE WHEN edge IN (1, 2) THEN side ELSE 0 END AS x0, lo_y + CASE WHEN edge IN (2, 3) THEN side ELSE 0 END AS y0,
         lo_x + CASE WHEN edge IN (0, 1) THEN side ELSE 0 END AS x1, lo_y + CASE WHEN edge IN (1, 2) THEN side ELSE 0 END AS y1
  FROM (SELECT n_nationkey AS feature_id, ring, edge,
               CAST((n_nationkey % 5) * 50 + ring * 10 AS DOUBLE) AS lo_x, CAST(CAST(floor(n_nationkey / 5) AS INT) * 50 + ring * 10 AS DOUBLE) AS lo_y,
               CAST(40 + (n_nationkey % 7) * 5 - ring * 20 AS DOUBLE) AS side
        FROM {nation} CROSS JOIN (VALUES (0), (1)) AS a(ring) CROSS JOIN (VALUES (0), (1), (2), (3)) AS b(edge)))"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of squares with a square hole, one feature a nation."""
    return spark.sql(RINGS, nation=read(spark, sf_dir, "nation"))


def rings_cte() -> str:
    return f"rings AS ({RINGS.replace('{nation}', 'nation')})"


POINTS = "SELECT c_custkey AS point_id, CAST(c_custkey * 7 % 270 AS DOUBLE) AS x, CAST(c_custkey * 13 % 271 AS DOUBLE) AS y FROM {customer}"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS, customer=read(spark, sf_dir, "customer"))


SAMPLES = "SELECT vec_id AS sample_id, embedding AS x, CAST(label % 5 AS INT) AS label, CAST(vec_id % 12 AS BIGINT) AS group_id FROM {embeddings}"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SAMPLES, embeddings=read(spark, sf_dir, "embeddings"))
