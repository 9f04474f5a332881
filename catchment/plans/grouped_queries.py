"""Queries whose steps are sequential inside a grid (no DuckDB equivalent but for their checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import correction, graph
from catchment.plans import fixtures as fx
from catchment.plans.grid_queries import _outlets

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def connect_outlet(spark, sf_dir):
    """Cells after least-cost repair towards one outlet a grid: code, and whether kept, edited or unresolved."""
    cells = fx.cells(spark, sf_dir, 4)
    outlets = cells.select("grid_id").distinct().select("grid_id", F.lit(7).alias("r"), F.lit(9).alias("c"))
    return correction.correct(cells, outlets)


@query
def connect_outlets(spark, sf_dir):
    """The same with several outlets: parts by nearest outlet, repaired apart."""
    cells = fx.cells(spark, sf_dir, 4)
    stops = _outlets(cells).withColumn("label", F.col("r") * 100 + F.col("c"))
    labels = graph.partition_by_outlet(cells.select("grid_id", "r", "c"), stops)
    return correction.correct_by_outlet(cells, labels, stops)


@query
def propagate_lines(spark, sf_dir):
    """Directions carried on through empty cells of unbranched lines: rows of a grid, joined by a column."""
    cells = fx.cells(spark, sf_dir, 2, keep="r % 4 = 0 AND c % 6 = 0")
    support = fx.cells(spark, sf_dir, 2, keep="r % 4 = 0 OR c = 13")
    return correction.propagate(cells, support)
