"""Masks and layers of a grid: set algebra, trimming, resampling, edits. Masks are rows (grid_id, r, c)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["grid_id", "r", "c"]


def intersect(*masks: DataFrame | None) -> DataFrame | None:
    """Cells of all given masks; None if none is given. Masks made of grids' rows are larger than their estimates: none is broadcast."""
    given = [m.select(*CELL) for m in masks if m is not None]
    return reduce(lambda a, b: a.join(b.hint("merge"), CELL, "left_semi"), given).distinct() if given else None


def union(*masks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [m.select(*CELL) for m in masks]).distinct()


def outside(cells: DataFrame, mask: DataFrame) -> DataFrame:
    return cells.join(mask.select(*CELL).hint("merge"), CELL, "left_anti")


def within(cells: DataFrame, mask: DataFrame) -> DataFrame:
    return cells.join(mask.select(*CELL).hint("merge"), CELL, "left_semi")


def zero_outside(layers: DataFrame, mask: DataFrame, columns: list[str]) -> DataFrame:
    """Aligned layers with the columns set to 0 outside the mask, and `dropped`: whether an active cell was cleared."""
    flagged = layers.join(mask.select(*CELL, F.lit(True).alias("_in")), CELL, "left")
    keep = F.coalesce("_in", F.lit(False))
    out = flagged.withColumn("dropped", ~keep & (F.col(columns[0]) > 0))
    return out.withColumns({c: F.when(keep, F.col(c)).otherwise(F.lit(0).cast(layers.schema[c].dataType)) for c in columns}).drop("_in")


def trim_bounds(occupied: DataFrame, grids: DataFrame, padding: int = 1) -> DataFrame:
    """grid_id, top, bottom, left, right (ends excluded) of the padded box of occupied cells, clipped to the grid."""
    box = occupied.groupBy("grid_id").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.min("c").alias("d"), F.max("c").alias("e")).join(grids, "grid_id")
    zero = F.lit(0)
    return box.select("grid_id", F.greatest(zero, F.col("a") - padding).alias("top"), F.least("rows", F.col("b") + padding + 1).alias("bottom"), F.greatest(zero, F.col("d") - padding).alias("left"), F.least("cols", F.col("e") + padding + 1).alias("right"))


def trim(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    inside = (F.col("r") >= F.col("top")) & (F.col("r") < F.col("bottom")) & (F.col("c") >= F.col("left")) & (F.col("c") < F.col("right"))
    moved = cells.join(bounds, "grid_id").where(inside)
    return moved.withColumns({"r": F.col("r") - F.col("top"), "c": F.col("c") - F.col("left")}).select(*cells.columns)


def _sources(size: int, to: int) -> Column:
    """Array of (target index, source index of its centre)."""
    i = F.sequence(F.lit(0), F.lit(to - 1))
    return F.transform(i, lambda k: F.struct(k.alias("to"), F.least(F.lit(size - 1), F.floor((k + 0.5) * (size / to))).cast("int").alias("src")))


def resample_centres(mask: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Nearest-centre resampling of a mask."""
    grids = mask.select("grid_id").distinct().withColumn("y", F.explode(_sources(shape[0], to[0]))).withColumn("x", F.explode(_sources(shape[1], to[1])))
    target = grids.select("grid_id", F.col("y.src").alias("r"), F.col("x.src").alias("c"), F.col("y.to").alias("tr"), F.col("x.to").alias("tc"))
    return target.join(mask.select(*CELL), CELL, "left_semi").select("grid_id", F.col("tr").alias("r"), F.col("tc").alias("c"))


def resample_any(mask: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Target cells that any cell of the mask overlaps."""
    span = lambda v, a, b: F.sequence(F.floor(F.col(v) * b / a).cast("int"), F.least(F.lit(b - 1), (F.ceil((F.col(v) + 1) * b / a) - 1).cast("int")))
    out = mask.withColumn("tr", F.explode(span("r", shape[0], to[0]))).withColumn("tc", F.explode(span("c", shape[1], to[1])))
    return out.select("grid_id", F.col("tr").alias("r"), F.col("tc").alias("c")).distinct()


def apply_edits(cells: DataFrame, edits: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """cells with edits (grid_id, r, c, d; 0 clears) laid over them; edits outside a mask are refused. edited marks them."""
    allowed = within(edits, mask) if mask is not None else edits
    both = cells.select(*CELL, "d").join(allowed.select(*CELL, F.col("d").alias("new")), CELL, "full")
    return both.select(*CELL, F.coalesce("new", "d").alias("d"), F.col("new").isNotNull().alias("edited")).where("d > 0 OR edited")


def corrections(current: DataFrame, base: DataFrame, edited: DataFrame) -> DataFrame:
    """Cells that were edited or differ from the base, with their code (an explicit 0 counts)."""
    both = current.select(*CELL, "d").join(base.select(*CELL, F.col("d").alias("was")), CELL, "full").join(edited.select(*CELL, F.lit(True).alias("touched")), CELL, "left")
    d, was = F.coalesce("d", F.lit(0)), F.coalesce("was", F.lit(0))
    return both.where(F.col("touched") | (d != was)).select(*CELL, d.alias("d"))


def dilate(mask: DataFrame, reach: int = 1) -> DataFrame:
    """Cells within `reach` rows and columns of the mask."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    out = mask.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    return out.select("grid_id", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).distinct()


def bridges(mask: DataFrame) -> DataFrame:
    """Empty cells between two opposite neighbours of the mask (rows, columns and diagonals)."""
    pairs = [((-1, 0), (1, 0)), ((0, -1), (0, 1)), ((-1, -1), (1, 1)), ((-1, 1), (1, -1))]
    tests = F.array(*[F.struct(F.lit(-a[0]).alias("dr"), F.lit(-a[1]).alias("dc"), F.lit(k).alias("k")) for k, pair in enumerate(pairs) for a in pair])
    near = mask.select(*CELL, F.explode(tests).alias("t")).select("grid_id", (F.col("r") + F.col("t.dr")).alias("r"), (F.col("c") + F.col("t.dc")).alias("c"), "t.k")
    return outside(near.groupBy(*CELL, "k").count().where("count = 2").select(*CELL).distinct(), mask)
