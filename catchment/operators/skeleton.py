"""Thinned lines as a pixel graph, and what follows from it for cells: support, heads and their halo, guidance.

Line pixels are rows (image_id, x, y); grids: image_id, rows, cols, width, height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.operators import masks

CELL = ["grid_id", "r", "c"]


def pixel_links(line: DataFrame) -> DataFrame:
    """image_id, x, y, nx, ny: each pair of touching line pixels (eight neighbours), both ways, by an equi-join on the neighbour's place."""
    step = F.sequence(F.lit(-1), F.lit(1))
    sent = line.select("image_id", "x", "y").distinct().withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).where("dx <> 0 OR dy <> 0")
    sent = sent.select("image_id", "x", "y", (F.col("x") + F.col("dx")).alias("nx"), (F.col("y") + F.col("dy")).alias("ny"))
    return sent.join(line.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny")).distinct(), ["image_id", "nx", "ny"])


def pixel_kinds(line: DataFrame) -> DataFrame:
    """image_id, x, y, degree, kind: end (one neighbour or none), path (two) or branch."""
    degree = pixel_links(line).groupBy("image_id", "x", "y").agg(F.count("*").alias("degree"))
    out = line.select("image_id", "x", "y").distinct().join(degree, ["image_id", "x", "y"], "left").fillna(0, ["degree"])
    return out.withColumn("kind", F.when(F.col("degree") <= 1, "end").when(F.col("degree") == 2, "path").otherwise("branch"))


def needs_more_scales(line: DataFrame, labels: DataFrame, found: DataFrame) -> DataFrame:
    """image_id, more: whether heads should be looked for on further scales: a component has many ends or branches, and few heads were found.

    labels: image_id, x, y, label; found: image_id, heads (their number).
    """
    kinds = pixel_kinds(line).join(labels, ["image_id", "x", "y"]).groupBy("image_id", "label").agg(F.count_if(F.col("kind") == "end").alias("ends"), F.count_if(F.col("kind") == "branch").alias("branches"))
    most = kinds.groupBy("image_id").agg(F.max("ends").alias("ends"), F.max("branches").alias("branches")).join(found, "image_id", "left").fillna(0, ["heads"])
    tangled = (F.col("ends") >= 24) & (F.col("branches") >= 60)
    expected = F.least(F.lit(48), F.greatest(F.lit(8), F.rint(F.col("ends") * 0.5)))
    busy = (F.col("ends") >= 8) | (F.col("branches") >= 8)
    return most.select("image_id", (busy & ((F.col("heads") < 2) | (tangled & (F.col("heads") < expected)))).alias("more"))


def cell_at(x: Column, y: Column) -> tuple[Column, Column]:
    """Row and column of a pixel, clipped to the grid (columns rows, cols, width, height)."""
    place = lambda v, n, size: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor(v / (F.col(size) / F.col(n).cast("double"))).cast("int")))
    return place(y, "rows", "height"), place(x, "cols", "width")


def line_support(line: DataFrame, grids: DataFrame) -> DataFrame:
    """grid_id, r, c: four-connected cells under a thinned line; where touching pixels lie in cells that touch at a corner only, the cell beside the upper one (along its row) belongs to them too."""
    pixels = line.select("image_id", "x", "y").distinct().join(grids, "image_id")
    own = pixels.select(F.col("image_id").alias("grid_id"), *[v.alias(n) for v, n in zip(cell_at(F.col("x"), F.col("y")), ("r", "c"))])
    links = pixel_links(line).where("(y, x) < (ny, nx)").join(grids, "image_id")
    (r, c), (nr, nc) = cell_at(F.col("x"), F.col("y")), cell_at(F.col("nx"), F.col("ny"))
    steps = links.select(F.col("image_id").alias("grid_id"), r.alias("r"), c.alias("c"), nr.alias("nr"), nc.alias("nc"))

    def beside(low: str, high: str) -> Column:
        down = F.col(high) < F.col(low)
        return F.when(F.col(high) == F.col(low), F.array().cast("array<int>")).otherwise(F.sequence(F.col(low) + F.when(down, -1).otherwise(1), F.col(high)))

    along = F.transform(beside("c", "nc"), lambda v: F.struct(F.col("r").alias("r"), v.alias("c")))
    across = F.transform(beside("r", "nr"), lambda v: F.struct(v.alias("r"), F.col("nc").alias("c")))
    more = steps.where("r <> nr OR c <> nc").select("grid_id", F.explode(F.concat(along, across)).alias("p")).select("grid_id", "p.r", "p.c")
    return own.unionByName(more).distinct()


def taper(widths: Column, probe: int = 8) -> Column:
    """Score of an arrow head at the first place of a line's widths: how much it narrows there, how thick it grows behind, how long it is (weights are fixed values)."""
    own = F.slice(widths, 1, F.least(F.size(widths), F.lit(max(3, probe))))
    inner = F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(1)))
    tip = F.get(own, F.lit(0))
    mean = F.aggregate(inner, F.lit(0.0), lambda s, v: s + v) / F.size(inner)
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    score = 0.60 * clip((mean - tip) / F.greatest(mean, F.lit(0.75))) + 0.25 * clip((F.array_max(inner) - tip) / 2.5) + 0.15 * clip((F.size(own) - 2) / 6)
    return F.when(F.size(widths) >= 3, score).otherwise(0.0)


def heading(path: Column, dx: Column, dy: Column, probe: int = 4) -> Column:
    """Cosine between a path's last steps (an array of structs x, y, tail to head) and a direction; 0 where either has no length."""
    head, anchor = F.element_at(path, -1), F.element_at(path, F.greatest(F.lit(1), F.size(path) - max(1, probe)))
    vx, vy = head["x"] - anchor["x"], head["y"] - anchor["y"]
    length = F.hypot(vx, vy) * F.hypot(dx, dy)
    return F.when((F.size(path) >= 2) & (length > 1e-9), (vx * dx + vy * dy) / length).otherwise(0.0)


def head_cells(heads: DataFrame, grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (grid_id, r, c) of heads' tips (heads: image_id, x, y; half to even), and those within one row and column inside the grid."""
    at = cell_at(F.rint("x").cast("int"), F.rint("y").cast("int"))
    rows = heads.join(grids, "image_id").select(F.col("image_id").alias("grid_id"), at[0].alias("r"), at[1].alias("c"), "rows", "cols").distinct()
    near = masks.dilate(rows.select(*CELL)).join(rows.select("grid_id", "rows", "cols").distinct(), "grid_id")
    return rows.select(*CELL), near.where("r >= 0 AND c >= 0 AND r < rows AND c < cols").select(*CELL)


def guidance(directed: DataFrame, traced: DataFrame, occupied: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells that a route may use, and those of them that may be filled: seeds, and empty cells that bridge two opposite seeds.

    Seeds are the directed and the traced cells; in a grid without any, the occupied cells of components. components: grid_id, r, c, component.
    A bridge stands between seeds of one component (or of none).
    """
    seeds = masks.union(directed, traced)
    bare = occupied.join(components.select(*CELL), CELL, "left_semi").join(seeds.select("grid_id").distinct(), "grid_id", "left_anti")
    seeds = masks.union(seeds, bare)
    named = seeds.join(components.select(*CELL, "component"), CELL, "left").fillna(0, ["component"])
    whole = masks.bridges(seeds)
    pairs = [((-1, 0), (1, 0)), ((0, -1), (0, 1)), ((-1, -1), (1, 1)), ((-1, 1), (1, -1))]
    tests = F.array(*[F.struct(F.lit(-a[0]).alias("dr"), F.lit(-a[1]).alias("dc"), F.lit(k).alias("k")) for k, pair in enumerate(pairs) for a in pair])
    near = named.select(*CELL, "component", F.explode(tests).alias("t")).select("grid_id", (F.col("r") + F.col("t.dr")).alias("r"), (F.col("c") + F.col("t.dc")).alias("c"), "t.k", "component")
    agreed = near.groupBy(*CELL, "k").agg(F.count("*").alias("n"), (F.min("component") == F.max("component")).alias("one")).where("n = 2 AND one").select(*CELL).distinct()
    fillable = masks.within(whole, agreed).join(directed.select(*CELL), CELL, "left_anti")
    return masks.union(seeds, fillable), fillable
