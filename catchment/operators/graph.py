"""Operators on the functional graph of a direction grid, for any number of grids at once.

cells: grid_id, r, c, d with d in 1..4, sparse (absent cells are 0). Grids of up to SMALL cells are one Arrow group
each, so many grids spread over the cluster and none takes a shuffle a round. Larger ones are iterated
as tables: pointers double, so a grid of depth n takes about log2(n) joins on (grid_id, id), and each round is
a written table. Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.functions import directions, materialise
from catchment.operators import kernels

CELL = ["grid_id", "r", "c"]
SHIFT = 1 << 31
SMALL = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """df written and read back. It meets others in sort-merge joins: files of cells are so much smaller than their rows that Spark would broadcast millions."""
    return materialise.cut(df).hint("merge")


def on_grids(cells: DataFrame, one, many, columns: str) -> DataFrame:
    """one(dict of arrays of a grid's columns) -> arrays for `columns` where a grid has at most SMALL rows, many(rows) -> DataFrame for all others.

    columns: "name type, ..." without grid_id, which comes first.
    """
    cells = cut(cells)
    big = cells.groupBy("grid_id").count().where(F.col("count") > SMALL).select("grid_id")
    some = bool(big.limit(1).count())
    names = [c.split()[0] for c in columns.split(", ")]
    kind = cells.schema["grid_id"].dataType.simpleString()

    def whole(frame):
        import pyarrow as pa

        name = frame.column("grid_id")[0]
        out = one({c: frame.column(c).to_numpy() for c in frame.column_names if c != "grid_id"})
        ids = pa.array([name.as_py()] * len(out[0]), name.type)
        return pa.Table.from_arrays([ids, *(x if isinstance(x, pa.Array) else pa.array(x) for x in out)], ["grid_id", *names])

    schema = f"grid_id {kind}, {columns}"
    if not some:
        return cells.groupBy("grid_id").applyInArrow(whole, schema)
    big = cut(big)
    small = cells.join(big, "grid_id", "left_anti").groupBy("grid_id").applyInArrow(whole, schema)
    return small.unionByName(many(cut(cells.join(big, "grid_id", "left_semi"))).select("grid_id", *names))


def stopped(cells: DataFrame, outlets: DataFrame | None) -> DataFrame:
    """grid_id, r, c, d, stop: whether a cell is an outlet."""
    if outlets is None:
        return cells.select(*CELL, "d", F.lit(False).alias("stop"))
    stops = outlets.select(*CELL, F.lit(True).alias("stop")).distinct()
    return cells.select(*CELL, "d").join(stops, CELL, "left").fillna(False, ["stop"])


def places(found, order, r, c):
    """Ids of places in the sorted cells; null where the place is -1."""
    import pyarrow as pa

    ids = r[order].astype("int64") * SHIFT + c[order]
    return pa.array(ids[found], mask=found < 0) if len(ids) else pa.array([], pa.int64())


def cell_id(r="r", c="c") -> Column:
    return F.col(r).cast("long") * SHIFT + F.col(c)


def row_of(i: str) -> Column:
    return F.expr(f"cast({i} div {SHIFT} as int)")


def col_of(i: str) -> Column:
    return F.expr(f"cast({i} % {SHIFT} as int)")


def target(cells: DataFrame) -> DataFrame:
    """cells with nr, nc: where the direction points."""
    return cells.withColumns({"nr": F.col("r") + directions.row_step(F.col("d")), "nc": F.col("c") + directions.col_step(F.col("d"))})


def edges(cells: DataFrame, outlets: DataFrame | None = None) -> DataFrame:
    """grid_id, id, next: next is null where the flow leaves the active cells, and at outlets."""
    out = target(cells).select("grid_id", cell_id().alias("id"), cell_id("nr", "nc").alias("to"), (F.least("nr", "nc") < 0).alias("off"))
    found = cells.select("grid_id", cell_id().alias("to"), F.lit(True).alias("active"))
    out = out.join(found, ["grid_id", "to"], "left").select("grid_id", "id", F.when(F.col("active") & ~F.col("off"), F.col("to")).alias("next"))
    if outlets is not None:
        stop = outlets.select("grid_id", cell_id().alias("id"), F.lit(True).alias("stop")).distinct()
        out = out.join(stop, ["grid_id", "id"], "left").select("grid_id", "id", F.when(F.col("stop").isNull(), F.col("next")).alias("next"))
    return out


def trace(cells: DataFrame, outlets: DataFrame | None = None) -> DataFrame:
    """grid_id, id, sink, depth: the last cell of each cell's flow and the steps to it; null for flows into cycles."""

    def one(g):
        import pyarrow as pa

        order, after = kernels.links(g["r"], g["c"], g["d"], g["stop"])
        sink, depth = kernels.ends(after)
        own = places(np.arange(len(order)), order, g["r"], g["c"])
        return own, places(sink, order, g["r"], g["c"]), pa.array(depth, mask=depth < 0)

    return on_grids(stopped(cells, outlets), one, trace_large, "id long, sink long, depth long")


def trace_large(cells: DataFrame) -> DataFrame:
    """The same by doubling pointers; cells have a column stop."""
    start = edges(cells, cells.where("stop"))
    ends = F.col("next").isNull()
    state = cut(start.select("grid_id", "id", F.coalesce("next", "id").alias("at"), F.when(ends, 0).otherwise(1).cast("long").alias("steps"), ends.alias("done")))
    known = state.where("done").count()
    while True:
        far = state.select("grid_id", F.col("id").alias("at"), F.col("at").alias("far"), F.col("steps").alias("more"), F.col("done").alias("over"))
        ahead = state.where("NOT done").join(far, ["grid_id", "at"])
        moved = ahead.select("grid_id", "id", F.col("far").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("over").alias("done"))
        state = cut(state.where("done").unionByName(moved))
        now = state.where("done").count()
        if now == known:  # depths along a flow have no gap, so no cell is deeper
            return state.select("grid_id", "id", F.when(F.col("done"), F.col("at")).alias("sink"), F.when(F.col("done"), F.col("steps")).alias("depth"))
        known = now


def cycle_cells(cells: DataFrame, outlets: DataFrame | None = None) -> DataFrame:
    """grid_id, id of the cells on cycles: where flows that never end are after as many steps as there are cells."""

    def one(g):
        order, after = kernels.links(g["r"], g["c"], g["d"], g["stop"])
        return (places(kernels.loops(after), order, g["r"], g["c"]),)

    return on_grids(stopped(cells, outlets), one, cycles_large, "id long")


def cycles_large(cells: DataFrame) -> DataFrame:
    stops = cells.where("stop")
    lost = cut(edges(cells, stops).join(trace_large(cells).where("sink IS NULL").select("grid_id", "id"), ["grid_id", "id"]).select("grid_id", "id", F.col("next").alias("at")))
    most = lost.groupBy("grid_id").count().agg(F.max("count")).first()[0] or 0
    steps = 1
    while steps < most:
        lost = cut(lost.join(lost.select("grid_id", F.col("id").alias("at"), F.col("at").alias("far")), ["grid_id", "at"]).select("grid_id", "id", F.col("far").alias("at")))
        steps *= 2
    return lost.select("grid_id", F.col("at").alias("id")).distinct()


def reaching(cells: DataFrame, outlets: DataFrame) -> DataFrame:
    """grid_id, r, c of cells whose flow enters an outlet, and of the outlets themselves."""
    stops = outlets.select("grid_id", cell_id().alias("sink")).distinct()
    # an outlet need not be active: it then takes flow as a cell of its own
    bare = outlets.select(*CELL).distinct().join(cells.select(*CELL), CELL, "left_anti").withColumn("d", F.lit(0))
    traced = trace(cells.select(*CELL, "d").unionByName(bare), outlets)
    found = traced.join(stops, ["grid_id", "sink"], "left_semi")
    return found.select("grid_id", row_of("id").alias("r"), col_of("id").alias("c"))


def inspect(cells: DataFrame, grids: DataFrame, outlets: DataFrame) -> DataFrame:
    """One row a grid: counts of active, connected, unreachable cells, sources, junctions, outlets, cycle cells, dead ends, exits."""
    outlets = cut(outlets.select(*CELL).distinct())

    def one(g):
        order, after = kernels.links(g["r"], g["c"], g["d"], g["stop"])
        sink, _ = kernels.ends(after)
        stop, incoming = g["stop"][order], np.bincount(after[after >= 0], minlength=len(after))
        step = np.array([(0, 0), *(directions.STEPS[k] for k in (1, 2, 3, 4))])[g["d"]]
        to_r, to_c = g["r"] + step[:, 0], g["c"] + step[:, 1]
        inside = ((to_r >= 0) & (to_c >= 0) & (to_r < g["rows"]) & (to_c < g["cols"]))[order]
        moving = ~stop & (g["rows"] >= 0)[order]
        found = len(order), (incoming == 0).sum(), (incoming >= 2).sum(), (moving & inside & (after < 0)).sum(), (moving & ~inside).sum(), len(kernels.loops(after)), ((sink >= 0) & stop[sink]).sum()
        return tuple(np.array([n], np.int64) for n in found)

    sizes = grids.select("grid_id", "rows", "cols")
    rows = stopped(cells, outlets).join(sizes, "grid_id", "left").fillna(-1, ["rows", "cols"])  # -1: no size, so neither dead ends nor exits
    names = ("active", "sources", "junctions", "dead_ends", "exits", "cycle_cells", "connected")
    out = on_grids(rows, one, inspect_large, ", ".join(f"{n} long" for n in names))
    out = out.join(outlets.groupBy("grid_id").agg(F.count("*").alias("outlets")), "grid_id", "left").fillna(0)
    return out.withColumn("unreachable", F.col("active") - F.col("connected"))


def inspect_large(rows: DataFrame) -> DataFrame:
    """The same counts as tables; rows have stop, rows, cols."""
    cells, stops = rows.select(*CELL, "d", "stop"), rows.where("stop")
    moving = target(rows.where("NOT stop AND rows >= 0"))
    inside = (F.col("nr") >= 0) & (F.col("nc") >= 0) & (F.col("nr") < F.col("rows")) & (F.col("nc") < F.col("cols"))
    active = cells.select("grid_id", F.col("r").alias("nr"), F.col("c").alias("nc"), F.lit(True).alias("active"))
    moved = cut(moving.join(active, ["grid_id", "nr", "nc"], "left").select("*", inside.alias("inside")))
    ends = moved.groupBy("grid_id").agg(F.count_if(F.col("inside") & F.col("active").isNull()).alias("dead_ends"), F.count_if(~F.col("inside")).alias("exits"))
    links = edges(cells, stops).where("next IS NOT NULL").groupBy("grid_id", F.col("next").alias("id")).count()
    degree = cells.select("grid_id", cell_id().alias("id")).join(links, ["grid_id", "id"], "left").groupBy("grid_id").agg(F.count("*").alias("active"), F.count_if(F.col("count").isNull()).alias("sources"), F.count_if(F.col("count") >= 2).alias("junctions"))
    loops = cycles_large(cells).groupBy("grid_id").agg(F.count("*").alias("cycle_cells"))
    connected = trace_large(cells).join(stops.select("grid_id", cell_id().alias("sink")), ["grid_id", "sink"], "left_semi").groupBy("grid_id").agg(F.count("*").alias("connected"))
    out = degree
    for more in (ends, loops, connected):
        out = out.join(more, "grid_id", "left")
    return out.fillna(0)


def rank_outlets(cells: DataFrame, limit: int = 12) -> DataFrame:
    """grid_id, r, c, cells of each grid's `limit` terminals that drain most cells (then by row, column)."""
    counts = trace(cells).where("sink IS NOT NULL").groupBy("grid_id", "sink").agg(F.count("*").alias("cells"))
    place = F.row_number().over(Window.partitionBy("grid_id").orderBy(F.desc("cells"), "sink"))
    return counts.withColumn("place", place).where(F.col("place") <= limit).select("grid_id", row_of("sink").alias("r"), col_of("sink").alias("c"), "cells", "place")


def main_sinks(traced: DataFrame) -> DataFrame:
    """grid_id, sink, cells: the sink with most cells; ties go to the smallest column, then row."""
    counts = traced.where("sink IS NOT NULL").groupBy("grid_id", "sink").agg(F.count("*").alias("cells"))
    best = F.struct("cells", -col_of("sink"), -row_of("sink"))
    return counts.groupBy("grid_id").agg(F.max_by("sink", best).alias("sink"), F.max("cells").alias("cells"))


def flowlines(cells: DataFrame) -> DataFrame:
    """grid_id, head, length, start: the flow lines left by always removing the longest one (see flowlines_large)."""

    def one(g):
        order, after = kernels.links(g["r"], g["c"], g["d"])
        head, length, start = kernels.flow_lines(after, g["r"][order], g["c"][order])
        return places(head, order, g["r"], g["c"]), length, places(start, order, g["r"], g["c"])

    return on_grids(cells.select(*CELL, "d"), one, flowlines_large, "head long, length long, start long")


def flowlines_large(cells: DataFrame) -> DataFrame:
    """The same as tables. Instead of removing them in turn: each cell's best line comes from upstream by the longest way (ties: the
    start in the smallest column, then row); at a confluence the best line goes on and all others end. Best lines are
    found by doubling: a cell's best line within twice as many steps is that of the cells as far upstream.
    """
    cells = cells.withColumn("stop", F.lit(False))
    traced = cut(trace_large(cells))
    basin = traced.join(main_sinks(traced).select("grid_id", "sink"), ["grid_id", "sink"], "left_semi").select("grid_id", "id")
    jump = cut(edges(cells).join(basin, ["grid_id", "id"]).select("grid_id", "id", F.col("next").alias("to")))
    order = lambda i: F.struct((-col_of(i)).alias("c"), (-row_of(i)).alias("r"))
    best = cut(jump.select("grid_id", "id", F.struct(F.lit(0).cast("long").alias("len"), order("id").alias("start")).alias("best")))
    first, steps = jump, 1
    while jump.where("to IS NOT NULL").limit(1).count():
        far = jump.where("to IS NOT NULL").join(best, ["grid_id", "id"]).groupBy("grid_id", F.col("to").alias("id")).agg(F.max(F.struct((F.col("best.len") + steps).alias("len"), F.col("best.start").alias("start"))).alias("far"))
        best = cut(best.join(far, ["grid_id", "id"], "left").select("grid_id", "id", F.greatest("best", F.coalesce("far", "best")).alias("best")))
        jump = cut(jump.where("to IS NOT NULL").join(jump.select("grid_id", F.col("id").alias("to"), F.col("to").alias("far")), ["grid_id", "to"]).select("grid_id", "id", F.col("far").alias("to")))
        steps *= 2
    line = first.join(best, ["grid_id", "id"])
    place = F.row_number().over(Window.partitionBy("grid_id", "to").orderBy(F.desc("best")))
    heads = line.withColumn("place", place).where("place > 1 OR to IS NULL")
    start = (-F.col("best.start.r")).cast("long") * SHIFT - F.col("best.start.c")
    return heads.select("grid_id", F.col("id").alias("head"), (F.col("best.len") + 1).alias("length"), start.alias("start"))


def gamma_index(chains: DataFrame) -> DataFrame:
    """One row a grid: cells, chains, longest, centre of gravity and gamma of its flow-line lengths, mean, deviation, share of the top tenth."""
    place = Window.partitionBy("grid_id").orderBy(F.desc("length"), "start")
    ranked = chains.select("grid_id", "length", F.row_number().over(place).alias("place"), F.count("*").over(Window.partitionBy("grid_id")).alias("n"))
    top = F.sum(F.when(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1)), F.col("length")).otherwise(0))
    out = ranked.groupBy("grid_id").agg(
        F.sum("length").alias("cells"),
        F.count("*").alias("chains"),
        F.max("length").alias("longest"),
        (F.sum(F.col("length") * F.col("length")) / F.sum("length")).alias("centre"),
        F.avg("length").alias("mean"),
        F.coalesce(F.stddev_samp("length"), F.lit(0.0)).alias("deviation"),
        (top / F.sum("length")).alias("top_share"),
    )
    return out.withColumn("gamma", F.col("centre") / F.col("longest"))


def spread(seeds: DataFrame, open_cells: DataFrame) -> DataFrame:
    """Breadth-first from seeds over open cells: grid_id, r, c, label, dist, d.

    seeds: grid_id, r, c, label. d leads one step back towards the seed (0 at seeds). Ties follow a queue: seeds by
    row and column, each taken cell's neighbours in the order north, south, west, east; a cell's rank is that of
    (its parent's rank, the step).
    """

    both = seeds.select(*CELL, F.col("label").cast("long").alias("label"), F.lit(True).alias("seed"))
    both = both.unionByName(open_cells.select(*CELL, F.lit(None).cast("long").alias("label"), F.lit(False).alias("seed")))

    def one(g):
        import pyarrow as pa

        own = g["seed"]
        at = np.stack([g["r"], g["c"]], 1).astype(np.int64)
        first = np.column_stack([at[own], np.nan_to_num(g["label"][own]).astype(np.int64)])
        first = first[np.lexsort((first[:, 1], first[:, 0]))]
        cells, label, dist, d = kernels.breadth_first(first, at[~own])
        return (*(pa.array(x, pa.int32()) for x in cells.T), pa.array(label), *(pa.array(x, pa.int32()) for x in (dist, d)))

    found = on_grids(both, one, spread_large, "r int, c int, label long, dist int, d int")
    return found.withColumn("label", F.col("label").cast(seeds.schema["label"].dataType))


def spread_large(both: DataFrame) -> DataFrame:
    """The same as tables, a round a step."""
    seeds, open_cells = both.where("seed"), both.where("NOT seed")
    rank = F.row_number().over(Window.partitionBy("grid_id").orderBy("r", "c"))
    front = cut(seeds.select(*CELL, "label", F.lit(0).alias("dist"), F.lit(0).alias("d"), rank.alias("rank")))
    found, behind, dist = [front], front, 0
    while True:
        dist += 1
        step = front.select("grid_id", "r", "c", "label", "rank", F.explode(directions.neighbours()).alias("n"))
        step = step.select("grid_id", (F.col("r") + F.col("n.dr")).alias("r"), (F.col("c") + F.col("n.dc")).alias("c"), "label", F.struct("rank", "n.k").alias("by"), F.col("n.back").alias("d"))
        # neighbours of a level lie in it, in the one before or in the next
        new = step.join(open_cells.select(*CELL), CELL, "left_semi").join(front.select(*CELL).unionByName(behind.select(*CELL)), CELL, "left_anti")
        new = new.groupBy(*CELL).agg(F.min(F.struct("by", "label", "d")).alias("won"))
        order = F.row_number().over(Window.partitionBy("grid_id").orderBy("won.by"))
        behind, front = front, cut(new.select(*CELL, "won.label", F.lit(dist).alias("dist"), "won.d", order.alias("rank")))
        if not front.limit(1).count():
            return reduce(DataFrame.unionByName, found).drop("rank")
        found.append(front)


def fill_basin(cells: DataFrame, basin: DataFrame) -> DataFrame:
    """cells with the basin's empty cells directed towards the nearest active cell; column dist is 0 for old cells."""
    open_cells = basin.join(cells.select(*CELL), CELL, "left_anti")
    reached = spread(cells.select(*CELL, F.lit(0).alias("label")), open_cells)
    old = cells.select(*CELL, F.col("d").alias("old"))
    return reached.join(old, CELL, "left").select(*CELL, F.coalesce("old", "d").alias("d"), "dist")


def distance_to_outlet(support: DataFrame, outlets: DataFrame) -> DataFrame:
    """grid_id, r, c, dist over four neighbours from the outlets through support cells."""
    return spread(outlets.select(*CELL, F.lit(0).alias("label")).distinct(), support).select(*CELL, "dist")


def partition_by_outlet(support: DataFrame, outlets: DataFrame) -> DataFrame:
    """grid_id, r, c, label of the nearest outlet; outlets: grid_id, r, c, label, in queue order of row and column."""
    return spread(outlets.select(*CELL, "label"), support).select(*CELL, "label", "dist")


def components(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """grid_id, r, c, component: numbered from 0 by the row-major first cell of each; 4 or 8 neighbours."""
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if diagonal else [])

    def one(g):
        import pyarrow as pa

        order, number = kernels.connected(g["r"], g["c"], steps)
        return g["r"][order], g["c"][order], pa.array(number, pa.int32())

    return on_grids(mask.select(*CELL).distinct(), one, lambda rows: components_large(rows, steps), "r int, c int, component int")


def components_large(mask: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    nodes = cut(mask.select("grid_id", cell_id().alias("id")).distinct())
    near = nodes.select("grid_id", "id", F.explode(F.array(*[F.lit(dr * SHIFT + dc) for dr, dc in steps])).alias("step")).select("grid_id", "id", (F.col("id") + F.col("step")).alias("to"))
    links = cut(near.join(nodes.select("grid_id", F.col("id").alias("to")), ["grid_id", "to"]))
    label = cut(nodes.select("grid_id", "id", F.col("id").alias("low")))
    while True:
        beside = links.join(label.select("grid_id", F.col("id").alias("to"), "low"), ["grid_id", "to"]).groupBy("grid_id", "id").agg(F.min("low").alias("near"))
        low = label.join(beside, ["grid_id", "id"], "left").select("grid_id", "id", F.col("low").alias("was"), F.least("low", F.coalesce("near", "low")).alias("at"))
        far = label.select("grid_id", F.col("id").alias("at"), F.col("low").alias("far"))
        new = cut(low.join(far, ["grid_id", "at"]).select("grid_id", "id", "was", F.least("at", "far").alias("low")))
        label = new.select("grid_id", "id", "low")
        if not new.where("low != was").limit(1).count():
            break
    number = F.dense_rank().over(Window.partitionBy("grid_id").orderBy("low")) - 1
    return label.select("grid_id", row_of("id").alias("r"), col_of("id").alias("c"), number.alias("component"))


def degrees(cells: DataFrame) -> DataFrame:
    """grid_id, r, c, degree (active neighbours) and incoming (flows that enter), and both over their grid's largest."""
    beside = cells.select("grid_id", "r", "c", F.explode(directions.neighbours()).alias("n"))
    beside = beside.select("grid_id", (F.col("r") + F.col("n.dr")).alias("r"), (F.col("c") + F.col("n.dc")).alias("c"), F.lit(1).alias("one"), F.lit(0).alias("into"))
    flows = target(cells).select("grid_id", F.col("nr").alias("r"), F.col("nc").alias("c"), F.lit(0).alias("one"), F.lit(1).alias("into"))
    sums = beside.unionByName(flows).groupBy(*CELL).agg(F.sum("one").alias("degree"), F.sum("into").alias("incoming"))
    out = cells.select(*CELL).join(sums, CELL, "left").fillna(0)
    grid = Window.partitionBy("grid_id")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(c).over(grid)), F.lit(0.0))
    return out.select(*CELL, "degree", "incoming", share("degree").alias("degree_share"), share("incoming").alias("incoming_share"))


def run_lengths(cells: DataFrame, most: int = 6) -> DataFrame:
    """grid_id, r, c, run: steps that the flow keeps to active cells, `most` at the most."""

    def one(g):
        import pyarrow as pa

        order, after = kernels.links(g["r"], g["c"], g["d"])
        at, run = np.arange(len(after)), np.zeros(len(after), np.int32)
        for _ in range(most):
            on = after[at] >= 0
            run += on
            at = np.where(on, after[at], at)
        return pa.array(g["r"][order], pa.int32()), pa.array(g["c"][order], pa.int32()), run

    return on_grids(cells.select(*CELL, "d"), one, lambda rows: run_lengths_large(rows, most), "r int, c int, run int")


def run_lengths_large(cells: DataFrame, most: int) -> DataFrame:
    """The same as tables, a join a step."""
    jump = cut(edges(cells))
    run = jump.select("grid_id", "id", F.col("next").alias("at"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("run"))
    for _ in range(most - 1):
        step = jump.select("grid_id", F.col("id").alias("at"), "next")
        run = run.join(step, ["grid_id", "at"], "left").select("grid_id", "id", F.col("next").alias("at"), (F.col("run") + F.when(F.col("next").isNull(), 0).otherwise(1)).alias("run"))
    return run.select("grid_id", row_of("id").alias("r"), col_of("id").alias("c"), "run")


def downhill(support: DataFrame, dist: DataFrame, cells: DataFrame) -> DataFrame:
    """grid_id, r, c, d towards the neighbour nearest the outlet; active ones first, then north, south, west, east."""
    step = support.join(dist, CELL).where("dist > 0").select("grid_id", "r", "c", "dist", F.explode(directions.neighbours()).alias("n"))
    to = step.select("*", (F.col("r") + F.col("n.dr")).alias("nr"), (F.col("c") + F.col("n.dc")).alias("nc"))
    near = dist.select("grid_id", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("dist").alias("near"))
    used = cells.select("grid_id", F.col("r").alias("nr"), F.col("c").alias("nc"), F.lit(0).alias("free"))
    to = to.join(near.hint("merge"), ["grid_id", "nr", "nc"]).join(used.hint("merge"), ["grid_id", "nr", "nc"], "left").where("near < dist")
    # distance, then free, then the neighbour's place in order, as one number: hashed, where structs would be sorted
    key = F.col("near").cast("long") * 8 + F.when((F.col("near") == 0) | F.col("free").isNotNull(), 0).otherwise(4) + F.col("n.k")
    codes = F.array(*[directions.axis_code(F.lit(dr), F.lit(dc)) for dr, dc, _ in directions.NEIGHBOURS])
    return to.groupBy(*CELL).agg(F.min(key).alias("key")).select(*CELL, F.get(codes, (F.col("key") % 4).cast("int")).alias("d"))


def coarse(v: Column, src: int, dst: int) -> Column:
    return F.floor(v * dst / src).cast("int")


def coarsen(cells: DataFrame, shape: tuple[int, int], to: tuple[int, int], outlets: DataFrame | None = None, lost: float = 0.35) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (n, hits), direction votes (w) and transitions (t) of a grid on a coarser one.

    Each fine cell's whole flow path, up to an outlet and with the empty cell that it may end in, crosses coarse cells.
    A path's steps count for every start upstream of them, so a step's weight is the number of starts that pass it (by
    doubling), not a walk from each start. All of them share their end: flows that miss the outlets weigh `lost`.
    """
    fine = target(cut(fates(cells, outlets)))
    fine = fine.withColumn("share", F.lit(1.0) if outlets is None else F.when(F.col("good"), 1.0).otherwise(lost))
    spot = lambda r, c: [coarse(F.col(r), shape[0], to[0]).alias("r"), coarse(F.col(c), shape[1], to[1]).alias("c")]
    inside = (F.col("nr") >= 0) & (F.col("nc") >= 0) & (F.col("nr") < shape[0]) & (F.col("nc") < shape[1])
    moved = fine.where(inside & ~F.col("stop")).select("grid_id", *spot("r", "c"), coarse(F.col("nr"), shape[0], to[0]).alias("nr"), coarse(F.col("nc"), shape[1], to[1]).alias("nc"), (F.col("passing") * F.col("share")).alias("weight"))
    code = directions.axis_code(F.col("nr") - F.col("r"), F.col("nc") - F.col("c"))
    moves = cut(moved.withColumn("d", code).where("d > 0").groupBy("grid_id", "r", "c", "d").agg(F.round(F.sum("weight"), 6).alias("t")))
    own = fine.select("grid_id", *spot("r", "c"), "d", "share")
    votes = own.groupBy("grid_id", "r", "c", "d").agg(F.count("*").alias("w"))
    into = moves.select("grid_id", (F.col("r") + directions.row_step(F.col("d"))).alias("r"), (F.col("c") + directions.col_step(F.col("d"))).alias("c"), F.lit(0).alias("n"), F.col("t").alias("hits"))
    counts = own.select(*CELL, F.lit(1).alias("n"), F.col("share").alias("hits")).unionByName(into).groupBy(*CELL).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return cut(counts), cut(votes), moves


def fates(cells: DataFrame, outlets: DataFrame | None = None) -> DataFrame:
    """grid_id, r, c, d, stop, passing (see through_counts), good: whether the cell's flow enters an outlet (see reaching), in one pass over a grid."""
    rows = stopped(cells, outlets).withColumn("bare", F.lit(False))
    if outlets is not None:  # an outlet that isn't active takes flow as a cell of its own
        bare = outlets.select(*CELL).distinct().join(cells.select(*CELL).hint("merge"), CELL, "left_anti")
        rows = rows.unionByName(bare.select(*CELL, F.lit(0).alias("d"), F.lit(True).alias("stop"), F.lit(True).alias("bare")))

    def one(g):
        order, after = kernels.links(g["r"], g["c"], g["d"], g["stop"])
        sink, _ = kernels.ends(after)
        stop, own = g["stop"][order], ~g["bare"][order]
        cells = (g[v][order][own].astype(np.int32) for v in ("r", "c", "d"))
        return *cells, stop[own], kernels.passing(after)[own], ((sink >= 0) & stop[sink])[own]

    return on_grids(rows, one, fates_large, "r int, c int, d int, stop boolean, passing long, good boolean")


def fates_large(rows: DataFrame) -> DataFrame:
    """The same as tables."""
    stops = rows.where("stop").select("grid_id", cell_id().alias("sink"))
    good = trace_large(rows).join(stops, ["grid_id", "sink"], "left_semi").select("grid_id", row_of("id").alias("r"), col_of("id").alias("c"), F.lit(True).alias("good"))
    own = rows.where("NOT bare").select(*CELL, F.col("d").cast("int").alias("d"), "stop")
    return own.join(through_large(own), CELL).join(good, CELL, "left").fillna(False, ["good"])


def through_counts(cells: DataFrame, outlets: DataFrame | None = None) -> DataFrame:
    """grid_id, r, c, passing: starts (the cell itself too) whose flow passes a cell; a flow into a cycle passes each of its cells once."""

    def one(g):
        order, after = kernels.links(g["r"], g["c"], g["d"], g["stop"])
        return g["r"][order], g["c"][order], kernels.passing(after)

    return on_grids(stopped(cells, outlets), one, through_large, "r int, c int, passing long")


def through_large(cells: DataFrame) -> DataFrame:
    """The same as tables: cycles are opened at their first cell, sums double along the trees."""
    ring = cut(cycles_large(cells))
    jump = edges(cells, cells.where("stop"))
    low = None
    if ring.limit(1).count():
        low = cut(jump.join(ring, ["grid_id", "id"]).select("grid_id", "id", F.col("next").alias("at"), F.col("id").alias("low")))
        most, steps = low.groupBy("grid_id").count().agg(F.max("count")).first()[0], 1
        while steps <= most:
            ahead = low.select("grid_id", F.col("id").alias("at"), F.col("at").alias("far"), F.col("low").alias("more"))
            low = cut(low.join(ahead, ["grid_id", "at"]).select("grid_id", "id", F.col("far").alias("at"), F.least("low", "more").alias("low")))
            steps *= 2
        opened = low.where("id = low").select("grid_id", "id", F.lit(True).alias("opened"))
        jump = jump.join(opened, ["grid_id", "id"], "left").select("grid_id", "id", F.when(F.col("opened").isNull(), F.col("next")).alias("next"))
    jump = cut(jump.select("grid_id", "id", F.col("next").alias("to")))
    total = cut(jump.select("grid_id", "id", F.lit(1).cast("long").alias("n")))
    while jump.where("to IS NOT NULL").limit(1).count():
        more = jump.where("to IS NOT NULL").join(total, ["grid_id", "id"]).groupBy("grid_id", F.col("to").alias("id")).agg(F.sum("n").alias("more"))
        total = cut(total.join(more, ["grid_id", "id"], "left").select("grid_id", "id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        jump = cut(jump.where("to IS NOT NULL").join(jump.select("grid_id", F.col("id").alias("to"), F.col("to").alias("far")), ["grid_id", "to"]).select("grid_id", "id", F.col("far").alias("to")))
    if low is not None:
        first = low.select("grid_id", "id", "low").join(total.select("grid_id", F.col("id").alias("low"), F.col("n").alias("whole")), ["grid_id", "low"])
        total = total.join(first.select("grid_id", "id", "whole"), ["grid_id", "id"], "left").select("grid_id", "id", F.coalesce("whole", "n").alias("n"))
    return total.select("grid_id", row_of("id").alias("r"), col_of("id").alias("c"), F.col("n").alias("passing"))


def rated_steps(support: DataFrame, votes: DataFrame, moves: DataFrame) -> DataFrame:
    """grid_id, r, c, d, nr, nc, cost, t, vote, conf: the steps from each supported cell to its supported neighbours."""
    options = support.select(*CELL, F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("d"))
    options = options.withColumns({"nr": F.col("r") + directions.row_step(F.col("d")), "nc": F.col("c") + directions.col_step(F.col("d"))})
    options = options.join(support.select("grid_id", F.col("r").alias("nr"), F.col("c").alias("nc")), ["grid_id", "nr", "nc"], "left_semi")
    key = ["grid_id", "r", "c", "d"]
    total_votes, total_moves = votes.groupBy(*CELL).agg(F.sum("w").alias("all_w")), moves.groupBy(*CELL).agg(F.sum("t").alias("all_t"))
    rated = options.join(votes, key, "left").join(moves, key, "left").join(total_votes, CELL, "left").join(total_moves, CELL, "left")
    vote, move = F.coalesce(F.col("w") / F.col("all_w"), F.lit(0.0)), F.coalesce(F.col("t") / F.col("all_t"), F.lit(0.0))
    cost = 1.75 - 1.15 * move - 0.5 * vote - F.when(move > 0.55, 0.2).otherwise(0.0)
    cost = F.when((move <= 0) & (vote <= 0), 3.0).otherwise(F.least(F.lit(3.0), F.greatest(F.lit(0.12), cost)))
    conf = F.least(F.lit(1.0), 0.25 + 0.45 * move + 0.3 * vote)
    return rated.select(*CELL, "d", "nr", "nc", cost.alias("cost"), F.coalesce("t", F.lit(0.0)).alias("t"), vote.alias("vote"), conf.alias("conf"))


def compress(cells: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """grid_id, r, c, d, conf of a grid without an outlet on `to` rows and columns.

    A coarse cell is supported by any fine cell or passing flow; of its supported neighbours it points
    to the one with the least edge cost, then the most transitions, votes, and the lowest code.
    """
    counts, votes, moves = coarsen(cells, shape, to)
    rated = rated_steps(counts.select(*CELL), votes, moves)
    best = rated.groupBy(*CELL).agg(F.min_by(F.struct("d", "conf"), F.struct("cost", -F.col("t"), -F.col("vote"), "d")).alias("best"))
    return best.select(*CELL, "best.d", "best.conf")


def compress_to_outlet(cells: DataFrame, outlets: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """grid_id, r, c, d, conf of grids with one outlet each, and a row a grid: outlet_r, outlet_c, dropped.

    A coarse cell is supported by fine cells on 8 % of its area, or by visits of weight 0.95. Cells from which support does not
    lead to the outlet are dropped; the others point to the neighbour nearest it, then as in `compress`, then the one nearest by rows and
    columns. The outlet has no direction and full confidence.
    """
    counts, votes, moves = coarsen(cells, shape, to, outlets)
    stops = outlets.select("grid_id", coarse(F.col("r"), shape[0], to[0]).alias("r"), coarse(F.col("c"), shape[1], to[1]).alias("c"))
    least = max(1.0, shape[0] / to[0] * shape[1] / to[1] * 0.08)
    held = cut(counts.where((F.col("n") >= least) | (F.col("hits") >= 0.95)).select(*CELL))
    bare = counts.where("n > 0").join(held.select("grid_id").distinct(), "grid_id", "left_anti").select(*CELL)
    support = cut(held.unionByName(bare).unionByName(stops).distinct())
    dist = cut(distance_to_outlet(support, stops))
    steps = rated_steps(dist.select(*CELL), votes, moves).join(dist.select("grid_id", F.col("r").alias("nr"), F.col("c").alias("nc"), "dist"), ["grid_id", "nr", "nc"])
    steps = steps.join(stops.select("grid_id", F.col("r").alias("to_r"), F.col("c").alias("to_c")), "grid_id").where("NOT (r = to_r AND c = to_c)")
    away = F.abs(F.col("nr") - F.col("to_r")) + F.abs(F.col("nc") - F.col("to_c"))
    best = steps.groupBy(*CELL).agg(F.min_by(F.struct("d", "conf"), F.struct("dist", "cost", -F.col("t"), -F.col("vote"), away, "d")).alias("best"))
    out = best.select(*CELL, "best.d", "best.conf").unionByName(stops.select(*CELL, F.lit(0).alias("d"), F.lit(1.0).alias("conf")))
    dropped = support.join(dist, CELL, "left_anti").groupBy("grid_id").agg(F.count("*").alias("dropped"))
    return out, stops.select("grid_id", F.col("r").alias("outlet_r"), F.col("c").alias("outlet_c")).join(dropped, "grid_id", "left").fillna(0, ["dropped"])


def gap_fills(cells: DataFrame, support: DataFrame, fillable: DataFrame | None = None) -> DataFrame:
    """grid_id, r, c, d for empty support cells between two directed neighbours of their component (which four-neighbours always share).

    Of a cell's pairs of directed neighbours, both ways, the way that most of the two directions agree with wins (then the fewest that
    contradict; then the pair first in the order north, south, west, east, and the way from its first). All cells look at the grid as given.
    """
    empty = support.select(*CELL).distinct().join(cells.select(*CELL), CELL, "left_anti")
    if fillable is not None:
        empty = empty.join(fillable.select(*CELL).distinct(), CELL, "left_semi")
    near = empty.select(*CELL, F.explode(directions.neighbours()).alias("n")).select(*CELL, (F.col("r") + F.col("n.dr")).alias("nr"), (F.col("c") + F.col("n.dc")).alias("nc"), "n.k", "n.back")
    held = cells.join(support.select(*CELL).distinct(), CELL, "left_semi").select("grid_id", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("d").alias("own"))
    near = near.join(held, ["grid_id", "nr", "nc"])
    # a neighbour's code towards the cell is `back`, the cell's code towards it the opposite
    list_ = F.array_sort(F.collect_list(F.struct("k", "back", "own")))
    rows = near.groupBy(*CELL).agg(list_.alias("l")).where("size(l) >= 2")
    pairs = rows.select(*CELL, F.posexplode("l").alias("i", "a"), "l").select(*CELL, "i", "a", F.posexplode("l").alias("j", "b")).where("i < j")

    def way(source, sink, order: int) -> Column:
        on = directions.opposite(sink["back"])  # the code from the cell to the sink
        agree = (source["own"] == source["back"]).cast("int") + (sink["own"] == on).cast("int")
        return F.struct(agree.alias("agree"), (agree - 2).alias("against"), F.lit(-order).alias("order"), on.alias("d"))

    ways = pairs.select(*CELL, "i", "j", F.explode(F.array(way(F.col("a"), F.col("b"), 0), way(F.col("b"), F.col("a"), 1))).alias("w"))
    best = F.max_by("w.d", F.struct("w.agree", "w.against", -F.col("i"), -F.col("j"), "w.order"))
    return ways.groupBy(*CELL).agg(best.alias("d"))


def guide_to_outlet(cells: DataFrame, support: DataFrame, outlets: DataFrame, fillable: DataFrame | None = None) -> DataFrame:
    """grid_id, r, c, d, dist for empty support cells: towards the neighbour nearest the outlet, one with a direction first (as given: no fill sees another)."""
    routes = support.select(*CELL).unionByName(outlets.select(*CELL)).distinct()
    dist = cut(distance_to_outlet(routes, outlets))
    empty = routes.join(cells.select(*CELL), CELL, "left_anti")
    if fillable is not None:
        empty = empty.join(fillable.select(*CELL).distinct(), CELL, "left_semi")
    return downhill(cut(empty), dist, cells).join(dist, CELL)


def progress(cells: DataFrame, outlets: DataFrame, most: int = 4) -> DataFrame:
    """grid_id, r, c, steps: how far each flow goes on over active cells, `most` at the most and for any that meets an outlet within so many."""
    jump = cut(edges(cells.unionByName(outlets.join(cells, CELL, "left_anti").select(*CELL, F.lit(0).alias("d"))), outlets))
    stops = outlets.select("grid_id", cell_id().alias("at"), F.lit(True).alias("stop")).distinct()
    walk = jump.select("grid_id", "id", F.col("id").alias("at"), F.lit(0).alias("steps"))
    for _ in range(most):
        step = jump.select("grid_id", F.col("id").alias("at"), "next")
        walk = walk.join(step, ["grid_id", "at"], "left").join(stops, ["grid_id", "at"], "left")
        on = F.col("next").isNotNull()
        walk = walk.select("grid_id", "id", F.when(on, F.col("next")).otherwise(F.col("at")).alias("at"), F.when(F.col("stop"), most).when(on, F.col("steps") + 1).otherwise(F.col("steps")).alias("steps"))
    return walk.join(cells.select("grid_id", cell_id().alias("id")), ["grid_id", "id"], "left_semi").select("grid_id", row_of("id").alias("r"), col_of("id").alias("c"), "steps")


def remaining(chains: DataFrame) -> DataFrame:
    """chains (grid_id, head, length, ...) with the cells that are left of their grid before each one is removed, the longest first."""
    w = Window.partitionBy("grid_id").orderBy(F.desc("length"), "start")
    total = F.sum("length").over(Window.partitionBy("grid_id"))
    before = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return chains.withColumn("left", total - F.coalesce(before, F.lit(0)))


def shortest_path(mask: DataFrame, ends: DataFrame) -> DataFrame:
    """grid_id, k, r, c: a shortest four-connected path inside the mask from (r0, c0) to (r1, c1) of each grid, ties by the order in which a
    breadth-first search from the start takes cells; only the start where there is none."""
    start = ends.select("grid_id", F.col("r0").alias("r"), F.col("c0").alias("c"), F.lit(0).alias("label"))
    found = spread(start, mask.select(*CELL).unionByName(start.select(*CELL)).distinct())
    goal = ends.select("grid_id", F.col("r1").alias("r"), F.col("c1").alias("c"), F.lit(True).alias("goal"))
    found = found.join(goal.hint("merge"), CELL, "left").select(*CELL, "d", F.coalesce("goal", F.lit(False)).alias("goal"))

    def one(g):
        import pyarrow as pa

        # d leads back to the start: the path is the flow from the goal, or the start alone
        order, after = kernels.links(g["r"], g["c"], g["d"])
        last = np.flatnonzero(g["goal"][order])
        path = [int(last[0])] if len(last) else np.flatnonzero(g["d"][order] == 0)[:1].tolist()
        while len(last) and after[path[-1]] >= 0:
            path.append(int(after[path[-1]]))
        at = order[np.array(path[::-1], np.int64)]
        return tuple(pa.array(x, pa.int32()) for x in (np.arange(len(at)), g["r"][at], g["c"][at]))

    return on_grids(found, one, path_large, "k int, r int, c int")


def path_large(found: DataFrame) -> DataFrame:
    """The same as tables; found has a column goal."""
    goal = found.where("goal").select(*CELL)
    lone = found.where("d = 0").join(goal.select("grid_id"), "grid_id", "left_anti").select(*CELL, F.lit(0).alias("back"))
    steps = cut(trace_from(found.select(*CELL, "d"), goal).unionByName(lone))
    last = steps.groupBy("grid_id").agg(F.max("back").alias("last"))
    return steps.join(last, "grid_id").select("grid_id", (F.col("last") - F.col("back")).alias("k"), "r", "c")


def trace_from(flow: DataFrame, starts: DataFrame) -> DataFrame:
    """grid_id, r, c, back: the cells on the flow (which ends at cells without a direction, d 0) from one start a grid, and the steps from it. The flow is doubled: the cells within 2^n steps hand on those 2^n further."""
    jump = cut(edges(flow, flow.where("d = 0")).select("grid_id", "id", F.col("next").alias("to")))
    on = cut(starts.select("grid_id", cell_id().alias("id"), F.lit(0).alias("back")))
    steps = 1
    while True:
        more = on.join(jump.where("to IS NOT NULL"), ["grid_id", "id"]).select("grid_id", F.col("to").alias("id"), (F.col("back") + steps).alias("back"))
        more = cut(more)
        if not more.limit(1).count():
            return on.select("grid_id", row_of("id").alias("r"), col_of("id").alias("c"), "back")
        on = cut(on.unionByName(more))
        jump = cut(jump.where("to IS NOT NULL").join(jump.select("grid_id", F.col("id").alias("to"), F.col("to").alias("far")), ["grid_id", "to"]).select("grid_id", "id", F.col("far").alias("to")))
        steps *= 2


def backbone(mask: DataFrame) -> DataFrame:
    """grid_id, k, r, c: a longest shortest path of a connected mask, by two breadth-first searches: from the first cell to the farthest, and from there (the first in row-major order of the farthest)."""
    far = lambda df: df.groupBy("grid_id").agg(F.min_by(F.struct("r", "c"), F.struct(-F.col("dist"), "r", "c")).alias("p")).select("grid_id", "p.r", "p.c")
    first = mask.groupBy("grid_id").agg(F.min(F.struct("r", "c")).alias("p")).select("grid_id", "p.r", "p.c")
    one = cut(far(distance_to_outlet(mask, first)))
    two = cut(far(distance_to_outlet(mask, one)))
    both = one.select("grid_id", F.col("r").alias("r0"), F.col("c").alias("c0")).join(two.select("grid_id", F.col("r").alias("r1"), F.col("c").alias("c1")), "grid_id")
    return shortest_path(mask, both)
