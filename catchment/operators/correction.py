"""Repairs that are sequential inside a grid: least-cost connections to the outlet, loop repair, propagation.

Each plan sees the edits before it, so a grid (or an outlet's part of it) is one group of an Arrow function;
grids spread over the cluster. A grid is bounded: `MAX_CELLS`.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.functions.directions import NEIGHBOURS, STEPS

MAX_CELLS = 2_000_000
TASKS = 200
CODE = {step: code for code, step in STEPS.items()}
EDITED = "grid_id string, r int, c int, d int, state string"


def edit_cost(now: int, new: int, head: bool, halo: bool) -> int:
    """Cost of giving a cell a direction: none if it has it, much if it is empty, little at arrow heads (fixed values)."""
    if now == new:
        return 0
    return 120 if now == 0 else 1 if head else 3 if halo else 7


class Grid:
    """One grid as arrays: d, route (cells that may carry flow), head, halo."""

    def __init__(self, d, route, head, halo, outlet):
        self.d, self.route, self.head, self.halo, self.outlet = d, route, head, halo, outlet
        self.edits = 0

    def inside(self, r, c):
        return 0 <= r < self.d.shape[0] and 0 <= c < self.d.shape[1]

    def follow(self, start):
        """The cells of the flow from start, and whether it enters the outlet; ends before a repeated cell."""
        seen, at = {}, start
        while at != self.outlet and at not in seen:
            seen[at] = True
            code = int(self.d[at])
            if not code:
                return list(seen), False
            to = (at[0] + STEPS[code][0], at[1] + STEPS[code][1])
            if not self.inside(*to) or (to != self.outlet and not self.route[to]):
                return list(seen), False
            at = to
        return [*seen, at], at == self.outlet

    def reached(self):
        """Mask of cells whose flow enters the outlet."""
        out = np.zeros(self.d.shape, bool)
        out[self.outlet], queue = True, [self.outlet]
        for r, c in queue:
            for dr, dc, back in NEIGHBOURS:
                at = (r + dr, c + dc)
                if self.inside(*at) and not out[at] and self.route[at] and self.d[at] == back:
                    out[at] = True
                    queue.append(at)
        return out

    def cheapest(self, start, goals, bridges=1):
        """Least-cost path (edits times 100 plus steps) from start to a goal; an empty cell off the route costs 1000 more, `bridges` at most."""
        best, heap, came = {(start, 0): 0}, [(0, start, 0)], {}
        while heap:
            cost, at, used = heapq.heappop(heap)
            if cost > best[at, used]:
                continue
            if goals[at]:
                path, key = [at], (at, used)
                while key in came:
                    key = came[key]
                    path.append(key[0])
                return path[::-1]
            for step, code in CODE.items():
                to = (at[0] + step[0], at[1] + step[1])
                if not self.inside(*to):
                    continue
                more = 0 if self.route[to] or to == self.outlet else 1
                if used + more > bridges:
                    continue
                price = cost + 100 * edit_cost(int(self.d[at]), code, bool(self.head[at]), bool(self.halo[at])) + 1 + 1000 * more
                key = (to, used + more)
                if price < best.get(key, 1 << 60):
                    best[key], came[key] = price, (at, used)
                    heapq.heappush(heap, (price, *key))
        return None

    def lay(self, path):
        for at, to in zip(path, path[1:]):
            code = CODE[to[0] - at[0], to[1] - at[1]]
            if self.d[at] != code:
                self.d[at], self.route[at] = code, True
                self.edits += 1

    def extend(self, reached, path):
        """Adds to reached the path's cells, which now lead into it, and all whose flow enters them. Nothing reached is lost: a plan only edits cells outside."""
        queue = [at for at in path if not reached[at]]
        for at in queue:
            reached[at] = True
        for r, c in queue:
            for dr, dc, back in NEIGHBOURS:
                at = (r + dr, c + dc)
                if self.inside(*at) and not reached[at] and self.route[at] and self.d[at] == back:
                    reached[at] = True
                    queue.append(at)

    def repair(self, attempts=8):
        """Connects every routed cell that can be: starts in row-major order, sources first; each plan sees the ones before. Returns the mask of connected cells."""
        entered = np.zeros(self.d.shape, bool)
        for r, c in zip(*np.nonzero(self.d)):
            dr, dc = STEPS[int(self.d[r, c])]
            if self.inside(r + dr, c + dc):
                entered[r + dr, c + dc] = True
        cells = [tuple(map(int, x)) for x in zip(*np.nonzero(self.route & (self.d > 0)))]
        reached = self.reached()
        for start in sorted(cells, key=lambda x: (bool(entered[x]), x)):
            for _ in range(attempts):
                if reached[start]:
                    break
                path, _ = self.follow(start)
                # leave the failing flow where the way to a connected cell is cheapest: its last cell comes first
                plan = self.cheapest(path[-1] if self.inside(*path[-1]) else start, reached)
                if plan is None or len(plan) < 2:
                    break
                self.lay(plan)
                self.extend(reached, plan)
        return reached


def correct(cells: DataFrame, outlets: DataFrame, heads: DataFrame | None = None, extra_route: DataFrame | None = None) -> DataFrame:
    """EDITED: cells (grid_id, r, c, d) after repair; state is kept, edited or unresolved (still reaching no outlet).

    outlets: grid_id, r, c, one a grid. heads: cells with arrow heads (their 3 x 3 halo is cheaper to edit too).
    extra_route: further cells that may carry flow.
    """
    layers = cells.select("grid_id", "r", "c", "d", F.lit(0).alias("kind"))
    layers = layers.unionByName(outlets.select("grid_id", "r", "c", F.lit(0).alias("d"), F.lit(1).alias("kind")))
    for more, kind in ((heads, 2), (extra_route, 3)):
        if more is not None:
            layers = layers.unionByName(more.select("grid_id", "r", "c", F.lit(0).alias("d"), F.lit(kind).alias("kind")))

    def run(key, frame):
        import pandas as pd

        rows, cols = int(frame.r.max()) + 1, int(frame.c.max()) + 1
        if rows * cols > MAX_CELLS:
            raise ValueError(f"grid {key[0]} has more than {MAX_CELLS} cells")
        mask = lambda kind: _mask(frame, kind, (rows, cols))
        own = frame[frame.kind == 0]
        d = np.zeros((rows, cols), int)
        d[own.r, own.c] = own.d
        before, head = d.copy(), mask(2)
        stop = frame[frame.kind == 1]
        if not len(stop):
            return pd.DataFrame({"grid_id": key[0], "r": own.r, "c": own.c, "d": own.d, "state": "unresolved"})
        grid = Grid(d, (d > 0) | mask(3), head, _grow(head), (int(stop.r.iloc[0]), int(stop.c.iloc[0])))
        reached = grid.repair()
        at = np.nonzero((grid.d > 0) | (before > 0))
        state = np.where(~reached[at], "unresolved", np.where(grid.d[at] != before[at], "edited", "kept"))
        return pd.DataFrame({"grid_id": key[0], "r": at[0], "c": at[1], "d": grid.d[at], "state": state})

    # a repair is long for its few bytes: by their size, Spark would put most grids into a few tasks
    return layers.repartition(TASKS, "grid_id").groupBy("grid_id").applyInPandas(run, EDITED)


def _mask(frame, kind, shape):
    out = np.zeros(shape, bool)
    some = frame[frame.kind == kind]
    out[some.r, some.c] = True
    return out


def _grow(mask):
    out = np.pad(mask, 1)
    wide = np.zeros_like(out)
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            wide |= np.roll(np.roll(out, dr, 0), dc, 1)
    return wide[1:-1, 1:-1]


def correct_by_outlet(cells: DataFrame, labels: DataFrame, outlets: DataFrame) -> DataFrame:
    """Grids with several outlets: each cell belongs to its nearest outlet's part (labels), parts are repaired apart and put together.

    labels: grid_id, r, c, label; outlets: grid_id, r, c, label. Cells without a label are unresolved.
    """
    part = lambda df: df.withColumn("whole", F.col("grid_id")).withColumn("grid_id", F.concat_ws("#", "grid_id", F.col("label").cast("string")))
    labelled = cells.join(labels.select("grid_id", "r", "c", "label"), ["grid_id", "r", "c"], "left")
    done = correct(part(labelled.where("label IS NOT NULL")), part(outlets)).withColumn("grid_id", F.substring_index("grid_id", "#", 1))
    lost = labelled.where("label IS NULL").select("grid_id", "r", "c", "d", F.lit("unresolved").alias("state"))
    return done.unionByName(lost)


#: Share of the old heading at each step, least cosine of the best step, and by how much it must beat the next (fixed values).
KEEP, LEAST_TURN, MARGIN = 0.65, -0.10, 0.20


def walk_line(start, first, free, codes):
    """The cells from start over first along empty line cells (free), and the directed cell (codes) that ends the walk, if one does.

    Each step takes the neighbour that fits the heading best; a neighbour that fits nearly as well is a branch, where the walk ends.
    """
    path, seen = [start, first], {start, first}
    heading = (first[0] - start[0], first[1] - start[1])
    while path[-1] not in codes:
        at, fits = path[-1], []
        for step in STEPS.values():
            to = (at[0] + step[0], at[1] + step[1])
            if to not in seen and (to in free or to in codes):
                fits.append((step[0] * heading[0] + step[1] * heading[1], to, step))
        fits.sort(key=lambda f: -f[0])
        if not fits or fits[0][0] < LEAST_TURN or (len(fits) > 1 and fits[1][0] >= fits[0][0] - MARGIN):
            return path, None
        _, to, step = fits[0]
        path.append(to)
        seen.add(to)
        mixed = tuple(KEEP * h + (1 - KEEP) * s for h, s in zip(heading, step))
        length = np.hypot(*mixed)
        heading = tuple(m / length for m in mixed)
    return path, path[-1]


def walk_codes(path, met, codes, downstream):
    """Cell -> code for the empty cells of a walk: on along it, or back against it; none if the directed cell at its end flows the other way."""
    flow = path if downstream else path[::-1]
    steps = {a: CODE[b[0] - a[0], b[1] - a[1]] for a, b in zip(flow, flow[1:])}
    if met is not None:
        into, own = (path[-2:] if downstream else path[:-3:-1]), STEPS[codes[met]]
        if (into[1][0] - into[0][0]) * own[0] + (into[1][1] - into[0][1]) * own[1] < 0:
            return {}
    if downstream and met is None:  # the last cell goes on as the one before
        steps[path[-1]] = steps[path[-2]] if len(path) > 2 else codes[path[0]]
    return {at: code for at, code in steps.items() if at not in codes}


def propagate(cells: DataFrame, support: DataFrame, least_share: float = 0.67) -> DataFrame:
    """grid_id, r, c, d, conf: directions for empty support cells that continue directed cells along unbranched lines, both ways.

    Walks start from the directed cells as given, so no filled cell spreads on. A cell takes the code that most of its walks propose, if
    it is alone and has `least_share` of them; more walks make it surer, 0.64 at most. A grid is one group, with a checked bound.
    """

    def run(key, frame):
        import pandas as pd

        if len(frame) > MAX_CELLS:
            raise ValueError(f"grid {key[0]} has more than {MAX_CELLS} cells")
        rows = list(frame[["r", "c", "d", "line"]].itertuples(index=False, name=None))
        codes = {(r, c): d for r, c, d, line in rows if d > 0 and line}
        free = {(r, c) for r, c, d, line in rows if d == 0 and line}
        votes: dict = {}
        for start, code in sorted(codes.items()):
            ahead = STEPS[code]
            for downstream, step in ((True, ahead), (False, (-ahead[0], -ahead[1]))):
                first = (start[0] + step[0], start[1] + step[1])
                if first in free:
                    path, met = walk_line(start, first, free, codes)
                    for at, proposed in walk_codes(path, met, codes, downstream).items():
                        votes.setdefault(at, []).append(proposed)
        out = []
        for (r, c), proposed in sorted(votes.items()):
            counts = np.bincount(proposed, minlength=5)
            best = int(counts.argmax())
            if counts[best] >= least_share * len(proposed) and (counts == counts[best]).sum() == 1:
                out.append((key[0], r, c, best, min(0.64, 0.44 + 0.08 * counts[best])))
        return pd.DataFrame(out, columns=["grid_id", "r", "c", "d", "conf"])

    line = support.select("grid_id", "r", "c").distinct().withColumn("line", F.lit(True))
    both = cells.select("grid_id", "r", "c", "d").join(line, ["grid_id", "r", "c"], "full").fillna(0, ["d"]).fillna(False, ["line"])
    return both.groupBy("grid_id").applyInPandas(run, "grid_id string, r int, c int, d int, conf double")


def suppress(candidates: DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """Greedy suppression per image: candidates (image_id, x, y, dx, dy, score) by falling score; one stays if no better
    one that stayed is near it and points alike (cosine over 0.7; opposite ones under -0.55 never suppress). The best
    `most` are left, all if it is None."""

    def run(frame):
        frame = frame.sort_values(["score", "x", "y"], ascending=[False, True, True])
        kept: list[int] = []
        x, y, dx, dy = (frame[c].to_numpy() for c in ("x", "y", "dx", "dy"))
        for i in range(len(frame)):
            if most is not None and len(kept) >= most:
                break
            k = np.array(kept, int)
            near = np.hypot(x[k] - x[i], y[k] - y[i]) <= radius
            if not (near & (dx[k] * dx[i] + dy[k] * dy[i] > 0.7)).any():
                kept.append(i)
        return frame.iloc[kept]

    return candidates.groupBy("image_id").applyInPandas(run, candidates.schema)
