"""Graph operators on one grid held as arrays: what a task does for a grid of bounded size (see graph.on_grids).

Cells are in row-major order; `after` holds the place of the cell that each one's direction points to, -1 where the
flow ends.
"""

from __future__ import annotations

import numpy as np

from catchment.functions.directions import NEIGHBOURS, STEPS

SHIFT = 1 << 31


def links(r: np.ndarray, c: np.ndarray, d: np.ndarray, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the cells, and `after` of the sorted ones. Cells where stop holds end their flow."""
    ids = r.astype(np.int64) * SHIFT + c
    order = np.argsort(ids, kind="stable")
    r, c, d, ids = r[order].astype(np.int64), c[order].astype(np.int64), d[order], ids[order]
    steps = np.array([(0, 0), *(STEPS[k] for k in (1, 2, 3, 4))])
    to_r, to_c = r + steps[d, 0], c + steps[d, 1]
    to = to_r * SHIFT + to_c
    at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    good = (to_r >= 0) & (to_c >= 0) & (ids[at] == to) & (d > 0)
    if stop is not None:
        good &= ~stop[order]
    return order, np.where(good, at, -1)


def ends(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each cell's last cell and the steps to it; -1 for flows that never end. Pointers double each round."""
    n = len(after)
    at, steps = np.where(after < 0, np.arange(n), after), (after >= 0).astype(np.int64)
    for _ in range(max(1, n).bit_length() + 1):
        at, steps = at[at], steps + steps[at]
    done = after[at] < 0
    return np.where(done, at, -1), np.where(done, steps, -1)


def loops(after: np.ndarray) -> np.ndarray:
    """Places of the cells on cycles: where flows that never end are after as many steps as there are cells."""
    sink, _ = ends(after)
    lost = np.flatnonzero(sink < 0)
    at = np.where(after < 0, np.arange(len(after)), after)
    for _ in range(max(1, len(lost)).bit_length() + 1):
        at = at[at]
    return np.unique(at[lost])


def passing(after: np.ndarray) -> np.ndarray:
    """How many starts pass each cell (itself too). A flow into a cycle passes each of its cells once: the cycle is opened at its first cell, and all its cells get that one's number."""
    ring = loops(after)
    opened, first = after.copy(), np.zeros(0, np.int64)
    if len(ring):
        # the first cell of each one's cycle: least places over twice as many steps each round
        low, at = np.arange(len(after)), np.where(after < 0, np.arange(len(after)), after)
        for _ in range(len(ring).bit_length() + 1):
            low, at = np.minimum(low, low[at]), at[at]
        first = low[ring]
        opened[np.unique(first)] = -1
    _, depth = ends(opened)
    total = np.ones(len(after), np.int64)
    for cells in levels(depth):
        if depth[cells[0]] > 0:
            np.add.at(total, opened[cells], total[cells])
    total[ring] = total[first]
    return total


def levels(depth: np.ndarray):
    """Places by depth, the deepest first."""
    order = np.argsort(depth, kind="stable")
    order = order[depth[order] >= 0]
    if len(order):
        yield from reversed(np.split(order, np.flatnonzero(np.diff(depth[order])) + 1))


def flow_lines(after: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Head, length in cells and start (places) of the main basin's flow lines; of equal lines the start in the smallest column, then row, goes on."""
    sink, depth = ends(after)
    sinks, size = np.unique(sink[sink >= 0], return_counts=True)
    if not len(sinks):
        return (np.zeros(0, np.int64),) * 3
    main = sinks[np.lexsort((r[sinks], c[sinks], -size))[0]]
    depth = np.where(sink == main, depth, -1)
    length, start, heads = np.zeros(len(after), np.int64), np.arange(len(after)), []
    for cells in levels(depth):
        if depth[cells[0]] == 0:
            heads.append(cells)
            continue
        to = after[cells]
        order = np.lexsort((r[start[cells]], c[start[cells]], -length[cells], to))
        cells, to = cells[order], to[order]
        first = np.concatenate([[True], to[1:] != to[:-1]])
        length[to[first]], start[to[first]] = length[cells[first]] + 1, start[cells[first]]
        heads.append(cells[~first])
    found = np.concatenate(heads)
    return found, length[found] + 1, start[found]


def breadth_first(seeds: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds (r, c, label; in queue order) spread over open cells (r, c): cell, label, distance and the code back, queue order deciding ties."""
    low = np.minimum(seeds[:, :2].min(axis=0, initial=0), cells.min(axis=0, initial=0)) - 1
    high = np.maximum(seeds[:, :2].max(axis=0, initial=0), cells.max(axis=0, initial=0)) + 2
    if (high - low).prod() > 64 * (len(seeds) + len(cells)) + 1_000_000:
        return sparse_first(seeds, cells)
    free = np.zeros(high - low, bool)
    free[tuple((cells - low).T)] = True
    free[tuple((seeds[:, :2] - low).T)] = False
    step = np.array([(dr, dc) for dr, dc, _ in NEIGHBOURS])
    back = np.array([code for _, _, code in NEIGHBOURS])
    front, label, dist = seeds[:, :2] - low, seeds[:, 2], 0
    out = [(front + low, label, np.zeros(len(front), np.int64), np.zeros(len(front), np.int64))]
    while len(front):
        dist += 1
        to = (front[:, None, :] + step[None]).reshape(-1, 2)
        names, codes = np.repeat(label, len(step)), np.tile(back, len(front))
        some = free[tuple(to.T)]
        to, names, codes = to[some], names[some], codes[some]
        _, first = np.unique(to[:, 0] * (high - low)[1] + to[:, 1], return_index=True)
        first.sort()
        front, label = to[first], names[first]
        free[tuple(front.T)] = False
        out.append((front + low, label, np.full(len(front), dist), codes[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def sparse_first(seeds: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for cells that lie far apart, over a set."""
    free = set(map(tuple, cells.tolist())).difference(map(tuple, seeds[:, :2].tolist()))
    queue, dist, back = [tuple(x) for x in seeds.tolist()], [0] * len(seeds), [0] * len(seeds)
    for k, (r, c, label) in enumerate(queue):
        for dr, dc, code in NEIGHBOURS:
            at = (r + dr, c + dc)
            if at in free:
                free.remove(at)
                queue.append((*at, label))
                dist.append(dist[k] + 1)
                back.append(code)
    found = np.array(queue, np.int64).reshape(-1, 3)
    return found[:, :2], found[:, 2], np.array(dist, np.int64), np.array(back, np.int64)


def connected(r: np.ndarray, c: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the cells, and their components, numbered by first cell."""
    ids = r.astype(np.int64) * SHIFT + c
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    pairs = []
    for dr, dc in steps:
        at = np.minimum(np.searchsorted(ids, ids + dr * SHIFT + dc), len(ids) - 1)
        good = np.flatnonzero(ids[at] == ids + dr * SHIFT + dc)
        pairs.append((good, at[good]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = low[low]
        if np.array_equal(low, label):
            return order, np.unique(label, return_inverse=True)[1]
        label = low
