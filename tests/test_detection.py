"""Readings of drawings on drawings made for the purpose."""

import numpy as np
import pytest

from catchment.operators import detection, graph, imaging


@pytest.fixture(scope="module")
def images(spark):
    grid = np.zeros((4, 5), int)
    grid[1, 1:4], grid[2, 3] = 1, 2
    canvas = imaging.draw(grid, 40)
    blank = np.full_like(canvas, 255)
    rows = [("a", *canvas.shape, bytearray(canvas.tobytes())), ("b", *blank.shape, bytearray(blank.tobytes()))]
    return spark.createDataFrame(rows, "image_id string, height int, width int, channels int, data binary")


def test_neutral_ink_leaves_colours():
    a = np.full((40, 60, 3), 255, np.uint8)
    a[10:12, 5:55] = 0
    a[25:28, 5:55] = (200, 30, 20)  # a blue boundary
    ink = detection.pipe_ink(a)
    assert ink[10:12, 6:54].all() and not ink[24:29].any()
    assert detection.neutral_ink(np.full((9, 9, 3), 7, np.uint8)).shape == (9, 9)


def test_edges_of_a_square():
    a = np.full((40, 40), 255.0)
    a[10:30, 10:30] = 0
    found = detection.edges(a)
    y, x = np.nonzero(found)
    assert len(y) >= 60 and all(min(abs(y - 9.5).min(), abs(x - 9.5).min()) <= 2 for y, x in zip(y[:, None], x[:, None]) if 12 < y[0] < 27 and x[0] < 20)
    assert not found[15:25, 15:25].any() and not found[:6].any()


def test_templates_find_themselves():
    for k in (0, 3, 8, 13):
        shape, (tx, ty) = detection.template(2 * np.pi * k / 16, 20 * 1.02)
        canvas = np.zeros((150, 150), bool)
        top = (150 - len(shape)) // 2
        canvas[top : top + len(shape), top : top + len(shape)] = shape
        best = max(detection.template_heads(canvas, 20.0), key=lambda h: h[4])
        assert best[4] == pytest.approx(1.0, abs=0.02)
        assert np.hypot(best[0] - top - tx, best[1] - top - ty) < 2 and best[2] * np.cos(2 * np.pi * k / 16) + best[3] * np.sin(2 * np.pi * k / 16) > 0.99


def test_correlation_matches_sums():
    rng = np.random.default_rng(4)
    mask, shape = rng.random((17, 14)) < 0.4, rng.random((5, 5)) < 0.5
    got = detection.correlation(mask, shape)
    for y in range(2, 15):
        for x in range(2, 12):
            part = mask[y - 2 : y + 3, x - 2 : x + 3]
            assert got[y, x] == pytest.approx((part & shape).sum() / np.sqrt(max(part.sum(), 1) * shape.sum()))


def test_boxes_and_consensus(images):
    boxes = detection.template_boxes(images, rows=(4, 5), least=0.5)
    found = boxes.collect()
    assert {x.image_id for x in found} == {"a"} and all(0 <= x.xmin < x.xmax <= 200 and 0 <= x.ymin < x.ymax <= 160 for x in found)
    kept = detection.consensus(boxes, 16.0, 1).collect()
    assert 1 <= len(kept) <= len(found)
    for a in kept:
        for b in found:
            if np.hypot(a.x - b.x, a.y - b.y) <= 16 and a.dx * b.dx + a.dy * b.dy > 0.7:
                assert b.score <= a.score


def test_turning():
    a = np.full((30, 50, 3), 255, np.uint8)
    a[10, 5:45] = 0
    assert np.array_equal(detection.turned(a, 0.0), a)
    quarter = detection.turned(a, 90.0)
    assert quarter.shape == (50, 30, 3) and np.array_equal(quarter, np.rot90(a))
    assert detection.turned(a, 30.0).shape[0] > 30 and (detection.turned(a, 30.0)[0, 0] == 255).all()


def test_patches(images):
    rows = detection.cell_patches(images, 4, 5).collect()
    assert len(rows) == 40 and all(len(x.patch) == 768 and 0 <= min(x.patch) and max(x.patch) <= 1 + 1e-9 for x in rows)
    blank = [x for x in rows if x.grid_id == "b"]
    assert max(max(x.patch) for x in blank) == 0
    a = np.arange(12.0).reshape(3, 4)
    assert detection.resampled(a, 1)[0, 0] == pytest.approx(a.mean()) and np.allclose(detection.resampled(np.kron(np.eye(2), np.ones((8, 8))), 2), np.eye(2))


def test_white_outside_of_a_region(spark, images):
    region = spark.createDataFrame([("a", 4, 5, [(1, 1), (1, 2)])], "image_id string, rows int, cols int, cells array<struct<r: int, c: int>>")
    out = {x.image_id: np.frombuffer(bytes(x.data), np.uint8).reshape(x.height, x.width, 3) for x in detection.whitened(images, region).collect()}
    assert (out["a"][:40] == 255).all() and (out["a"][:, 120:] == 255).all() and (out["a"][40:80, 40:120] < 255).any() and (out["b"] == 255).all()


def naive_passing(m):
    """Starts that pass each cell, by walking from each until a cell repeats."""
    out = {}
    step = {1: (0, 1), 2: (1, 0), 3: (0, -1), 4: (-1, 0)}
    for r, line in enumerate(m):
        for c, d in enumerate(line):
            at, seen = (r, c), set()
            while d and at not in seen and 0 <= at[0] < len(m) and 0 <= at[1] < len(m[0]) and m[at[0]][at[1]]:
                seen.add(at)
                out[at] = out.get(at, 0) + 1
                dr, dc = step[m[at[0]][at[1]]]
                at = (at[0] + dr, at[1] + dc)
    return out


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_flow_counts_take_cycles_whole(spark, monkeypatch, small):
    import random

    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(14)
    grids = [[[rng.choice([0, 1, 2, 3, 4]) for _ in range(6)] for _ in range(6)] for _ in range(20)]
    rows = [(str(g), r, c, d) for g, m in enumerate(grids) for r, line in enumerate(m) for c, d in enumerate(line) if d]
    got = {(int(x.grid_id), x.r, x.c): x.passing for x in graph.through_counts(spark.createDataFrame(rows, "grid_id string, r int, c int, d int")).collect()}
    assert got == {(g, *k): v for g, m in enumerate(grids) for k, v in naive_passing(m).items()}


def test_shortest_paths_and_backbone(spark):
    import random
    from collections import deque

    rng = random.Random(6)
    masks = [{(r, c) for r in range(7) for c in range(7) if rng.random() < 0.7} | {(0, 0)} for _ in range(12)]

    def distances(mask, start):
        dist, queue = {start: 0}, deque([start])
        while queue:
            r, c = queue.popleft()
            for at in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if at in mask and at not in dist:
                    dist[at] = dist[r, c] + 1
                    queue.append(at)
        return dist

    whole = [set(distances(m, (0, 0))) for m in masks]
    frame = spark.createDataFrame([(str(g), r, c) for g, m in enumerate(whole) for r, c in m], "grid_id string, r int, c int")
    ends = [(str(g), 0, 0, *max(m)) for g, m in enumerate(whole)]
    got = {}
    for x in graph.shortest_path(frame, spark.createDataFrame(ends, "grid_id string, r0 int, c0 int, r1 int, c1 int")).collect():
        got.setdefault(int(x.grid_id), {})[x.k] = (x.r, x.c)
    for g, m in enumerate(whole):
        path = [got[g][k] for k in range(len(got[g]))]
        assert path[0] == (0, 0) and path[-1] == max(m) and set(path) <= m and len(path) - 1 == distances(m, (0, 0))[max(m)]
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:]))
    lone = graph.shortest_path(frame.where("grid_id = '0'"), spark.createDataFrame([("0", 0, 0, 40, 40)], "grid_id string, r0 int, c0 int, r1 int, c1 int")).collect()
    assert [(x.k, x.r, x.c) for x in lone] == [(0, 0, 0)]
    back = {}
    for x in graph.backbone(frame).collect():
        back.setdefault(int(x.grid_id), {})[x.k] = (x.r, x.c)
    for g, m in enumerate(whole):
        first = distances(m, min(m))
        far = min(k for k, v in first.items() if v == max(first.values()))
        assert len(back[g]) - 1 == max(distances(m, far).values()) and back[g][0] == far
