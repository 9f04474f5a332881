"""Sections of drawn strokes against plain sampling, single linkage against all pairs, recovered heads against a plain pass."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catchment.operators import linkage, sections

HEADS = "image_id string, head_id long, x double, y double, dx double, dy double, span double"


def plain_section(ink, x, y, dx, dy, span, distance):
    n = math.hypot(dx, dy)
    if n <= 1e-6:
        return 0.0, 0.0
    ux, uy = dx / n, dy / n
    step, half = max(1.0, span / 10), max(3.0, span * 1.4)
    offsets, k = [], 0
    while -half + k * step < half + 0.5 * step:
        offsets.append(-half + k * step)
        k += 1
    cx, cy = x - ux * distance * span, y - uy * distance * span
    hit = [(round(cx - uy * o), round(cy + ux * o)) in ink for o in offsets]
    if not any(hit):
        return 0.0, 0.0
    middle = min(range(len(offsets)), key=lambda i: abs(offsets[i]))
    anchor = min((i for i in range(len(hit)) if hit[i]), key=lambda i: abs(i - middle))
    if abs(offsets[anchor]) > max(step * 2.5, span * 0.18):
        return 0.0, 0.0
    low = high = anchor
    while low > 0 and hit[low - 1]:
        low -= 1
    while high + 1 < len(hit) and hit[high + 1]:
        high += 1
    less, more = abs(min(0.0, offsets[low])), max(0.0, offsets[high])
    return offsets[high] - offsets[low], min(less, more) / max(less, more, 1e-6)


def drawing():
    """A thick bar, an arrow head of growing width on a thin shaft, and scattered dots."""
    rng = random.Random(1)
    ink = {(x, y) for x in range(10, 60) for y in range(20, 27)}
    ink |= {(100 - k, 50 + j) for k in range(12) for j in range(-(k // 2), k // 2 + 1)} | {(x, 50) for x in range(60, 100)}
    return ink | {(rng.randrange(130), rng.randrange(80)) for _ in range(400)}


def test_sections(spark):
    ink = drawing()
    rng = random.Random(2)
    heads = [("a", 0, 59.0, 23.0, 1.0, 0.0, 8.0), ("a", 1, 100.2, 50.1, 1.0, 0.0, 7.0), ("a", 2, 30.0, 20.0, 0.0, 0.0, 7.0), ("b", 3, 59.0, 23.0, 1.0, 0.0, 8.0)]
    heads += [("a", 10 + k, rng.uniform(0, 130), rng.uniform(0, 80), rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice([2.0, 7.3, 25.0])) for k in range(60)]
    frame = spark.createDataFrame(heads, HEADS)
    pixels = spark.createDataFrame([("a", x, y) for x, y in ink] * 2, "image_id string, x int, y int")
    distances = (-0.48, 0.0, 0.62, 1.7)
    for r in sections.cross_sections(frame, pixels, distances).collect():
        head = next(h for h in heads if h[1] == r.head_id)
        want = plain_section(ink if head[0] == "a" else set(), *head[2:], r.distance)
        assert abs(r.width - want[0]) < 1e-9 and abs(r.balance - want[1]) < 1e-9
    scores = {r.head_id: r.score for r in sections.local_scores(frame, pixels).collect()}
    assert len(scores) == len(heads) and scores[2] == 0 and abs(scores[3] - 0.10 * 0.28) < 1e-9  # without a direction; without ink, of which nothing lies ahead
    assert scores[1] > 0.5 and scores[1] > scores[0]
    assert sections.local_scores(frame.limit(0), pixels).count() == 0


def plain_clusters(points, gap):
    label = {}
    for image, i, x, y in points:
        if i in label:
            continue
        todo, seen = [(i, x, y)], {i}
        while todo:
            _, ax, ay = todo.pop()
            for other, j, bx, by in points:
                if other == image and j not in seen and (ax - bx) ** 2 + (ay - by) ** 2 <= gap * gap:
                    seen.add(j)
                    todo.append((j, bx, by))
        label |= {j: min(seen) for j in seen}
    return label


@pytest.mark.parametrize("gap", [0.7, 3.0, 9.5])
def test_linkage(spark, gap):
    rng = random.Random(gap)
    points = [(rng.choice("ab"), k, rng.uniform(-60, 60), rng.choice([float(rng.randrange(40)), rng.uniform(0, 40)])) for k in range(250)]
    points += [("a", 300 + k, 5.0, 5.0) for k in range(80)] + [("b", 400 + k, gap * k, 100.0) for k in range(40)]  # one place; a chain of steps of the gap
    frame = spark.createDataFrame(points, "image_id string, id long, x double, y double")
    got = {r.id: r.cluster for r in linkage.linked(frame, gap).collect()}
    assert got == plain_clusters(points, gap)


def test_new_heads(spark):
    rng = random.Random(4)
    columns = "image_id string, cluster long, x double, y double, dx double, dy double, score double"
    rows = [(rng.choice("pq"), k, float(rng.randrange(30)), float(rng.randrange(30)), *rng.choice([(2.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.8, 0.6)]), k / 100) for k in range(80)]
    known = [(rng.choice("pq"), float(rng.randrange(30)), float(rng.randrange(30)), 1.0, 0.0, 0.5) for _ in range(6)]
    old = spark.createDataFrame(known, "image_id string, x double, y double, dx double, dy double, score double")
    got = {r.cluster for r in linkage.new_heads(spark.createDataFrame(rows, columns), old, 6.0, 7).collect()}
    want = set()
    near = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1]) <= 0.72 * 6 and (a[2] * b[2] + a[3] * b[3]) / (math.hypot(*a[2:4]) * math.hypot(*b[2:4])) > 0.45
    for image in "pq":
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: -r[6]):
            if len(kept) < 7 and not any(near(r[2:6], o) for o in [k[1:5] for k in known if k[0] == image] + [k[2:6] for k in kept]):
                kept.append(r)
        want |= {r[1] for r in kept}
    assert got == want


def test_recovered_heads_rules(spark):
    columns = "image_id string, id long, x double, y double, dx double, dy double, score double, area double, xmin double, ymin double, xmax double, ymax double"
    box = (0.0, 0.0, 1.0, 1.0)
    rows = [
        ("a", 1, 0.0, 0.0, 1.0, 0.0, 0.9, 0.0, *box), ("a", 2, 2.0, 0.0, 1.0, 0.1, 0.7, 5.0, 2.0, 0.0, 9.0, 1.0), ("a", 3, 1.0, 0.0, -1.0, 0.0, 0.6, 5.0, *box),  # two agree, one is against them
        ("a", 4, 50.0, 0.0, 0.0, 1.0, 0.95, 5.0, *box),  # alone and best of its image
        ("a", 5, 90.0, 0.0, 0.0, 1.0, 0.85, 5.0, *box),  # alone and not good enough beside it
        ("a", 6, 120.0, 0.0, 0.0, 0.0, 0.95, 5.0, *box), ("a", 7, 150.0, 0.0, 1.0, 0.0, 0.2, 5.0, *box),  # no direction; too low
    ]
    got = {r.cluster: r for r in linkage.recovered_heads(spark.createDataFrame(rows, columns), 3.0).collect()}
    assert set(got) == {1, 4} and (got[1].members, got[1].x, got[1].area, got[1].xmax) == (2, 2.0, 6.0, 9.0)
    assert got[1].dx > 0.99 and got[4].dy == 1.0
    assert Counter(r.members for r in got.values()) == Counter({2: 1, 1: 1})
