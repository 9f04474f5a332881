"""Further readings of a drawing, one image a row in Arrow functions: neutral ink, edges, arrow templates, scales, turned images, patches.

Published methods in NumPy (Otsu's threshold, Sobel gradients, normalised cross-correlation by FFT, area resampling); see imaging.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.operators.imaging import blur, gray_of, ink_mask, neighbours8, otsu

BOXES = "image_id string, scale int, x double, y double, dx double, dy double, score double, xmin int, ymin int, xmax int, ymax int"


def colours_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a[..., :1], 3, axis=2) if channels == 1 else a[..., :3]


def neutral_ink(colours: np.ndarray) -> np.ndarray:
    """Dark pixels (Otsu) of little colour: the limit follows the dark pixels' own (fixed values); all dark pixels if next to none is neutral."""
    gray = 0.114 * colours[..., 0] + 0.587 * colours[..., 1] + 0.299 * colours[..., 2]
    dark = gray <= otsu(gray)
    high, low = colours.max(axis=2).astype(float), colours.min(axis=2).astype(float)
    chroma = (high - low) / np.maximum(high, 1.0)
    if not dark.any():
        return dark
    limit = np.clip(np.quantile(chroma[dark], 0.40) + 0.04, 0.08, 0.24)
    neutral = dark & (chroma <= limit)
    return neutral if neutral.sum() >= 8 else dark


def pipe_ink(colours: np.ndarray) -> np.ndarray:
    """Neutral ink, and robust ink beside it; lone pixels go."""
    gray = 0.114 * colours[..., 0] + 0.587 * colours[..., 1] + 0.299 * colours[..., 2]
    detail = neutral_ink(colours)
    zone = detail | neighbours8(detail)[::2].any(0)
    found = detail | (ink_mask(gray) & zone)
    return found & neighbours8(found).any(0)


def edges(gray: np.ndarray, low: float = 40.0, high: float = 110.0) -> np.ndarray:
    """Gradient maxima across their direction, strong ones and the weak ones that touch them (a Canny detector)."""
    p = np.pad(blur(gray), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.hypot(gx, gy)
    near = neighbours8(size)  # clockwise from the north
    sector = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4  # 0 across, 1 down the diagonal, 2 down, 3 up it
    pairs = np.stack([np.maximum(near[2], near[6]), np.maximum(near[3], near[7]), np.maximum(near[0], near[4]), np.maximum(near[1], near[5])])
    top = size >= np.take_along_axis(pairs, sector[None], 0)[0]
    strong, weak = top & (size >= high), top & (size >= low)
    while True:
        more = strong | (weak & neighbours8(strong).any(0))
        if np.array_equal(more, strong):
            return strong
        strong = more


def template(angle: float, span: float) -> tuple[np.ndarray, tuple[float, float]]:
    """A drawn arrow of a direction (a triangle of a length near the cell's span, and a shaft behind it), and where its tip lies."""
    length, dx, dy = max(7.0, 0.92 * span), np.cos(angle), np.sin(angle)
    half, shaft, thick = 0.43 * length, max(5.0, 0.58 * span), max(1.0, 0.05 * span)
    size = int(2 * np.ceil(length + shaft) + 3)
    mid = size // 2
    y, x = np.mgrid[:size, :size] - mid
    along, aside = x * dx + y * dy, np.abs(-x * dy + y * dx)
    tip = 0.48 * length
    behind = tip - along  # how far behind the tip
    head = (behind >= 0) & (behind <= length) & (aside <= half * behind / length)
    return head | ((behind > length) & (behind <= length + shaft) & (aside <= thick)), (mid + tip * dx, mid + tip * dy)


def correlation(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of a mask with a template at each place where the template's middle may lie, by FFT."""
    h, w = mask.shape[0] + shape.shape[0] - 1, mask.shape[1] + shape.shape[1] - 1
    image = np.fft.rfft2(mask.astype(float), (h, w))
    turn = lambda k: np.fft.irfft2(image * np.fft.rfft2(k[::-1, ::-1].astype(float), (h, w)), (h, w))
    cut = np.s_[shape.shape[0] // 2 : shape.shape[0] // 2 + mask.shape[0], shape.shape[1] // 2 : shape.shape[1] // 2 + mask.shape[1]]
    hits, area = turn(shape)[cut], turn(np.ones_like(shape))[cut]
    return hits / np.sqrt(np.maximum(area, 1.0) * shape.sum())


def template_heads(mask: np.ndarray, span: float, least: float = 0.53, angles: int = 16, scales=(0.78, 1.02, 1.28)) -> list[tuple]:
    """(x, y, dx, dy, score) of tips where an arrow template fits best around, over angles and scales."""
    out = []
    for scale in scales:
        for k in range(angles):
            angle = 2 * np.pi * k / angles
            shape, (tx, ty) = template(angle, span * scale)
            if min(mask.shape) <= shape.shape[0]:
                continue
            fit = correlation(mask, shape)
            best = (fit >= least) & (fit >= neighbours8(fit).max(0)) & mask
            for y, x in zip(*np.nonzero(best)):
                mid = shape.shape[0] // 2
                out.append((x + tx - mid, y + ty - mid, np.cos(angle), np.sin(angle), float(min(1.0, 0.34 + 0.66 * fit[y, x]))))
    return out


def template_boxes(images: DataFrame, rows: tuple[int, ...] = (20, 30, 50), least: float = 0.62) -> DataFrame:
    """BOXES of arrow heads found by templates on several scales (heights in rows, whatever the grid that is asked for)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                mask = pipe_ink(colours_of(row["data"], row["height"], row["width"], row["channels"]))
                out = []
                for n in rows:
                    span = max(row["height"] / n, 1.0)
                    reach = max(3, round(0.6 * span))
                    for x, y, dx, dy, score in template_heads(mask, span, least):
                        out.append((row["image_id"], n, x, y, dx, dy, score, max(0, round(x) - reach), max(0, round(y) - reach), min(row["width"], round(x) + reach + 1), min(row["height"], round(y) + reach + 1)))
                columns = list(zip(*out)) if out else [[]] * 11
                kinds = [pa.string(), pa.int32(), *[pa.float64()] * 5, *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in BOXES.split(", ")])

    return images.select("image_id", "height", "width", "channels", "data").mapInArrow(run, BOXES)


def consensus(boxes: DataFrame, reach: float, least: int = 2) -> DataFrame:
    """The best head of each place that `least` scales agree on, or one scale with a score of 0.8 or more; heads that oppose each other may touch.

    boxes: BOXES. Heads meet others in bins of side `reach`; a head stays if none better that points alike is within reach.
    """
    at = lambda v: F.floor(F.col(v) / reach).cast("int")
    step = F.sequence(F.lit(-1), F.lit(1))
    named = boxes.withColumn("id", F.xxhash64("image_id", "scale", "x", "y", "dx", "dy"))
    sent = named.withColumn("bx", F.explode(F.transform(step, lambda d: at("x") + d))).withColumn("by", F.explode(F.transform(step, lambda d: at("y") + d)))
    other = named.select("image_id", at("x").alias("bx"), at("y").alias("by"), *[F.col(c).alias(f"o_{c}") for c in ("id", "scale", "x", "y", "dx", "dy", "score")])
    near = sent.join(other, ["image_id", "bx", "by"]).where((F.col("x") - F.col("o_x")) ** 2 + (F.col("y") - F.col("o_y")) ** 2 <= reach * reach)
    alike = F.col("dx") * F.col("o_dx") + F.col("dy") * F.col("o_dy") > 0.7
    better = (F.col("o_score") > F.col("score")) | ((F.col("o_score") == F.col("score")) & (F.col("o_id") < F.col("id")))
    votes = near.where(alike).groupBy("image_id", "id").agg(F.count_distinct("o_scale").alias("scales"), F.bool_or(better).alias("beaten"))
    kept = votes.where(~F.col("beaten") & (F.col("scales") >= least))
    sure = votes.where(~F.col("beaten") & (F.col("scales") < least)).join(named.where("score >= 0.8").select("image_id", "id"), ["image_id", "id"])
    good = kept.select("image_id", "id", "scales").unionByName(sure.select("image_id", "id", "scales"))
    return named.join(good, ["image_id", "id"]).drop("id")


def turned(colours: np.ndarray, degrees: float) -> np.ndarray:
    """An image turned counter-clockwise about its middle on a white canvas that holds all of it (bilinear)."""
    h, w = colours.shape[:2]
    a = np.radians(degrees)
    cos, sin = np.cos(a), np.sin(a)
    nw, nh = int(round(abs(w * cos) + abs(h * sin))), int(round(abs(w * sin) + abs(h * cos)))
    y, x = np.mgrid[:nh, :nw].astype(float)
    x, y = x - (nw - 1) / 2, y - (nh - 1) / 2
    sx, sy = cos * x - sin * y + (w - 1) / 2, sin * x + cos * y + (h - 1) / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    padded = np.pad(colours.astype(float), ((1, 2), (1, 2), (0, 0)), constant_values=255.0)
    inside = (x0 >= -1) & (x0 <= w - 1) & (y0 >= -1) & (y0 <= h - 1)
    cx, cy = np.clip(x0, -1, w - 1) + 1, np.clip(y0, -1, h - 1) + 1
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    top = padded[cy, cx] * (1 - fx) + padded[cy, cx + 1] * fx
    low = padded[cy + 1, cx] * (1 - fx) + padded[cy + 1, cx + 1] * fx
    out = np.where(inside[..., None], top * (1 - fy) + low * fy, 255.0)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def resampled(image: np.ndarray, size: int) -> np.ndarray:
    """An image at size x size by area: each new pixel is the mean of what it covers."""

    def weights(n: int) -> np.ndarray:
        edge = np.linspace(0, n, size + 1)
        low, high = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(1, n + 1))
        cover = np.clip(high - low, 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return weights(image.shape[0]) @ image @ weights(image.shape[1]).T


def cell_patches(images: DataFrame, rows: int, cols: int, side: int = 16) -> DataFrame:
    """grid_id, r, c, patch: three channels (darkness, ink, edges; 0..1) of the 3 x 3 cells around each cell, side x side each, flat; nothing lies outside of the image."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                gray = gray_of(row["data"], row["height"], row["width"], row["channels"])
                maps = np.stack([1 - gray / 255, pipe_ink(colours_of(row["data"], row["height"], row["width"], row["channels"])), edges(gray)]).astype(float)
                h, w = gray.shape
                ys, xs = np.rint(np.arange(-1, rows + 2) * h / rows).astype(int), np.rint(np.arange(-1, cols + 2) * w / cols).astype(int)
                top, left = int(-ys[0]), int(-xs[0])
                held = np.pad(maps, ((0, 0), (top, int(max(0, ys[-1] - h))), (left, int(max(0, xs[-1] - w)))))
                for r in range(rows):
                    out = []
                    for c in range(cols):
                        part = held[:, ys[r] + top : max(ys[r] + 1, ys[r + 3]) + top, xs[c] + left : max(xs[c] + 1, xs[c + 3]) + left]
                        out.append(np.concatenate([resampled(k, side).ravel() for k in part]))
                    n = len(out)
                    yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]] * n, pa.string()), pa.array([r] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([v.tolist() for v in out], pa.list_(pa.float64()))], ["grid_id", "r", "c", "patch"])

    return images.select("image_id", "height", "width", "channels", "data").mapInArrow(run, "grid_id string, r int, c int, patch array<double>")


def whitened(images: DataFrame, region: DataFrame) -> DataFrame:
    """images with all pixels white outside of a region (image_id, rows, cols, cells: array of structs r, c)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if row["cells"] is None:
                    continue
                a = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"]).copy()
                keep = np.zeros((row["rows"], row["cols"]), bool)
                keep[[k["r"] for k in row["cells"]], [k["c"] for k in row["cells"]]] = True
                y, x = np.arange(row["height"]) * row["rows"] // row["height"], np.arange(row["width"]) * row["cols"] // row["width"]
                a[~keep[y[:, None], x[None]]] = 255
                row["data"] = a.tobytes()
            yield pa.RecordBatch.from_pylist([{c: row[c] for c in ("image_id", "height", "width", "channels", "data")} for row in rows], schema=schema)

    import pyarrow as pa

    schema = pa.schema([("image_id", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
    both = images.select("image_id", "height", "width", "channels", "data").join(region, "image_id", "left")
    return both.mapInArrow(run, "image_id string, height int, width int, channels int, data binary")
