"""Learned correction: standardising, nearest exemplars, neighbourhood features, splits, override rules.

Exemplars go to the queries in blocks of about `BLOCK` rows, each one matrix; a batch of queries is multiplied with a
block, only the k best of a query leave it, and the best of all blocks are merged. Queries stay where they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["grid_id", "r", "c"]
BLOCK = 20_000


def moments(samples: DataFrame, x: str = "x") -> DataFrame:
    """One row: arrays mean and std (population; under 1e-6 counts as 1) of each dimension."""
    long = samples.select(F.posexplode(x).alias("i", "v"))
    per = long.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    row = F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s")).alias("s"))))
    return per.agg(row.alias("row")).select(F.transform("row", lambda k: k["m"]).alias("mean"), F.transform("row", lambda k: k["s"]).alias("std"))


def standardise(samples: DataFrame, stats: DataFrame, x: str = "x") -> DataFrame:
    """samples with x scaled by the one row of stats (two arrays as long as x)."""
    mean, std = stats.first()
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    z = F.transform(F.arrays_zip(F.col(x).alias("v"), m.alias("m"), s.alias("s")), lambda k: (k["v"] - k["m"]) / k["s"])
    return samples.withColumn(x, z)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def blocks(exemplars: DataFrame):
    """Ids, vectors (a matrix) and labels of the exemplars, some BLOCK at a time."""
    parts = -(-exemplars.count() // BLOCK)
    rows = exemplars.select(F.col("sample_id").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label"))
    for k in range(parts):
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k) if parts > 1 else rows
        held = some.toArrow().combine_chunks()  # about BLOCK rows
        if held.num_rows:
            yield held.column("id").to_numpy(), matrix(held.column("x").combine_chunks()), held.column("label").to_numpy()


def matrix(column) -> np.ndarray:
    """An Arrow list column whose lists are equally long."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


NEAR = "array<struct<dist: double, id: bigint, label: int>>"


def best_of_block(queries: DataFrame, held, k: int, copies: float | None = None) -> DataFrame:
    """query_id, near: the k nearest of one block but the query itself (with copies: but those within that distance)."""
    ids, x, labels = held
    norms = (x * x).sum(axis=1)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            names, points = batch.column("query_id").to_numpy(), matrix(batch.column("x"))
            out = []
            for low in range(0, len(names), 256):
                q = points[low : low + 256]
                rough = norms[None] - 2 * (q @ x.T)  # without the query's own norm, which moves all alike
                rough[names[low : low + 256, None] == ids[None]] = np.inf
                if copies is not None:
                    near = rough + (q * q).sum(axis=1)[:, None] <= 1e-6
                    for i, j in zip(*np.nonzero(near & np.isfinite(rough))):
                        if np.sqrt(((q[i] - x[j]) ** 2).sum()) <= copies:
                            rough[i, j] = np.inf
                some = np.argpartition(rough, min(k + 8, rough.shape[1]) - 1, axis=1)[:, : k + 8]
                exact = np.sqrt(((q[:, None] - x[some]) ** 2).sum(axis=2))
                exact[~np.isfinite(np.take_along_axis(rough, some, 1))] = np.inf
                for i in range(len(q)):
                    order = np.lexsort((ids[some[i]], exact[i]))[:k]
                    out.append([{"dist": float(exact[i, j]), "id": int(ids[some[i, j]]), "label": int(labels[some[i, j]])} for j in order if np.isfinite(exact[i, j])])
            kind = pa.list_(pa.struct([("dist", pa.float64()), ("id", pa.int64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").cast(pa.int64()), pa.array(out, kind)], ["query_id", "near"])

    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("x").cast("array<double>").alias("x"))
    return rows.mapInArrow(scan, f"query_id long, near {NEAR}")


def nearest(queries: DataFrame, exemplars: DataFrame, k: int, copies: float | None = None) -> DataFrame:
    """query_id and `near`: the k nearest exemplars (dist, id, label) without the query itself; ties by id."""
    found = [best_of_block(queries, held, k, copies) for held in blocks(exemplars)]
    if not found:
        return queries.select(F.col("query_id").cast("long").alias("query_id"), F.array().cast(NEAR).alias("near"))
    if len(found) == 1:
        return found[0]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def vote(near: DataFrame, sigma: float, classes: int = 5) -> DataFrame:
    """query_id, label, p: normalised weights exp(-d^2 / (2 sigma^2)); if all vanish, the nearest label gets 1."""
    weight = lambda e: F.exp(-e["dist"] * e["dist"] / (2 * sigma * sigma))
    sums = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.aggregate(F.filter("near", lambda e: e["label"] == k), F.lit(0.0), lambda s, e: s + weight(e)))
    total = F.aggregate("w", F.lit(0.0), lambda s, v: s + v)
    rows = near.withColumn("w", sums).withColumn("total", total)
    p = F.when(F.col("total") > 0, F.col("v") / F.col("total")).otherwise((F.col("near")[0]["label"] == F.col("label")).cast("double"))
    return rows.select("query_id", "near", "total", F.posexplode("w").alias("label", "v")).select("query_id", "label", p.alias("p"))


def nearest_other(samples: DataFrame) -> DataFrame:
    """query_id, dist to the nearest sample that isn't a copy (farther than 1e-8)."""
    near = nearest(samples.withColumnRenamed("sample_id", "query_id"), samples, 1, 1e-8)
    return near.select("query_id", F.get("near", F.lit(0))["dist"].alias("dist"))


def scale(samples: DataFrame) -> DataFrame:
    """One row: sigma (median distance), reach (trust limit) and k for a set of exemplars."""
    q = nearest_other(samples).agg(F.percentile("dist", 0.5).alias("sigma"), F.percentile("dist", 0.85).alias("q85"), F.count("*").alias("n"))
    reach = F.greatest(1.35 * F.col("q85"), 1.25 * F.col("sigma"), F.lit(1e-3))
    return q.select("sigma", reach.alias("reach"), F.least(F.lit(9), F.greatest(F.lit(3), F.rint(F.sqrt("n")).cast("int"))).alias("k"))


def offsets(cells: DataFrame, value: str, radius: int = 2) -> DataFrame:
    """grid_id, r, c, x: the values of the (2 radius + 1)^2 cells around each, row by row; 0 where there is none."""
    side = 2 * radius + 1
    step = F.sequence(F.lit(-radius), F.lit(radius))
    sent = cells.select(*CELL, F.col(value).alias("v")).withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    slot = (radius - F.col("dr")) * side + radius - F.col("dc")
    sent = sent.select("grid_id", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), slot.alias("slot"), "v")
    got = sent.join(cells.select(*CELL), CELL, "left_semi").groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"))
    return got.select(*CELL, F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))).alias("x"))


def one_hot(code: Column) -> Column:
    return F.array(*[(code == k).cast("double") for k in (1, 2, 3, 4)])


def coverage(samples: DataFrame, least: int = 96, per_class: int = 6, groups: int = 8) -> DataFrame:
    """One row: counts, and the mode a training set allows (none, exemplar, network)."""
    per = samples.groupBy("label").agg(F.count("*").alias("n"))
    counts = per.agg(F.sum("n").alias("samples"), F.count("*").alias("classes"), F.min("n").alias("smallest"))
    full = counts.join(samples.agg(F.count_distinct("group_id").alias("groups")), how="cross")  # one row each
    good = (F.col("samples") >= least) & (F.col("classes") >= 5) & (F.col("smallest") >= per_class)
    return full.withColumn("mode", F.when(F.col("samples") == 0, "none").when(good & (F.col("groups") >= groups), "network").otherwise("exemplar"))


def class_accuracy(rows: DataFrame) -> DataFrame:
    """label, n, accuracy of rows with label and pred; the macro accuracy is their mean."""
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


def group_split(samples: DataFrame, share: float = 0.2) -> DataFrame:
    """samples with `validation`: whole groups by the MD5 of group_id (as text), a null group by that of the empty text."""
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("group_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    return samples.withColumn("validation", drawn % 1000 < share * 1000)


def stratified_split(samples: DataFrame, share: float = 0.2) -> DataFrame:
    """samples with `validation`: the same share of each label, by a hash order inside it."""
    w = Window.partitionBy("label").orderBy(F.xxhash64("sample_id"), "sample_id")
    n = F.count("*").over(Window.partitionBy("label"))
    return samples.withColumn("validation", F.row_number().over(w) <= F.greatest(F.lit(1), F.rint(n * share).cast("int")))


def repeat_hard(samples: DataFrame, weight: int = 1) -> DataFrame:
    """samples (detected, overlap, conf, and tier and reference, which may be null) `weight` times, hard ones once more, and once more where lines overlap; 4 times at most.

    Hard are cells where lines overlap, the detector is unsure or has little support, or a reference says otherwise than it.
    """
    hard = (F.col("overlap") > 1) | (F.col("conf") < 0.55) | F.coalesce(F.col("tier") <= 1, F.lit(False)) | F.coalesce(F.col("reference") != F.col("detected"), F.lit(False))
    times = F.when(hard, F.least(F.lit(4), weight + 1 + (F.col("overlap") > 1).cast("int"))).otherwise(weight)
    return samples.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def training_samples(corrections: DataFrame, cells: DataFrame, vectors: DataFrame, trusted: DataFrame | None = None, weight: int = 1) -> DataFrame:
    """grid_id, r, c, x, label, copy: corrected cells (d: the label 0 to 4; others are left out) with their vectors, repeated as `repeat_hard` says, and trusted cells (d) once.

    cells: grid_id, r, c, detected, overlap, conf, tier, reference. Corrections outside of the grid have no vector and are left out.
    """
    own = corrections.where("d BETWEEN 0 AND 4").select(*CELL, F.col("d").alias("label")).join(cells, CELL)
    rows = repeat_hard(own, weight).select(*CELL, "label", "copy")
    if trusted is not None:
        more = trusted.join(corrections.select(*CELL), CELL, "left_anti").join(cells.where("overlap <= 1 AND (tier IS NULL OR tier >= 2)").select(*CELL), CELL, "left_semi")
        rows = rows.unionByName(more.select(*CELL, F.col("d").alias("label"), F.lit(1).alias("copy")))
    return rows.join(vectors.select(*CELL, "x"), CELL)


def override(cells: DataFrame, fill: float = 0.6, relabel: float = 0.7, clear: float = 0.8) -> DataFrame:
    """Predictions laid over detections. cells: d (detected), best, p, dist, reach, support (local pipe evidence).

    An exemplar farther than its reach is never trusted. Empty cells are filled, wrong codes relabelled and
    unsupported ones cleared, each from its own probability on; everything else stays.
    """
    trusted = F.col("dist") <= F.col("reach")
    rule = (
        F.when(~trusted, "untrusted")
        .when((F.col("d") == 0) & (F.col("best") > 0) & (F.col("p") >= fill) & F.col("support"), "filled")
        .when((F.col("d") > 0) & (F.col("best") > 0) & (F.col("best") != F.col("d")) & (F.col("p") >= relabel), "relabelled")
        .when((F.col("d") > 0) & (F.col("best") == 0) & (F.col("p") >= clear) & ~F.col("support"), "cleared")
        .otherwise("kept")
    )
    out = cells.withColumn("rule", rule)
    return out.withColumn("d", F.when(F.col("rule").isin("filled", "relabelled", "cleared"), F.col("best")).otherwise(F.col("d")))


def train_network(samples: DataFrame, hidden: tuple[int, ...] = (64, 32), classes: int = 5, seed: int = 42, rounds: int = 60):
    """A fitted multilayer perceptron on x (standardise first); use it where `coverage` says network."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = samples.select(array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("features"), F.col("label").cast("double").alias("label"))
    width = len(rows.first().features)
    return MultilayerPerceptronClassifier(layers=[width, *hidden, classes], maxIter=rounds, seed=seed).fit(rows)


def predict_network(model, samples: DataFrame) -> DataFrame:
    """sample_id, best, p of each sample."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = samples.select("sample_id", array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("features"))
    out = model.transform(rows).withColumn("probs", vector_to_array("probability"))
    return out.select("sample_id", F.col("prediction").cast("int").alias("best"), F.array_max("probs").alias("p"))


def reliable_context(anchors: DataFrame, cells: DataFrame, radius: int = 2, zeros: int = 2, directed: int = 2) -> DataFrame:
    """Trusted neighbours of corrected cells: at most two empty and two directed ones an anchor, the best score of each cell.

    anchors: grid_id, r, c; cells: grid_id, r, c, d, score.
    """
    step = F.sequence(F.lit(-radius), F.lit(radius))
    near = anchors.select("grid_id", F.col("r").alias("ar"), F.col("c").alias("ac")).withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step)).where("dr <> 0 OR dc <> 0")
    near = near.select("grid_id", "ar", "ac", (F.col("ar") + F.col("dr")).alias("r"), (F.col("ac") + F.col("dc")).alias("c"))
    found = near.join(cells, CELL).join(anchors.select(*CELL), CELL, "left_anti")
    w = Window.partitionBy("grid_id", "ar", "ac", F.col("d") > 0).orderBy(F.desc("score"), "r", "c")
    kept = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.when(F.col("d") > 0, directed).otherwise(zeros))
    return kept.groupBy(*CELL).agg(F.max_by("d", "score").alias("d"), F.max("score").alias("score"))


def append_samples(old: DataFrame, new: DataFrame, identity: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The training set with a batch appended (columns that one side lacks are null), the last sample of each identity kept, and one row of counts."""
    from catchment.operators import evaluate

    both = old.unionByName(new, allowMissingColumns=True)
    return evaluate.dedupe_keep_last(both, F.col(identity).cast("string"), order, "label")
