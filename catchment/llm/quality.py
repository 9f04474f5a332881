"""Quality rules: counts of each text with fixed limits, and a logistic regression over hashed n-grams.

Words are `[^\\x20\\x09-\\x0D]+`. The features are single words and pairs of neighbouring words, and runs of three
code points, each hashed to one of 2 ** BITS columns for its family; a text's value in a column is the share of its
n-grams of the family that fall there, so a text's score is a mean of weights and long texts weigh no more than
short ones. The regression (L2, both classes weighing the same) learns from labelled rows; a logistic curve
(Platt's) fitted to labelled rows that it has not seen, weighted to the classes' shares of all labelled rows,
turns the score into the probability of quality 1. Texts are scored in Arrow batches, whole, against `least`.

The sample: of the different labelled (doc_id, text), about per_class of each class by a hash of both, or all if
there are fewer; a quarter of them calibrates. It is bounded by per_class, and only these rows' texts leave
their place. Rows without quality don't count. If a class has no row there is no verdict, and the limits decide
alone (probability null). Only text is looked at in scoring: repeated rows share their verdict, null text counts
as empty (no words, base_failed), an empty table gives an empty result, further columns are not read. Ids that
repeat with different texts, or labels that contradict each other, are learned from as they stand.

An executor's task holds one Arrow batch, one slice of it of SLICE bytes or one longer text with about 40 bytes
for each of its bytes, and the weights (8 bytes a column).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import hashing, shared

BITS = 16
FAMILIES = 3
SLICE = 2 << 20
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LEAD = np.ones(256, bool)  # bytes that begin a code point
LEAD[0x80:0xC0] = False
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measured:
    """Counts and hashed n-grams of several texts, none of which reaches into another."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        size = len(texts)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        words, at = hashing.words_at(data)
        doc = np.searchsorted(ends, at)
        self.n_words = np.bincount(doc, minlength=size)
        between = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(mask)]))
        self.word_chars = between(LEAD[raw] & ~hashing.SPACE[raw])
        self.n_symbols = between(SYMBOL[raw])
        self.n_dup_lines = np.array([repeated_lines(t) for t in texts], np.int64)
        self.n_repeat_words = self.repeats(words, doc, size)
        pairs = doc[1:] == doc[:-1]
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        last = np.cumsum(LEAD[raw])[ends] - 1  # the separator behind each text, counted in code points
        place = np.searchsorted(last, np.arange(len(points) - 2)) if len(points) > 2 else np.zeros(0, np.int64)
        inside = np.arange(len(place)) + 2 < last[place]
        threes = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D) if len(place) else np.zeros(0, np.uint32)
        threes = (threes ^ (threes >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        #: For each family the text and the column of each n-gram.
        self.grams = [(doc, (words >> np.uint64(64 - BITS)).astype(np.int64)), (doc[1:][pairs], (hashing.grams(words, 2)[pairs] >> np.uint64(64 - BITS)).astype(np.int64)), (place[inside], (threes[inside] >> np.uint32(32 - BITS)).astype(np.int64))]
        self.size = size

    @staticmethod
    def repeats(words: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
        """Words of each text in windows of three words that the text holds twice or more."""
        if len(words) < 3:
            return np.zeros(size, np.int64)
        own = doc[2:] == doc[:-2]
        keys = hashing.mix(hashing.grams(words, 3) ^ hashing.mix(doc[2:].astype(np.uint64) + np.uint64(1)))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        twice = (counts[inverse] > 1) & own
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        return np.bincount(doc[covered], minlength=size)

    def vectors(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the columns and the shares, of all families."""
        for i in range(self.size):
            columns, values = [], []
            for k, (doc, column) in enumerate(self.grams):
                low, high = np.searchsorted(doc, [i, i + 1])
                there, counts = np.unique(column[low:high], return_counts=True)
                columns.append(there + (k << BITS))
                values.append(counts / max(1, high - low))
            yield np.concatenate(columns), np.concatenate(values)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum over the families of the mean weight of a text's n-grams."""
        out = np.zeros(self.size)
        for k, (doc, column) in enumerate(self.grams):
            sums = np.bincount(doc, weights[column + (k << BITS)], self.size)
            out += sums / np.maximum(1, np.bincount(doc, minlength=self.size))
        return out


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measured(texts: pa.Array) -> Iterator[tuple[int, int, Measured]]:
    """[low, high) of the rows of each slice, and what it holds."""
    raw = texts.fill_null("").cast(pa.binary()).to_pylist()
    low = 0
    while low < len(raw):
        high, size = low, 0
        while high < len(raw) and (high == low or size + len(raw[high]) <= SLICE):
            size += len(raw[high])
            high += 1
        yield low, high, Measured(raw[low:high])
        low = high


def sampled(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """text, quality, held (for calibration) of the sample, and how many labelled rows each class has."""
    keys = docs.select("doc_id", F.xxhash64("text").alias("hash")).distinct()
    known = keys.join(labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct(), "doc_id")
    sizes = {x.quality: x.n for x in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    # about per_class rows of each class, which is what makes the list small enough to be sent to all tasks
    draw = F.pmod(F.xxhash64("doc_id", "hash", F.lit(12)), F.lit(1 << 30))
    limit = F.lit(0)
    for quality, n in sizes.items():
        limit = F.when(F.col("quality") == quality, min(1 << 30, (per_class << 30) // n)).otherwise(limit)
    chosen = known.where(draw < limit).withColumn("held", F.pmod(draw, F.lit(4)) == 0)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(chosen), ["doc_id", "hash"])
    return rows.groupBy("doc_id", "hash", "quality", "held").agg(F.first("text").alias("text")).select("text", "quality", "held"), sizes


def vectors(sample: DataFrame) -> DataFrame:
    """quality, held and the features as a sparse vector."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for low, high, own in measured(batch.column(0)):
                columns, values = zip(*own.vectors())
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([c.astype(np.int32) for c in columns], pa.list_(pa.int32())), pa.array(list(values), pa.list_(pa.float64()))], ["quality", "held", "columns", "shares"])

    rows = sample.mapInArrow(batches, "quality int, held boolean, columns array<int>, shares array<double>")
    vector = F.udf(lambda c, v: SparseVector(FAMILIES << BITS, c, v), VectorUDT())  # of the sample's rows only
    return rows.select(F.col("quality").cast("double").alias("quality"), "held", vector("columns", "shares").alias("features"))


def platt(score: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from scores to the probability of good, by Newton's steps with Platt's softened targets."""
    n = [max(1.0, weight[good == k].sum()) for k in (0, 1)]
    target = np.where(good, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x = np.stack([score, np.ones(len(score))], 1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weight * (p - target)) + 1e-6 * at
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


class Quality:
    """The fitted model: a weight for each column, and the curve from a score to a probability."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights, self.slope, self.shift = weights, slope, shift

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, work: str, per_class: int = 2000, penalty: float = 0.001, rounds: int = 50) -> Quality | None:
        """From docs(doc_id, text) and labels(doc_id, quality); None if a class has no row to train or calibrate with."""
        rows, sizes = sampled(shared.bound_batches(docs), labels, per_class)
        sample = shared.stash(vectors(rows), f"{work}/sample")
        held = {(x.quality, x.held): x.n for x in sample.groupBy("quality", "held").agg(F.count("*").alias("n")).collect()}
        if min((held.get((q, h), 0) for q in (0.0, 1.0) for h in (False, True))) == 0:
            return None
        most = max(held[q, False] for q in (0.0, 1.0))
        weight = F.when(F.col("quality") == 1, most / held[1.0, False]).otherwise(most / held[0.0, False])
        train = sample.where("NOT held").withColumn("weight", weight)
        model = LogisticRegression(featuresCol="features", labelCol="quality", weightCol="weight", regParam=penalty, maxIter=rounds, standardization=True).fit(train)
        weights, shift = model.coefficients.toArray(), model.intercept
        dot = F.udf(lambda v: float(v.dot(weights)), "double")
        seen = sample.where("held").select("quality", dot("features").alias("score")).toPandas()  # a quarter of the sample at most
        good = seen.quality.to_numpy() == 1
        share = np.where(good, sizes[1] / max(1, good.sum()), sizes[0] / max(1, (~good).sum()))
        slope, at = platt(seen.score.to_numpy() + shift, good, share * len(share) / share.sum())
        return cls(weights, slope, slope * shift + at)

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.shift, -700, 700)))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def rated(docs: DataFrame, model: Quality | None, least: float = 0.5, min_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """SCHEMA for each row of docs(doc_id, text): kept is false if the text has under min_words words, if over most_repeated percent of them stand in repeated windows, or if its probability is below least."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in found:
            for low, high, own in measured(batch.column(1)):
                failed = (own.n_words < min_words) | (100 * own.n_repeat_words > most_repeated * own.n_words)
                p = None if model is None else model.probability(own.scores(model.weights))
                kept = ~failed if p is None else ~failed & (p >= least)
                counts = [pa.array(getattr(own, c), pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *counts, pa.array(failed), pa.nulls(high - low, pa.float64()) if p is None else pa.array(p), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "probability", "kept"])

    rows = shared.bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, SCHEMA)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Quality.fit(docs, shared.table(spark, sf_dir, "labels"), shared.work_dir(spark, "quality"))
    return rated(docs, model)
