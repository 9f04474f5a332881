"""Language ID: each document's mixture of languages, by expectation-maximisation over n-gram likelihoods.

Learning counts hashed byte trigrams of lower-cased text for each language, on about `per_language` whole
labelled documents a language, drawn by a hash of doc_id and text (equal rows count once; the bound of the fitted sample); the model is a
table of likelihoods, languages x buckets (at most `max_languages` x 32,768 of four bytes: 34 MB, which goes to every task). For a document, EM estimates the proportions of all
languages; the languages with the largest proportions then form nested sets of 1, 2, 3 ... languages,
each is fitted by EM, and the set with the best likelihood less `penalty` * log(trigrams) for each further
language wins. The prediction is its largest language, the score that language's proportion.

A text that is null or has no letter is `und` with score 0, as is any text if nothing was learned (empty
table, no lang). Rows are judged one by one: repeated rows get equal answers; ties between languages go to
the first by name. More than `max_languages` learned languages are an error.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import shared, tokens

BUCKETS = 1 << 15
LETTER = re.compile(r"[^\W\d_]")
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, langs string"


def histogram(text: str) -> np.ndarray:
    """Counts of the text's byte trigrams by bucket. Runs of characters other than letters count as one space."""
    raw = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode(), np.uint8).astype(np.uint32)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(17), minlength=BUCKETS)


class Mixture:
    """Log-likelihoods of trigram buckets (languages x BUCKETS) and the inference on one document."""

    def __init__(self, counts: dict[str, np.ndarray], smooth: float = 0.5, penalty: float = 2.0, rounds: int = 12, least: float = 0.03):
        self.langs = sorted(counts)
        table = np.stack([counts[k] for k in self.langs]) + smooth if counts else np.zeros((0, BUCKETS))
        self.chance = np.ascontiguousarray((table / table.sum(axis=1, keepdims=True)).T, np.float32) if counts else table.T
        self.penalty, self.rounds, self.least = penalty, rounds, least

    def fit(self, chance: np.ndarray, counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        total = counts.sum()
        for _ in range(self.rounds):
            mixed = chance @ share
            share = share * ((counts / mixed) @ chance) / total
        return share, float(counts @ np.log(chance @ share))

    def infer(self, text: str) -> tuple[str, float, list[tuple[str, float]]]:
        counts = histogram(text)
        seen = np.flatnonzero(counts)
        counts, n = counts[seen].astype(np.float64), len(self.langs)
        total, chance = counts.sum(), self.chance[seen].astype(np.float64)
        alone = counts @ np.log(chance)
        first = int(np.round(alone, 6).argmax())  # rounded, so that equal languages tie in any order of summation
        chosen, value = (np.array([first]), np.ones(1)), float(alone[first])
        if n > 1:
            share, _ = self.fit(chance, counts, np.full(n, 1 / n))
            order = np.argsort(-np.round(share, 9), kind="stable")
            for size in range(2, int((share >= self.least).sum()) + 1):
                some = order[:size]
                fitted, likely = self.fit(chance[:, some], counts, share[some] / share[some].sum())
                likely -= self.penalty * (size - 1) * np.log(total)
                if likely <= value:
                    break
                chosen, value = (some, fitted), likely
        langs = sorted(((self.langs[i], float(s)) for i, s in zip(*chosen)), key=lambda x: (-round(x[1], 9), x[0]))
        return langs[0][0], min(1.0, langs[0][1]), langs


def learn(labelled: DataFrame, per_language: int = 1500, max_languages: int = 256) -> dict[str, np.ndarray]:
    """Bucket counts of each language from doc_id, text, lang, of about per_language different rows each. Rates come from all labelled rows; equal rows are drawn together and count once."""
    labelled = shared.bound_batches(labelled).where("lang IS NOT NULL AND text IS NOT NULL").withColumn("hash", F.xxhash64("doc_id", "text", F.lit("learn")))
    sizes = dict(map(tuple, labelled.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02)).limit(max_languages + 1).collect()))
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return {}
    rate = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / v)))])
    drawn = labelled.where(F.pmod("hash", F.lit(1_000_000)) < F.get(F.map_values(F.map_filter(rate, lambda k, v: k == F.col("lang"))), 0) * 1_000_000)
    drawn = drawn.groupBy("lang", "doc_id", "hash").agg(F.first("text").alias("text"))

    def count(batches):
        import pyarrow as pa

        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if LETTER.search(text):
                    seen[lang] = seen.get(lang, 0) + histogram(text)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])

    rows = drawn.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().combine_chunks()  # languages x BUCKETS at most
    if not rows.num_rows:
        return {}
    langs, buckets, n = rows.column("lang").combine_chunks().dictionary_encode(), rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    table = np.zeros((len(langs.dictionary), BUCKETS))
    table[langs.indices.to_numpy(), buckets] = n
    return dict(zip(langs.dictionary.to_pylist(), table))


def identify(docs: DataFrame, held_out, **options) -> DataFrame:
    """PREDICTED for each document; rows for which the column held_out is true are not learned from."""
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang")
    model = Mixture(learn(rows.where("not held_out").select("doc_id", "text", "lang"), **options))

    def predict(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.string())])
        for batch in batches:
            out = []
            for text in tokens.each(batch.column("text")):
                text = text.decode("utf-8", "replace")
                if not model.langs or not LETTER.search(text):
                    out.append(("und", 0.0, ""))
                else:
                    lang, score, langs = model.infer(text)
                    out.append((lang, score, ",".join(f"{k}:{s:.4f}" for k, s in langs)))
            lang, score, langs = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.string())], schema=schema)

    return rows.select("doc_id", "text", "held_out").mapInArrow(predict, PREDICTED)


def keep_identified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs, all columns, whose text has a language that makes up `least` of it; learns from all labelled rows.

    Null, empty and letterless texts go. An empty table stays empty; rows without any label to learn from are an error.
    """
    model = Mixture(learn(docs.select("doc_id", "text", "lang"), **options))
    if not model.langs and docs.limit(1).count():
        raise ValueError("no row with a letter has a lang to learn from")

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            texts = (t.decode("utf-8", "replace") for t in tokens.each(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array([bool(model.langs and LETTER.search(t)) and model.infer(t)[1] >= least for t in texts], pa.bool_()))
        tokens.trim()

    return docs.mapInArrow(keep, docs.schema)


def fold() -> object:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold())
