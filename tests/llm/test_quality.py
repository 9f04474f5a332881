"""Quality rules: counts against plain Python, scores against dense vectors, accuracy on labelled rows that were not learned from."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.llm import quality, shared

from .conftest import prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), n < 50 or 100 * len(covered) > 50 * n


ODD = ["", " ", "a", "a b", "a b c", "a b c a b c", "é é é é", "x\x00y\x1f z w v", "#*$%&|<>", "l\nl\nl\n\n\n \nl ", "one two\none two\n", "w " * 49, "w " * 50, " ".join(f"w{i}" for i in range(50)), "日本 語 🙂 <p>"]


@pytest.mark.parametrize("size", [1, 64, quality.SLICE])
def test_counts(spark, rows, docs, monkeypatch, size):
    monkeypatch.setattr(quality, "SLICE", size)
    odd = [(1000 + k, t) for k, t in enumerate(ODD)]
    frame = docs.union(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit("x") for c in ("n_words", "quality", "kept", "probability")})
    got = quality.rated(frame, None).collect()
    assert Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got) == Counter((i, *brute(t)) for i, t in rows + odd)
    assert all(x.kept == (not x.base_failed) and x.probability is None for x in got)


def test_scores_are_of_each_text_alone():
    """The same in any company, and equal to the product with the text's vector."""
    rng = random.Random(2)
    texts = [t.encode() for t in [*ODD, prose(rng, 300), prose(rng, 40), "", "ab"]]
    weights = np.random.default_rng(1).normal(size=quality.FAMILIES << quality.BITS)
    together = quality.Measured(texts)
    scores = together.scores(weights)
    for text, score, (columns, values) in zip(texts, scores, together.vectors()):
        assert np.isclose(values @ weights[columns], score) and len(set(columns.tolist())) == len(columns)
        assert quality.Measured([text]).scores(weights)[0] == score
    words = ODD[13].split()
    _, (columns, values) = 0, list(quality.Measured([ODD[13].encode()]).vectors())[0]
    assert np.isclose(values.sum(), 3) and len(words) == 50  # a mean for each family


def test_calibration():
    rng = np.random.default_rng(3)
    score = rng.normal(size=20_000) * 3
    good = rng.random(20_000) < 1 / (1 + np.exp(-(1.7 * score - 0.6)))
    slope, shift = quality.platt(score, good, np.ones(20_000))
    assert abs(slope - 1.7) < 0.1 and abs(shift + 0.6) < 0.1
    slope, shift = quality.platt(np.array([-1.0, -2.0, 1.0, 2.0]), np.array([False, False, True, True]), np.ones(4))
    assert 0 < slope < 50 and np.isfinite(shift)  # classes without overlap


def labelled():
    rng = random.Random(7)
    rows = []
    for i in range(400):
        text = prose(rng, rng.randint(60, 120))
        bad = i % 4 == 0
        rows.append((i, " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split()) if bad else text, 0 if bad else 1))
    return rows


def test_model_on_rows_that_it_has_not_seen(spark, work):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, "x") for i, _, q in rows if i < 200] + [(900, 0, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    model = quality.Quality.fit(docs, labels, work, per_class=100)
    got = {x.doc_id: x for x in quality.rated(docs, model).collect()}
    assert all(got[i].kept == (q == 1) and not got[i].base_failed for i, _, q in rows)
    assert all((got[i].probability > 0.9) == (q == 1) for i, _, q in rows)


def test_sample_is_bounded(spark, work):
    """One id with a third of all rows, repeated rows and contradicting labels: about per_class rows of each class, each text once."""
    rows = [(i, f"text {i} {'bad' if i % 2 else 'good'}") for i in range(3000)]
    same = [(5, f"hot {i}") for i in range(1500)] + [(7, "always the same")] * 500
    labels = [(i, i % 2) for i in range(3000)] + [(8, 1), (None, 1)]
    docs = spark.createDataFrame(rows + same + [(None, None)], "doc_id long, text string").repartition(4)
    sample, sizes = quality.sampled(docs, spark.createDataFrame(labels, "doc_id long, quality int"), 200)
    got = Counter((x.text, x.quality) for x in sample.collect())
    assert max(got.values()) == 1 and all(120 < sum(q == k for _, q in got) < 290 for k in (0, 1))
    assert sizes == {0: 1500, 1: 1500 + 1500 + 1 + 1}


def test_no_model_without_both_classes(spark, docs, empty, work):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.Quality.fit(docs, none, f"{work}/1") is None
    assert quality.Quality.fit(docs, spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int"), f"{work}/2") is None
    assert quality.Quality.fit(empty, none, f"{work}/3") is None
    assert quality.rated(empty, None).count() == 0


def test_query_keeps_clean_documents(spark, tables):
    """Labelled rows of the larger test tables (the smaller ones have nine bad ones to test with): rows of quality 1 stay unless a limit fails, hardly any of quality 0 does; half of the labels are held back."""
    large = "/root/testdata/sf0.1"
    if not os.path.exists(large):
        pytest.skip("no test tables")
    docs, labels = shared.table(spark, large, "documents"), shared.table(spark, large, "labels")
    learned = labels.where("crc32(cast(doc_id AS string)) % 2 = 0")
    model = quality.Quality.fit(docs, learned, shared.work_dir(spark, "test"))
    rated = quality.rated(docs, model).join(labels.where("crc32(cast(doc_id AS string)) % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    good, bad = [x for x in rated if x.quality == 1], [x for x in rated if x.quality == 0]
    assert len(good) > 100 and sum(x.kept for x in good) >= 0.99 * len(good)
    assert len(bad) > 80 and sum(x.kept for x in bad) <= 0.1 * len(bad)
    query = quality.op12_quality_rules(spark, tables)
    assert query.count() == shared.table(spark, tables, "documents").count() and query.where("kept AND base_failed").count() == 0
