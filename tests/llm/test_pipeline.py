"""The pipeline's stages keep the columns of documents, hold their decisions and feed each other."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline

from .conftest import prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    item = prose(rng, 40, 40)
    near = prose(rng, 120, 120).split(" ")  # one line, so that line dedup leaves the copies
    rows = [(i, prose(rng, 90), "en", "s", 1) for i in range(40)]
    rows += [(50 + i, " ".join([*near[:-1], f"end{i}"]), "en", "s", 1) for i in range(5)]
    rows += [(70, prose(rng, 40) + "\n" + item, "en", "s", 1), (80, None, None, None, None), (81, "123", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.schema.names == docs.schema.names
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept.append({x.doc_id for x in frame.collect()})
    assert {80, 81}.isdisjoint(kept[0]) and kept[0] >= set(range(40))
    assert kept[2] >= set(range(40)) | {50} and {51, 52, 53, 54}.isdisjoint(kept[2])
    assert 70 in kept[2] and 70 not in kept[3] and kept[3] >= set(range(40))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in pieces} == kept[3]
    assert max(Counter(x.sequence_id for x in pieces).values()) > 1


def test_pipeline_edges(spark, tmp_path):
    """Repeated rows, ties, null and repeated ids, a very long text, columns with clashing names, an empty benchmark."""
    from pyspark.sql import functions as F

    rng = random.Random(23)
    rows = [(i, prose(rng, 60), "en", "s", 1) for i in range(20)]
    rows += [rows[0], rows[0], (3, prose(rng, 50), "en", "s", 1), (None, prose(rng, 40), None, None, None), (None, None, None, None, None)]
    rows += [(30, prose(rng, 40_000, 12), "en", "s", 1), (31, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit("x") for c in ("key", "hash", "row", "lines", "gone", "removed_lines", "entity", "score", "uid", "group", "stays", "found")}
    docs.withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert sorted(frame.columns) == sorted(c for c in columns if c in frame.columns) and set(docs.columns) <= set(frame.columns)
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
    kept = Counter((x.doc_id, x.text) for x in frame.collect())
    assert kept == Counter({(i, t): 1 for i, t, *_ in rows if t})  # of the equal rows one stays
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i for i, _ in kept}


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
