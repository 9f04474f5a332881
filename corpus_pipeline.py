"""A corpus pipeline over `documents`: language ID, line dedup, near-duplicate removal, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again for the
next. All stages but the last return the columns of documents, with any further ones, whatever their names.
Every stage takes an empty table and gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from catchment.llm import decontaminate, jaccard_join, langid, line_chunks, packing, shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or of which no language makes up half, go. Repeated rows share their fate. Rows without any lang to learn from are an error."""
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, but for their first occurrence (smallest doc_id, null first); documents that lose all lines with text go. Headings, single short lines and paragraph breaks stay. Null and empty texts stay; rows with one doc_id and text keep or lose lines together; removed_lines, if there is such a column, holds their number."""
    return line_chunks.dedup_lines(docs, shared.work_dir(spark, "pipeline-lines")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest doc_id (null after all others), then by the text's hash, then any one of equal rows. Texts without words stay, all of them."""
    return jaccard_join.drop_near_duplicates(docs, shared.work_dir(spark, "pipeline-near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go. Items of under eight words never match, nor do texts without words; an empty benchmark drops nothing."""
    return decontaminate.drop_leaks(docs, shared.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and packed into sequences of 2048 tokens. A null or empty text is its end id alone; rows that share a doc_id are packed apart."""
    return packing.pack_documents(docs, shared.work_dir(spark, "pipeline-packing"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]

#: The stages use learned models, alignments and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = shared.table(spark, sf_dir, "documents"), shared.work_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = shared.stash(stage(spark, docs, sf_dir), f"{work}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
