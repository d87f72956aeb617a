"""The corpus pipeline: language ID, exact dedup, near-duplicate join, mixing by source, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. Rows are told apart by their place in their table, so doc_id may be null or repeated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelloom.llm import langid
from modelloom.llm.common import bounded, new_path, numbered, staged, table
from modelloom.llm.exact_dedup import dedup
from modelloom.llm.jaccard import row_components
from modelloom.llm.mixing import mixed_documents, quality
from modelloom.llm.packing import pack


ROW = "row_of_docs"


def _firsts(docs: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """Of each group of rows of `docs` (numbered) the one with the smallest doc_id, nulls last, then the first; and all rows
    in no group. `groups` has (row, group) of rows in groups of two or more."""
    members = staged(groups.select(F.col("row").alias(ROW), "group"), f"{name}_groups")
    ids = staged(docs.select(ROW, "doc_id").join(bounded(members), ROW).select(ROW, "group", "doc_id"), f"{name}_ids")
    first = ids.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    gone = staged(ids.select(ROW).join(bounded(staged(first, f"{name}_firsts")), ROW, "left_anti"), name)
    return docs.join(bounded(gone), ROW, "left_anti").drop(ROW)


def _by_row(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(ROW).alias("doc_id"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents whose language is none of those learned, or that have no letter; without labels only the latter."""
    return langid.keep_identified(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stays: of equal texts the one with the smallest doc_id; without ids the first row."""
    rows = numbered(docs, ROW)
    return _firsts(rows, dedup(_by_row(rows)).where("group_size > 1").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")), "copies")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stays: of documents linked by a similarity of 0.8 of five-word shingles the one with the smallest doc_id; without ids the first row."""
    rows = numbered(docs, ROW)
    labelled = staged(row_components(_by_row(rows), k=5, percent=80).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "labelled_rows")
    several = staged(labelled.where("row <> group").select("group").distinct(), "linked")
    return _firsts(rows, labelled.join(bounded(several), "group", "left_semi"), "near_copies")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, the last of a source cut to its budget."""
    return mixed_documents(docs, quality())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences with their token ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "before", 0)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_jaccard", ngram_jaccard), ("source_mixing", source_mixing), ("packing", packing)]

#: SQL expresses neither the classifier nor the packer; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
