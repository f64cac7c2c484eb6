"""A corpus made ready for training: quality rules, line dedup, near-duplicates, decontamination, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` applies
them to the documents of ``sf_dir``. Nulls, empty and very long texts, repeated rows, ties, empty tables and columns with
clashing names are taken as the operator's docstring says: null and empty texts fail the quality rules; behind these every
stage gives one result for rows repeated with one doc_id and text. Every result is written as Parquet in the shared checkpoint folder and read again
as the next stage's documents, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import decontaminate, line_quality, line_runs, near_dups, packing
from flowtide.llm.queries import table, tokenizer_path
from flowtide.llm.spark_help import Shelf, cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are common in their host."""
    return line_quality.clean_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds."""
    return line_runs.deduplicated_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8)."""
    return near_dups.drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), width=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, and their places in sequences of 1024 tokens."""
    return packing.pack_documents_ids(docs, tokenizer_path(), packing.Limits(tokens=1024), end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Near-duplicate components and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    shelf = Shelf(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
        if before:
            shelf.remove(before)
        before = name
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    shelf.close()
    return out
