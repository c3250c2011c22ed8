"""A training corpus from ``documents``: five stages, each calling one operator of ``assaykit.llm``.

Each stage works on all documents that its predecessor kept; all but the last return the columns of ``documents``. In all
stages null and empty texts are texts without words, a null doc_id is a document of its own, and an empty table gives an empty
one; extra columns go along until the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import decontam, jaccard, linededup, packing, quality
from assaykit.llm.common import materialize
from assaykit.llm.queries import table, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. The classifier is fitted on labelled rows of the documents. Rows are judged one by
    one: repeated ones alike, null and empty texts by their site's rate too."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines (50 words or more) that an earlier document has; documents that this empties go, others
    without text stay, and so do repeated rows, with equal lines."""
    return linededup.replace_text(linededup.dedup_lines(docs)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more: the one of the smallest doc_id, once.
    Documents without words and rows of null doc_id stay."""
    return jaccard.keep_first(docs, size=5, percent=80).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item (a shorter item: all its words)."""
    marked = decontam.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.col(f"{decontam.RESULT}.n_hit") == 0).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in training sequences; a document without text has its end id alone, repeated rows are packed
    each."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express a fitted classifier and a genetic algorithm; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
