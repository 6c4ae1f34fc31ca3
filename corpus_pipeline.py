"""From raw documents to packed training sequences, in five stages; each takes all that the one before kept.

A stage is (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docstyle.llm import common, jaccard, mixing, packing, spans, trees


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return trees.keep_quality(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences that a non-first repeated span covers go."""
    return spans.cleaned(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; one taken in part keeps its first words."""
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets, and which copy of a document taken several times."""
    return packing.pack(common.checkpoint(packing.pieces(docs)), copies=True)


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("repeated spans", repeated_spans), ("mixture", mixture), ("packing", packed)]

#: The first stage is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.checkpoint(docs)
    return docs
