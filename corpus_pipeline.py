"""A training-data pipeline: quality, exact duplicates, near-duplicates, personal data, packing.

Each stage is a function of (spark, docs, sf_dir) and gets all rows that the
stage before it kept.  All but the last return the columns of ``documents``.

In every stage null text counts as empty, texts of any length are taken whole,
repeated rows are rows in their own right, columns beyond those of ``documents``
are left behind, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.llm import exact_dedup, near_text, pii, quality
from draftmill.llm.catalog import byte_bpe
from draftmill.llm.common import save, table
from draftmill.llm.packing import pack_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Empty texts are scored too; equal texts share a fate; without labels of both kinds none goes."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model, name="score").where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: that with the most code points, then the least id, nulls last, then the first row."""
    return exact_dedup.dedup_exact(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, Jaccard similarity of 0.8 or more.

    Of a group the least id stays, nulls last; texts without words are one group.
    """
    return near_text.dedup_near(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows the text.  Texts without any, null included, stay as they are."""
    clean = pii.redact(docs.select(*COLUMNS), pii.judge(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; an empty text is its end id alone."""
    return pack_documents(docs.select(*COLUMNS), byte_bpe())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The classifier, the boosted trees and the tokenizer have no counterpart in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"pipeline-{name}")
    return docs
