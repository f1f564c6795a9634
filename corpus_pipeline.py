"""The corpus pipeline: quality classifier, near-duplicates, decontamination, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and reread as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from ``labels`` of the documents at hand."""
    from weighbridge.llm.quality import accepted

    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash group. Rows of one id are one
    document; rows without an id stay."""
    from weighbridge.llm.simhash import simhash_groups

    groups = simhash_groups(docs, shingle=4, max_bits=4)
    copies = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap an item of ``benchmark`` of at least eight tokens; rows without an id stay.
    A shorter item is a phrase that clean documents hold too: the operator reports it, but it condemns no document here."""
    from weighbridge.llm.decontam import MIN_TOKENS, overlaps

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = overlaps(docs, items, min_tokens=MIN_TOKENS).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens, one row per piece."""
    from weighbridge.llm.packing import pack_documents

    return pack_documents(docs, max_tokens=2048, as_loaded=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Hash functions, trained models and packing have no SQL form: tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
