"""A training corpus from documents: quality rules, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of
documents. Null texts and empty tables pass through the stages as the operators
state; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ngram_join, packing, quality, queries, toxicity
from tessera.llm.storage import materialise
from tessera.sources import table

#: No stage before the last is expressible in SQL: fitted models decide in the first two.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate go."""
    return quality.keep_documents(docs, quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; held-out labels aren't learnt from here either."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.keep_documents(docs, toxicity.fit(docs.select("doc_id", "text"), labels.where(~toxicity.held_out(labels["doc_id"]))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles, the one of the least id stays."""
    return ngram_join.keep_representatives(docs, words=5, threshold=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, queries.BYTES, capacity=1024, end_id=2)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
