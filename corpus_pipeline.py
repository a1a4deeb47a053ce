"""The corpus pipeline: five stages over documents, each calling one operator of textloom.llm.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents. What the learned stages decide cannot be written in SQL, so there is
no oracle; tests/llm/test_pipeline.py holds run() against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontam, mixing, ngram_join, pii, toxicity
from textloom.llm._spark import checkpoint, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts, null ids and repeated rows are judged like any other."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word Jaccard 0.8 stays, the one of the smallest doc_id; null and empty texts are in no group, rows without id stay."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go; null and empty texts hold none, and an empty benchmark takes none."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; null and empty texts stay as they are."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in the order of training; null and empty texts have no words and are not taken."""
    return mixing.training_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", redact_pii),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in turn.

    What a stage keeps is written to the shared checkpoint folder, since the next one reads it more than once: each stage
    works on each of its rows once, and a lost executor costs no earlier stage. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
