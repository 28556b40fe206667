"""A training-data pipeline over ``documents``; each stage calls one operator of ``vatlens.llm``.

toxicity          documents that score as toxic go
simhash           of each near-duplicate component the smallest doc_id stays
decontaminate     documents with a window of a benchmark item go
pii               personal data in the texts is replaced
bpe               ``input_ids`` and ``n_tokens`` are added

A stage returns the columns of its documents; the last one adds its own. Repeated
rows, null and empty texts and extra columns are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vatlens.llm import bpe, decontaminate, pii, simhash, toxicity
from vatlens.llm.common import saved, table
from vatlens.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, *vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact),
    ("bpe", encode),
]

#: SQL cannot express compression distance or the merges of a vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
