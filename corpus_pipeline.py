"""The training-data pipeline over ``documents``: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folkmoot.llm import decontam, gumbel, linededup, neardup, toxicity
from folkmoot.llm.common import stored, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on this stage's labelled documents, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources share; n_chars follows the text."""
    return linededup.line_dedup(docs, length_col="n_chars")


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.drop_leaked(docs, decontam.Benchmark(table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document left."""
    return gumbel.encode_samples(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_boilerplate),
    ("near dedup", remove_copies),
    ("decontamination", remove_leaks),
    ("sentencepiece", encode),
]

#: Toxicity, SimHash and sampling can't be said in SQL; tests/llm holds the run against a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        # Each stage but the first reads what the one before has written, as it uses its input more than once.
        docs = stage(spark, stored(docs) if i else docs, sf_dir)
    return docs
