"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkmoot.llm import decontam, fertility, gumbel, linededup, neardup, pii, preference, sharding, tokencount, toxicity
from folkmoot.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"), counts=True)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel.encode_samples(table(spark, sf_dir, "documents"))


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = preference.preference_format(*preference.rejected_sides(table(spark, sf_dir, "conversations")))
    # Ranges as text, which reads alike from any engine.
    spelled = {c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["stop"])), " ") for c in ("chosen_mask", "rejected_mask")}
    return made.withColumns(spelled)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask_private(table(spark, sf_dir, "documents"), pii.fit())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), decontam.Benchmark(table(spark, sf_dir, "benchmark")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": linededup.line_dedup_sql(),
        "op3_preference": preference.preference_sql(),
        "op7_sharding": sharding.shard_plan_sql(),
    }
