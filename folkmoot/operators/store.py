"""Keyed tables of Parquet, written by version, and what is missing from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that comes last; an aggregate with partial results before the shuffle, not a sort."""
    best = df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(order, F.xxhash64(*df.columns))).alias("r"))
    return best.select(*key, "r.*").select(*df.columns)


def changed(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows that aren't in the table yet, or are there with other values: a put of the same is no work."""
    rest = sorted(c for c in new.columns if c not in key)
    mark = F.xxhash64(*[F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in rest]).alias("_mark")
    held = old.select(*key, mark)
    return new.withColumn("_mark", mark).join(held, [*key, "_mark"], "left_anti").drop("_mark")


class KeyedStore:
    """A table of (key, version, payload) that is only appended to; a read takes the latest version of each key."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path
        self.schema = spark.createDataFrame([], schema).schema

    def load(self) -> DataFrame:
        """Rows by key; empty before the first save."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema.add("_version", "long") if "_version" not in self.schema.names else self.schema).parquet(self.path)
        return latest(rows, [self.schema.names[0]], "_version").select(*[n for n in self.schema.names if n != "_version"])

    def save(self, rows: DataFrame, version: int) -> int:
        """Append what has changed; how many rows that was."""
        names = [n for n in self.schema.names if n != "_version"]
        new = changed(rows.select(*names), self.load(), names[:1]).withColumn("_version", F.lit(version).cast("long"))
        # Written aside and then counted, so that what is counted is what was written.
        batch = f"{self.path}/batch={uuid.uuid4().hex}"
        new.write.parquet(batch)
        return self.spark.read.parquet(batch).count()


def is_current(summaries: DataFrame) -> DataFrame:
    """(meeting_id, current): any summary that is neither legacy nor provisional."""
    return summaries.groupBy("meeting_id").agg(F.bool_or(~F.col("is_legacy") & ~F.col("provisional")).alias("current"))


def meetings_to_do(meetings: DataFrame, summaries: DataFrame) -> DataFrame:
    return meetings.join(is_current(summaries).where("current"), "meeting_id", "left_anti")
