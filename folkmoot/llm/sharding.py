"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the
fractional rank (rank - 1/2) / n of every row, sorted over all sources, spreads
each source evenly over the whole order, so that any cut of that order into
equal runs has the mixture of the whole.

No sort or window runs over a whole source: ranks are counted by hash bucket
first (a small table of counts), then only within a bucket, so the hottest
source is as parallel as the rest. The same holds for the global order, cut
into ranges of the fractional rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.llm.common import Intake

BUCKETS = 4096


def shard_plan(df: DataFrame, shards: int = 64, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, source, frac, position, shard) for every row.

    Null sources form a stratum of their own. Null or repeated ids are rows like
    any other; rows that tie (same id and source) hold neighbouring places and
    can't be told apart. An empty table gives an empty plan; with fewer rows
    than shards some shards are empty. Other columns aren't read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = Intake(df, id_col, source_col).narrow(id=id_col, source=source_col).select(
        "id",
        "source",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("src"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("h"),
    )
    rows = rows.withColumn("b", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    # The hash order is b first, then h: any fixed order of hashes is a shuffle.
    per = rows.groupBy("src", "b").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("src")
    per = per.select(
        F.col("src").alias("src_"),
        F.col("b").alias("b_"),
        (F.sum("c").over(own.orderBy("b")) - F.col("c")).alias("before"),
        F.sum("c").over(own).alias("n"),
    )
    ranked = rows.join(per, (F.col("src") == F.col("src_")) & (F.col("b") == F.col("b_"))).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("src", "b").orderBy("h", "id"))
    )
    ranked = ranked.select("id", "source", "src", "h", ((F.col("rank") - F.lit(0.5)) / F.col("n")).alias("frac"))
    ranked = ranked.withColumn("g", F.floor(F.col("frac") * buckets).cast("int"))
    # At most `buckets` rows pass through the one window without a key.
    ranges = ranked.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    ranges = ranges.select(
        F.col("g").alias("g_"),
        (F.sum("c").over(Window.orderBy("g")) - F.col("c")).alias("start"),
        F.sum("c").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    placed = ranked.join(ranges, F.col("g") == F.col("g_")).withColumn(
        "position", (F.col("start") + F.row_number().over(Window.partitionBy("g").orderBy("frac", "src", "h", "id")) - 1).cast("long")
    )
    return placed.select(
        F.col("id").alias("doc_id"),
        "source",
        "frac",
        "position",
        F.expr(f"position * {int(shards)} div total").cast("int").alias("shard"),
    )


def shard_plan_sql(shards: int = 64, seed: int = 17, buckets: int = BUCKETS) -> str:
    return f"""
WITH r AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
         md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
b AS (SELECT *, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % {buckets} AS INT) AS b FROM r),
f AS (
  SELECT *, (row_number() OVER (PARTITION BY src ORDER BY b, h, doc_id) - 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY src) AS frac
  FROM b),
p AS (
  SELECT *, row_number() OVER (ORDER BY frac, src, h, doc_id) - 1 AS position, count(*) OVER () AS total
  FROM f)
SELECT doc_id, source, frac, CAST(position AS BIGINT) AS position,
       CAST(position * {shards} // total AS INT) AS shard
FROM p"""
