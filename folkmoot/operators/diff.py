"""Differences of snapshots, audits of categories, quality gates and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkmoot.functions.classify import INTERPRETIVE, is_eligible
from folkmoot.functions.match import continued_bullets, description_echo, title_echo
from folkmoot.functions.text import clean_bullets


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, old, new): NEW, GONE, changed or unchanged; nulls equal each other."""
    a, b = old.select(F.col(key).alias("k"), F.col(value).alias("old"), F.lit(1).alias("in_old")), new.select(F.col(key).alias("k"), F.col(value).alias("new"), F.lit(1).alias("in_new"))
    both = a.join(b, "k", "full_outer")
    change = F.when(F.col("in_old").isNull(), "NEW").when(F.col("in_new").isNull(), "GONE").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return both.select(F.col("k").alias(key), change.alias("change"), "old", "new")


def chip_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """X1 by category: (key, category, change, old, new) of categories gained, lost or reworded, chips in their order."""

    def spread(df: DataFrame, side: str) -> DataFrame:
        rows = df.select("key", F.posexplode("chips").alias("at", "c"))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("c.text").alias("t")))), lambda x: x["t"])
        return rows.groupBy("key", F.col("c.category").alias("category")).agg(texts.alias(side))

    keys = old.select("key").join(new.select("key"), "key", "left_semi")
    both = spread(old, "old").join(spread(new, "new"), ["key", "category"], "full_outer").join(keys, "key", "left_semi")
    change = F.when(F.col("old").isNull(), "gained").when(F.col("new").isNull(), "lost").when(F.col("old") != F.col("new"), "reworded")
    return both.select("key", "category", change.alias("change"), "old", "new").where("change IS NOT NULL")


def category_audit(chips: DataFrame, categories: DataFrame, total: int | Column, noisy: float = 0.4) -> DataFrame:
    """For each known category the chips, the meetings and the share of items with chips, and whether it is never used or noise.

    ``chips`` has (meeting_id, item_id, category); labels that aren't known come
    out too, marked so.
    """
    used = chips.groupBy("category").agg(F.count(F.lit(1)).alias("chips"), F.countDistinct("meeting_id").alias("meetings"), F.countDistinct("meeting_id", "item_id").alias("items"))
    rows = used.join(categories.select("category", F.lit(True).alias("known")), "category", "full_outer").na.fill(0, ["chips", "meetings", "items"])
    share = F.coalesce(F.try_divide(F.col("items").cast("double"), total if isinstance(total, Column) else F.lit(total)), F.lit(0.0))
    return rows.select("category", "chips", "meetings", share.alias("share"), (F.col("chips") == 0).alias("never"), (share > noisy).alias("noise"), F.coalesce("known", F.lit(False)).alias("known"))


def quality_report(results: DataFrame, longest: int = 220) -> DataFrame:
    """A7, of (key, title, description, chips): coverage, echo and continuation shares, 0 where there is nothing to share."""
    b = clean_bullets(F.col("description"))
    own = F.exists("chips", lambda c: c["category"].isin(INTERPRETIVE) & ~title_echo(c["text"], F.col("title")))
    rows = results.select(
        b.alias("b"),
        F.coalesce(own, F.lit(False)).alias("soft"),
        F.size(F.coalesce("chips", F.array().cast(dict(results.dtypes)["chips"]))).alias("chips"),
        F.size(F.filter("chips", lambda c: title_echo(c["text"], F.col("title")))).alias("echoes"),
        (F.size(continued_bullets(b)) > 0).alias("goes_on"),
        description_echo(F.col("description"), F.col("title")).alias("desc_echo"),
        F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x)).alias("chars"),
    )
    has = F.size("b") > 0
    share = lambda a, n: F.coalesce(F.try_divide(a.cast("double"), n), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum("chips"), F.lit(0)).alias("chips"),
        F.count_if(has).alias("descriptions"),
        F.count_if(~has).alias("missing_descriptions"),
        F.count_if(has & F.col("desc_echo")).alias("description_echoes"),
        F.count_if(has & (F.col("chars") > longest)).alias("description_overruns"),
        share(F.count_if("soft"), F.count(F.lit(1))).alias("soft_coverage"),
        share(F.sum("echoes"), F.sum("chips")).alias("echo_share"),
        share(F.count_if("goes_on"), F.count_if(has)).alias("continuation_share"),
    )


def gates(verdicts: DataFrame, faithful: float = 4.0, specific: float = 3.0, floor: int = 2) -> DataFrame:
    """(gate, failed, value): the judge's means, its floor, and summaries it couldn't score. No failure where nothing was scored."""
    scored = F.col("faithfulness").isNotNull()
    got = verdicts.agg(
        F.count_if(scored).alias("n"), F.count_if(~scored).alias("unscored"), F.avg("faithfulness").alias("f"), F.avg(F.when(scored, F.col("specificity"))).alias("s"), F.count_if(F.col("faithfulness") <= floor).alias("low")
    )
    rules = (("unscored", F.col("unscored") > 0, "unscored"), ("mean_faithfulness", F.col("f") < faithful, "f"), ("mean_specificity", F.col("s") < specific, "s"), ("faithfulness_floor", F.col("low") > 0, "low"))
    each = F.array(*[F.struct(F.lit(n).alias("gate"), (F.col("n") > 0) & F.coalesce(c, F.lit(False)), F.col(v).cast("double").alias("value")) for n, c, v in rules])
    return got.select(F.explode(F.transform(each, lambda x: F.struct(x["gate"].alias("gate"), x["col2"].alias("failed"), x["value"].alias("value")))).alias("g")).select("g.*")


def union_latest(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Tables one after the other, a later row of a key taking the place of an earlier."""
    whole = None
    for n, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(n))
        whole = p if whole is None else whole.unionByName(p)
    best = whole.groupBy(key).agg(F.max_by(F.struct(*whole.columns), F.struct("_part", order)).alias("r"))
    return best.select("r.*").drop("_part")


def summary_work(items: DataFrame, done: DataFrame) -> DataFrame:
    """Every item with a status: done, to do, or not eligible, which gets an empty row at once."""
    marked = items.join(done.select("meeting_id", "item_id").distinct().withColumn("_done", F.lit(True)), ["meeting_id", "item_id"], "left")
    status = F.when(F.col("_done"), "done").when(is_eligible(), "todo").otherwise("ineligible")
    return marked.withColumn("status", status).drop("_done")


def missing_gists(attachments: DataFrame, gists: DataFrame) -> DataFrame:
    """Documents without a gist yet, each once."""
    doc = F.regexp_extract("url", r"DocumentId=(\d+)", 1)
    return attachments.withColumn("doc_id", doc).where("doc_id <> ''").dropDuplicates(["doc_id"]).join(gists.select("doc_id"), "doc_id", "left_anti")
