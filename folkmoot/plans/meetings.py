"""Whole tables from recorded pages to ranked, published meetings. Stages are functions of tables; nothing loops over meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkmoot.functions.text import text
from folkmoot.operators import intervals, rank, speakers
from folkmoot.operators.graph import settle
from folkmoot.schemas import ATTACHMENT, SPEAKER
from folkmoot.sources import parse


def load_detail(agendas: DataFrame, postminutes: DataFrame, site: str = "") -> DataFrame:
    """Items of all meetings from their agenda pages, joined with what was minuted and voted; a meeting without minutes has none."""
    marks = parse.bookmarks(agendas)
    rows = parse.agenda_rows(agendas).join(marks, ["meeting_id", "item_id"], "left")
    rows = rows.select("meeting_id", "pos", "item_id", "title", "section_number", F.col("start_ms").alias("time_start_ms"), F.col("end_ms").alias("time_end_ms"), F.lit(False).alias("timestamp_inherited"), F.lit(False).alias("is_recess"), F.lit("").alias("content"))
    rows = settle(intervals.insert_recesses(intervals.mark_brief(intervals.inherit_spans(rows))))
    blocks, after = parse.item_blocks(agendas), parse.item_blocks(postminutes)
    files = intervals.distribute_attachments(rows, parse.attachments(blocks, site))
    filed = files.groupBy("meeting_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("att_pos", "name", "url"))).alias("f"))
    key = ["meeting_id", "item_id"]
    rows = rows.join(parse.recommendations(blocks), key, "left").join(parse.descriptions(blocks), key, "left").join(parse.minutes(after), key, "left").join(parse.votes(after), key, "left").join(filed, key, "left")
    motion = F.nullif("motion", F.lit(""))
    items = rows.select(
        "meeting_id", "pos", "item_id", "title", F.coalesce("minuted", "described", "content").alias("content"), "section_number", "time_start_ms", "time_end_ms",
        F.coalesce(motion, "recommendation", F.lit("")).alias("recommendation"), F.lit(None).cast("string").alias("motion_text"), text("result").alias("vote_result"), text("detail").alias("vote_detail"),
        F.coalesce("is_contested", F.lit(False)).alias("is_contested"), "timestamp_inherited", "is_recess", F.lit(False).alias("scheduled"),
        F.coalesce(F.transform("f", lambda a: F.struct(a["name"].alias("name"), a["url"].alias("url"))), F.array().cast(f"array<{ATTACHMENT}>")).alias("attachments"),
    )
    items = settle(items)
    return with_speakers(items, speakers.extract_speakers(items))


def with_speakers(items: DataFrame, found: DataFrame) -> DataFrame:
    one = F.struct(*[(F.col(c) if c in found.columns else F.lit(None)).alias(c) for c in ("name", "organization", "stance", "summary", "source", "said", "heard", "time_start_ms")]).cast(SPEAKER)
    order = "spk_order" if "spk_order" in found.columns else "spk_pos"
    per = found.groupBy("meeting_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("s")))), lambda x: x["s"]).alias("speakers"))
    return items.drop("speakers").join(per, ["meeting_id", "pos"], "left").withColumn("speakers", F.coalesce("speakers", F.array().cast(f"array<{SPEAKER}>")))


def spread_speakers(items: DataFrame) -> DataFrame:
    return items.select("meeting_id", "pos", F.posexplode("speakers").alias("spk_pos", "s")).select("meeting_id", "pos", "spk_pos", "s.*")


def with_summaries(items: DataFrame, summaries: DataFrame) -> DataFrame:
    """Items with description and chips; cached remarks are merged into the roster."""
    got = summaries.select("meeting_id", "item_id", "description", "chips", F.col("speakers").alias("_cached"))
    rows = settle(items.drop("description", "chips").join(got, ["meeting_id", "item_id"], "left"))
    cached = rows.where(F.size("_cached") > 0).select("meeting_id", "pos", F.posexplode("_cached").alias("spk_pos", "s")).select("meeting_id", "pos", "spk_pos", "s.*")
    merged = intervals.merge_remarks(spread_speakers(rows), cached)
    return with_speakers(rows.drop("_cached"), merged)


def align(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Each stage's table is read more than once by the next, so it is checkpointed between them.

    Starts corrected by the transcript; groups before stamps, as joint windows decide where speakers are looked for."""
    rows = settle(intervals.shift_past_recesses(settle(intervals.correct_timestamps(items, segments)), segments))
    marked = settle(intervals.mark_jointly_heard(rows))
    window = settle(intervals.group_window(marked))
    heard = settle(intervals.mark_heard(spread_speakers(marked), marked, segments, window))
    stamped = intervals.mark_timestamps(heard, marked, segments, window)
    return intervals.mark_questions(with_speakers(marked, stamped), segments, window)


def build(items: DataFrame, segments: DataFrame, summaries: DataFrame, topics: int = 8) -> tuple[DataFrame, DataFrame]:
    """(weighted items, topic rows with speakers beneath) of all meetings."""
    rows = settle(rank.mark_row_weights(align(with_summaries(items, summaries), segments)))
    return rows, rank.speaker_rows(rank.meeting_topics(rows, topics), spread_speakers(rows))
