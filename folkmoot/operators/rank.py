"""Scores, top-k by group, counts and rosters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.functions.classify import (
    badges,
    card_badges,
    chip_badges,
    format_outcome,
    is_consent,
    is_eligible,
    is_major,
    is_procedural,
    is_section_header,
    qualifies,
    ROUTINE_UNDER,
    topic_summary,
    truth,
)
from folkmoot.functions.match import best_sentences, name_candidates, organization_color, organization_label
from folkmoot.functions.text import clean_bullets, clean_entities, discussion_minutes, plainify, split_sentences, text, titleize


def minutes() -> Column:
    return discussion_minutes(F.col("time_start_ms"), F.col("time_end_ms"), F.col("timestamp_inherited"), F.col("is_recess"))


def top_per_group(df: DataFrame, by: list[str], measure: Column, tie: list[str], k: int) -> DataFrame:
    """The k rows of each group with the greatest measure, earlier ones first on a tie. Plans as a limit within groups before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(measure.desc(), *tie))
    return df.withColumn("nth", nth).where(F.col("nth") <= k)


def qualifying_items(items: DataFrame, k: int = 8) -> DataFrame:
    """Of items with something to say, the longest discussed of each meeting."""
    return top_per_group(items.where(qualifies()).withColumn("minutes", minutes()), ["meeting_id"], F.col("minutes"), ["pos"], k)


def interest(minutes_: Column) -> Column:
    """How much an item is worth a reader's time."""
    title, rec, vote = text("title"), text("recommendation"), text("vote_result")
    points = F.length(text("section_number")) - F.length(F.replace(text("section_number"), F.lit("."), F.lit("")))
    add = lambda cond, a, b=0.0: F.when(cond, F.lit(a)).otherwise(F.lit(b))
    low = F.lower(title)
    depth = add(points.between(1, 2), 0.15, 0.05) - add(F.contains(low, F.lit("standing policy committee")), 0.2) - add(F.contains(low, F.lit("appointments")) & (points >= 3), 0.1)
    length = F.lit(0.45) * F.least(F.lit(1.0), F.log1p(minutes_) / math.log1p(120))
    return (
        add(truth("is_contested"), 0.5) + add(F.concat_ws(" ", rec, title).rlike(r"\$[\d,.]+"), 0.3) + add(vote != "", 0.2) + add(rec != "", 0.2) + depth
        + F.least(F.lit(0.4), F.size(chip_badges()) * 0.15) + add(F.size(clean_bullets(F.col("description"))) > 0, 0.25) + length
    )


def meeting_topics(items: DataFrame, k: int = 8, places: tuple[str, ...] = ()) -> DataFrame:
    """The topics of each meeting, ranked by interest (from 0) and given in the agenda's order. Scores are compared to twelve places."""
    real = items.where(~is_procedural("title") & ~is_section_header() & ~truth("is_recess"))
    ranked = top_per_group(real.withColumn("score", F.round(interest(minutes()), 12)), ["meeting_id"], F.col("score"), ["pos"], k)
    said = topic_summary()
    return ranked.select(
        "meeting_id",
        "pos",
        F.lit("topic").alias("kind"),
        titleize(plainify("title")).alias("topic"),
        format_outcome("vote_result", "recommendation").alias("outcome"),
        clean_entities("recommendation").alias("outcome_detail"),
        said["lines"].alias("summary"),
        said["described"].alias("summary_is_description"),
        text("vote_result").alias("vote_result"),
        is_major("title", "recommendation", "is_contested").alias("is_major"),
        truth("is_contested").alias("is_contested"),
        truth("timestamp_inherited").alias("is_consent"),
        card_badges(places).alias("badges"),
        "time_start_ms",
        "item_id",
        "score",
        (F.col("nth") - 1).alias("rank"),
    )


def speaker_rows(topics: DataFrame, speakers: DataFrame, most: int = 3) -> DataFrame:
    """Topics with up to three speakers who have remarks beneath each, and how many there are in all."""
    with_remarks = speakers.where(F.size(F.coalesce("said", F.array().cast("array<string>"))) > 0)
    w = Window.partitionBy("meeting_id", "pos")
    few = with_remarks.withColumns({"nth": F.row_number().over(w.orderBy("spk_pos")), "many": F.count(F.lit(1)).over(w)}).where(F.col("nth") <= most)
    few = few.select("meeting_id", "pos", "nth", "many", "name", F.col("organization").alias("org"), text("stance").alias("stance"), F.col("time_start_ms").alias("own_ms"))
    rows = few.join(topics, ["meeting_id", "pos"])
    label = F.when(F.col("stance") == "support", "In support").when(F.col("stance") == "concern", "Raised concerns").otherwise("Spoke")
    beneath = rows.select(
        "meeting_id",
        "pos",
        F.lit("speaker").alias("kind"),
        F.coalesce(F.nullif("name", F.lit("")), F.lit("A speaker")).alias("topic"),
        label.alias("outcome"),
        F.when(F.col("stance").isin("support", "concern"), F.col("stance")).otherwise("").alias("stance"),
        organization_label("org").alias("organization"),
        organization_color("org").alias("org_color"),
        F.col("many").alias("item_speaker_count"),
        F.filter("badges", lambda b: F.startswith(b["type"], F.lit("cat-"))).alias("badges"),
        F.coalesce("own_ms", "time_start_ms").alias("time_start_ms"),
        "item_id",
        "rank",
        F.col("nth").alias("line"),
    )
    return topics.withColumn("line", F.lit(0)).unionByName(beneath, allowMissingColumns=True).orderBy("meeting_id", "pos", "line")


def speaker_roster(speakers: DataFrame, items: DataFrame, places: tuple[str, ...] = ()) -> DataFrame:
    """A2: organizations of each meeting as first met, with residents and speakers counted; who only registered and wasn't heard is left out."""
    present = ~((text("source") == "registered") & (F.size(F.coalesce("said", F.array().cast("array<string>"))) <= 0) & ~truth("heard"))
    org = F.trim(text("organization"))
    cats = F.transform(F.filter(badges(places), lambda b: F.startswith(b["type"], F.lit("cat-"))), lambda b: b["type"])
    about = items.select("meeting_id", "pos", "item_id", F.col("time_start_ms").alias("item_ms"), cats.alias("categories"))
    rows = speakers.where(present).join(about, ["meeting_id", "pos"]).withColumns({"org": org, "label": F.when(org != "", organization_label(org))})
    first = rows.where("label IS NOT NULL").groupBy("meeting_id", "label").agg(F.min_by(F.struct("pos", "spk_pos", organization_color("org").alias("color"), "item_id", F.col("item_ms").alias("time_start_ms"), "categories"), F.struct("pos", "spk_pos")).alias("f"))
    orgs = first.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("f.pos", "f.spk_pos", "label", "f.color", "f.item_id", "f.time_start_ms", "f.categories"))).alias("organizations"))
    name = F.nullif(text("name"), F.lit(""))
    counts = rows.groupBy("meeting_id").agg(F.countDistinct(F.when(F.col("label").isNull(), name)).alias("resident_count"), F.countDistinct(name).alias("speaker_count"))
    return counts.join(orgs, "meeting_id", "left")


def mark_row_weights(items: DataFrame) -> DataFrame:
    """Items with is_routine and is_heading. A heading over nothing is routine; so is procedure that reports little."""
    number = F.regexp_replace(F.trim(text("section_number")), r"\.+$", "")
    rows = items.withColumns({"_prefix": F.when(number != "", F.concat(number, F.lit("."))).otherwise(""), "_head": is_section_header(), "_proc": is_procedural("title")})
    # A section has items beneath it if it is among another's ancestors: an equi join on exploded prefixes.
    parts = F.split(F.regexp_replace("_prefix", r"\.$", ""), r"\.")
    above = rows.where("_prefix <> ''").select("meeting_id", parts.alias("p")).where(F.size("p") > 1).select("meeting_id", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("d"))
    above = above.select("meeting_id", F.concat(F.array_join(F.slice("p", F.lit(1), F.col("d")), "."), F.lit(".")).alias("_prefix")).distinct().withColumn("_over", F.lit(True))
    rows = rows.join(above, ["meeting_id", "_prefix"], "left")
    routine = F.when(truth("is_recess"), False).when(F.col("_proc"), F.length(F.trim(text("content"))) < ROUTINE_UNDER).otherwise(F.col("_head") & ~truth("_over"))
    return rows.withColumn("is_routine", routine).withColumn("is_heading", ~F.col("is_routine") & F.col("_head")).drop("_prefix", "_head", "_proc", "_over")


def meeting_counts(weighted: DataFrame) -> DataFrame:
    """A1: items, consent items and discussed items of each meeting."""
    real = ~truth("is_recess") & ~is_section_header()
    return weighted.groupBy("meeting_id").agg(
        F.count_if(real).alias("agenda_items"), F.count_if(is_consent()).alias("consent_items"), F.count_if(real & ~truth("is_routine") & ~is_consent()).alias("discussed_items")
    )


def is_settled(summarised: Column, day: Column, today: Column, days: int = 7) -> Column:
    """A3, over the meetings of a day: all have summaries, or a week has gone by."""
    return F.bool_and(F.coalesce(summarised, F.lit(False))) | F.coalesce(F.datediff(today, F.max(day)) >= days, F.lit(False))


def days_to_publish(meetings: DataFrame, items: DataFrame, today: str) -> DataFrame:
    """A4: (day, meetings) of days that have something to publish and are settled, newest first."""
    from folkmoot.functions.text import iso_date

    some = items.where(qualifies()).select("meeting_id").distinct()
    rows = meetings.withColumn("day", F.trim(text("date"))).withColumn("d", iso_date("day")).where("d IS NOT NULL").join(some, "meeting_id", "left_semi")
    days = rows.groupBy("day").agg(F.array_sort(F.collect_set("meeting_id")).alias("meetings"), is_settled(F.col("has_summaries"), F.col("d"), F.lit(today).cast("date")).alias("settled"))
    return days.where("settled").select("day", "meetings").orderBy(F.desc("day"))


def trim_transcript(slices: DataFrame) -> DataFrame:
    """Distinct segments of chosen items' slices, in order."""
    return slices.select("meeting_id", "start_ms", "end_ms", "text").distinct().orderBy("meeting_id", "start_ms", "end_ms", "text")


def rank_by_names(items: DataFrame, slices: DataFrame, roster: Column | None = None) -> DataFrame:
    """Eligible items by how many names their words hold."""
    said = slices.groupBy("meeting_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("heard"))
    rows = items.where(is_eligible()).join(said, ["meeting_id", "pos"], "left").withColumn("heard", F.coalesce("heard", F.lit("")))
    return rows.select("meeting_id", "pos", "item_id", name_candidates("heard", roster).alias("names"), F.length("heard").alias("chars")).orderBy(F.desc(F.size("names")), "item_id")


def summary_of(body: Column | str, title: Column | str, k: int = 2) -> Column:
    """The k sentences of a text that say most, in the order of the text.

    Arrow batches, as counting a text's words takes a table of them: a lookup in
    a map would be a scan of it, and joins on word shuffle many times the text.
    Ties go to the earlier sentence; a text of k sentences or fewer is its own
    summary; null and blank texts give a blank.
    """
    whole, name = F.make_valid_utf8(text(body)), F.make_valid_utf8(text(title))  # else Arrow fails on bytes that aren't text
    return best_sentences(split_sentences(whole), name, F.lit(k))


def extractive_summary(rows: DataFrame, key: list[str], body: str, title: str, k: int = 2) -> DataFrame:
    """(key, summary) of each row by itself."""
    return rows.select(*key, summary_of(body, title, k).alias("summary"))


def summarize_items(items: DataFrame) -> DataFrame:
    """W8 over items: procedure is only named so."""
    whole = F.when(text("content") != "", F.concat_ws(". ", text("title"), "content")).otherwise(text("title"))
    return items.withColumn("extractive_summary", F.when(is_procedural("title"), "Procedural item.").otherwise(summary_of(whole, "title")))
