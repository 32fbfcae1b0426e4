"""Who spoke, from minutes and from filed requests to speak."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.functions.classify import SPOKE, is_city_unit, is_office, is_procedural, is_staff_presenting, stance, truth
from folkmoot.functions.text import clean_entities, shorten, text

NOT_NAMES = ("discussion", "he", "it", "questions", "she", "the", "they")
NAME = r"(?U)^[A-Z][\w\-.]*(?:\s+[A-Z][\w\-.]*){0,5}$"
FILED = r"(?i)(?:Request to Speak|RTS)\s+-\s+(.+?)\s+-\s+(.+?)(?:_Redacted)?\s*(?:\(\d+\))?\.pdf$"


def from_minutes(items: DataFrame, city: str = r"\w+") -> DataFrame:
    """(meeting_id, pos, at, name, organization, stance, summary, source): members of the public in the minutes' prose, each once."""
    rows = items.where(~truth("is_recess") & ~is_procedural("title")).select("meeting_id", "pos", F.posexplode(F.split(clean_entities("content"), r"(?<=[.!?])\s+")).alias("at", "s"))
    rows = rows.withColumn("s", F.trim("s")).where(F.col("s").rlike(f"(?i){SPOKE}"))
    who = F.regexp_replace(F.trim(F.regexp_extract("s", rf"(?is)^(.*?){SPOKE}", 1)), ",+$", "")
    parts = F.filter(F.transform(F.split(who, ","), lambda p: F.trim(p)), lambda p: p != "")
    rows = rows.withColumn("p", parts).where(F.size("p") > 0).withColumn("name", F.col("p")[0])
    lead = F.lower(F.regexp_extract("name", r"^(\S+)", 1))
    # An organization's parts go on as long as they begin with a capital.
    rest = F.slice("p", 2, 1 << 20)
    stop = F.array_position(F.transform(rest, lambda p: p.rlike(r"(?U)^\p{Lu}")), False)
    org = F.array_join(F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest), ", ")
    rows = rows.withColumn("organization", org)
    rows = rows.where(~lead.isin(*NOT_NAMES) & F.col("name").rlike(NAME) & ~is_office(F.col("name")) & ~is_city_unit(F.col("organization"), city) & ~is_staff_presenting(F.col("s"), F.col("name"), F.col("organization")))
    tail = F.regexp_extract("s", rf"(?is)({SPOKE}.*)$", 1)
    first = F.row_number().over(Window.partitionBy("meeting_id", "pos", F.lower("name")).orderBy("at"))
    rows = rows.withColumn("nth", first).where("nth = 1")
    return rows.select("meeting_id", "pos", "at", "name", "organization", stance(tail).alias("stance"), shorten("s").alias("summary"), F.lit("minutes").alias("source"))


def from_filings(items: DataFrame) -> DataFrame:
    """The same of requests to speak among an item's attachments."""
    rows = items.where(~truth("is_recess") & ~is_procedural("title")).select("meeting_id", "pos", F.posexplode("attachments").alias("at", "a"))
    name, topic = (F.trim(F.regexp_extract(text("a.name"), FILED, i)) for i in (1, 2))
    rows = rows.withColumns({"name": name, "topic": topic}).where("name <> ''")
    first = F.row_number().over(Window.partitionBy("meeting_id", "pos", F.lower("name")).orderBy("at"))
    rows = rows.withColumn("nth", first).where("nth = 1")
    said = F.when(F.col("topic") != "", F.concat(F.lit("Registered to speak on: "), "topic")).otherwise("Registered to speak.")
    return rows.select("meeting_id", "pos", (F.col("at") + 1_000_000).alias("at"), "name", F.lit("").alias("organization"), F.lit("").alias("stance"), said.alias("summary"), F.lit("registered").alias("source"))


def extract_speakers(items: DataFrame, city: str = r"\w+") -> DataFrame:
    """(meeting_id, pos, spk_pos, …): minutes first, then filings of names not known yet."""
    said, filed = from_minutes(items, city), from_filings(items)
    known = said.select("meeting_id", "pos", F.lower("name").alias("low"))
    new = filed.withColumn("low", F.lower("name")).join(known, ["meeting_id", "pos", "low"], "left_anti").drop("low")
    both = said.unionByName(new)
    return both.withColumn("spk_pos", F.row_number().over(Window.partitionBy("meeting_id", "pos").orderBy("at")) - 1).drop("at")
