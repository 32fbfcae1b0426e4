"""Sources: recorded listings, pages and fixtures, and keyed Parquet tables. Fetching over a network is left to what fills the landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folkmoot import schemas
from folkmoot.functions.classify import truth
from folkmoot.functions.text import text, titleize
from folkmoot.sources.parse import envelope_date


def listings(spark: SparkSession, path: str) -> DataFrame:
    """Recorded list calls, a row a meeting, with the page's total."""
    raw = spark.read.schema(schemas.LISTING).json(path, multiLine=True)
    return raw.select(F.col("d.TotalCount").alias("total"), F.explode("d.Meetings").alias("m")).select("total", "m.*")


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """S2, S4."""
    return spark.read.schema(schemas.CALENDAR).json(path, multiLine=True).select(F.explode("d").alias("m")).select("m.*")


def pages(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(meeting_id, html) of files named ``{prefix}_{meeting_id}.html``."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"{prefix}_*.html")
    return files.select(F.regexp_extract(F.input_file_name(), rf"{prefix}_([^/]+)\.html$", 1).alias("meeting_id"), F.col("value").alias("html"))


def past_meetings(listed: DataFrame) -> DataFrame:
    """Cancelled if so flagged, or if any link says so."""
    links = F.coalesce(F.col("MeetingLinks"), F.array().cast("array<struct<Title:string>>"))
    cancelled = truth("Cancelled") | F.exists(links, lambda x: F.contains(F.lower(F.coalesce(x["Title"], F.lit(""))), F.lit("cancel")))
    return listed.select(
        text("Id").alias("meeting_id"),
        titleize(F.coalesce(F.trim("MeetingType"), F.lit("City Council Meeting"))).alias("title"),
        envelope_date("Start").alias("date"),
        text("FormattedStart").alias("start_time"),
        text("LocationName").alias("location"),
        truth("HasVideo").alias("has_video"),
        truth("HasAgenda").alias("has_agenda"),
        cancelled.alias("is_cancelled"),
    )


def scheduled_meetings(listed: DataFrame, bodies: DataFrame, start: str, end: str) -> DataFrame:
    """Meetings to come of known bodies, ``bodies`` being (meeting_type, body), soonest first."""
    rows = listed.where(~truth("MeetingPassed")).withColumn("kind", F.trim(text("MeetingType")))
    known = rows.join(bodies.select(F.col("meeting_type").alias("kind"), "body"), "kind")
    day = F.split_part(F.replace(text("StartDate"), F.lit("/"), F.lit("-")), F.lit(" "), F.lit(1))
    got = known.select(text("ID").alias("meeting_id"), titleize("kind").alias("title"), "body", day.alias("date"), text("FormattedStart").alias("start_time"), F.trim(text("Location")).alias("location"), truth("HasAgenda").alias("has_agenda"))
    return got.where(F.col("date").between(start, end)).orderBy("date", "start_time")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts, a file each, named ``{meeting_id}.transcript.json``."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.transcript.json")
    rows = raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.transcript\.json$", 1).alias("meeting_id"), F.from_json("value", "array<struct<start_ms:bigint,end_ms:bigint,text:string>>").alias("s"))
    return rows.select("meeting_id", F.posexplode("s").alias("seq", "x")).select("meeting_id", "seq", "x.*")


def chunked_segments(chunks: DataFrame, minutes: int = 30) -> DataFrame:
    """Recognised chunks (meeting_id, chunk, seq, start_ms, end_ms, text) on the meeting's own clock."""
    shift = F.col("chunk") * minutes * 60_000
    order = Window.partitionBy("meeting_id").orderBy("chunk", "seq")
    return chunks.select("meeting_id", (F.row_number().over(order) - 1).alias("seq"), (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"), "text")


def summaries(raw: DataFrame) -> DataFrame:
    """Cached summaries (meeting_id, json) to a row an item. An old entry is a bare list of chips, a description may be plain text."""
    entries = raw.select("meeting_id", F.explode(F.from_json("json", "map<string,string>")).alias("item_id", "entry"))
    chips = f"array<{schemas.CHIP}>"
    new = F.from_json("entry", f"description string, chips {chips}, speakers array<{schemas.SPEAKER}>, provisional boolean")
    from folkmoot.functions.text import as_bullets

    legacy = F.col("entry").rlike(r"^\s*\[")
    return entries.select(
        "meeting_id",
        F.col("item_id").cast("bigint").alias("item_id"),
        F.when(~legacy & new["description"].isNotNull(), as_bullets(new["description"])).alias("description"),
        F.when(legacy, F.from_json("entry", chips)).otherwise(new["chips"]).alias("chips"),
        new["speakers"].alias("speakers"),
        F.coalesce(new["provisional"], F.lit(False)).alias("provisional"),
        (legacy | new["description"].isNull()).alias("is_legacy"),
    )


def page_dates(spark: SparkSession, path: str) -> DataFrame:
    """(meeting_id, date) from the titles of built pages."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.html")
    title = F.regexp_extract("value", r"(?is)<title>(.*?)</title>", 1)
    day = F.try_to_timestamp(F.regexp_extract(title, r"([A-Z][a-z]+ \d{1,2}, \d{4})", 1), F.lit("MMMM d, yyyy")).cast("date")
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.html$", 1).alias("meeting_id"), day.alias("date")).where("date IS NOT NULL")


def resolve_meeting(meetings: DataFrame, body: str, date: str) -> DataFrame:
    """The meeting of a body on a day."""
    return meetings.where((F.col("title") == body) & (F.col("date") == date)).orderBy("meeting_id").select("meeting_id").limit(1)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot {key: {section_number, title, description, chips}} as rows."""
    raw = spark.read.text(path, wholetext=True)
    entry = f"struct<section_number:string,title:string,description:array<string>,chips:array<{schemas.CHIP}>>"
    return raw.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("key", "e")).select("key", "e.*")


def save_golden(results: DataFrame, path: str) -> None:
    results.drop("_source").orderBy("key").write.mode("overwrite").json(path)


def in_memory(spark: SparkSession, meetings: list[tuple]) -> DataFrame:
    """A listing of given meetings, for tests and tools; pages and kinds of meeting play no part."""
    return spark.createDataFrame(meetings, schemas.MEETINGS)
