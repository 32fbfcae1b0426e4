"""Agenda pages to rows. A page is one string; patterns are Java's, and everything is built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.functions.text import clean_entities, clean_html, text, titleize

KINDS = "addendum agenda meeting minutes public regular revised special".split()
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"


def bookmarks(pages: DataFrame) -> DataFrame:
    """(meeting_id, item_id, start_ms, end_ms): the span of each item's marks, repaired JSON where it isn't strict."""
    raw = F.regexp_extract(F.col("html"), r"(?s)Bookmarks\s*:\s*([\[].*?\])", 1)
    schema = "array<struct<AgendaItemId:bigint,TimeStart:bigint,TimeEnd:bigint>>"
    mended = F.regexp_replace(F.regexp_replace(raw, r"(\w+)\s*:", r'"$1":'), r",\s*([}\]])", "$1")
    strict, loose = F.from_json(raw, schema), F.from_json(mended, schema)
    good = F.exists(strict, lambda b: b["AgendaItemId"].isNotNull())
    marks = F.when(F.coalesce(good, F.lit(False)), strict).otherwise(loose)
    rows = pages.where(raw != "").select("meeting_id", F.explode(marks).alias("b")).where("b.AgendaItemId IS NOT NULL")
    return rows.groupBy("meeting_id", F.col("b.AgendaItemId").alias("item_id")).agg(F.min("b.TimeStart").alias("start_ms"), F.max("b.TimeEnd").alias("end_ms"))


def agenda_rows(pages: DataFrame) -> DataFrame:
    """(meeting_id, pos, item_id, section_number, title), the first of each id."""
    # (?is) as on the page: a counter, then a title, then the link that selects the item.
    p = r"(?is)AgendaItemCounter.*?>([.\d]+)</DIV.*?AgendaItemTitle.*?SelectItem\((\d+)\).*?>(.*?)</a>"
    groups = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(p), F.lit(i)).alias(n) for i, n in ((1, "n"), (2, "id"), (3, "t"))])
    rows = pages.select("meeting_id", F.posexplode(groups).alias("at", "r")).select("meeting_id", "at", F.col("r.id").cast("bigint").alias("item_id"), clean_html("r.n").alias("section_number"), clean_html("r.t").alias("title"))
    first = rows.groupBy("meeting_id", "item_id").agg(F.min_by(F.struct("at", "section_number", "title"), "at").alias("f"))
    order = Window.partitionBy("meeting_id").orderBy("f.at")
    return first.select("meeting_id", (F.row_number().over(order) - 1).alias("pos"), "item_id", "f.section_number", "f.title")


def item_blocks(pages: DataFrame) -> DataFrame:
    """(meeting_id, item_id, block): from an item's first mark to the first mark of the next item."""
    # Pieces begin at each mark; later marks of an item already seen belong to the block before them.
    pieces = pages.select("meeting_id", F.posexplode(F.split("html", r"(?=SelectItem\(\d+\))")).alias("at", "piece"))
    marked = pieces.withColumn("item_id", F.regexp_extract("piece", r"^SelectItem\((\d+)\)", 1).try_cast("bigint")).where("item_id IS NOT NULL")
    first = F.min("at").over(Window.partitionBy("meeting_id", "item_id")) == F.col("at")
    owner = F.last(F.when(F.col("new"), F.col("item_id")), ignorenulls=True).over(Window.partitionBy("meeting_id").orderBy("at"))
    owned = marked.withColumn("new", first).withColumn("owner", owner)
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    return owned.groupBy("meeting_id", F.col("owner").alias("item_id")).agg(glued.alias("block"))


def rich_text(block: Column, kind: str) -> Column:
    """The first division of a kind, null if there is none or it is blank."""
    return F.nullif(clean_html(F.regexp_extract(block, rf"(?is){kind}.*?>(.*?)</DIV>", 1)), F.lit(""))


def recommendations(blocks: DataFrame) -> DataFrame:
    return _kind(blocks, "MotionText RichText", "recommendation")


def descriptions(blocks: DataFrame) -> DataFrame:
    return _kind(blocks, "AgendaItemDescription RichText", "described")


def minutes(blocks: DataFrame) -> DataFrame:
    return _kind(blocks, "AgendaItemMinutes RichText", "minuted")


def _kind(blocks: DataFrame, kind: str, name: str) -> DataFrame:
    return blocks.select("meeting_id", "item_id", rich_text(F.col("block"), kind).alias(name)).where(F.col(name).isNotNull())


def attachments(blocks: DataFrame, site: str = "") -> DataFrame:
    """P5: (meeting_id, item_id, att_pos, doc_id, name, url): the first link to each document; a first link without a name uses the document up."""
    p = r'(?is)<a\s[^<>]*?href="(filestream[.]ashx[?]DocumentId=(\d+))"[^<>]*>(.*?)</a>'
    links = F.arrays_zip(*[F.regexp_extract_all("block", F.lit(p), F.lit(i)).alias(n) for i, n in ((1, "u"), (2, "d"), (3, "n"))])
    rows = blocks.select("meeting_id", "item_id", F.posexplode(links).alias("att_pos", "l"))
    rows = rows.select("meeting_id", "item_id", "att_pos", F.col("l.d").alias("doc_id"), clean_html("l.n").alias("name"), F.concat(F.lit(f"{site}/" if site else ""), "l.u").alias("url"))
    nth = F.row_number().over(Window.partitionBy("meeting_id", "item_id", "doc_id").orderBy("att_pos"))
    return rows.withColumn("nth", nth).where("nth = 1 AND name <> ''").drop("nth")


def contested(result: Column) -> Column:
    up = F.upper(result)
    split = ~F.contains(up, F.lit("UNANIMOUSLY")) & result.rlike(r"[(]\d+\s+to\s+\d+[)]")
    return F.contains(up, F.lit("DEFEATED")) | split


def votes(blocks: DataFrame) -> DataFrame:
    """P6."""
    got = blocks.select("meeting_id", "item_id", rich_text(F.col("block"), "MotionResult").alias("result"), text(rich_text(F.col("block"), "VoterVote")).alias("detail"), text(rich_text(F.col("block"), "MotionText RichText")).alias("motion"))
    return got.where("result IS NOT NULL").withColumn("is_contested", contested(F.col("result")))


def meeting_info(html: Column) -> Column:
    """(title, date, start_time) of a page; blank where it doesn't say."""
    head = F.regexp_extract(html, r"""(?is)<h1\b[^<>]*\bid=["']AgendaHeaderTitle["'][^<>]*>(.*?)</h1>""", 1)
    bare = lambda c: clean_entities(F.regexp_replace(c, r"(?s)<[^>]+>", " "))
    lines = F.transform(F.split(head, r"(?i)<br\s*/?>"), bare)
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))
    kept = F.filter(lines, lambda x: (x != "") & ~((F.size(words(x)) > 0) & F.forall(words(x), lambda w: w.isin(KINDS))))
    # Lines up to the first that tells when.
    when = F.transform(kept, lambda x: x.rlike(rf"(?i)^\[|\b\d\d?:\d\d\s*[ap]\.?\s*m|^\s*(?:{MONTHS})\b"))
    stop = F.array_position(when, True)
    name = F.array_join(F.when(stop > 0, F.slice(kept, F.lit(1), (stop - 1).cast("int"))).otherwise(kept), " ")
    spare = F.trim(F.regexp_replace(bare(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), r"\s*-\s*[a-zA-Z]+\s+\d\d?,\s*\d{4}\s*$", ""))
    time = r"""(?i)<time\b[^<>]*datetime=["'](\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d))?"""
    return F.struct(
        titleize(F.when((head != "") & (name != ""), name).otherwise(spare)).alias("title"),
        F.regexp_extract(html, time, 1).alias("date"),
        F.regexp_extract(html, time, 2).alias("start_time"),
    )


def envelope_date(c: Column | str) -> Column:
    """``/Date(ms)/`` as a date in the session's time zone; other text as it is."""
    raw = text(c)
    ms = F.regexp_extract(raw, r"/Date\((\d+)\)/", 1).try_cast("bigint")
    return F.when(ms.isNotNull(), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")).otherwise(raw)


def start_time(c: Column | str) -> Column:
    """``… @ 9:30 AM`` as ``09:30``."""
    p = r"(?i)(\d\d?):(\d\d)\s*([ap])\.?\s*m"
    part = lambda i: F.regexp_extract(text(c), p, i)
    hour = part(1).try_cast("int") % 12 + F.when(F.lower(part(3)) == "p", 12).otherwise(0)
    return F.when(part(1) == "", "").otherwise(F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(2)))


def gist(c: Column | str) -> Column:
    """P10: five labelled lines to a struct; a later line of a label wins; null on SKIP or under three labels."""
    raw = text(c)
    p = r"^\s*(Who|What|Where|When|Why)\s*:(.*)$"
    lines = F.filter(F.split(raw, r"\r?\n"), lambda x: x.rlike(p))
    labels = F.transform(lines, lambda x: F.lower(F.regexp_extract(x, p, 1)))

    def of(name: str) -> Column:
        mine = F.filter(lines, lambda x: F.lower(F.regexp_extract(x, p, 1)) == name)
        return F.coalesce(F.nullif(F.trim(F.regexp_extract(F.try_element_at(mine, F.lit(-1)), p, 2)), F.lit("")), F.lit("—")).alias(name)

    got = F.struct(*[of(n) for n in ("what", "who", "when", "where", "why")])
    return F.when(~F.startswith(F.trim(raw), F.lit("SKIP")) & (F.size(F.array_distinct(labels)) >= 3), got)


def page_title(html: Column) -> Column:
    return clean_html(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))
