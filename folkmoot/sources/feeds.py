"""What is published. Text is composed in columns; the driver only wraps a bounded number of entries."""

from __future__ import annotations

from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkmoot.functions.classify import format_outcome, future_publishable, is_procedural, item_topics, takeaway, truth
from folkmoot.functions.match import organization_label
from folkmoot.functions.text import clean_bullets, escape, iso_date, item_url, joined, noon, plainify, readable_date, text, titleize
from folkmoot.operators.rank import days_to_publish, qualifying_items

DAYS, ENTRIES = 30, 100


def item_title() -> Column:
    return F.coalesce(F.nullif(titleize(plainify("title")), F.lit("")), F.lit("Agenda item"))


def item_outcome() -> Column:
    out = format_outcome("vote_result", "recommendation")
    return F.when(out == "Discussed", "").otherwise(out)


def bullet_list() -> Column:
    b = clean_bullets(F.col("description"))
    lines = F.array_join(F.transform(b, lambda x: F.concat(F.lit("<li>"), escape(x), F.lit("</li>"))), "")
    return F.when(F.size(b) > 0, F.concat(F.lit("<ul>"), lines, F.lit("</ul>"))).otherwise("")


def speaker_line() -> Column:
    """Distinct names in order, with whom they came for."""
    named = F.filter(F.coalesce(F.col("speakers"), F.array()), lambda s: F.trim(F.coalesce(s["name"], F.lit(""))) != "")
    names = F.transform(named, lambda s: F.trim(s["name"]))
    once = F.filter(named, lambda s, i: F.array_position(names, F.trim(s["name"])) == i + 1)
    line = F.array_join(F.transform(once, lambda s: F.concat(F.trim(s["name"]), F.lit(" ("), organization_label(s["organization"]), F.lit(")"))), ", ")
    return F.when(F.size(once) > 0, F.concat(F.lit("Spoke: "), line)).otherwise("")


def item_html(context: bool) -> Column:
    """A5."""
    line = joined(item_outcome(), F.coalesce(F.nullif(F.trim(text("body")), F.lit("")), F.trim(text("meeting_title"))), readable_date("day"))
    head = F.when(line != "", F.concat(F.lit("<p><strong>"), escape(line), F.lit("</strong></p>"))).otherwise("") if context else F.lit("")
    t = takeaway()
    hook = F.when(t.isNotNull(), F.concat(F.lit("<p><em>"), escape(t["category"]), F.lit(":</em> "), escape(t["text"]), F.lit("</p>"))).otherwise("")
    spoke = F.when(speaker_line() != "", F.concat(F.lit("<p>"), escape(speaker_line()), F.lit("</p>"))).otherwise("")
    return F.concat(head, bullet_list(), hook, spoke)


def published_items(meetings: DataFrame, items: DataFrame, today: str) -> DataFrame:
    days = days_to_publish(meetings, items, today).select("day", F.explode("meetings").alias("meeting_id"))
    about = meetings.select("meeting_id", text("body").alias("body"), text("title").alias("meeting_title"), text("body_slug").alias("body_slug"))
    return qualifying_items(items).join(days, "meeting_id").join(about, "meeting_id")


def item_entries(meetings: DataFrame, items: DataFrame, today: str, site: str, most: int = ENTRIES) -> DataFrame:
    """An entry an item: newest day first, by body, longest discussed first."""
    rows = published_items(meetings, items, today)
    url = item_url(site, F.col("meeting_id"), F.col("item_id"))
    return rows.orderBy(F.desc("day"), "body", "meeting_id", "nth").limit(most).select(
        url.alias("id"), item_title().alias("title"), url.alias("link"), noon("day").alias("updated"), item_html(True).alias("content"), F.concat(F.array("body_slug"), item_topics()).alias("categories")
    )


def day_entries(meetings: DataFrame, items: DataFrame, today: str, site: str, most: int = DAYS) -> DataFrame:
    """An entry a day, with the items of its meetings beneath their body's name."""
    rows = published_items(meetings, items, today)
    link = F.concat(F.lit('<p><a href="'), escape(item_url(site, F.col("meeting_id"), F.col("item_id"))), F.lit('">'), escape(item_title()), F.lit("</a>"))
    out = F.when(item_outcome() != "", F.concat(F.lit(" — "), escape(item_outcome()))).otherwise("")
    one = F.concat(link, out, F.lit("</p>"), item_html(False))
    name = F.coalesce(F.nullif(F.trim("body"), F.lit("")), F.nullif(F.trim("meeting_title"), F.lit("")), F.lit("Meeting"))
    per = rows.select("day", "meeting_id", "body", "body_slug", name.alias("name"), "nth", one.alias("html"), item_topics().alias("topics"))
    glue = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["html"]), "")
    meeting = per.groupBy("day", "meeting_id", "body", "body_slug", "name").agg(glue(F.collect_list(F.struct("nth", "html"))).alias("html"), F.flatten(F.collect_list("topics")).alias("topics"))
    meeting = meeting.withColumn("html", F.concat(F.lit("<h3>"), escape("name"), F.lit("</h3>"), "html"))
    bodies = F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("body", "meeting_id"))), lambda x: F.trim(x["body"])), lambda b: b != ""))
    day = meeting.groupBy("day").agg(
        glue(F.collect_list(F.struct("body", "meeting_id", "html"))).alias("content"), bodies.alias("bodies"), F.collect_set("meeting_id").alias("ids"), F.array_sort(F.collect_set("body_slug")).alias("slugs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topics")
    )
    to = F.when(F.size("ids") == 1, F.concat(F.lit(f"{site}/meeting/"), F.col("ids")[0], F.lit(".html"))).otherwise(f"{site}/")
    return day.orderBy(F.desc("day")).limit(most).select(
        F.concat(F.lit(f"{site}/feed/day/"), "day").alias("id"), joined(readable_date("day"), F.array_join("bodies", ", ")).alias("title"), to.alias("link"), noon("day").alias("updated"), "content", F.concat("slugs", "topics").alias("categories")
    )


def future_entries(meetings: DataFrame, items: DataFrame, today: str, site: str) -> DataFrame:
    """An entry for each meeting to come, soonest first, without a limit."""
    rows = meetings.where(future_publishable(iso_date("date"), F.col("has_agenda"), iso_date("deadline"), F.lit(today).cast("date")))
    shown = items.where(~truth("is_recess") & ~is_procedural("title"))
    one = F.concat(F.lit("<p>"), escape(item_title()), F.lit("</p>"), bullet_list())
    per = shown.select("meeting_id", "pos", one.alias("html")).groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "html"))), lambda x: x["html"]), "").alias("html"))
    due = F.when(iso_date("deadline").isNotNull(), F.concat(F.lit("<p><strong>Request to speak by "), readable_date("deadline"), F.lit(", 5:00 p.m.</strong></p>"))).otherwise("")
    body = F.coalesce(F.nullif(F.trim(text("body")), F.lit("")), F.trim(text("title")))
    return rows.join(per, "meeting_id", "left").orderBy("date", "body").select(
        F.concat(F.lit(f"{site}/feed/future/"), "meeting_id").alias("id"), joined(body, readable_date("date")).alias("title"), F.concat(F.lit(f"{site}/meeting/"), "meeting_id", F.lit(".html")).alias("link"), noon("date").alias("updated"),
        F.concat(due, F.coalesce("html", F.lit("<p>The agenda has not been posted yet.</p>"))).alias("content"), F.array(text("body_slug")).alias("categories"),
    )


def atom(entries: DataFrame, title: str, path: str, site: str, subtitle: str = "") -> str:
    """An Atom document of entries, which their own limits keep few."""
    rows = entries.collect()
    feed = ET.Element("feed", xmlns="http://www.w3.org/2005/Atom")

    def leaf(parent, tag, body=None, **attrs):
        node = ET.SubElement(parent, tag, attrs)
        node.text = body

    for tag, body in (("title", title), ("subtitle", subtitle), ("id", f"{site}/{path}"), ("updated", rows[0]["updated"] if rows else "1970-01-01T12:00:00-06:00")):
        leaf(feed, tag, body)
    leaf(feed, "link", rel="alternate", type="text/html", href=f"{site}/")
    leaf(feed, "link", rel="self", type="application/atom+xml", href=f"{site}/{path}")
    leaf(ET.SubElement(feed, "author"), "name", title)
    for r in rows:
        e = ET.SubElement(feed, "entry")
        for tag, body in (("title", r["title"]), ("id", r["id"]), ("updated", r["updated"]), ("published", r["updated"])):
            leaf(e, tag, body)
        leaf(e, "link", rel="alternate", type="text/html", href=r["link"])
        for c in r["categories"]:
            if c:
                leaf(e, "category", term=c)
        leaf(e, "content", r["content"], type="html")
    ET.indent(feed, space="  ")
    return f'<?xml version="1.0" encoding="utf-8"?>\n{ET.tostring(feed, encoding="unicode")}\n'


def meeting_json(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """(meeting_id, json) of a meeting with its items in order, for a page or an interface to embed."""
    rest = [c for c in items.columns if c != "meeting_id"]
    per = items.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"])), lambda a, b: a["pos"] - b["pos"]).alias("agenda_items"))
    whole = meetings.join(per, "meeting_id", "left")
    return whole.select("meeting_id", F.to_json(F.struct(*whole.columns)).alias("json"))


def meeting_pages(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """(meeting_id, html): a page of a meeting that lists its items and holds its data for scripts; nothing in the data can end the script."""
    listed = items.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("section_number", F.lit("")).alias("n"), F.coalesce("title", F.lit("")).alias("t")))).alias("rows"))
    rows = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("<li>"), escape(F.trim(F.concat_ws(" ", r["n"], r["t"]))), F.lit("</li>"))), "")
    data = F.replace(F.col("json"), F.lit("</"), F.lit("<\\/"))
    head = F.concat(escape(F.coalesce("title", F.lit(""))), F.lit(" - "), escape(F.coalesce("date", F.lit(""))))
    whole = meeting_json(meetings, items).join(meetings.select("meeting_id", "title", "date"), "meeting_id").join(listed, "meeting_id", "left")
    page = F.concat(F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'), head, F.lit("</title></head><body><h1>"), head, F.lit("</h1><ol>"), F.coalesce(rows, F.lit("")), F.lit('</ol><script type="application/json" id="meeting">'), data, F.lit("</script></body></html>"))
    return whole.select("meeting_id", page.alias("html"))


def write_pages(pages: DataFrame, path: str) -> None:
    """A folder of text a meeting, written by the executors."""
    pages.write.mode("overwrite").partitionBy("meeting_id").text(path)
