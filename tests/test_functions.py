"""Scalar functions against known values."""

import pytest
from pyspark.sql import functions as F

from folkmoot.functions import classify as C
from folkmoot.functions import match as M
from folkmoot.functions import text as T
from folkmoot.operators.intervals import clean_heard_org
from folkmoot.sources import parse as P

L = F.lit
CASES = [
    (lambda: T.clean_html(L("<p>A<b>b</b></p><div>c</div>  d")), "Ab c d"),
    (lambda: T.clean_html(L("<pre>x</pre>y")), "x y"),
    (lambda: T.titleize(L("MUNICIPAL HERITAGE ADVISORY COMMITTEE")), "Municipal Heritage Advisory Committee"),
    (lambda: T.titleize(L("THE CITY OF O'NEIL")), "The City of O'neil"),
    (lambda: T.titleize(L("Mixed Case")), "Mixed Case"),
    (lambda: T.clean_entities(L("a&#58; b&#160;c &amp;lt;")), "a: b c <"),
    (lambda: T.plainify(L("Bylaw No. 9876 - The Foo Bylaw, 2025 (No. 3)")), "Foo"),
    (lambda: T.plainify(L("Award of Contract - North Bridge (Contract No. 25-0456)")), "North Bridge"),
    (lambda: T.plainify(L("Bylaw")), "Bylaw"),
    (lambda: T.format_money(L("$1,500,000")), "$1.5M"),
    (lambda: T.format_money(L("$1,250,000")), "$1.2M"),
    (lambda: T.format_money(L("$2,450,000")), "$2.5M"),
    (lambda: T.format_money(L("$250,000")), "$250K"),
    (lambda: T.format_money(L("$99,999")), "$99,999"),
    (lambda: T.format_money(L("$3 million")), "$3 million"),
    (lambda: T.format_money(L("$2,000,000,000")), "$2B"),
    (lambda: T.trim_to_chip(L("short, text;")), "short, text"),
    (lambda: T.trim_to_chip(L("This sentence is long enough to keep. " + "x" * 90)), "This sentence is long enough to keep"),
    (lambda: T.trim_to_chip(L("y" * 120)), ""),
    (lambda: T.readable_date(L("2025-06-07")), "June 7, 2025"),
    (lambda: T.readable_date(L("2025")), "2025"),
    (lambda: T.readable_date(L("n/a")), "n/a"),
    (lambda: T.strip_filler_leads(L("Um, so, well the budget")), "the budget"),
    (lambda: T.sentence_around(L("One. Two three! Four."), L(6), L(9)), "Two three!"),
    (lambda: T.split_sentences(L("A b. C d! E")), ["A b.", "C d!", "E"]),
    (lambda: T.tokens(L("The City, and its 24 Buses!")), ["city", "buses"]),
    (lambda: T.clock(L(3723000).cast("long")), "1:02:03"),
    (lambda: T.clock(L(65000).cast("long")), "1:05"),
    (lambda: P.start_time(L("Wednesday, 24 June 2026 @ 12:05 AM")), "00:05"),
    (lambda: P.start_time(L("x @ 2:00 PM")), "14:00"),
    (lambda: T.week_deadline(L("2026-08-04").cast("date")).cast("string"), "2026-08-03"),
    (lambda: T.noon(L("bad")), "1970-01-01T12:00:00-06:00"),
    (lambda: T.escape(L("a<b & c>d")), "a&lt;b &amp; c&gt;d"),
    (lambda: T.field(L("abcdef"), 3), "abc… [truncated]"),
    (lambda: T.as_bullets(L('["a", " ", "b "]')), ["a", "b"]),
    (lambda: T.as_bullets(L("plain")), ["plain"]),
    (lambda: T.fallback_summary(L("word " * 40)), "word " * 22 + "word..."),
    (lambda: C.format_outcome(L(""), L("")), "Discussed"),
    (lambda: C.format_outcome(L(""), L("x")), "Recommended"),
    (lambda: C.format_outcome(L("CARRIED (8 to 3)"), L("That X be approved")), "Approved (8-3)"),
    (lambda: C.format_outcome(L("CARRIED UNANIMOUSLY"), L("That Y")), "Approved"),
    (lambda: C.format_outcome(L("DEFEATED (5 to 6)"), L("z")), "Defeated (5-6)"),
    (lambda: C.format_outcome(L("CARRIED"), L("That the item be deferred")), "Deferred"),
    (lambda: C.format_outcome(L("CARRIED UNANIMOUSLY"), L("recommend to City Council that")), "Recommended to Council"),
    (lambda: C.format_outcome(L("CARRIED (9 to 0)"), L("That City Council consider Bylaw No. 10169")), "First reading passed (9-0)"),
    (lambda: C.format_outcome(L("CARRIED"), L("That the report be received as information")), "Received as information"),
    (lambda: C.format_outcome(L("Lost"), L("x")), "Lost"),
    (lambda: C.categorize(L("Affordable housing rezoning near park"), L(""), L("traffic")), ["Housing", "Zoning & Dev"]),
    (lambda: C.is_major(L("Annual Budget"), L(""), L(False)), True),
    (lambda: C.money_too_small(L("$99")), True),
    (lambda: C.money_too_small(L("$1.2M")), True),
    (lambda: C.money_too_small(L("$1.2 M")), False),
    (lambda: C.money_too_small(L("$500K")), False),
    (lambda: C.is_procedural(L("5. CONFIRMATION OF MINUTES")), True),
    (lambda: C.is_boilerplate(L("That the report be received as information")), True),
    (lambda: C.discussion_topics(L("Talks related to roads, parks and and paths, and buses.")), ["Roads", "Parks and and paths", "Buses"]),
    (lambda: M.phonetic(L("ironstar")), "V652"),
    (lambda: M.phonetic(L("armstrong")), "V652"),
    (lambda: M.phonetic(L("wolfe")), "w41"),
    (lambda: M.phonetic(L("naytowhow")), "n3"),
    (lambda: M.organization_color(L("Riverton Police Service")), 6),
    (lambda: M.organization_color(L(" ")), None),
    (lambda: M.clean_organization(L("Executive Director, The Salvation Army")), "The Salvation Army"),
    (lambda: M.clean_organization(L("Smith, Jones and Co")), "Smith, Jones and Co"),
    (lambda: clean_heard_org(L("bus riders of riverton and you are well")), "Bus Riders of Riverton"),
    (lambda: M.file_key(L("RTS - A - B_Redacted(1).pdf")), "rts - a - b"),
    (lambda: M.file_words(L("RTS - Jane Doe - Bridge Funding_Redacted.pdf")), ["bridge", "funding"]),
    (lambda: M.keywords(L("Transit Fare Policy [CC2025-0402]")), ["transit", "fare"]),
    (lambda: M.title_echo(L("Approved: Bridge Funding Report"), L("Bridge Funding Report")), True),
    (lambda: M.name_candidates(L("We met Ann Lee. Then Bob said hi to Carl")), ["Ann", "Bob", "Carl", "Lee"]),
    (lambda: T.discussion_minutes(L(0), L(60000), L(None), L(None)), 1.0),
    (lambda: T.discussion_minutes(L(0), L(10800000), L(None), L(None)), 180.0),
    (lambda: T.discussion_minutes(L(0), L(10800001), L(None), L(None)), 0.0),
    (lambda: T.discussion_minutes(L(0), L(600000), L(True), L(None)), 0.0),
    (lambda: T.discussion_minutes(L(5), L(5), L(None), L(None)), 0.0),
    (lambda: P.envelope_date(L("/Date(1719446400000)/")), "2024-06-27"),
    (lambda: P.envelope_date(L("x")), "x"),
    (lambda: P.gist(L("What: a\nWho: b\nWhen:\nWhat: c"))["what"], "c"),
    (lambda: P.gist(L("SKIP\nWhat: a\nWho: b\nWhen: c")), None),
    (lambda: P.gist(L("What: a\nWho: b")), None),
]


def plain(v):
    return [plain(x) for x in v] if isinstance(v, list) else v


def test_known_values(spark):
    """All in one row, so that one plan serves them."""
    row = spark.range(1).select(*[f().alias(f"c{i}") for i, (f, _) in enumerate(CASES)]).first()
    wrong = [(i, row[f"c{i}"], want) for i, (_, want) in enumerate(CASES) if plain(row[f"c{i}"]) != want]
    assert not wrong


def test_nulls_are_blank(spark):
    null = L(None).cast("string")
    fs = [T.clean_html, T.titleize, T.clean_entities, T.plainify, T.format_money, T.trim_to_chip, T.readable_date, T.strip_filler_leads, M.clean_organization, M.file_key]
    assert set(spark.range(1).select(*[f(null).alias(f"c{i}") for i, f in enumerate(fs)]).first()) == {""}


@pytest.mark.parametrize(
    "name,heard,want",
    [
        ("em ironstar", "my name is emma armstrong", ("phonetic", 0.44)),
        ("jan wilgenhof", "welcome mr wilgunhof now", ("fuzzy", 0.4583333333333333)),
        ("ann lee", "this is ann lee here", ("exact", 0.4)),
        ("ann lee", "nobody", None),
    ],
)
def test_name_tiers(name, heard, want):
    assert M.match_tier(name, heard) == want


def test_accents_are_letters(spark):
    """Where Java's classes are ASCII, patterns ask for Unicode."""
    assert spark.range(1).select(T.plainify(L("Métis  Centre, 2025"))).first()[0] == "Métis Centre"


def test_cost_and_amendment_chips(spark):
    df = spark.createDataFrame([("Plan", "That $1,500,000 for the new bridge be approved, as amended. And $50 for pens.", "", "CARRIED (8 to 3)", "", "", False)], "title string, recommendation string, motion_text string, vote_result string, vote_detail string, content string, scheduled boolean")
    r = df.select(C.cost_chips().alias("cost"), C.amendment_text().alias("a"), C.vote_tally().alias("t"), C.deterministic_chips().alias("c")).first()
    assert r["cost"] == ["$1.5M for the new bridge"] and r["a"] == "CARRIED (8 to 3) That $1,500,000 for the new bridge be approved, as amended."
    assert tuple(r["t"]) == (8, 3) and [c["category"] for c in r["c"]] == ["Outcome", "Vote Breakdown", "Amendment Made", "Cost & Funding"]


def test_badges_and_takeaway(spark):
    schema = "title string, recommendation string, content string, description array<string>, chips array<struct<category:string,text:string>>"
    df = spark.createDataFrame([("Councillor A. Smith - 12 Main Street housing", "award $1,500,000 contract", "", None, [("Outcome", "x"), ("Public Sentiment", "p"), ("Debate Highlight", "d"), ("Public Sentiment", "q")])], schema)
    r = df.select(C.badges().alias("b"), C.takeaway().alias("t"), C.item_topics().alias("i"), C.chip_badges().alias("cb"), C.qualifies().alias("q")).first()
    assert [(b["type"], b["label"]) for b in r["b"]] == [("cat-housing", "Housing"), ("money", "$1.5M awarded"), ("person", "A. Smith"), ("location", "12 Main Street")]
    assert r["t"]["category"] == "Debate Highlight" and r["i"] == ["Public Sentiment", "Debate Highlight"] and [b["label"] for b in r["cb"]] == r["i"] and r["q"]
