"""Queries that run the meeting operators on small built-in tables, each with the rows that the rules ask for as SQL values.

The meeting tables aren't among the test tables, and some rules (name matching,
colours, page parsing) have no equal in SQL; so inputs and results are written
out here, the results worked out by hand from the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folkmoot import schemas
from folkmoot.functions import classify, match
from folkmoot.functions import text as tx
from folkmoot.operators import diff, intervals, rank, speakers
from folkmoot.plans import meetings as plan
from folkmoot.sources import feeds, parse, readers

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool | int | float):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'"


def expected(columns: str, *rows: tuple):
    """Register a query with its rows; ``columns`` are names with SQL types."""
    names = [c.split() for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    sql = f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names)} FROM (VALUES {values}) v({', '.join(n for n, _ in names)})"

    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        _sql[f.__name__] = sql
        return f

    return put


def items_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Items from dicts; what a row doesn't say is null."""
    schema = spark.createDataFrame([], schemas.ITEMS).schema
    return spark.createDataFrame([tuple({"meeting_id": "m", "pos": n, "item_id": n, **r}.get(c) for c in schema.names) for n, r in enumerate(rows)], schema)


def segments_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([("m", n, *r) for n, r in enumerate(rows)], schemas.SEGMENTS)


def speakers_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(pos, name, organization, stance, source, said), numbered as they stand."""
    return spark.createDataFrame([("m", r[0], n, *r[1:]) for n, r in enumerate(rows)], "meeting_id string, pos int, spk_pos int, name string, organization string, stance string, source string, said array<string>")


def who(*names: str) -> list[tuple]:
    return [(n, None, None, None, None, None, None, None) for n in names]


# Scalars with known values: (operator, input, a second input, output).

TEXT_CASES = [
    ("T1", "<p>A<b>b</b></p><div>c</div>  d", None, "Ab c d"),
    ("T2", "MUNICIPAL HERITAGE ADVISORY COMMITTEE", None, "Municipal Heritage Advisory Committee"),
    ("T2", "THE CITY OF O'NEIL", None, "The City of O'neil"),
    ("T2", "Mixed Case", None, "Mixed Case"),
    ("T3", "a&#58; b&#160;c &amp;lt;", None, "a: b c <"),
    ("T4", "Bylaw No. 9876 - The Foo Bylaw, 2025 (No. 3)", None, "Foo"),
    ("T4", "Award of Contract - North Bridge (Contract No. 25-0456)", None, "North Bridge"),
    ("T5", "$1,500,000", None, "$1.5M"),
    ("T5", "$1,250,000", None, "$1.2M"),
    ("T5", "$2,450,000", None, "$2.5M"),
    ("T5", "$250,000", None, "$250K"),
    ("T5", "$99,999", None, "$99,999"),
    ("T5", "$3 million", None, "$3 million"),
    ("T5", "$2,000,000,000", None, "$2B"),
    ("T6", "short, text;", None, "short, text"),
    ("T6", "This sentence is long enough to keep. " + "x" * 90, None, "This sentence is long enough to keep"),
    ("T6", "y" * 120, None, ""),
    ("T7", "2025-06-07", None, "June 7, 2025"),
    ("T7", "n/a", None, "n/a"),
    ("T8", "Um, so, well the budget", None, "the budget"),
    ("T9", "One. Two three! Four.", None, "Two three!"),
    ("T10", "A b. C d! E", None, "A b.|C d!|E"),
    ("T11", "The City, and its 24 Buses!", None, "city|buses"),
    ("T13", "2026-08-04", None, "2026-08-03"),
    ("P8", "/Date(1719446400000)/", None, "2024-06-27"),
    ("P8", "x", None, "x"),
    ("P9", "Wednesday, 24 June 2026 @ 12:05 AM", None, "00:05"),
    ("P9", "x @ 2:00 PM", None, "14:00"),
    ("P10", "What: a\nWho: b\nWhen:\nWhat: c", None, "c"),
    ("P10", "SKIP\nWhat: a\nWho: b\nWhen: c", None, None),
    ("P10", "What: a\nWho: b", None, None),
]
OUTCOME_CASES = [
    ("C1", "", "", "Discussed"),
    ("C1", "", "x", "Recommended"),
    ("C1", "CARRIED (8 to 3)", "That X be approved", "Approved (8-3)"),
    ("C1", "CARRIED UNANIMOUSLY", "That Y", "Approved"),
    ("C1", "DEFEATED (5 to 6)", "z", "Defeated (5-6)"),
    ("C1", "CARRIED", "That the item be deferred", "Deferred"),
    ("C1", "CARRIED UNANIMOUSLY", "recommend to City Council that", "Recommended to Council"),
    ("C1", "CARRIED (9 to 0)", "That City Council consider Bylaw No. 10169", "First reading passed (9-0)"),
    ("C1", "CARRIED", "That the report be received as information", "Received as information"),
    ("C1", "Lost", "x", "Lost"),
    ("C2", "Affordable housing rezoning near park", "traffic", "Housing|Zoning & Dev"),
    ("C4", "Talks related to roads, parks and and paths, and buses.", None, "Roads|Parks and and paths|Buses"),
    ("F1", "5. CONFIRMATION OF MINUTES", None, "true"),
    ("F3", "That the report be received as information", None, "true"),
    ("F11", "Annual Budget", "", "true"),
    ("F12", "$99", None, "true"),
    ("F12", "$1.2M", None, "true"),
    ("F12", "$1.2 M", None, "false"),
    ("F12", "$500K", None, "false"),
    ("M6", "Approved: Bridge Funding Report", "Bridge Funding Report", "true"),
]
NAME_CASES = [
    ("M2", "ironstar", None, "V652"),
    ("M2", "armstrong", None, "V652"),
    ("M2", "wolfe", None, "w41"),
    ("M2", "naytowhow", None, "n3"),
    ("M3", "em ironstar", "my name is emma armstrong", "phonetic 0.440000"),
    ("M3", "jan wilgenhof", "welcome mr wilgunhof now", "fuzzy 0.458333"),
    ("M3", "ann lee", "this is ann lee here", "exact 0.400000"),
    ("M3", "ann lee", "nobody", None),
    ("M4", "Riverton Police Service", None, "6"),
    ("M4", " ", None, None),
    ("M5", "Executive Director, The Salvation Army", None, "The Salvation Army"),
    ("M5", "Smith, Jones and Co", None, "Smith, Jones and Co"),
    ("M7", "We met Ann Lee. Then Bob said hi to Carl", None, "Ann|Bob|Carl|Lee"),
    ("J4", "RTS - A - B_Redacted(1).pdf", None, "rts - a - b"),
    ("J4w", "RTS - Jane Doe - Bridge Funding_Redacted.pdf", None, "bridge|funding"),
    ("J9", "Transit Fare Policy [CC2025-0402]", None, "transit|fare"),
    ("J13", "bus riders of riverton and you are well", None, "Bus Riders of Riverton"),
]


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def run_cases(spark: SparkSession, cases: list[tuple], by: dict[str, Column]) -> DataFrame:
    rows = spark.createDataFrame([c[:3] for c in cases], "op string, a string, b string")
    out = None
    for op, result in by.items():
        part = rows.where(F.col("op") == op).select("op", "a", "b", result.cast("string").alias("result"))
        out = part if out is None else out.unionByName(part)
    return out


@expected("op VARCHAR, a VARCHAR, b VARCHAR, result VARCHAR", *TEXT_CASES)
def known_texts(spark, d):
    """T1-T11, T13, P8-P10."""
    a = F.col("a")
    return run_cases(spark, TEXT_CASES, {
        "T1": tx.clean_html(a), "T2": tx.titleize(a), "T3": tx.clean_entities(a), "T4": tx.plainify(a), "T5": tx.format_money(a), "T6": tx.trim_to_chip(a), "T7": tx.readable_date(a),
        "T8": tx.strip_filler_leads(a), "T9": tx.sentence_around(a, F.lit(6), F.lit(9)), "T10": joined(tx.split_sentences(a)), "T11": joined(tx.tokens(a)), "T13": tx.week_deadline(a.try_cast("date")),
        "P8": parse.envelope_date(a), "P9": parse.start_time(a), "P10": parse.gist(a)["what"],
    })


@expected("op VARCHAR, a VARCHAR, b VARCHAR, result VARCHAR", *OUTCOME_CASES)
def known_outcomes(spark, d):
    """C1, C2, C4, F1, F3, F11, F12, M6."""
    a, b = F.col("a"), F.col("b")
    return run_cases(spark, OUTCOME_CASES, {
        "C1": classify.format_outcome(a, b), "C2": joined(classify.categorize(a, F.lit(""), b)), "C4": joined(classify.discussion_topics(a)), "F1": classify.is_procedural(a), "F3": classify.is_boilerplate(a),
        "F11": classify.is_major(a, b, F.lit(False)), "F12": classify.money_too_small(a), "M6": match.title_echo(a, b),
    })


@expected("op VARCHAR, a VARCHAR, b VARCHAR, result VARCHAR", *NAME_CASES)
def known_names(spark, d):
    """M1-M5, M7 and the names in J4, J9, J13."""
    a, b = F.col("a"), F.col("b")
    tier = match.name_tier(a, b)
    return run_cases(spark, NAME_CASES, {
        "M2": match.phonetic(a), "M3": F.when(tier["tier"].isNotNull(), F.concat_ws(" ", tier["tier"], F.format_string("%.6f", tier["at"]))), "M4": match.organization_color(a), "M5": match.clean_organization(a),
        "M7": joined(match.name_candidates(a)), "J4": match.file_key(a), "J4w": joined(match.file_words(a)), "J9": joined(match.keywords(a)), "J13": intervals.clean_heard_org(a),
    })


# Pages.

AGENDA = """<html><title>COUNCIL - June 27, 2024</title><h1 id='AgendaHeaderTitle'>PUBLIC AGENDA<br/>STANDING POLICY COMMITTEE<br/>ON TRANSPORTATION<br/>Thursday 9:30 a.m.</h1>
<time datetime='2024-06-27 09:30'></time><script>Bookmarks : [{AgendaItemId: 101, TimeStart: 300000, TimeEnd: 900000,}, {AgendaItemId: 102, TimeStart: 1200000, TimeEnd: 1800000}]</script>
<DIV class='AgendaItemCounter'>1.</DIV><DIV class='AgendaItemTitle'><a onclick='SelectItem(101)'>Call to Order</a></DIV><DIV class='AgendaItemDescription RichText'><p>The chair will call.</p></DIV>
<DIV class='AgendaItemCounter'>2.</DIV><DIV class='AgendaItemTitle'><a onclick='SelectItem(102)'>Bridge &amp; Road</a></DIV><DIV class='MotionText RichText'><p>That it be read.</p></DIV>
<a class='x' href="filestream.ashx?DocumentId=7">Report.pdf</a><a class='x' href="filestream.ashx?DocumentId=7">Again.pdf</a></html>"""
MINUTES = """<a onclick='SelectItem(102)'>x</a><DIV class='MotionText RichText'>That the bridge be built.</DIV><DIV class='MotionResult'>CARRIED (8 to 3)</DIV>
<DIV class='VoterVote'>In Favour: (8) Against: (3)</DIV><DIV class='AgendaItemMinutes RichText'>Jane Doe, Bus Riders, spoke in support of the item.</DIV>"""


def page(spark: SparkSession, html: str) -> DataFrame:
    return spark.createDataFrame([("m1", html)], "meeting_id string, html string")


@expected("pos INT, item_id BIGINT, section_number VARCHAR, title VARCHAR", (0, 101, "1.", "Call to Order"), (1, 102, "2.", "Bridge &amp; Road"))
def page_items(spark, d):
    """A title keeps its entities until it is shown."""
    return parse.agenda_rows(page(spark, AGENDA)).selectExpr("cast(pos AS int) AS pos", "cast(item_id AS bigint) AS item_id", "section_number", "title")


@expected("item_id BIGINT, start_ms BIGINT, end_ms BIGINT", (101, 300000, 900000), (102, 1200000, 1800000))
def page_bookmarks(spark, d):
    """Marks in JSON with a stray comma."""
    return parse.bookmarks(page(spark, AGENDA)).selectExpr("cast(item_id AS bigint) AS item_id", "start_ms", "end_ms")


@expected("item_id BIGINT, kind VARCHAR, body VARCHAR", (101, "description", "The chair will call."), (102, "recommendation", "That it be read."), (102, "minutes", "Jane Doe, Bus Riders, spoke in support of the item."))
def page_blocks(spark, d):
    """What stands under each item."""
    a, m = parse.item_blocks(page(spark, AGENDA)), parse.item_blocks(page(spark, MINUTES))
    parts = [(parse.descriptions(a), "description"), (parse.recommendations(a), "recommendation"), (parse.minutes(m), "minutes")]
    rows = [p.select(F.col("item_id").cast("bigint").alias("item_id"), F.lit(kind).alias("kind"), F.col(p.columns[-1]).alias("body")) for p, kind in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@expected("item_id BIGINT, doc_id VARCHAR, name VARCHAR, url VARCHAR", (102, "7", "Report.pdf", "https://example.org/filestream.ashx?DocumentId=7"))
def page_files(spark, d):
    """P5: the first link to a document."""
    return parse.attachments(parse.item_blocks(page(spark, AGENDA)), "https://example.org").selectExpr("cast(item_id AS bigint) AS item_id", "doc_id", "name", "url")


@expected("item_id BIGINT, result VARCHAR, detail VARCHAR, motion VARCHAR, is_contested BOOLEAN", (102, "CARRIED (8 to 3)", "In Favour: (8) Against: (3)", "That the bridge be built.", True))
def page_votes(spark, d):
    """P6."""
    return parse.votes(parse.item_blocks(page(spark, MINUTES))).selectExpr("cast(item_id AS bigint) AS item_id", "result", "detail", "motion", "is_contested")


@expected("title VARCHAR, day VARCHAR, start_time VARCHAR", ("Standing Policy Committee on Transportation", "2024-06-27", "09:30"))
def page_head(spark, d):
    """P7."""
    i = parse.meeting_info(F.col("html"))
    return page(spark, AGENDA).select(i["title"].alias("title"), i["date"].cast("string").alias("day"), i["start_time"].alias("start_time"))


@expected(
    "pos INT, item_id BIGINT, section_number VARCHAR, start_ms BIGINT, end_ms BIGINT, is_recess BOOLEAN, content VARCHAR, recommendation VARCHAR, vote_result VARCHAR, files VARCHAR, speakers VARCHAR",
    (0, 101, "1.", 300000, 900000, False, "The chair will call.", "", "", "", ""),
    (1, -1, "", 900000, 1200000, True, "", "", "", "", ""),
    (2, 102, "2.", 1200000, 1800000, False, "Jane Doe, Bus Riders, spoke in support of the item.", "That the bridge be built.", "CARRIED (8 to 3)", "Report.pdf", "Jane Doe/Bus Riders/support"),
)
def page_detail(spark, d):
    """An agenda and its minutes to items, with the recess between them."""
    rows = plan.load_detail(page(spark, AGENDA), page(spark, MINUTES), "https://example.org")
    said = F.transform(F.coalesce("speakers", F.array().cast(dict(rows.dtypes)["speakers"])), lambda s: F.concat_ws("/", s["name"], s["organization"], s["stance"]))
    return rows.select(
        F.col("pos").cast("int").alias("pos"), F.col("item_id").cast("bigint").alias("item_id"), "section_number", F.col("time_start_ms").alias("start_ms"), F.col("time_end_ms").alias("end_ms"), "is_recess", F.coalesce("content", F.lit("")).alias("content"),
        "recommendation", "vote_result", joined(F.transform("attachments", lambda a: a["name"])).alias("files"), joined(said).alias("speakers"),
    )


# Joins of items with what was said and filed.


@expected("item_id BIGINT, doc_id VARCHAR", (0, "1"), (0, "2"), (1, "1"), (2, "3"))
def files_by_title(spark, d):
    """A filed letter is copied to the item whose title it matches best, the other stays where it was filed."""
    rows = items_of(spark, [{"title": "Confirmation of Agenda"}, {"title": "Bridge funding plan"}, {"title": "Bridge paint"}, {"title": "Roll Call bridge funding"}])
    files = [("m", 0, 0, "1", "RTS - Jane Doe - Bridge Funding_Redacted.pdf", "u"), ("m", 0, 1, "2", "RTS - Al - Sidewalks.pdf", "v"), ("m", 2, 0, "3", "x.pdf", "w")]
    filed = spark.createDataFrame(files, "meeting_id string, item_id bigint, att_pos int, doc_id string, name string, url string")
    return intervals.distribute_attachments(rows, filed).select("item_id", "doc_id")


@expected("name VARCHAR, organization VARCHAR, stance VARCHAR, said VARCHAR, label VARCHAR", ("Ann", "Riders", "concern", "y", "Riders"), ("Bo", "Acme", "", "z", "Acme"), ("Cy", "", "", None, "Resident"))
def remarks_merged(spark, d):
    """The last of a cached name counts; the roster's organization comes first, the cached stance too."""
    roster = speakers_of(spark, [(0, "Ann", "", "support", "minutes", None), (0, "Bo", "CEO, Acme", "", "minutes", None), (0, "Cy", None, None, "registered", None)])
    cached = speakers_of(spark, [(0, "Ann", "Old", "", None, ["x"]), (0, "Ann", "Riders", "concern", None, ["y"]), (0, "Bo", "Other", "", None, ["z"])])
    return intervals.merge_remarks(roster, cached).select("name", "organization", "stance", F.when(F.col("said").isNotNull(), joined(F.col("said"))).alias("said"), F.col("org_label").alias("label"))


_SPOKEN = [(0, 5000, "good day"), (20_000, 25_000, "item 9.2.1 now"), (31_000, 35_000, "transit"), (50_000, 52_000, "fare talk"), (62_000, 63_000, "nine two one")]


@expected("pos INT, found_ms BIGINT, start_ms BIGINT", (0, 62000, 62000), (1, 31000, 31000))
def items_found_in_talk(spark, d):
    """A number said in words, two words of a title in one window; items start there."""
    rows = items_of(spark, [{"section_number": "9.2.1", "title": "Zzz", "time_start_ms": 60_000, "time_end_ms": 90_000}, {"section_number": "4", "title": "Transit Fare Policy [CC2025-0402]", "time_start_ms": 0, "time_end_ms": 90_000}])
    talk = segments_of(spark, _SPOKEN)
    moved = intervals.correct_timestamps(rows, talk).select("pos", F.col("time_start_ms").alias("start_ms"))
    return intervals.nearest_match(rows, talk).select("pos", "found_ms").join(moved, "pos").select("pos", "found_ms", "start_ms")


_HEARD = [(0, 10_000, "our next speaker"), (10_000, 20_000, "welcome jane wilgenhof from the bus riders of town and thanks"), (30_000, 40_000, "we move to questions of administration"), (200_000, 210_000, "speaker emma absent")]


@expected("name VARCHAR, heard BOOLEAN, organization VARCHAR, at_ms BIGINT, spk_order INT, questions_ms BIGINT", ("Jane Wilgenhof", True, "The Bus Riders of Town", 11311, 0, 30000), ("Emma Absent", False, "", 204210, 1, 30000))
def speakers_heard(spark, d):
    """Who registered is heard where the item's words name them, and stamped as far into the segment as the name stands in its words: 8 of 61 letters of ten seconds, and 8 of 19."""
    rows = items_of(spark, [{"time_start_ms": 0, "time_end_ms": 100_000, "speakers": who("Jane Wilgenhof", "Emma Absent")}])
    roster = speakers_of(spark, [(0, "Jane Wilgenhof", "", "", "registered", None), (0, "Emma Absent", "", "", "registered", None)])
    talk = segments_of(spark, _HEARD)
    stamped = intervals.mark_timestamps(intervals.mark_heard(roster, rows, talk), rows, talk)
    asked = intervals.mark_questions(rows, talk).select("pos", F.col("questions_start_ms").alias("questions_ms"))
    return stamped.join(asked, "pos").select("name", "heard", "organization", F.col("time_start_ms").cast("bigint").alias("at_ms"), F.col("spk_order").cast("int").alias("spk_order"), "questions_ms")


@expected("pos INT, primary_section VARCHAR, partners VARCHAR, win_start BIGINT, win_end BIGINT", (0, "1.1", "1.2|1.3", 0, 180), (1, "1.1", "1.1|1.3", 0, 180), (2, "1.1", "1.1|1.2", 0, 180))
def chain_heard_together(spark, d):
    """Three items in a chain share speakers and time; their parent and an item that only brushes them stay out."""
    rows = items_of(spark, [
        {"section_number": "1.1", "time_start_ms": 0, "time_end_ms": 100, "speakers": who("A b")}, {"section_number": "1.2", "time_start_ms": 40, "time_end_ms": 140, "speakers": who("a  B", "C")},
        {"section_number": "1.3", "time_start_ms": 80, "time_end_ms": 180, "speakers": who("c")}, {"section_number": "1", "time_start_ms": 0, "time_end_ms": 180, "speakers": who("c")}, {"section_number": "2", "time_start_ms": 175, "time_end_ms": 300, "speakers": who("c")},
    ])
    marked = intervals.mark_jointly_heard(rows)
    together = marked.where("heard_with IS NOT NULL").select("meeting_id", "pos", F.col("heard_with.primary_section").alias("primary_section"), joined(F.col("heard_with.partners")).alias("partners"))
    return together.join(intervals.group_window(marked), ["meeting_id", "pos"]).select("pos", "primary_section", "partners", "win_start", "win_end")


@expected("pos INT, name VARCHAR, organization VARCHAR, stance VARCHAR, source VARCHAR", (0, "Jane Doe", "Bus Riders", "support", "minutes"), (0, "John Roe", "Resident", "concern", "minutes"), (0, "Al B", "", "", "registered"))
def speakers_named(spark, d):
    """The public in the minutes' prose and in filings; staff, the city and procedure are left out."""
    said = "Jane Doe, Bus Riders, spoke in support. Director Smith presented the report. He addressed council. John Roe, Resident, expressed concerns. Jane Doe addressed council again. Amy Li, City of Foo, presented."
    rows = items_of(spark, [{"title": "Bridge", "content": said, "attachments": [("RTS - Jane Doe - Bridge.pdf", "u"), ("Request to Speak - Al B - Roads_Redacted.pdf", "v"), ("Other.pdf", "w")]}, {"title": "Adjournment", "content": said}])
    return speakers.extract_speakers(rows).select("pos", "name", "organization", "stance", "source")


@expected("name VARCHAR, gist VARCHAR", ("a.pdf", "about a"), ("b.pdf", None), ("c.pdf", None))
def gists_attached(spark, d):
    """J15."""
    files = spark.createDataFrame([("a.pdf", "filestream.ashx?DocumentId=12"), ("b.pdf", "filestream.ashx?DocumentId=13"), ("c.pdf", "other")], "name string, url string")
    return intervals.attach_gists(files, spark.createDataFrame([("12", "about a"), ("1", "no")], "doc_id string, gist string")).select("name", "gist")


@expected("doc_id VARCHAR", ("13",))
def gists_missing(spark, d):
    """Each document once, those with a gist left out."""
    files = spark.createDataFrame([("filestream.ashx?DocumentId=12",), ("filestream.ashx?DocumentId=13",), ("x/filestream.ashx?DocumentId=13",), ("other",)], "url string")
    return diff.missing_gists(files, spark.createDataFrame([("12", "g")], "doc_id string, gist string")).select("doc_id")


# Chips, badges, ranks.


def _plan_item(spark: SparkSession) -> DataFrame:
    return items_of(spark, [{"title": "Plan", "recommendation": "That $1,500,000 for the new bridge be approved, as amended. And $50 for pens.", "motion_text": "", "vote_result": "CARRIED (8 to 3)", "vote_detail": "", "content": "", "scheduled": False}])


@expected(
    "n INT, category VARCHAR, text VARCHAR",
    (0, "Outcome", "Approved (8-3)"),
    (1, "Vote Breakdown", "8 for, 3 against"),
    (2, "Amendment Made", "CARRIED (8 to 3) That $1,500,000 for the new bridge be approved, as amended"),
    (3, "Cost & Funding", "$1.5M for the new bridge"),
)
def chips_by_rule(spark, d):
    """C6-C9, C11."""
    return _plan_item(spark).select(F.posexplode(classify.deterministic_chips()).alias("n", "c")).select("n", "c.category", F.rtrim(F.regexp_replace("c.text", r"\.$", "")).alias("text"))


@expected("n INT, category VARCHAR, text VARCHAR", (0, "Public Sentiment", "Residents want it"), (1, "Debate Highlight", "It was long"))
def chips_made_sane(spark, d):
    """Unknown, useless and repeated chips go."""
    rows = spark.createDataFrame([([("Public Sentiment", "Residents want it", "high"), ("Public Sentiment", "Another", "high"), ("Unknown", "x", "high"), ("Debate Highlight", "It was long", "medium"), ("Promise Made", "Too little", "low"), ("Dissenting View", "It was long", "high")],)], "parsed array<struct<category:string,text:string,usefulness:string>>")
    allowed = F.array(*map(F.lit, ("Public Sentiment", "Debate Highlight", "Promise Made", "Dissenting View")))
    return rows.select(F.posexplode(classify.sane_chips(F.col("parsed"), allowed)).alias("n", "c")).select("n", "c.category", "c.text")


@expected(
    "n INT, type VARCHAR, label VARCHAR",
    (0, "cat-housing", "Housing"),
    (1, "money", "$1.5M awarded"),
    (2, "person", "A. Smith"),
    (3, "location", "12 Main Street"),
    (4, "chip", "Public Sentiment"),
    (5, "chip", "Debate Highlight"),
)
def badges_on_cards(spark, d):
    """Badges found in the text, then the item's interpretive chips."""
    rows = items_of(spark, [{"title": "Councillor A. Smith - 12 Main Street housing", "recommendation": "award $1,500,000 contract", "content": "", "chips": [("Outcome", "x"), ("Public Sentiment", "p"), ("Debate Highlight", "d"), ("Public Sentiment", "q")]}])
    return rows.select(F.posexplode(classify.card_badges()).alias("n", "b")).select("n", "b.type", "b.label")


_TOPICS = [{"title": "Call to Order", "recommendation": "x"}, {"title": "Same A", "recommendation": "r", "section_number": "1.1"}, {"title": "Same B", "recommendation": "r", "section_number": "1.2"}, {"title": "Fight $5", "recommendation": "r", "is_contested": True, "section_number": "1.3"}, {"title": "Head"}]


@expected("topic VARCHAR, rank INT", ("Same A", 1), ("Fight $5", 0))
def topics_ranked(spark, d):
    """A contested item first, then the earlier of two that tie; procedure and headings are no topics."""
    return rank.meeting_topics(items_of(spark, _TOPICS), 2).select("topic", F.col("rank").cast("int").alias("rank"))


@expected("topic VARCHAR, speakers INT", ("Same A", None), ("Fight $5", None), ("P0", 4), ("P1", 4), ("P2", 4))
def topics_with_speakers(spark, d):
    """At most three speakers beneath a topic, with how many there were."""
    people = speakers_of(spark, [(3, f"P{n}", "", "concern", "minutes", ["s"]) for n in range(4)]).withColumn("time_start_ms", F.lit(None).cast("bigint"))
    rows = rank.speaker_rows(rank.meeting_topics(items_of(spark, _TOPICS), 2), people)
    return rows.select("topic", F.when(F.col("kind") == "speaker", F.col("item_speaker_count")).cast("int").alias("speakers"))


_WEIGHED = [{"title": "Urgent Business"}, {"title": "Reports", "section_number": "8"}, {"title": "Plan", "section_number": "8.1", "recommendation": "That it be built"}, {"title": "Empty", "section_number": "9"}, {"title": "In block", "section_number": "8.2", "recommendation": "That it be paid", "timestamp_inherited": True}]


@expected("pos INT, is_routine BOOLEAN, is_heading BOOLEAN", (0, True, False), (1, False, True), (2, False, False), (3, True, False), (4, False, False))
def rows_weighed(spark, d):
    """C15."""
    return rank.mark_row_weights(items_of(spark, _WEIGHED)).select("pos", "is_routine", "is_heading")


@expected("a BIGINT, b BIGINT, c BIGINT", (2, 1, 1))
def agenda_counted(spark, d):
    """A1: items, consent items and discussed items."""
    counts = rank.meeting_counts(rank.mark_row_weights(items_of(spark, _WEIGHED)))
    return counts.select(*[F.col(c).cast("bigint").alias(n) for n, c in zip("abc", counts.columns[1:])])


@expected("residents BIGINT, speakers BIGINT, organizations VARCHAR", (1, 3, "Acme"))
def roster_of_speakers(spark, d):
    """A2: who only registered and wasn't heard is left out, unless remarks are known."""
    people = speakers_of(spark, [(2, "Ann", "Acme", "", "minutes", None), (2, "Bo", "", "", "minutes", None), (2, "Cy", "", "", "registered", None), (2, "Di", "CEO, Acme", "", "registered", ["x"])]).withColumn("heard", F.lit(False))
    r = rank.speaker_roster(people, items_of(spark, _WEIGHED))
    return r.select(F.col("resident_count").cast("bigint").alias("residents"), F.col("speaker_count").cast("bigint").alias("speakers"), joined(F.transform("organizations", lambda o: o["label"])).alias("organizations"))


@expected("status VARCHAR, n BIGINT", ("done", 1), ("todo", 1), ("ineligible", 1))
def summary_statuses(spark, d):
    """What has a summary, what wants one and what gets none."""
    rows = items_of(spark, [{"title": "Bridge", "recommendation": "That it be built", "time_start_ms": 0, "time_end_ms": 600_000}, {"title": "Road", "recommendation": "That it be paved", "time_start_ms": 0, "time_end_ms": 600_000}, {"title": "Adjournment"}])
    done = spark.createDataFrame([("m", 0)], "meeting_id string, item_id bigint")
    return diff.summary_work(rows, done).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@expected("k VARCHAR, v VARCHAR", ("a", "new"), ("b", "old"), ("c", "last"))
def tables_united(spark, d):
    """A later table's row of a key takes the place of an earlier one's, within a table the later row."""
    rows = lambda *r: spark.createDataFrame(r, "k string, v string, t int")
    return diff.union_latest([rows(("a", "old", 9), ("b", "old", 1)), rows(("a", "new", 1), ("c", "first", 1), ("c", "last", 2))], "k", "t").select("k", "v")


@expected("item_id BIGINT, names VARCHAR", (0, "Ann|Lee"), (1, ""))
def items_by_names(spark, d):
    """Eligible items by the names their words hold."""
    rows = items_of(spark, [{"title": "Bridge", "recommendation": "That it be built", "time_start_ms": 0, "time_end_ms": 600_000}, {"title": "Road", "recommendation": "That it be paved", "time_start_ms": 0, "time_end_ms": 600_000}, {"title": "Adjournment"}])
    slices = spark.createDataFrame([("m", 0, 1, "Lee spoke"), ("m", 0, 0, "then Ann"), ("m", 2, 0, "with Bo and Cy")], "meeting_id string, pos int, seq int, text string")
    return rank.rank_by_names(rows, slices).select("item_id", joined(F.col("names")).alias("names"))


@expected("start_ms BIGINT, text VARCHAR", (0, "a"), (5, "b"))
def transcript_trimmed(spark, d):
    """A segment that several items share comes once."""
    return rank.trim_transcript(spark.createDataFrame([("m", 0, 0, 5, "a"), ("m", 1, 0, 5, "a"), ("m", 1, 5, 9, "b")], "meeting_id string, pos int, start_ms bigint, end_ms bigint, text string")).select("start_ms", "text")


_CHIPPED = f"key string, title string, description array<string>, chips array<{schemas.CHIP}>"


@expected("items BIGINT, chips BIGINT, descriptions BIGINT, soft DOUBLE", (3, 3, 1, 0.333333))
def summary_quality(spark, d):
    """A7."""
    rows = spark.createDataFrame([("a", "T", ["x"], [("Outcome", "1")]), ("b", "T", None, [("Outcome", "2"), ("Promise Made", "q")]), ("d", "T", None, [])], _CHIPPED)
    return diff.quality_report(rows).select(*[F.col(c).cast("bigint").alias(c) for c in ("items", "chips", "descriptions")], F.round("soft_coverage", 6).alias("soft"))


@expected("key VARCHAR, category VARCHAR, change VARCHAR", ("b", "Outcome", "reworded"), ("b", "Public Sentiment", "lost"), ("b", "Promise Made", "gained"))
def chips_compared(spark, d):
    """X1 by category."""
    old = spark.createDataFrame([("a", "T", ["x"], [("Outcome", "1")]), ("b", "T", None, [("Outcome", "1"), ("Public Sentiment", "p")]), ("c", "T", None, [])], _CHIPPED)
    new = spark.createDataFrame([("a", "T", ["x"], [("Outcome", "1")]), ("b", "T", None, [("Outcome", "2"), ("Promise Made", "q")]), ("d", "T", None, [])], _CHIPPED)
    return diff.chip_diff(old, new).select("key", "category", "change")


# Listings and feeds.


@expected("meeting_id VARCHAR, title VARCHAR, date VARCHAR, is_cancelled BOOLEAN", ("a", "City Council", "2024-06-27", False), ("b", "City Council Meeting", "", True))
def past_listed(spark, d):
    """A meeting is cancelled if a link says so."""
    raw = '{"d": {"TotalCount": 2, "Meetings": [{"Id": "a", "MeetingType": "CITY COUNCIL", "Start": "/Date(1719446400000)/", "HasVideo": true, "MeetingLinks": []}, {"Id": "b", "MeetingLinks": [{"Title": "CANCELLED"}]}]}}'
    whole = spark.createDataFrame([(raw,)], "v string").select(F.from_json("v", schemas.LISTING).alias("j")).select(F.explode("j.d.Meetings").alias("x")).select("x.*")
    return readers.past_meetings(whole).select("meeting_id", "title", "date", "is_cancelled")


@expected("meeting_id VARCHAR, title VARCHAR, body VARCHAR, date VARCHAR, has_agenda BOOLEAN", ("c", "City Council", "Council", "2026-07-02", True), ("e", "City Council", "Council", "2026-07-09", False))
def scheduled_listed(spark, d):
    """Meetings to come of known bodies, in the range."""
    raw = '[{"ID": "c", "MeetingType": " CITY COUNCIL ", "StartDate": "2026/07/02 09:30", "HasAgenda": true}, {"ID": "d", "MeetingType": "OTHER", "StartDate": "2026/07/02 09:30"}, {"ID": "e", "MeetingType": "CITY COUNCIL", "StartDate": "2026/07/09 13:00"}, {"ID": "f", "MeetingType": "CITY COUNCIL", "StartDate": "2026/09/01 13:00"}, {"ID": "g", "MeetingType": "CITY COUNCIL", "StartDate": "2026/07/03 13:00", "MeetingPassed": true}]'
    whole = spark.createDataFrame([('{"d": ' + raw + "}",)], "v string").select(F.from_json("v", schemas.CALENDAR).alias("j")).select(F.explode("j.d").alias("x")).select("x.*")
    bodies = spark.createDataFrame([("CITY COUNCIL", "Council")], "meeting_type string, body string")
    return readers.scheduled_meetings(whole, bodies, "2026-07-01", "2026-07-31").select("meeting_id", "title", "body", "date", "has_agenda")


@expected("meeting_id VARCHAR", ("a",))
def meeting_of_a_day(spark, d):
    """J17."""
    rows = spark.createDataFrame([("b", "Council", "2025-01-01"), ("a", "Council", "2025-01-02"), ("c", "Other", "2025-01-02"), ("d", "Council", "2025-01-02")], "meeting_id string, title string, date string")
    return readers.resolve_meeting(rows, "Council", "2025-01-02")


@expected("item_id BIGINT, description VARCHAR, is_legacy BOOLEAN, provisional BOOLEAN, chips VARCHAR", (1, "one line", False, False, "t"), (2, "", True, False, "old"), (3, "a|b", False, True, ""))
def summaries_read(spark, d):
    """Cached summaries in their three shapes."""
    raw = '{"1": {"description": "one line", "chips": [{"category": "Outcome", "text": "t"}]}, "2": [{"category": "Outcome", "text": "old"}], "3": {"description": ["a", "b"], "provisional": true}}'
    rows = readers.summaries(spark.createDataFrame([("m", raw)], "meeting_id string, json string"))
    texts = lambda c: F.coalesce(joined(c), F.lit(""))
    return rows.select(F.col("item_id").cast("bigint").alias("item_id"), texts(F.col("description")).alias("description"), "is_legacy", F.coalesce("provisional", F.lit(False)).alias("provisional"), texts(F.transform("chips", lambda c: c["text"])).alias("chips"))


@expected("kind VARCHAR, title VARCHAR, content VARCHAR", ("item", "Bridge", "<p><strong>Approved · Council · June 7, 2025</strong></p><ul><li>Built &amp; paid</li></ul><p>Spoke: Ann (Resident)</p>"), ("future", "Planning · July 1, 2025", None))
def feed_of_entries(spark, d):
    """An entry for what was decided, one for a meeting to come; escaped."""
    meetings = spark.createDataFrame([("m", "COUNCIL", "Council", "council", "2025-06-07", True, False, None), ("f", "X", "Planning", "planning", "2025-07-01", False, False, "2025-06-30")], "meeting_id string, title string, body string, body_slug string, date string, has_summaries boolean, has_agenda boolean, deadline string")
    rows = items_of(spark, [{"title": "Bridge", "recommendation": "r", "vote_result": "CARRIED", "description": ["Built & paid"], "time_start_ms": 0, "time_end_ms": 120_000, "speakers": who("Ann")}, {"title": "Nothing"}])
    one = feeds.item_entries(meetings, rows, "2025-06-08", "https://example.org").select(F.lit("item").alias("kind"), "title", "content")
    return one.unionByName(feeds.future_entries(meetings, rows, "2025-06-28", "https://example.org").select(F.lit("future").alias("kind"), "title", F.lit(None).cast("string").alias("content")))


@expected("meeting_id VARCHAR, title VARCHAR, cancelled BOOLEAN", ("a", "Council", False), ("b", "Board", True))
def listing_in_memory(spark, d):
    """S8."""
    rows = [("a", "Council", "2025-01-01", None, None, True, True, False), ("b", "Board", "2025-01-02", None, None, False, False, True)]
    return readers.in_memory(spark, rows).select("meeting_id", "title", F.col("is_cancelled").alias("cancelled"))


@expected("k INT, description VARCHAR, chips VARCHAR", (1, "a|b", "t"), (2, None, None), (3, None, None), (4, None, None))
def summaries_guarded(spark, d):
    """Old plain text, other JSON and nulls are no summaries."""
    rows = spark.createDataFrame([(1, '{"description": ["a", "b"], "chips": [{"category": "Outcome", "text": "t"}]}'), (2, "plain text"), (3, "[1]"), (4, None)], "k int, summary string")
    s = tx.item_summary("summary")
    return rows.select("k", joined(s["description"]).alias("description"), joined(F.transform(s["chips"], lambda c: c["text"])).alias("chips"))


@expected("meeting_id VARCHAR, heading VARCHAR, listed VARCHAR, scripts INT", ("m", "A & B - 2025-01-01", "<li>1. Bridge &lt;new&gt;</li><li>2. End</li>", 1))
def pages_built(spark, d):
    """What is shown is escaped, and data can't end its script."""
    meetings = spark.createDataFrame([("m", "A & B", "2025-01-01")], "meeting_id string, title string, date string")
    rows = items_of(spark, [{"section_number": "2.", "title": "End", "pos": 1}, {"section_number": "1.", "title": "Bridge <new>", "content": "</script>", "pos": 0}])
    html = F.col("html")
    return feeds.meeting_pages(meetings, rows).select("meeting_id", F.replace(F.regexp_extract(html, "<h1>(.*?)</h1>", 1), F.lit("&amp;"), F.lit("&")).alias("heading"), F.regexp_extract(html, "<ol>(.*?)</ol>", 1).alias("listed"), F.regexp_count(html, F.lit("</script>")).cast("int").alias("scripts"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
