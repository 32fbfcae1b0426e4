"""Joins, windows and parsers on small meetings."""

import random

import pytest
from pyspark.sql import functions as F

from folkmoot import schemas
from folkmoot.operators import diff, external, graph, intervals, rank, store
from folkmoot.operators import speakers as sp
from folkmoot.plans import meetings as plan
from folkmoot.sources import feeds, parse, readers

AGENDA = """<html><title>COUNCIL - June 27, 2024</title><h1 id='AgendaHeaderTitle'>PUBLIC AGENDA<br/>STANDING POLICY COMMITTEE<br/>ON TRANSPORTATION<br/>Thursday 9:30 a.m.</h1>
<time datetime='2024-06-27 09:30'></time><script>Bookmarks : [{AgendaItemId: 101, TimeStart: 300000, TimeEnd: 900000,}, {AgendaItemId: 102, TimeStart: 1200000, TimeEnd: 1800000}]</script>
<DIV class='AgendaItemCounter'>1.</DIV><DIV class='AgendaItemTitle'><a onclick='SelectItem(101)'>Call to Order</a></DIV><DIV class='AgendaItemDescription RichText'><p>The chair will call.</p></DIV>
<DIV class='AgendaItemCounter'>2.</DIV><DIV class='AgendaItemTitle'><a onclick='SelectItem(102)'>Bridge &amp; Road</a></DIV><DIV class='MotionText RichText'><p>That it be read.</p></DIV>
<a class='x' href="filestream.ashx?DocumentId=7">Report.pdf</a><a class='x' href="filestream.ashx?DocumentId=7">Again.pdf</a></html>"""
MINUTES = """<a onclick='SelectItem(102)'>x</a><DIV class='MotionText RichText'>That the bridge be built.</DIV><DIV class='MotionResult'>CARRIED (8 to 3)</DIV>
<DIV class='VoterVote'>In Favour: (8) Against: (3)</DIV><DIV class='AgendaItemMinutes RichText'>Jane Doe, Bus Riders, spoke in support of the item.</DIV>"""


@pytest.fixture(scope="module")
def detail(spark):
    page = lambda html: spark.createDataFrame([("m1", html)], "meeting_id string, html string")
    return plan.load_detail(page(AGENDA), page(MINUTES), "https://example.org").orderBy("pos").collect()


def test_pages_to_items(detail):
    assert [(r["pos"], r["item_id"], r["section_number"], r["time_start_ms"], r["time_end_ms"]) for r in detail] == [(0, 101, "1.", 300000, 900000), (1, -1, "", 900000, 1200000), (2, 102, "2.", 1200000, 1800000)]
    first, recess, second = detail
    assert first["content"] == "The chair will call." and recess["is_recess"] and recess["title"] == "Recess"
    assert second["recommendation"] == "That the bridge be built." and second["vote_result"] == "CARRIED (8 to 3)" and second["is_contested"]
    assert [(a["name"], a["url"]) for a in second["attachments"]] == [("Report.pdf", "https://example.org/filestream.ashx?DocumentId=7")]
    assert [(s["name"], s["organization"], s["stance"]) for s in second["speakers"]] == [("Jane Doe", "Bus Riders", "support")]


def test_meeting_info(spark):
    r = spark.createDataFrame([(AGENDA,)], "h string").select(parse.meeting_info(F.col("h")).alias("i")).first()["i"]
    assert tuple(r) == ("Standing Policy Committee on Transportation", "2024-06-27", "09:30")


def items(spark, rows, **more):
    """Items from dicts; what a row doesn't say is null."""
    schema = spark.createDataFrame([], schemas.ITEMS).schema
    return spark.createDataFrame([tuple({"meeting_id": "m", "pos": n, "item_id": n, **more, **r}.get(c) for c in schema.names) for n, r in enumerate(rows)], schema)


def segments(spark, rows):
    return spark.createDataFrame([("m", n, *r) for n, r in enumerate(rows)], schemas.SEGMENTS)


def test_nearest_ancestor_counts(spark):
    df = items(spark, [{"section_number": "1.", "time_start_ms": 1, "time_end_ms": 2}, {"section_number": "1.1.", "time_start_ms": 5, "time_end_ms": None}, {"section_number": "1.1.3"}, {"section_number": "1.2"}, {"section_number": "2.1"}, {"section_number": None}])
    got = [(r["time_start_ms"], r["timestamp_inherited"]) for r in intervals.inherit_spans(df).orderBy("pos").collect()]
    assert got == [(1, False), (5, False), (5, True), (1, True), (None, False), (None, False)]


def force_recesses(rows, least=300_000):
    """The same by a plain loop: (start, end) in the agenda's order."""
    timed = sorted([r for r in rows if r[0] is not None], key=lambda r: r[0])
    waiting = sorted((a[1], b[0]) for a, b in zip(timed, timed[1:]) if a[1] is not None and b[0] - a[1] >= least)
    out = []
    for r in rows:
        out.append((*r, False))
        while waiting and r[0] is not None and r[1] is not None and r[1] <= waiting[0][0]:
            out.append((*waiting.pop(0), True))
    return out + [(*w, True) for w in waiting]


def test_recesses_against_a_loop(spark):
    rng = random.Random(5)
    all_rows, want = [], {}
    for m in range(25):
        at, rows = 0, []
        for _ in range(8):
            at += rng.choice([0, 100_000, 300_000, 500_000])
            end = at + rng.randint(1, 9) * 100_000
            rows.append((at, end) if rng.random() < 0.85 else (None, None))
            at = end
        rng.shuffle(rows) if m % 3 == 0 else None
        want[f"m{m}"] = force_recesses(rows)
        all_rows += [(f"m{m}", n, n, *r, False, False) for n, r in enumerate(rows)]
    df = spark.createDataFrame(all_rows, "meeting_id string, pos int, item_id bigint, time_start_ms bigint, time_end_ms bigint, timestamp_inherited boolean, is_recess boolean")
    got = {}
    for r in intervals.insert_recesses(df).orderBy("meeting_id", "pos").collect():
        got.setdefault(r["meeting_id"], []).append((r["time_start_ms"], r["time_end_ms"], r["is_recess"]))
    assert got == want


def test_strict_and_inclusive_bounds(spark):
    df = items(spark, [{"time_start_ms": 10, "time_end_ms": 20}, {"time_start_ms": 10, "time_end_ms": 20, "timestamp_inherited": True}])
    seg = segments(spark, [(0, 10, "a"), (10, 12, "b"), (20, 30, "c")])
    assert sorted((r["pos"], r["seq"]) for r in intervals.slice_strict(df, seg).collect()) == [(0, 1), (1, 1)]
    assert [r["heard"] for r in intervals.item_text(df, seg).orderBy("pos").collect()] == ["a b c", ""]


def who(*names):
    return [(n, None, None, None, None, None, None, None) for n in names]


def test_a_chain_of_three_is_heard_together(spark):
    df = items(spark, [
        {"section_number": "1.1", "time_start_ms": 0, "time_end_ms": 100, "speakers": who("A b")}, {"section_number": "1.2", "time_start_ms": 40, "time_end_ms": 140, "speakers": who("a  B", "C")},
        {"section_number": "1.3", "time_start_ms": 80, "time_end_ms": 180, "speakers": who("c")}, {"section_number": "1", "time_start_ms": 0, "time_end_ms": 180, "speakers": who("c")}, {"section_number": "2", "time_start_ms": 175, "time_end_ms": 300, "speakers": who("c")},
    ])
    groups = graph.settle(intervals.joint_groups(df))
    assert sorted((r["pos"], r["grp"]) for r in groups.collect()) == [(0, 0), (1, 0), (2, 0)]
    marked = intervals.mark_jointly_heard(df, groups)
    assert marked.where("pos = 1").first()["heard_with"].asDict() == {"primary_item_id": 0, "primary_section": "1.1", "partners": ["1.1", "1.3"]}
    assert {(r["win_start"], r["win_end"]) for r in intervals.group_window(marked).collect()} == {(0, 180)}


def test_components_against_union(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def test_windows_open_greedily_and_match(spark):
    seg = segments(spark, [(0, 5000, "good day"), (20_000, 25_000, "item 9.2.1 now"), (31_000, 35_000, "transit"), (50_000, 52_000, "fare talk"), (62_000, 63_000, "nine two one")])
    assert [r["win_start"] for r in intervals.greedy_windows(seg).orderBy("win_start").collect()] == [0, 31_000, 62_000]
    df = items(spark, [{"section_number": "9.2.1", "title": "Zzz", "time_start_ms": 60_000, "time_end_ms": 90_000}, {"section_number": "4", "title": "Transit Fare Policy [CC2025-0402]", "time_start_ms": 0, "time_end_ms": 90_000}])
    got = {r["pos"]: r["found_ms"] for r in intervals.nearest_match(df, seg).collect()}
    assert got == {0: 62_000, 1: 31_000}
    assert intervals.correct_timestamps(df, seg).where("pos = 1").first()["time_start_ms"] == 31_000


def force_shift(start, segs):
    hit = next((i for i, s in enumerate(segs) if s[1] > start and s[0] <= start + 1_200_000 and "recess" in s[2]), None)
    if hit is None:
        return start
    prev = segs[hit][1]
    for a, b, t in segs[hit + 1 :]:
        if a > start + 1_200_000:
            break
        if "reconvene" in t or a - prev >= 60_000:
            return a if 60_000 <= a - start <= 1_200_000 else start
        prev = min(b, a + 30_000)
    return start


def test_shifts_against_a_loop(spark):
    rng = random.Random(8)
    rows, segs, want = [], [], {}
    for m in range(60):
        at, mine = 0, []
        for _ in range(30):
            at += rng.choice([0, 5_000, 61_000])
            end = at + rng.choice([10_000, 40_000, 90_000])
            mine.append((at, end, rng.choice(["words", "words", "a recess", "we reconvene"])))
            at = end
        start = rng.randrange(0, at)
        want[f"m{m}"] = force_shift(start, mine)
        rows.append((f"m{m}", 0, start, False))
        segs += [(f"m{m}", n, *s) for n, s in enumerate(mine)]
    got = intervals.shift_past_recesses(spark.createDataFrame(rows, "meeting_id string, pos int, time_start_ms bigint, timestamp_inherited boolean"), spark.createDataFrame(segs, schemas.SEGMENTS))
    assert {r["meeting_id"]: r["time_start_ms"] for r in got.collect()} == want
    assert any(w != r[2] for w, r in zip(want.values(), rows))


def test_attachments_go_to_the_best_title(spark):
    df = items(spark, [{"title": "Confirmation of Agenda"}, {"title": "Bridge funding plan"}, {"title": "Bridge paint"}, {"title": "Roll Call bridge funding"}])
    files = spark.createDataFrame([("m", 0, 0, "1", "RTS - Jane Doe - Bridge Funding_Redacted.pdf", "u"), ("m", 0, 1, "2", "RTS - Al - Sidewalks.pdf", "v"), ("m", 2, 0, "3", "x.pdf", "w")], "meeting_id string, item_id bigint, att_pos int, doc_id string, name string, url string")
    got = intervals.distribute_attachments(df, files)
    assert got.count() == 4 and [r["doc_id"] for r in got.where("item_id = 1").collect()] == ["1"]


def speaker_rows(spark, rows):
    return spark.createDataFrame([("m", 0, n, *r) for n, r in enumerate(rows)], "meeting_id string, pos int, spk_pos int, name string, organization string, stance string, source string, said array<string>")


def test_remarks_are_merged(spark):
    roster = speaker_rows(spark, [("Ann", "", "support", "minutes", None), ("Bo", "CEO, Acme", "", "minutes", None), ("Cy", None, None, "registered", None)])
    cached = speaker_rows(spark, [("Ann", "Old", "", None, ["x"]), ("Ann", "Riders", "concern", None, ["y"]), ("Bo", "Other", "", None, ["z"])])
    got = {r["name"]: r for r in intervals.merge_remarks(roster, cached).collect()}
    assert (got["Ann"]["organization"], got["Ann"]["stance"], got["Ann"]["said"]) == ("Riders", "concern", ["y"])
    assert got["Bo"]["organization"] == "Acme" and got["Cy"]["org_label"] == "Resident" and got["Cy"]["org_color"] is None


def test_speakers_are_heard_and_stamped(spark):
    df = items(spark, [{"time_start_ms": 0, "time_end_ms": 100_000, "speakers": who("Jane Wilgenhof", "Emma Absent")}])
    seg = segments(spark, [(0, 10_000, "our next speaker"), (10_000, 20_000, "welcome jane wilgenhof from the bus riders of town and thanks"), (30_000, 40_000, "we move to questions of administration"), (200_000, 210_000, "speaker emma absent")])
    roster = speaker_rows(spark, [("Jane Wilgenhof", "", "", "registered", None), ("Emma Absent", "", "", "registered", None)])
    heard = intervals.mark_heard(roster, df, seg)
    got = {r["name"]: (r["heard"], r["organization"]) for r in heard.collect()}
    assert got == {"Jane Wilgenhof": (True, "The Bus Riders of Town"), "Emma Absent": (False, "")}
    when = {r["name"]: (r["time_start_ms"], r["spk_order"]) for r in intervals.mark_timestamps(heard, df, seg).collect()}
    assert when["Jane Wilgenhof"][0] == 10_000 + int(8 / 61 * 10_000) or 10_000 < when["Jane Wilgenhof"][0] < 20_000
    assert when["Emma Absent"][0] > 200_000 and when["Emma Absent"][1] == 1
    assert intervals.mark_questions(df, seg).first()["questions_start_ms"] == 30_000


def test_speakers_from_minutes_and_filings(spark):
    text = "Jane Doe, Bus Riders, spoke in support. Director Smith presented the report. He addressed council. John Roe, Resident, expressed concerns. Jane Doe addressed council again. Amy Li, City of Foo, presented."
    df = items(spark, [{"title": "Bridge", "content": text, "attachments": [("RTS - Jane Doe - Bridge.pdf", "u"), ("Request to Speak - Al B - Roads_Redacted.pdf", "v"), ("Other.pdf", "w")]}, {"title": "Adjournment", "content": text}])
    got = [(r["name"], r["organization"], r["stance"], r["source"]) for r in sp.extract_speakers(df).orderBy("pos", "spk_pos").collect()]
    assert got == [("Jane Doe", "Bus Riders", "support", "minutes"), ("John Roe", "Resident", "concern", "minutes"), ("Al B", "", "", "registered")]


def test_topics_rank_with_ties_in_agenda_order(spark):
    df = items(spark, [{"title": "Call to Order", "recommendation": "x"}, {"title": "Same A", "recommendation": "r", "section_number": "1.1"}, {"title": "Same B", "recommendation": "r", "section_number": "1.2"}, {"title": "Fight $5", "recommendation": "r", "is_contested": True, "section_number": "1.3"}, {"title": "Head"}])
    got = rank.meeting_topics(df, 2).orderBy("pos").collect()
    assert [(r["topic"], r["rank"]) for r in got] == [("Same A", 1), ("Fight $5", 0)]
    people = speaker_rows(spark, [(f"P{n}", "", "concern", "minutes", ["s"]) for n in range(4)]).withColumns({"pos": F.lit(3), "time_start_ms": F.lit(None).cast("bigint")})
    rows = rank.speaker_rows(rank.meeting_topics(df, 2), people).collect()
    assert [r["topic"] for r in rows] == ["Same A", "Fight $5", "P0", "P1", "P2"] and rows[2]["item_speaker_count"] == 4 and rows[2]["outcome"] == "Raised concerns"


def test_weights_counts_and_roster(spark):
    df = items(spark, [{"title": "Urgent Business"}, {"title": "Reports", "section_number": "8"}, {"title": "Plan", "section_number": "8.1", "recommendation": "That it be built"}, {"title": "Empty", "section_number": "9"}, {"title": "In block", "section_number": "8.2", "recommendation": "That it be paid", "timestamp_inherited": True}])
    rows = rank.mark_row_weights(df)
    assert [(r["is_routine"], r["is_heading"]) for r in rows.orderBy("pos").collect()] == [(True, False), (False, True), (False, False), (True, False), (False, False)]
    assert tuple(rank.meeting_counts(rows).first()) == ("m", 2, 1, 1)
    people = speaker_rows(spark, [("Ann", "Acme", "", "minutes", None), ("Bo", "", "", "minutes", None), ("Cy", "", "", "registered", None), ("Di", "CEO, Acme", "", "registered", ["x"])]).withColumns({"pos": F.lit(2), "heard": F.lit(False)})
    r = rank.speaker_roster(people, df).first()
    assert (r["resident_count"], r["speaker_count"], [o["label"] for o in r["organizations"]]) == (1, 3, ["Acme"])


def test_summary_of_a_known_text(spark):
    text = "The bridge needs repair soon. Council discussed funding options for the bridge at length today. Weather was fine. Funding for the bridge will come from reserves."
    df = spark.createDataFrame([(1, text, "Bridge Funding"), (2, None, None), (3, "One only here.", "")], "k int, b string, t string")
    got = {r["k"]: r["summary"] for r in rank.extractive_summary(df, ["k"], "b", "t").collect()}
    assert got == {1: "The bridge needs repair soon. Council discussed funding options for the bridge at length today.", 2: "", 3: "One only here."}


def test_summaries_shuffle_nothing(spark):
    text = "The bridge needs repair soon. Council discussed funding options for the bridge at length today. Weather was fine. Funding for the bridge will come from reserves."
    best = "The bridge needs repair soon. Council discussed funding options for the bridge at length today."
    rows = [(1, text, "Bridge Funding"), (1, "One only here.", ""), (None, text, "Bridge Funding")]
    got = rank.extractive_summary(spark.createDataFrame(rows, "k int, b string, t string"), ["k"], "b", "t")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert set(map(tuple, got.collect())) == {(1, best), (1, "One only here."), (None, best)}
    df = spark.createDataFrame([("m", 1, "Bridge Funding", text), ("m", 2, "Adjournment", text), ("m", 3, None, None)], "meeting_id string, pos int, title string, content string")
    whole = rank.summarize_items(df)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    assert {r["pos"]: r["extractive_summary"] for r in whole.collect()} == {1: "Bridge Funding. Funding for the bridge will come from reserves.", 2: "Procedural item.", 3: ""}


def test_summaries_of_odd_texts(spark):
    same = "Water tree road. "
    texts = {
        "ties go to the earlier": (same * 4, "", (same * 2).strip()),
        "no words": ("1234567890 1. 1234567890 2. 1234567890 3.", "Title", ""),
        "few words": ("1234567890 1. 1234567890 2. Bridges are built. 1234567890 3.", "", "Bridges are built."),
        "short sentences count": ("Alpha beta gamma. Delta epsilon zeta. Road road road road. Kappa. Kappa. Kappa. Kappa. Kappa. Kappa lambda kappa.", "Kappa", "Alpha beta gamma. Kappa lambda kappa."),
        "any spaces": ("Alpha\u00a0beta gamma.\u2003Delta epsilon zeta.\nEta theta iota.", "delta", "Alpha beta gamma. Delta epsilon zeta."),
    }
    df = spark.createDataFrame([(k, b, t) for k, (b, t, _) in texts.items()], "k string, b string, t string")
    assert dict(map(tuple, rank.extractive_summary(df, ["k"], "b", "t").collect())) == {k: want for k, (_, _, want) in texts.items()}
    broken = spark.range(1).selectExpr("id", "cast(unhex(concat(repeat(hex('Water tree road. '), 3), 'C328')) as string) b", "cast(X'C328' as string) t")
    assert rank.extractive_summary(broken, ["id"], "b", "t").first()["summary"] == (same * 2).strip()


def test_feeds(spark):
    meetings = spark.createDataFrame([("m", "COUNCIL", "Council", "council", "2025-06-07", True, False, None), ("f", "X", "Planning", "planning", "2025-07-01", False, False, "2025-06-30")], "meeting_id string, title string, body string, body_slug string, date string, has_summaries boolean, has_agenda boolean, deadline string")
    df = items(spark, [{"title": "Bridge", "recommendation": "r", "vote_result": "CARRIED", "description": ["Built & paid"], "time_start_ms": 0, "time_end_ms": 120_000, "speakers": who("Ann")}, {"title": "Nothing"}])
    r = feeds.item_entries(meetings, df, "2025-06-08", "https://example.org").collect()
    assert len(r) == 1 and r[0]["content"] == "<p><strong>Approved · Council · June 7, 2025</strong></p><ul><li>Built &amp; paid</li></ul><p>Spoke: Ann (Resident)</p>" and r[0]["categories"] == ["council"]
    day = feeds.day_entries(meetings, df, "2025-06-08", "https://example.org").collect()
    assert day[0]["title"] == "June 7, 2025 · Council" and day[0]["link"] == "https://example.org/meeting/m.html" and "<h3>Council</h3>" in day[0]["content"]
    soon = feeds.future_entries(meetings, df, "2025-06-28", "https://example.org")
    assert [x["title"] for x in soon.collect()] == ["Planning · July 1, 2025"] and feeds.future_entries(meetings, df, "2025-06-20", "x").count() == 0
    xml = feeds.atom(soon, "Feed", "f.xml", "https://example.org")
    assert xml.count("<entry>") == 1 and xml == feeds.atom(soon, "Feed", "f.xml", "https://example.org")
    assert '"agenda_items":[' in feeds.meeting_json(meetings, df).where("meeting_id = 'm'").first()["json"]


def test_diffs_audits_and_gates(spark):
    schema = f"key string, title string, description array<string>, chips array<{schemas.CHIP}>"
    old = spark.createDataFrame([("a", "T", ["x"], [("Outcome", "1")]), ("b", "T", None, [("Outcome", "1"), ("Public Sentiment", "p")]), ("c", "T", None, [])], schema)
    new = spark.createDataFrame([("a", "T", ["x"], [("Outcome", "1")]), ("b", "T", None, [("Outcome", "2"), ("Promise Made", "q")]), ("d", "T", None, [])], schema)
    assert {(r["key"], r["change"]) for r in diff.snapshot_diff(old, new, "key", "chips").collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "GONE"), ("d", "NEW")}
    assert {(r["category"], r["change"]) for r in diff.chip_diff(old, new).collect()} == {("Outcome", "reworded"), ("Public Sentiment", "lost"), ("Promise Made", "gained")}
    q = diff.quality_report(new).first()
    assert (q["items"], q["chips"], q["descriptions"], q["soft_coverage"]) == (3, 3, 1, pytest.approx(1 / 3))
    v = spark.createDataFrame([("a", 5, 5), ("b", 2, 1), ("c", None, None)], "key string, faithfulness int, specificity int")
    assert {r["gate"]: r["failed"] for r in diff.gates(v).collect()} == {"unscored": True, "mean_faithfulness": True, "mean_specificity": False, "faithfulness_floor": True}
    assert not any(r["failed"] for r in diff.gates(v.limit(0)).collect())


def test_store_puts_only_what_changed(spark, tmp_path):
    s = store.KeyedStore(spark, str(tmp_path / "t"), "key string, value string")
    assert s.load().count() == 0
    rows = lambda *r: spark.createDataFrame(r, "key string, value string")
    assert s.save(rows(("a", "1"), ("b", None)), 1) == 2
    assert s.save(rows(("a", "1"), ("b", None)), 2) == 0
    assert s.save(rows(("b", "2")), 3) == 1
    assert sorted(map(tuple, s.load().collect())) == [("a", "1"), ("b", "2")]


def test_summaries_of_all_shapes(spark):
    raw = spark.createDataFrame([("m", '{"1": {"description": "one line", "chips": [{"category": "Outcome", "text": "t"}]}, "2": [{"category": "Outcome", "text": "old"}], "3": {"description": ["a", "b"], "provisional": true}}')], "meeting_id string, json string")
    got = {r["item_id"]: r for r in readers.summaries(raw).collect()}
    assert got[1]["description"] == ["one line"] and not got[1]["is_legacy"] and got[2]["is_legacy"] and got[2]["chips"][0]["text"] == "old" and got[3]["provisional"]
    assert store.is_current(readers.summaries(raw)).first()["current"]


class Down(Exception):
    code = 503


def test_model_calls_report_errors(spark):
    asked = []

    def flaky(p):
        asked.append(p)
        if len(asked) < 3:
            raise Down("later")
        return "ok"

    assert external.call_with_retry(flaky, "p", sleep=lambda s: None) == "ok"

    def call(p):
        if p == "b":
            raise ValueError("bad")
        return p * 2

    df = spark.createDataFrame([("a",), ("b",)], "t string")
    got = {r["t"]: (r["answer"], r["error"]) for r in external.call_model(df, F.col("t"), call).collect()}
    assert got == {"a": ("aa", None), "b": (None, "other: bad")}
    assert external.call_model(df, F.col("t"), None).first()["error"] == "disabled"
    v = spark.createDataFrame([('{"faithfulness": 9, "specificity": 0, "non_redundancy": 3}',), ('{"faithfulness": 4}',)], "a string").select(external.parse_verdict(F.col("a")).alias("v")).collect()
    assert v[0]["v"][:3] == (5, 1, 3) and v[1]["v"] is None


def test_listings(spark, tmp_path):
    (tmp_path / "past_x_1.json").write_text('{"d": {"TotalCount": 2, "Meetings": [{"Id": "a", "MeetingType": "CITY COUNCIL", "Start": "/Date(1719446400000)/", "HasVideo": true, "MeetingLinks": []}, {"Id": "b", "MeetingLinks": [{"Title": "CANCELLED"}]}]}}')
    got = readers.past_meetings(readers.listings(spark, str(tmp_path / "past_x_1.json"))).orderBy("meeting_id").collect()
    assert [(r["title"], r["date"], r["is_cancelled"]) for r in got] == [("City Council", "2024-06-27", False), ("City Council Meeting", "", True)]
    (tmp_path / "agenda_a.html").write_text(AGENDA)
    assert [r["meeting_id"] for r in readers.pages(spark, str(tmp_path), "agenda").collect()] == ["a"]
    assert [(r["meeting_id"], str(r["date"])) for r in readers.page_dates(spark, str(tmp_path)).collect()] == [("agenda_a", "2024-06-27")]


def test_whole_build(spark):
    df = items(spark, [{"title": "Bridge", "section_number": "1.1", "recommendation": "That it be built", "vote_result": "CARRIED (8 to 3)", "time_start_ms": 0, "time_end_ms": 600_000, "speakers": [("Ann Lee", "Acme", "", "s", "minutes", None, None, None)]}])
    seg = segments(spark, [(0, 10_000, "the bridge"), (10_000, 20_000, "welcome ann lee")])
    done = spark.createDataFrame([("m", 0, ["A bridge."], [("Public Sentiment", "Glad")], [("Ann Lee", "", "support", None, None, ["I like it"], None, None)])], f"meeting_id string, item_id bigint, description array<string>, chips array<{schemas.CHIP}>, speakers array<{schemas.SPEAKER}>")
    weighted, topics = plan.build(df, seg, done)
    rows = topics.collect()
    assert [(r["kind"], r["topic"], r["outcome"]) for r in rows] == [("topic", "Bridge", "Approved (8-3)"), ("speaker", "Ann Lee", "In support")]
    assert rows[1]["organization"] == "Acme" and 10_000 < rows[1]["time_start_ms"] < 20_000 and not weighted.first()["is_routine"]
