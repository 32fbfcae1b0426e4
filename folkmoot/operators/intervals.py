"""Joins by ancestry, by overlap and by nearness of items and the segments of their meeting.

Every join has the meeting as its equal key, so that it is a hash or sort-merge
join with the range as a residual, never a nested loop over all meetings.
Strict overlap (J2, J12-J14) and inclusive overlap (J3) differ on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.functions.classify import truth
from folkmoot.functions.match import clean_organization, file_key, file_words, keywords, name_tier, organization_color, organization_label, title_words
from folkmoot.functions.text import clock, text
from folkmoot.operators.graph import components

BRIEF_MS = 60_000
RECESS_MS = 300_000
SHIFT_MS = (60_000, 1_200_000)


def inherit_spans(items: DataFrame) -> DataFrame:
    """An item without a start takes the span of its nearest ancestor that has one.

    Ancestors are filed under their number with a point at the end; of sections
    filed twice the last counts.
    """
    section = text("section_number")
    parts = F.split(F.regexp_replace(section, r"\.+$", ""), r"\.")
    spans = items.where("time_start_ms IS NOT NULL").groupBy("meeting_id", section.alias("key")).agg(F.max_by(F.struct("time_start_ms", "time_end_ms"), "pos").alias("span"))
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    asked = items.where("time_start_ms IS NULL").select("meeting_id", "pos", parts.alias("parts"), F.explode(depths).alias("depth"))
    asked = asked.withColumn("key", F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "."), F.lit(".")))
    found = asked.join(spans, ["meeting_id", "key"]).groupBy("meeting_id", "pos").agg(F.max_by("span", "depth").alias("span"))
    own = F.col("time_start_ms").isNotNull()
    return items.join(found, ["meeting_id", "pos"], "left").withColumns(
        {
            "timestamp_inherited": truth("timestamp_inherited") | F.col("span").isNotNull(),
            "time_start_ms": F.when(own, F.col("time_start_ms")).otherwise(F.col("span.time_start_ms")),
            "time_end_ms": F.when(own | F.col("span").isNull(), F.col("time_end_ms")).otherwise(F.col("span.time_end_ms")),
        }
    ).drop("span")


def mark_brief(items: DataFrame) -> DataFrame:
    """An own span of a minute or less is no discussion."""
    brief = F.coalesce(F.col("time_end_ms") - F.col("time_start_ms") <= BRIEF_MS, F.lit(False))
    return items.withColumn("timestamp_inherited", truth("timestamp_inherited") | brief)


def insert_recesses(items: DataFrame, least_ms: int = RECESS_MS) -> DataFrame:
    """A row for each long gap between an item and the end of the one that started before it.

    A recess stands after the first item that ends by its start, but never
    before an earlier recess; without such an item it stands at the end.
    ``pos`` is numbered anew.
    """
    timed = items.where(F.col("time_start_ms").isNotNull() & ~truth("timestamp_inherited"))
    before = F.lag("time_end_ms").over(Window.partitionBy("meeting_id").orderBy("time_start_ms", "pos"))
    gaps = timed.withColumn("from", before).where(F.col("time_start_ms") - F.col("from") >= least_ms).select("meeting_id", "from", F.col("time_start_ms").alias("to"))
    ends = timed.where("time_end_ms IS NOT NULL").select("meeting_id", "pos", F.col("time_end_ms").alias("end"))
    hosted = gaps.join(ends, ["meeting_id"], "left").groupBy("meeting_id", "from", "to").agg(F.min(F.when(F.col("end") <= F.col("from"), F.col("pos"))).alias("host"))
    order = Window.partitionBy("meeting_id").orderBy("from", "to")
    hosted = hosted.withColumn("host", F.max(F.coalesce("host", F.lit(1 << 30))).over(order)).withColumn("nth", F.row_number().over(order))
    rest = {c: F.lit(None).cast(t) for c, t in items.dtypes}
    rest |= {
        "meeting_id": F.col("meeting_id"), "item_id": F.lit(-1).cast(dict(items.dtypes)["item_id"]), "title": F.lit("Recess"), "content": F.lit(""), "section_number": F.lit(""),
        "time_start_ms": F.col("from"), "time_end_ms": F.col("to"), "is_recess": F.lit(True), "timestamp_inherited": F.lit(False),
    }
    breaks = hosted.select(*[v.alias(c) for c, v in rest.items() if c in items.columns], F.col("host").alias("_host"), F.col("nth").alias("_nth"))
    both = items.withColumns({"_host": F.col("pos"), "_nth": F.lit(0)}).unionByName(breaks)
    place = F.row_number().over(Window.partitionBy("meeting_id").orderBy("_host", "_nth")) - 1
    return both.withColumn("pos", place.cast(dict(items.dtypes)["pos"])).drop("_host", "_nth")


def _windowed(items: DataFrame, window: DataFrame | None) -> DataFrame:
    """Items with w0 and w1: the joint window where there is one, else their own span."""
    if window is None:
        return items.withColumns({"w0": F.col("time_start_ms"), "w1": F.col("time_end_ms")})
    return items.join(window.select("meeting_id", "pos", "win_start", "win_end"), ["meeting_id", "pos"], "left").withColumns(
        {"w0": F.coalesce("win_start", "time_start_ms"), "w1": F.coalesce("win_end", "time_end_ms")}
    ).drop("win_start", "win_end")


def slice_strict(items: DataFrame, segments: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """(item columns, seq, start_ms, end_ms, text) of segments that share time with the item's span."""
    rows = _windowed(items, window).where("w0 IS NOT NULL AND w1 IS NOT NULL")
    return rows.join(segments, "meeting_id").where("start_ms < w1 AND end_ms > w0").drop("w0", "w1")


def slice_inclusive(items: DataFrame, segments: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """Segments that touch the span, none for inherited spans unless a joint window is given."""
    rows = _windowed(items, window)
    own = ~truth("timestamp_inherited")
    if window is not None:
        own = own | ~F.col("w0").eqNullSafe(F.col("time_start_ms")) | ~F.col("w1").eqNullSafe(F.col("time_end_ms"))
    return rows.where(own & F.col("w0").isNotNull() & F.col("w1").isNotNull()).join(segments, "meeting_id").where("start_ms <= w1 AND end_ms >= w0").drop("w0", "w1")


def item_text(items: DataFrame, segments: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """Items with ``heard``, the words of their segments in order; blank where there are none."""
    said = slice_inclusive(items, segments, window).withColumn("t", F.trim(F.coalesce("text", F.lit("")))).where("t <> ''")
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), " ")
    return items.join(said.groupBy("meeting_id", "pos").agg(glued.alias("heard")), ["meeting_id", "pos"], "left").withColumn("heard", F.coalesce("heard", F.lit("")))


NOT_TARGETS = "adjournment|adoption of minutes|call to order|committee reports \\(not on consent|confirmation of|consent agenda|roll call"


def distribute_attachments(items: DataFrame, attachments: DataFrame, least: float = 0.3) -> DataFrame:
    """Attachments with copies of those filed under the confirmation of the agenda, at the item whose title they match best.

    The share of an attachment's words in a title counts; the first item wins a
    tie, and a target that has a file of that name already gets no copy.
    """
    low = F.lower(text("title"))
    sources = items.where(F.contains(low, F.lit("confirmation of agenda"))).select("meeting_id", "item_id")
    targets = items.where(~low.rlike(NOT_TARGETS)).select("meeting_id", F.col("item_id").alias("target"), F.col("pos").alias("target_pos"), title_words("title").alias("tw")).where("size(tw) > 0")
    filed = attachments.join(sources, ["meeting_id", "item_id"], "left_semi").withColumn("aw", file_words("name")).where("size(aw) > 0")
    scored = filed.join(targets, "meeting_id").withColumn("score", F.size(F.array_intersect("aw", "tw")) / F.size("aw")).where(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy("meeting_id", "item_id", "att_pos").orderBy(F.desc("score"), "target_pos"))
    moved = scored.withColumn("nth", best).where("nth = 1").withColumn("fk", file_key("name"))
    held = attachments.select("meeting_id", F.col("item_id").alias("target"), file_key("name").alias("fk"))
    moved = moved.join(held, ["meeting_id", "target", "fk"], "left_anti")
    # Of files that would land at one item under one name, the first.
    once = F.row_number().over(Window.partitionBy("meeting_id", "target", "fk").orderBy("item_id", "att_pos"))
    moved = moved.withColumn("nth", once).where("nth = 1").withColumns({"item_id": F.col("target"), "att_pos": F.col("att_pos") + 100_000})
    return attachments.unionByName(moved.select(*attachments.columns))


def merge_remarks(roster: DataFrame, cached: DataFrame) -> DataFrame:
    """The roster (meeting_id, pos, spk_pos, name, organization, stance, …) with remarks cached under the same name.

    The roster's organization and the cached stance come first; of a name cached
    twice the last counts; blank counts as missing.
    """
    last = cached.where(text("name") != "").groupBy("meeting_id", "pos", "name").agg(F.max_by(F.struct("said", "stance", "organization"), "spk_pos").alias("c"))
    rows = roster.join(last, ["meeting_id", "pos", "name"], "left")
    pick = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs], F.lit(""))
    org = clean_organization(F.when(F.col("c").isNull(), text("organization")).otherwise(pick(text("organization"), text("c.organization"))))
    return rows.withColumns(
        {
            "said": F.coalesce("c.said", F.col("said") if "said" in roster.columns else F.lit(None).cast("array<string>")),
            "stance": F.when(F.col("c").isNull(), text("stance")).otherwise(pick(text("c.stance"), text("stance"))),
            "organization": org,
            "org_label": organization_label(org),
            "org_color": organization_color(org),
        }
    ).drop("c")


def joint_edges(items: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs of items (meeting_id, a, b) that overlap by half of the shorter span, share a speaker and aren't nested."""
    names = F.filter(F.transform(F.coalesce("speakers", F.array().cast(dict(items.dtypes)["speakers"])), lambda s: F.trim(F.regexp_replace(F.lower(F.coalesce(s["name"], F.lit(""))), r"\s+", " "))), lambda n: n != "")
    rows = items.where("time_end_ms > time_start_ms").select(
        "meeting_id", "pos", F.col("time_start_ms").alias("s"), F.col("time_end_ms").alias("e"), F.regexp_replace(text("section_number"), r"\.+$", "").alias("sec"), names.alias("names")
    )
    rows = rows.where("size(names) > 0")
    a, b = (rows.select("meeting_id", *[F.col(c).alias(f"{c}_{k}") for c in rows.columns[1:]]) for k in "ab")
    shared = F.least("e_a", "e_b") - F.greatest("s_a", "s_b")
    nested = F.startswith("sec_b", F.concat("sec_a", F.lit("."))) | F.startswith("sec_a", F.concat("sec_b", F.lit(".")))
    near = a.join(b, "meeting_id").where("pos_a < pos_b AND s_a < e_b AND s_b < e_a")
    enough = shared / F.least(F.col("e_a") - F.col("s_a"), F.col("e_b") - F.col("s_b")) >= share
    return near.where(enough & ~nested & F.arrays_overlap("names_a", "names_b")).select("meeting_id", F.col("pos_a").alias("a"), F.col("pos_b").alias("b"))


def joint_groups(items: DataFrame) -> DataFrame:
    """(meeting_id, pos, grp) of items that are heard together with others."""
    node = lambda c: F.struct("meeting_id", F.col(c).alias("pos"))
    got = components(joint_edges(items).select(node("a").alias("u"), node("b").alias("v")))
    return got.select("node.meeting_id", "node.pos", F.col("label.pos").alias("grp"))


def mark_jointly_heard(items: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Items with ``heard_with``: the item of the group that starts first, and the other items' sections as sorted text."""
    rows = items.join(joint_groups(items) if groups is None else groups, ["meeting_id", "pos"], "left")
    w = Window.partitionBy("meeting_id", "grp")
    first = F.min_by(F.struct("item_id", text("section_number").alias("section")), F.struct(F.coalesce("time_start_ms", F.lit(0)), "pos")).over(w)
    all_ = F.collect_list(F.struct("pos", text("section_number").alias("s"))).over(w)
    others = F.array_sort(F.transform(F.filter(all_, lambda x: x["pos"] != F.col("pos")), lambda x: x["s"]))
    mark = F.struct(first["item_id"].alias("primary_item_id"), first["section"].alias("primary_section"), others.alias("partners"))
    return rows.withColumn("heard_with", F.when(F.col("grp").isNotNull(), mark))


def group_window(marked: DataFrame) -> DataFrame:
    """(meeting_id, pos, win_start, win_end) of items heard together."""
    w = Window.partitionBy("meeting_id", "heard_with.primary_item_id")
    both = F.col("time_start_ms").isNotNull() & F.col("time_end_ms").isNotNull()
    rows = marked.where("heard_with IS NOT NULL")
    return rows.select("meeting_id", "pos", F.min(F.when(both, F.col("time_start_ms"))).over(w).alias("win_start"), F.max(F.when(both, F.col("time_end_ms"))).over(w).alias("win_end"))


def greedy_windows(segments: DataFrame, width_ms: int = 30_000) -> DataFrame:
    """(meeting_id, win_start, spoken): a window opens at the first segment that starts over half a minute after the one that opened the last.

    The cut depends on the cut before, so each meeting is folded in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "start_ms", F.coalesce("text", F.lit("")).alias("text"))))
    one = "struct<at:bigint,said:array<string>>"

    def put(got: Column, s: Column) -> Column:
        last = F.element_at(got, -1)
        fresh = F.array(F.struct(s["start_ms"].alias("at"), F.array(s["text"]).alias("said")))
        grown = F.concat(F.slice(got, F.lit(1), F.size(got) - 1), F.array(F.struct(last["at"].alias("at"), F.concat(last["said"], F.array(s["text"])).alias("said"))))
        return F.when(F.size(got) == 0, fresh).when(s["start_ms"] - F.try_element_at(got, F.lit(-1))["at"] > width_ms, F.concat(got, fresh)).otherwise(grown)

    folded = segments.groupBy("meeting_id").agg(ordered.alias("s")).withColumn("w", F.aggregate("s", F.array().cast(f"array<{one}>"), put))
    return folded.select("meeting_id", F.explode("w").alias("w")).select("meeting_id", F.col("w.at").alias("win_start"), F.array_join("w.said", " ").alias("spoken"))


SPOKEN = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()


def section_spoken(section: Column, spoken: Column) -> Column:
    """A section's number is said, in digits or in words."""
    digits = F.split(F.regexp_replace(section, r"\.+$", ""), r"\.")
    numbers = F.create_map(*[x for i, n in enumerate(SPOKEN, 1) for x in (F.lit(str(i)), F.lit(n))])
    words = F.transform(digits, lambda d: F.coalesce(F.try_element_at(numbers, d), d))
    figure = F.concat(F.lit(r"(?i)\b"), F.array_join(digits, r"[\s.,]+"), F.lit(r"\b"))
    return (F.regexp_replace(section, r"\.+$", "") != "") & (F.rlike(spoken, figure) | F.rlike(spoken, F.concat(F.lit(r"(?i)\b"), F.array_join(words, r"\s+"), F.lit(r"\b"))))


def nearest_match(items: DataFrame, segments: DataFrame) -> DataFrame:
    """(meeting_id, pos, found_ms): the window that fits the item best: by number, by two of its words, by its only word; then the nearest, then the first."""
    rows = items.select("meeting_id", "pos", text("section_number").alias("sec"), keywords("title").alias("kw"), F.col("time_start_ms").alias("hint"))
    both = rows.join(greedy_windows(segments), "meeting_id")
    hits = F.size(F.filter("kw", lambda k: F.contains(F.lower(F.col("spoken")), k)))
    rank = F.when(section_spoken(F.col("sec"), F.col("spoken")), 3).when(hits >= 2, 2).when((hits == 1) & (F.size("kw") == 1), 1)
    far = F.when(F.col("hint").isNotNull(), F.abs(F.col("win_start") - F.col("hint"))).otherwise(F.lit(0))
    best = both.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("meeting_id", "pos").agg(F.min(F.struct(-F.col("rank"), far, F.col("win_start").alias("at"))).alias("b"))
    return best.select("meeting_id", "pos", F.col("b.at").alias("found_ms"))


def correct_timestamps(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Items with their own start moved to where the transcript takes them up."""
    own = ~truth("timestamp_inherited") & F.col("time_start_ms").isNotNull()
    found = nearest_match(items.where(own), segments)
    rows = items.join(found, ["meeting_id", "pos"], "left")
    return rows.withColumn("time_start_ms", F.coalesce("found_ms", "time_start_ms")).withColumn("time_start_formatted", clock(F.col("time_start_ms"))).drop("found_ms")


RECESS = r"(?i)\b(?:back\s+at\s+\d{1,2}|recess|stand\s+down|stand(?:ing|s)?\s+at\s+ease|take\s+a\s+break|take\s+a\s+short\s+break)\b"
RECONVENE = r"(?i)\b(?:back\s+to\s+order|call\s+the\s+meeting\s+back|come\s+back\s+to\s+order|reconvene|resume)\b"


def shift_past_recesses(items: DataFrame, segments: DataFrame) -> DataFrame:
    """An item whose bookmark is followed by a recess starts where the meeting resumes, one to twenty minutes later.

    The meeting resumes where that is said, or after a minute without a word; a
    segment is taken to last half a minute at most, but for the one that
    announces the recess.
    """
    least, most = SHIFT_MS
    own = items.where(F.col("time_start_ms").isNotNull() & ~truth("timestamp_inherited")).select("meeting_id", "pos", F.col("time_start_ms").alias("at"))
    near = own.join(segments, "meeting_id").where((F.col("end_ms") > F.col("at")) & (F.col("start_ms") <= F.col("at") + most))
    by = Window.partitionBy("meeting_id", "pos").orderBy("seq")
    whole = Window.partitionBy("meeting_id", "pos")
    near = near.withColumn("recess", F.min(F.when(F.coalesce("text", F.lit("")).rlike(RECESS), F.col("seq"))).over(whole)).where("seq >= recess")
    end = F.when(F.col("seq") == F.col("recess"), F.col("end_ms")).otherwise(F.least("end_ms", F.col("start_ms") + 30_000))
    near = near.withColumn("prev", F.lag(end).over(by)).where("seq > recess")
    back = F.coalesce("text", F.lit("")).rlike(RECONVENE) | (F.col("start_ms") - F.col("prev") >= least)
    found = near.where(back).groupBy("meeting_id", "pos").agg(F.min_by("start_ms", "seq").alias("resumed"))
    rows = items.join(found, ["meeting_id", "pos"], "left")
    moved = (F.col("resumed") - F.col("time_start_ms")).between(least, most)
    return rows.withColumns(
        {
            "time_start_original_ms": F.when(moved, F.col("time_start_ms")),
            "time_start_adjusted": F.coalesce(moved, F.lit(False)),
            "adjustment_reason": F.when(moved, "recess"),
            "time_start_ms": F.when(moved, F.col("resumed")).otherwise(F.col("time_start_ms")),
        }
    ).drop("resumed")


CUE = "five minutes|introduc|microphone|name is|podium|speaker|welcom"


def _named(speakers: DataFrame, pairs: DataFrame, cue_always: bool) -> DataFrame:
    """The first segment that names each speaker, with where in it; fuzzy and phonetic matches need a cue."""
    by = Window.partitionBy("meeting_id", "pos", "spk_pos").orderBy("seq")
    rows = pairs.withColumn("low", F.lower(F.coalesce("text", F.lit("")))).withColumn("around", F.concat_ws(" ", F.coalesce(F.lag("low").over(by), F.lit("")), "low"))
    rows = rows.withColumn("m", name_tier(F.trim(F.regexp_replace(F.lower(text("name")), r"\s+", " ")), F.col("low"))).where("m.tier IS NOT NULL")
    cue = F.col("around").rlike(CUE)
    rows = rows.where(cue if cue_always else (F.col("m.tier") == "exact") | cue)
    at = F.col("start_ms") + (F.col("m.at") * (F.col("end_ms") - F.col("start_ms"))).cast("bigint")
    return rows.groupBy("meeting_id", "pos", "spk_pos").agg(F.min_by(F.struct(at.alias("ms"), "seq"), "seq").alias("hit")).select("meeting_id", "pos", "spk_pos", "hit.ms", "hit.seq")


def mark_timestamps(speakers: DataFrame, items: DataFrame, segments: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """Speakers (meeting_id, pos, spk_pos, name, …) with the time at which they are named.

    Their item's window is searched first, then the whole meeting, where a cue
    is always needed; items without any segment in their window are passed over.
    """
    w = _windowed(items.select("meeting_id", "pos", "time_start_ms", "time_end_ms"), window).where("w0 IS NOT NULL AND w1 IS NOT NULL").select("meeting_id", "pos", "w0", "w1")
    asked = speakers.where(F.trim(text("name")) != "").join(w, ["meeting_id", "pos"])
    inside = asked.join(segments, "meeting_id").where("start_ms < w1 AND end_ms > w0")
    first = _named(asked, inside, False)
    reached = inside.select("meeting_id", "pos").distinct()
    left = asked.join(reached, ["meeting_id", "pos"], "left_semi").join(first, ["meeting_id", "pos", "spk_pos"], "left_anti")
    second = _named(left, left.join(segments, "meeting_id"), True)
    found = first.unionByName(second).select("meeting_id", "pos", "spk_pos", F.col("ms").alias("found_ms"))
    kept = F.col("time_start_ms") if "time_start_ms" in speakers.columns else F.lit(None).cast("bigint")
    rows = speakers.join(found, ["meeting_id", "pos", "spk_pos"], "left").withColumn("time_start_ms", F.coalesce("found_ms", kept)).drop("found_ms")
    order = Window.partitionBy("meeting_id", "pos").orderBy(F.col("time_start_ms").asc_nulls_last(), "spk_pos")
    return rows.withColumn("spk_order", F.row_number().over(order) - 1)


def clean_heard_org(c: Column) -> Column:
    """What is heard of an organization's name, in title case."""
    cut = c
    for stop in (*(f" {w} " for w in "and you we i your thank members ms mr".split()), ",", "."):
        cut = F.split_part(cut, F.lit(stop), F.lit(1))
    small = ("and", "for", "in", "of", "on", "the")
    words = F.filter(F.split(F.trim(cut), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))), " ")


DISCLAIMED = r"as a private citizen|not (?:here |speaking )?on behalf of|not (?:to )?speak(?:ing|) (?:for|on behalf)|not represent"
ORG = r"([a-z](?:[a-z &']|-){2,60})"


def organization_near(tail: Column, later: Column) -> Column:
    """The organization said after a name, blank where the speaker disclaims one within two minutes."""
    whole_word = lambda c, p, i: F.when(c.rlike(f"(?:{p})(?=[a-z])"), F.regexp_replace(F.regexp_extract(c, p, i), r"\s*\S+$", "")).otherwise(F.regexp_extract(c, p, i))
    chair, of = r"^(?:[^\s]+\s+){0,4}?(?:from|representing|with)\s+" + ORG, r"^(?:[^\s]+\s+){0,2}?of\s+" + ORG
    from folkmoot.functions.match import TITLE_ENDS

    self_ = r"\b(?:i am|i'm)\s+(?:the\s+|an?\s+)?(?:[a-z][a-z \-]*\s)?(?:" + "|".join(sorted(TITLE_ENDS)) + r")\s+of\s+(?:the\s+)?" + ORG
    found = F.coalesce(*[F.nullif(whole_word(tail, p, 1), F.lit("")) for p in (chair, of, self_)], F.lit(""))
    return F.when(F.substring(later, 1, 1200).rlike(DISCLAIMED), "").otherwise(clean_heard_org(found))


def mark_heard(speakers: DataFrame, items: DataFrame, segments: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """Registered speakers without remarks are heard where their item's words name them; an organization is read near the name."""
    w = _windowed(items.select("meeting_id", "pos", "time_start_ms", "time_end_ms"), window).where("w0 IS NOT NULL AND w1 IS NOT NULL").select("meeting_id", "pos", "w0", "w1")
    inside = w.join(segments, "meeting_id").where("start_ms < w1 AND end_ms > w0").withColumn("low", F.lower(F.coalesce("text", F.lit(""))))
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "low"))), lambda x: x["low"]), " ")
    heard = inside.groupBy("meeting_id", "pos").agg(glued.alias("heard_text"))
    open_ = (text("source") == "registered") & (F.size(F.coalesce("said", F.array().cast("array<string>"))) == 0) & (F.trim(text("name")) != "")
    asked = speakers.where(open_).join(heard, ["meeting_id", "pos"])
    name = F.trim(F.regexp_replace(F.lower(text("name")), r"\s+", " "))
    asked = asked.withColumn("m", name_tier(name, F.col("heard_text"))).where("m.tier IS NOT NULL").select("meeting_id", "pos", "spk_pos", "name")
    first = _named(asked, asked.join(inside.drop("w0", "w1"), ["meeting_id", "pos"]), False).select("meeting_id", "pos", "spk_pos", F.col("seq").alias("hit"))
    after = asked.join(first, ["meeting_id", "pos", "spk_pos"]).join(inside, ["meeting_id", "pos"]).where("seq >= hit")
    rows = after.groupBy("meeting_id", "pos", "spk_pos", "name").agg(F.array_sort(F.collect_list(F.struct("seq", "start_ms", "low"))).alias("s"))
    rows = rows.withColumn("m", name_tier(name, F.col("s")[0]["low"]))
    own = F.substring(F.col("s")[0]["low"], F.floor(F.col("m.at") * F.length(F.col("s")[0]["low"])).cast("int") + 1, F.lit(1 << 20))
    add = lambda xs: F.array_join(F.concat(F.array(own), F.transform(xs, lambda x: x["low"])), " ")
    tail = F.substring(add(F.slice("s", 2, 2)), 1, 400)
    later = F.filter(F.slice("s", 2, 1 << 20), lambda x: x["start_ms"] - F.col("s")[0]["start_ms"] <= 120_000)
    orgs = rows.select("meeting_id", "pos", "spk_pos", organization_near(tail, F.concat_ws(" ", tail, F.array_join(F.transform(later, lambda x: x["low"]), " "))).alias("org"))
    marks = asked.select("meeting_id", "pos", "spk_pos", F.lit(True).alias("is_heard")).join(orgs, ["meeting_id", "pos", "spk_pos"], "left")
    got = speakers.join(marks, ["meeting_id", "pos", "spk_pos"], "left")
    was = truth("heard") if "heard" in speakers.columns else F.lit(False)
    return got.withColumns({"heard": was | truth("is_heard"), "organization": F.when(F.trim(text("organization")) != "", F.col("organization")).otherwise(F.coalesce(F.nullif("org", F.lit("")), text("organization")))}).drop("is_heard", "org")


QUESTIONS = r"(?i)\b(?:go|moved?|proceed|turn)\s+to\s+questions\s+(?:to|of|for)\s+(?:the )?administration\b"


def mark_questions(items: DataFrame, segments: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """Items that have speakers, with the time at which the body moves to questions."""
    asked = slice_strict(items.where(F.size(F.coalesce("speakers", F.array().cast(dict(items.dtypes)["speakers"]))) > 0).select("meeting_id", "pos", "time_start_ms", "time_end_ms"), segments, window)
    found = asked.where(F.coalesce("text", F.lit("")).rlike(QUESTIONS)).groupBy("meeting_id", "pos").agg(F.min_by("start_ms", "seq").alias("questions_start_ms"))
    return items.join(found, ["meeting_id", "pos"], "left")


def attach_gists(attachments: DataFrame, gists: DataFrame) -> DataFrame:
    """Attachments with the gist filed under their document's id."""
    doc = F.regexp_extract("url", r"DocumentId=(\d+)", 1)
    return attachments.withColumn("_doc", doc).join(gists.select(F.col("doc_id").alias("_doc"), "gist"), "_doc", "left").drop("_doc")
