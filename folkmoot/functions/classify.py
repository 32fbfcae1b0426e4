"""Predicates over items, and what is read out of their titles, motions and votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folkmoot.functions.text import chip, format_money, sentence_around, text

PROCEDURAL = sorted(
    "call to order|roll call|o canada|in remembrance|public acknowledgments|public acknowledgements|adoption of agenda|adoption of minutes|confirmation of agenda|"
    "confirmation of minutes|declaration of conflict|declarations of conflict|communications to council|consent agenda|question period|inquiries|giving notice|"
    "motions (notice|urgent business|unfinished business|in camera session|council members|committee reports (not on consent|administrative reports|"
    "legislative reports|other reports|adjournment".split("|")
)
ROUTINE_UNDER = 500
DISCUSSED_MS = 60_000

CATEGORIES = (
    "Outcome|Vote Breakdown|Amendment Made|Cost & Funding|Debate Highlight|Who's Affected|Staff vs. Council|Procedural Note|"
    "Precedent Set|Unanswered Question|Public Sentiment|Dissenting View|Legal Risk Flagged|Equity Impact|Environmental Impact|Promise Made"
).split("|")
HARD = ("Outcome", "Vote Breakdown", "Amendment Made", "Procedural Note")
INTERPRETIVE = [c for c in CATEGORIES if c not in HARD]
TAKEAWAYS = (
    "Dissenting View|Debate Highlight|Unanswered Question|Staff vs. Council|Promise Made|Precedent Set|"
    "Legal Risk Flagged|Equity Impact|Environmental Impact|Cost & Funding|Public Sentiment|Who's Affected"
).split("|")
GROUPS = {
    "decision": ("Amendment Made", "Dissenting View", "Outcome", "Vote Breakdown"),
    "money": ("Cost & Funding",),
    "context": ("Debate Highlight", "Unanswered Question"),
    "voices": ("Public Sentiment", "Staff vs. Council"),
    "impact": ("Environmental Impact", "Equity Impact", "Legal Risk Flagged", "Who's Affected"),
    "future": ("Precedent Set", "Procedural Note", "Promise Made"),
}


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def truth(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("boolean"), F.lit(False))


def is_procedural(title: Column | str) -> Column:
    """F1."""
    return F.exists(strings(PROCEDURAL), lambda k: F.contains(F.lower(F.trim(text(title))), k))


def has_substance() -> Column:
    return (F.trim(text("recommendation")) != "") | (F.trim(text("content")) != "")


def is_section_header() -> Column:
    """nothing to say, and no time of its own."""
    return ~has_substance() & (F.col("time_start_ms").isNull() | truth("timestamp_inherited"))


def is_boilerplate(c: Column | str) -> Column:
    """F3."""
    return F.trim(text(c)).rlike("(?i)^that the (?:communication|correspondence|information|letter|minutes|petition|presentation|report) be (?:filed|noted|received)")


def resolves() -> Column:
    rec = F.trim(text("recommendation"))
    return ~truth("is_recess") & ~is_procedural("title") & (rec != "") & ~is_boilerplate(rec)


def is_consent() -> Column:
    """passed in a block, and says what was resolved."""
    return truth("timestamp_inherited") & resolves()


def is_scheduled() -> Column:
    """of a meeting to come, and says what is proposed."""
    return truth("scheduled") & ~is_section_header() & resolves()


def is_eligible() -> Column:
    """what a summary is written for; the order of the rules matters."""
    long = F.coalesce(F.col("time_end_ms") - F.col("time_start_ms") >= DISCUSSED_MS, F.lit(False))
    return (
        F.when(truth("is_recess") | is_procedural("title") | is_section_header(), False)
        .when(truth("scheduled"), is_scheduled())
        .when(is_consent(), True)
        .otherwise(~truth("timestamp_inherited") & long)
    )


def is_major(title: Column | str, recommendation: Column | str, contested: Column | str) -> Column:
    """F11."""
    worth = F.exists(strings(("acquisition", "budget", "bylaw", "contract", "tax")), lambda k: F.contains(F.lower(text(title)), k))
    return truth(contested) | F.concat_ws(" ", text(title), text(recommendation)).rlike(r"\$[\d,.]+") | worth


def money_too_small(raw: Column) -> Column:
    """under 100 without a word for thousands. A letter glued to the number isn't such a word, so ``$1.2M`` counts as 1.2."""
    n = F.regexp_replace(raw, r"[^\d.]", "").try_cast("double")
    return ~raw.rlike(r"(?i)billion|million|thousand|\b[bkm]\b") & F.coalesce(n < 100, F.lit(True))


def interpretive(chips: Column | str) -> Column:
    """chips of an interpretive category with a text."""
    given = F.coalesce(F.col(chips) if isinstance(chips, str) else chips, F.array().cast("array<struct<category:string,text:string>>"))
    return F.filter(given, lambda c: c["category"].isin(INTERPRETIVE) & (F.trim(F.coalesce(c["text"], F.lit(""))) != ""))


def qualifies() -> Column:
    """F6."""
    from folkmoot.functions.text import clean_bullets

    return (F.size(clean_bullets(F.col("description"))) > 0) | (F.size(interpretive("chips")) > 0)


def future_publishable(day: Column, has_agenda: Column, deadline: Column, today: Column) -> Column:
    """F7."""
    near = F.coalesce(F.datediff(deadline, today) <= 3, F.lit(False))
    return F.coalesce(day >= today, F.lit(False)) & (truth(has_agenda) | near)


STAFF = "auditor commissioner constable deputy director inspector manager sergeant solicitor superintendent".split()
OFFICES = (
    "administrator alderman clerk commissioner controller coordinator councillor deputy director engineer manager mayor officer planner solicitor superintendent supervisor treasurer"
).split()


def any_word(c: Column, among: list[str], strip: str = r"^[.,]+|[.,]+$") -> Column:
    return F.exists(F.split(F.lower(c), r"(?U)\s+"), lambda w: F.regexp_replace(w, strip, "").isin(among))


def is_office(name: Column) -> Column:
    """a role, not a person."""
    return any_word(name, OFFICES)


def is_city_unit(organization: Column, city: str = r"\w+") -> Column:
    """a part of the city itself. ``city`` is a pattern for its name."""
    from folkmoot.functions.match import clean_organization

    return clean_organization(organization).rlike(rf"(?i)\bcity\s+of\s+{city}\b|\bdivision$")


def is_staff_presenting(sentence: Column, name: Column, organization: Column) -> Column:
    """F10."""
    answered = sentence.rlike(r"(?i)\b(?:answered|responded)\b[^.]{0,40}\bquestions\s+of\s+(?:the )?(?:council|committee|board)\b")
    title = any_word(F.replace(F.concat_ws(" ", name, organization), F.lit(","), F.lit(" ")), STAFF, r"^\.+|\.+$")
    return sentence.rlike(r"(?i)\bpresented\s+the\s+(?:item|presentation|report)\b") & (answered | title)


def format_outcome(vote_result: Column | str, recommendation: Column | str) -> Column:
    """What became of an item. What was moved is read before what was carried."""
    vote, rec = text(vote_result), text(recommendation)
    v, r = F.upper(vote), F.upper(rec)
    n = [F.regexp_extract(vote, r"[(](\d+)\s+to\b\s*(\d+)[)]", i) for i in (1, 2)]
    tally = F.when(n[0] != "", F.concat(F.lit(" ("), n[0], F.lit("-"), n[1], F.lit(")"))).otherwise("")
    label = lambda s: F.concat(F.lit(s), tally)
    has = F.contains
    return (
        F.when((vote == "") & (rec == ""), "Discussed")
        .when(vote == "", "Recommended")
        .when(has(v, F.lit("DEFEATED")), label("Defeated"))
        .when(v.rlike("DEFERRED|TABLED"), "Deferred")
        .when(has(v, F.lit("WITHDRAWN")), "Withdrawn")
        .when(r.rlike(r"\bDEFER(?:RED)?\b|TABLED"), "Deferred")
        .when(r.rlike(r"\bRECOMMEND(?:ED|S)?\s+TO\s+(?:CITY )?COUNCIL\b"), label("Recommended to Council"))
        .when(r.rlike(r"\bBE\s+(?:FILED|NOTED|RECEIVED)\b"), "Received as information")
        .when(r.rlike(r"\bFIRST\s+READING\b|\bCONSIDER\s+BYLAW\b"), label("First reading passed"))
        .when(has(v, F.lit("UNANIMOUSLY")), "Approved")
        .when(has(v, F.lit("CARRIED")), label("Approved"))
        .when(v.rlike("RECEIVED|NOTED"), "Received")
        .otherwise(vote)
    )


#: A pattern for each category, in order of precedence.
TOPICS = {
    "Homelessness": r"drop.in|encampment|homeless|shelter\b|supportive housing|unshelter|vulnerable\s+p",
    "Housing": r"densif|housing\b|infill\b|rental|residential",
    "Zoning & Dev": r"building\s+standard|corridor\s+plan|development\s+review|land\s+(?:development|use)|neighbourhood\s+plan|redevelop|reserve\s+redesignation|rezon|subdivision|zoning\b",
    "Transit": r"\bbrt\b|bus rapid|grade.separation|public\s+transport|rail\s+(?:cross|grade)|\btransit\b",
    "Active Transport": r"active\s+transport|bicycle|bike\s+lane|\bbike\b|crosswalk|cycling|multi.use\s+(?:path|trail)|pedestrian|protected.*\blane|sidewalk|walkability",
    "Traffic": r"intersection|road\s+(?:clos|improv|safe)|speed\s+limit|\btraffic\b|\btransportation\b",
    "Greenspace": r"\belm\b|green\s*space|meewasin|natural\s+area|\bpark\b(?!ing)|river\s*bank|\btrail\b|tree\b|urban\s+forest",
    "Small Business": r"\bbid\b|business\s+improvement|commercial\s+district|merchant|small\s+business|storefront",
    "Infrastructure": r"bridge\b|capital\s+project|landfill|pipeline\b|road\s+construct|sewer|storm\s*water|utilit|waste\b|water\s+main|waterworks",
    "Public Safety": r"bylaw\s+enforce|community\s+safety|crime\b|fire\s+(?:dep|serv|stat)|police|\bsps\b",
    "Recreation": r"arena\b|golf\s+course|ice\s+sheet|leisure|playground|pool\b|recreation|sport\s+facil",
    "Property Tax": r"assessment\b|mill\s+rate|property\s+tax|tax\s+(?:levy|lien)",
    "Arts & Culture": r"art\s+gallery|cultur|festival\b|heritage\b|mural\b|public\s+art",
    "Environment": r"carbon\b|climate\b|electric\s+vehicle|emission|energy\s+effic|environmental|\bev\b|greenhouse\s+gas|solar\b|sustainab",
}


def categorize(*parts: Column | str, rules: dict[str, str] | None = None, most: int = 2) -> Column:
    """The first categories, in their order, of which a pattern occurs."""
    whole = F.concat_ws(" ", *[text(p) for p in parts])
    found = [F.when(whole.rlike(f"(?i){p}"), F.lit(c)) for c, p in (rules or TOPICS).items()]
    return F.slice(F.array_compact(F.array(*found)), 1, most)


def vote_tally() -> Column:
    """(yes, no) from the detail, else from the result; null where neither says."""
    detail, result = text("vote_detail"), text("vote_result")
    number = lambda p, c, i=1: F.regexp_extract(c, p, i).try_cast("int")
    yes, no = number(r"(?i)In\s+Favour\s*:\s*\((\d+)\)", detail), number(r"(?i)\bAgainst\s*:\s*\((\d+)\)", detail)
    pair = lambda a, b: F.struct(F.coalesce(a, F.lit(0)).alias("yes"), F.coalesce(b, F.lit(0)).alias("no"))
    t = r"\((\d+)\s*(?:-|to)\s*(\d+)\)"
    first, second = pair(yes, no), pair(number(t, result), number(t, result, 2))
    some = lambda p: (p["yes"] > 0) | (p["no"] > 0)
    return F.when(some(first), first).when(some(second), second)


def made(category: str, body: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), body.alias("text"))


AMENDED = (
    r"(?i)\bmoved\s+an?\s+amendment\b|\bmoved\s+amendment\b|\bamendment\s+to\s+the\s+(?:recommendation|motion)\b|"
    r"\bamendment\s+(?:was )?(?:adopted|approved|carried|defeated|lost)\b|\b(?:clause|motion|recommendation|resolution)\s+be\s+amended\b|\bas\s+amended\b"
)


def amendment_text() -> Column:
    """The sentence that tells of an amendment, null without one."""
    whole = F.concat_ws(" ", text("motion_text"), text("vote_result"), text("recommendation"))
    hit = F.regexp_extract(whole, f"({AMENDED})", 1)
    at = F.instr(whole, hit) - 1
    return F.when(whole.rlike(AMENDED), chip(sentence_around(whole, at, at + F.length(hit))))


MONEY = r"\$\s?[\d,]+(?:[.]\d+)?(?:\s*(?:thousand|billion|million|[bkm]))?"


def cost_chips(most: int = 3) -> Column:
    """Distinct amounts with what they are for."""
    whole = F.concat_ws(" ", *[text(c) for c in ("title", "recommendation", "motion_text", "content")])
    # An amount and up to 80 characters after it, which a lookahead leaves for the next.
    parts = [F.regexp_extract_all(whole, F.lit(rf"(?is)({MONEY})(?=(.{{0,80}}))"), F.lit(i)) for i in (1, 2)]
    purpose = r"(?iU)^\s*(towards?|to(?:\s+the)?|for)\s+([a-z](?:[\s\w'&]|-){2,40}?)(?=[\[\]().,;:–—]|\s+(?:and|be|that|to|which)\b|$)"

    def label(raw: Column, tail: Column) -> Column:
        what = F.concat_ws(" ", F.lower(F.regexp_replace(F.regexp_extract(tail, purpose, 1), r"\s+", " ")), F.trim(F.regexp_extract(tail, purpose, 2)))
        return F.when(~money_too_small(raw) & tail.rlike(purpose), chip(F.concat_ws(" ", format_money(raw), what)))

    labels = F.filter(F.array_compact(F.zip_with(*parts, label)), lambda x: x != "")
    return F.slice(F.array_distinct(labels), 1, most)


def procedural_note() -> Column:
    """The first keyword in alphabetical order, where several occur."""
    found = F.filter(strings(PROCEDURAL), lambda k: F.contains(F.lower(text("title")), k))
    return F.when(F.size(found) > 0, chip(F.initcap(F.element_at(found, 1))))


def deterministic_chips() -> Column:
    """C11: outcome, votes, amendment, costs and procedure, in the order of categories."""
    outcome, tally, held = format_outcome("vote_result", "recommendation"), vote_tally(), ~truth("scheduled")
    one = lambda category, body: F.array(F.when(F.coalesce(body, F.lit("")) != "", made(category, body)))
    return F.array_compact(
        F.concat(
            one("Outcome", F.when(held & (outcome != "Discussed"), chip(outcome))),
            one("Vote Breakdown", F.when(held & tally.isNotNull(), F.concat(tally["yes"].cast("string"), F.lit(" for, "), tally["no"].cast("string"), F.lit(" against")))),
            one("Amendment Made", amendment_text()),
            F.transform(cost_chips(), lambda t: made("Cost & Funding", t)),
            one("Procedural Note", procedural_note()),
        )
    )


def category_rank(category: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(strings(CATEGORIES), category), F.lit(0).cast("long")), F.lit(999).cast("long"))


def covered() -> Column:
    """C11: categories that a model needn't write."""
    tally = vote_tally()
    one_sided = F.contains(F.upper(text("vote_result")), F.lit("UNANIM")) | F.coalesce((tally["yes"] == 0) | (tally["no"] == 0), F.lit(False))
    return F.array_union(F.transform(deterministic_chips(), lambda c: c["category"]), F.when(one_sided, strings(["Dissenting View"])).otherwise(F.array().cast("array<string>")))


def merged_chips(written: Column) -> Column:
    """C11: chips found by rule with those that a model wrote, by category; ties as they stand."""
    both = F.concat(deterministic_chips(), F.coalesce(written, F.array().cast("array<struct<category:string,text:string>>")))
    return F.transform(F.array_sort(F.transform(both, lambda c, i: F.struct(category_rank(c["category"]), i, c.alias("c")))), lambda x: x["c"])


def first_per(items: Column, key) -> Column:
    """An array's elements but those whose key has been seen."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def sane_chips(parsed: Column, allowed: Column) -> Column:
    """C12, of a model's answer (category, text, usefulness): allowed and useful, one of a category, no text twice."""
    from folkmoot.functions.text import spoken_chip

    good = F.filter(F.coalesce(parsed, F.array().cast("array<struct<category:string,text:string,usefulness:string>>")), lambda c: F.array_contains(allowed, c["category"]) & c["usefulness"].isin("high", "medium"))
    cut = F.filter(F.transform(good, lambda c: F.struct(c["category"].alias("category"), spoken_chip(c["text"]).alias("text"))), lambda c: c["text"] != "")

    def put(got: Column, c: Column) -> Column:
        seen = F.exists(got, lambda g: (g["category"] == c["category"]) | (g["text"] == c["text"]))
        return F.when(seen, got).otherwise(F.concat(got, F.array(c)))

    return F.aggregate(cut, F.array().cast("array<struct<category:string,text:string>>"), put)


def chip_badges(most: int = 3) -> Column:
    """C13."""
    given = F.filter(F.coalesce(F.col("chips"), F.array().cast("array<struct<category:string,text:string>>")), lambda c: c["category"].isin(INTERPRETIVE))

    def badge(c: Column) -> Column:
        g = F.coalesce(*[F.when(c["category"].isin(list(cs)), F.lit(k)) for k, cs in GROUPS.items()], F.lit("context"))
        return F.struct(F.lit("chip").alias("type"), c["category"].alias("label"), c["text"].alias("tooltip"), g.alias("chip_group"))

    return F.transform(F.slice(first_per(given, lambda c: c["category"]), 1, most), badge)


def takeaway() -> Column:
    """C14: the chip to show: the first of the category that ranks highest."""
    ranked = F.transform(interpretive("chips"), lambda c, i: F.struct(F.array_position(strings(TAKEAWAYS), c["category"]), i, c.alias("c")))
    return F.array_min(F.transform(ranked, lambda x: x))["c"]


def item_topics() -> Column:
    """C14."""
    return F.array_distinct(F.transform(interpretive("chips"), lambda c: c["category"]))


def discussion_topics(content: Column | str, most: int = 3) -> Column:
    """C4: what a discussion is said to relate to."""
    listed = F.trim(F.regexp_extract(text(content), r"(?i)(?:concerning|regarding|related to)\s+(.+?)(?:\.|$)", 1))
    parts = F.transform(F.split(listed, r",\s*"), lambda p: F.regexp_replace(F.trim(p), r"(?i)^and\s+", ""))
    big = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20)))
    return F.slice(F.filter(big, lambda p: F.length(p).between(3, 50)), 1, most)


#: What an amount nearby is said to be, in order of preference: pattern > word.
VERBS = [
    tuple(x.split(">"))
    for x in (
        "not.{0,10}exceed>max;award>awarded;approv>approved;budget>budgeted;allocat>allocated;fund(?:ed|ing)>funded;grant>granted;contract>contract;expend|spend>spent;"
        "invest>invested;lev(?:ied|y)>levied;increas>increase;decreas|reduc|sav>savings;revenue>revenue;charge|fee>fee;compensat|pay|salar>salary;donat>donated;cost|estimat>estimated"
    ).split(";")
]
NO_PURPOSE = "a an and city development for in land municipal neighbourhood of the".split()


def money_contexts(whole: Column) -> Column:
    """Every amount as (raw, near, after): near from 80 characters before its start to 30 after, after the next 200.

    Lookarounds capture the context and leave it to the neighbours. The
    lookbehind takes 80 characters, or fewer from the very start.
    """
    p = F.lit(r"(?s)(?<=(^.{0,79}|.{80}))(\$[\d,]+(?:[.]\d+)?(?:\s*(?:billion|million))?)(?=(.{0,200}))")
    before, raw, after = (F.regexp_extract_all(whole, p, F.lit(i)) for i in (1, 2, 3))
    zipped = F.arrays_zip(before.alias("before"), raw.alias("raw"), after.alias("after"))
    near = lambda m: F.lower(F.concat(m["before"], F.substring(F.concat(m["raw"], m["after"]), 1, 30)))
    return F.transform(zipped, lambda m: F.struct(m["raw"].alias("raw"), near(m).alias("near"), m["after"].alias("after")))


def money_label(m: Column) -> Column:
    verb = F.coalesce(*[F.when(m["near"].rlike(p), F.lit(v)) for p, v in VERBS], F.lit(""))
    window = F.regexp_extract(m["after"], r"(?s)^(.*?)(?:;|\. | and That| That |$)", 1)
    named = F.regexp_extract(window, r"(?:for|for\s+the|to\s+the)\s+((?:[A-Z]\w*\s*){1,5}?)(?:Account|Fund|Initiative|Plan|Program|Reserve)", 1)
    purpose = F.array_join(F.slice(F.filter(F.split(F.trim(named), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(NO_PURPOSE)), 1, 2), " ")
    amount = format_money(m["raw"])
    return F.when(purpose != "", F.concat(amount, F.lit(" → "), purpose)).when(verb != "", F.concat_ws(" ", amount, verb)).otherwise(amount)


def badges(places: tuple[str, ...] = ()) -> Column:
    """Badges of category, money (4), person (2), place (1) and topic (3), in that order.

    ``places`` are names of parts of the town, in order of preference, for titles without a street address.
    """
    title, rec, content = text("title"), text("recommendation"), text("content")
    badge = lambda kind, label: F.struct(kind.alias("type"), label.alias("label"))
    slug = lambda c: F.concat(F.lit("cat-"), F.replace(F.replace(F.lower(c), F.lit(" & "), F.lit("-")), F.lit(" "), F.lit("-")))
    people = F.slice(F.regexp_extract_all(title, F.lit(r"Councillor\s+([A-Z][.]?\s*[a-zA-Z]+)"), F.lit(1)), 1, 2)
    kinds = "Avenue|Boulevard|Circle|Crescent|Drive|Place|Road|Street|Way"
    address = F.slice(F.regexp_extract_all(title, F.lit(rf"(\d+\s+(?:[A-Z]\w+\s+)*?(?:{kinds})(?:\s+(?:East|North|South|West))?)"), F.lit(1)), 1, 1)
    if places:
        known = F.slice(F.filter(strings(places), lambda p: F.contains(F.lower(title), F.lower(p))), 1, 1)
        address = F.when(F.size(address) > 0, address).otherwise(known)
    of = lambda kind, labels: F.transform(labels, lambda x: badge(F.lit(kind), F.trim(x)))
    return F.concat(
        F.transform(categorize(title, rec, content), lambda c: badge(slug(c), c)),
        F.transform(F.slice(money_contexts(F.concat_ws(" ", title, rec, content)), 1, 4), lambda m: badge(F.lit("money"), money_label(m))),
        of("person", people),
        of("location", address),
        of("topic", discussion_topics(content)),
    )


def card_badges(places: tuple[str, ...] = ()) -> Column:
    """With chips, one money badge is enough."""
    found = F.transform(badges(places), lambda b: F.struct(b["type"].alias("type"), b["label"].alias("label"), F.lit(None).cast("string").alias("tooltip"), F.lit(None).cast("string").alias("chip_group")))
    kinds = F.transform(found, lambda b: b["type"])
    single = F.filter(found, lambda b, i: (b["type"] != "money") | (F.array_position(kinds, F.lit("money")) == i + 1))
    return F.when(F.size(chip_badges()) == 0, found).otherwise(F.concat(single, chip_badges()))


def topic_summary() -> Column:
    """(lines, whether they are a description)."""
    from folkmoot.functions.text import clean_bullets, fallback_summary

    lines = clean_bullets(F.col("description"))
    spare = F.when(text("content") == "", F.array().cast("array<string>")).otherwise(F.array(fallback_summary("content")))
    return F.when(F.size(lines) > 0, F.struct(lines.alias("lines"), F.lit(True).alias("described"))).otherwise(F.struct(spare.alias("lines"), F.lit(False).alias("described")))


def stance(tail: Column) -> Column:
    low = F.lower(tail)
    return F.when(F.contains(low, F.lit("support")), "support").when(low.rlike("concern|oppos"), "concern").otherwise("")


SPOKE = r"\b(?:addressed|appeared before|expressed (?:concerns?|opposition|support)|presented|spoke in (?:opposition|support)|was called forward)\b"
