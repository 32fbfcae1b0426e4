"""Scalar text, date and number functions, as columns of columns; all stay in generated code but ``unescape``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "[-–—]"
SMALL_WORDS = "a an and at for in of on the to".split()
SHORT_STOPS = (
    "about after all also and any are been before being but can could did does each for from had has have how into its just may more not other our over should "
    "some such than that the their then there these they this those very was were what when where which who will with would"
).split()


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def rewrite(c: Column, *steps: tuple[str, str]) -> Column:
    """Regular expressions replaced one after the other; the order matters."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_html(c: Column | str) -> Column:
    """Tags gone, the ends of blocks a space. No boundary follows the tag's name, so ``</pre>`` ends a block too."""
    return squeeze(rewrite(text(c), (r"(?i)</(?:br|div|li|p|t[drh])[^>]*>", " "), (r"<[^>]+>", "")))


def clean_entities(c: Column | str) -> Column:
    """Six entities decoded, in an order in which ``&amp;lt;`` becomes ``<``."""
    pairs = (("&#58;", ":"), ("&#160;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"))
    return squeeze(reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text(c)))


def titleize(c: Column | str) -> Column:
    """Text in capitals only is put in title case, small words but the first stay small; other text is left alone."""
    clean = clean_entities(c)
    pieces = F.split(clean, r"(?<![A-Za-z'])(?=[A-Za-z])|(?<=[A-Za-z'])(?![A-Za-z'])")

    def put(word: Column, i: Column) -> Column:
        low = F.lower(word)
        big = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20)))
        return F.when(~word.rlike("^[A-Za-z]"), word).when((i > 0) & low.isin(SMALL_WORDS), low).otherwise(big)

    return F.when(clean == F.upper(clean), F.array_join(F.transform(pieces, put), "")).otherwise(clean)


def unescape(c: Column) -> Column:
    """All HTML entities decoded; Arrow batches, as there are too many for a fold of replacements."""

    @F.pandas_udf("string")
    def decoded(s):
        import html

        return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x))

    return decoded(c)


def spaced(words: str) -> str:
    """A pattern for words with white space between."""
    return r"\s+".join(words.split())


PLAIN_STEPS = (
    (rf"(?i)^bylaw\s+no\.\s*\d+\s*{DASH}\s*", ""),
    (r"(?i)\bbylaw\b,?\s*", ""),
    (r"(?i)\(no\.\s*\d+\)", ""),
    (r"(?:\s*\[[^\]\[]*\])+\s*$", ""),
    (rf"(?i)^{spaced("award of contract")}\s*{DASH}\s*", ""),
    (r"(?i)\(contract\s+no\.\s*[\w-]+\)", ""),
    (rf"(?i)^{spaced("request for expressions? of interest")}\s*{DASH}\s*", ""),
    (rf"(?i)^{spaced("request for proposals?")}\s*{DASH}\s*", ""),
    (rf"(?i)^enquiry\s*{DASH}\s*councillor(?:\s+\S+){{1,2}}?\s*\([^)]*\)\s*{DASH}\s*", ""),
    (rf"(?i)^enquiry\s*{DASH}\s*", ""),
    (rf"(?i)^councillor(?:\s+\S+){{1,2}}\s*{DASH}\s*{spaced("notice of motion")}\s*{DASH}\s*", ""),
    (rf"(?i)^councillor(?:\s+\S+){{2}}\s*{DASH}\s*", ""),
    (rf"(?iU)^{spaced("report of the")}\s+\w[\s\w]{{0,30}}?{DASH}\s*", ""),
    (rf"(?i)^appointments?\s*{DASH}\s*", ""),
    (rf"(?i)^{spaced("standing policy committee")}\s+(?:on\s+)?", ""),
    (r"(?i)^the\s+", ""),
    (r"(?U)\s*\[\w\w\w?\w?\d\d\d\d-\d{3,5}\]\s*", ""),
    (r"[,\s]+\d{4}\s*$", ""),
    (rf"\s*{DASH}\s*$", ""),
    (r"\s{2,}", " "),
)


def plainify(c: Column | str, entities: bool = True) -> Column:
    """T4: a title without filing numbers, forms and offices; the title itself if nothing would be left."""
    whole = F.trim(text(c))
    out = F.regexp_replace(rewrite(unescape(whole) if entities else whole, *PLAIN_STEPS), r"^[ –—,.\-]+|[ –—,.\-]+$", "")
    return F.when(out == "", whole).otherwise(F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 20)))


def one_decimal(c: Column) -> Column:
    """Half even on the binary value, as the usual ``%.1f``; ``format_string`` and ``bround`` differ."""
    return F.replace(F.format_number(c, 1), F.lit(","), F.lit(""))


def format_money(c: Column | str) -> Column:
    """T5: ``$1,500,000`` as ``$1.5M``; under 100 thousand, spelled with a word, or no number: as it is."""
    raw = text(c)
    n = F.translate(raw, "$,", "").try_cast("double")
    short = lambda by, unit: F.replace(F.concat(F.lit("$"), one_decimal(n / by), F.lit(unit)), F.lit(f".0{unit}"), F.lit(unit))
    return (
        F.when(raw.rlike("(?i)million|billion") | n.isNull(), F.trim(raw))
        .when(n >= 1e9, short(1e9, "B"))
        .when(n >= 1e6, short(1e6, "M"))
        .when(n >= 1e5, F.concat(F.lit("$"), F.replace(F.format_number(n / 1000, 0), F.lit(","), F.lit("")), F.lit("K")))
        .otherwise(F.trim(raw))
    )


def trim_to_chip(c: Column | str, limit: int = 100) -> Column:
    """Cut at the last sentence end in reach, else at the last clause end; too long without either: nothing."""
    whole = F.regexp_replace(F.trim(text(c)), "^[,;:]+|[,;:]+$", "")
    head = F.substring(whole, 1, limit)

    def before(sep: str) -> Column:
        at = F.locate(sep[::-1], F.reverse(head))
        index = F.length(head) - at - len(sep) + 1
        return F.when((at > 0) & (index > 20), F.regexp_replace(F.substring(whole, F.lit(1), index), "[,;:]+$", ""))

    cut = F.coalesce(*[before(s) for s in [f"{mark} " for mark in ".!?;,"]], F.lit(""))
    return F.when(F.length(whole) <= limit, whole).otherwise(cut)


def chip(c: Column | str, limit: int = 100) -> Column:
    return trim_to_chip(clean_entities(c), limit)


def spoken_chip(c: Column | str, limit: int = 100) -> Column:
    return trim_to_chip(strip_filler_leads(clean_entities(c)), limit)


def iso_date(c: Column | str) -> Column:
    """A date from ``yyyy-m-d``, null from anything else; a bare year isn't a date here."""
    raw = text(c)
    return F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(raw))


def readable_date(c: Column | str) -> Column:
    """``2025-06-07`` as ``June 7, 2025``."""
    return F.coalesce(F.date_format(iso_date(c), "MMMM d, yyyy"), text(c))


FILLERS = "actually|and|basically|but|i think|ok|okay|right|so|uh+|um+|well|yeah|yep|you know"


def strip_filler_leads(c: Column | str) -> Column:
    """T8."""
    return F.regexp_replace(text(c), rf"(?i)^(?:(?:and|but|i think)\s+|(?:{FILLERS}),?\s+)+", "")


def sentence_around(c: Column, start: Column, end: Column) -> Column:
    """The sentence that holds characters start to end, counted from 0."""
    left, right = F.substring(c, F.lit(1), start), F.substring(c, end + 1, F.lit(1 << 24))
    return F.trim(F.concat(F.regexp_extract(left, r"(?s)([^.!?]*)$", 1), F.substring(c, start + 1, end - start), F.regexp_extract(right, r"(?s)^([^.!?]*[.!?]?)", 1)))


def split_sentences(c: Column | str, min_len: int | None = None, max_len: int | None = None) -> Column:
    """T10."""
    parts = F.filter(F.transform(F.split(squeeze(text(c)), r"(?<=[.!?])\s+"), lambda p: F.trim(p)), lambda p: p != "")
    if min_len is not None:
        parts = F.filter(parts, lambda p: F.length(p) >= min_len)
    return parts if max_len is None else F.filter(parts, lambda p: F.length(p) <= max_len)


def tokens(c: Column | str) -> Column:
    """Words of three letters or more that aren't stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(SHORT_STOPS))


def clock(ms: Column) -> Column:
    """Milliseconds as ``h:mm:ss``, or ``m:ss`` under an hour; null stays null."""
    s = F.floor(ms / 1000)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two((s % 60).cast("long")))).when(ms.isNotNull(), F.concat_ws(":", m.cast("string"), two((s % 60).cast("long"))))


def week_deadline(d: Column) -> Column:
    """The Monday of the date's week."""
    return F.date_trunc("week", d).cast("date")


def noon(c: Column | str, offset: str = "-06:00") -> Column:
    """A feed's time stamp; the epoch's day where there is no date."""
    return F.concat(F.coalesce(F.date_format(iso_date(c), "yyyy-MM-dd"), F.lit("1970-01-01")), F.lit(f"T12:00:00{offset}"))


def escape(c: Column | str) -> Column:
    """T15."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), text(c))


def item_url(site: str, meeting_id: Column, item_id: Column) -> Column:
    return F.concat(F.lit(f"{site}/meeting/"), meeting_id, F.lit(".html#item-"), F.coalesce(item_id.cast("string"), F.lit("None")))


def joined(*parts: Column, sep: str = " · ") -> Column:
    """Parts that aren't blank."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def field(c: Column | str, limit: int) -> Column:
    """T17."""
    clean = clean_entities(c)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, 1, limit), F.lit("… [truncated]")))


def as_bullets(c: Column | str) -> Column:
    """A description that is JSON text or plain text, as an array without blanks."""
    raw = text(c)
    listed = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>"))
    return clean_bullets(F.coalesce(listed, F.array(raw)))


def clean_bullets(bullets: Column) -> Column:
    return F.filter(F.transform(F.coalesce(bullets, F.array().cast("array<string>")), lambda b: F.trim(F.coalesce(b, F.lit("")))), lambda b: b != "")


def sane_bullets(bullets: Column, most: int = 4) -> Column:
    """T18, of a model's answer: leading marks gone, at most four, null if none is left."""
    out = F.slice(clean_bullets(F.transform(bullets, lambda b: F.regexp_replace(clean_entities(b), r"^[-•*–—]\s*", ""))), 1, most)
    return F.when(F.size(out) > 0, out)


def discussion_minutes(start: Column, end: Column, inherited: Column, recess: Column) -> Column:
    """Minutes of an item's own span; 0 without one, and for spans over three hours, which are broken."""
    minutes = (end - start) / F.lit(60000.0)
    own = ~F.coalesce(inherited, F.lit(False)) & ~F.coalesce(recess, F.lit(False))
    return F.when(own & (end > start) & (minutes <= 180), minutes).otherwise(F.lit(0.0))


def shorten(c: Column | str, limit: int = 240) -> Column:
    """T20."""
    raw = text(c)
    return F.when(F.length(raw) <= limit, raw).otherwise(F.concat(F.rtrim(F.substring(raw, 1, limit - 3)), F.lit("...")))


def fallback_summary(c: Column | str) -> Column:
    """At most 120 characters, cut at a space."""
    clean = clean_entities(c)
    return F.when(F.length(clean) <= 120, clean).otherwise(F.concat(F.regexp_replace(F.substring(clean, 1, 117), r" [^ ]*$", ""), F.lit("...")))


def item_summary(c: Column | str) -> Column:
    """A cached summary as its fields; an empty one where the value is plain text of an older kind, another value or missing."""
    whole = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(F.trim(whole).startswith("{"), F.from_json(whole, "description array<string>, chips array<struct<category:string,text:string>>")), F.struct(F.lit(None).cast("array<string>").alias("description"), F.lit(None).cast("array<struct<category:string,text:string>>").alias("chips")))
