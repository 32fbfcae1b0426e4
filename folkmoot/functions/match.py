"""Name and text matching. Vectorised UDFs live here only; all else is built from columns."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import nsmallest

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folkmoot.functions.text import SHORT_STOPS, text

CODES = {c: d for d, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}
LONG_SURNAME = 7
HONORIFICS = frozenset("chief councillor dr elder mayor".split())
TITLE_ENDS = (
    "owner president chair chairman chairperson chairwoman ceo cfo coo executive director manager administrator coordinator officer supervisor superintendent commissioner treasurer"
).split()
WORDS = re.compile(r"[a-z'\-]+")
LONG_WORDS = re.compile("[a-z]{3,}")
STOPS = frozenset(SHORT_STOPS)


@lru_cache(maxsize=100_000)
def phonetic_key(word: str) -> str:
    """M2: like Soundex, but a vowel in front is V, h and w are passed over, and nothing is padded."""
    if not word:
        return ""
    before, out = CODES.get(word[0]), []
    for c in word[1:]:
        if c in "hw":
            continue
        code = CODES.get(c)
        if code and code != before:
            out.append(code)
        before = code
    return ("V" if word[0] in "aeiou" else word[0]) + "".join(out[:3])


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> float:
    """M1's measure, which isn't symmetric: the order of the two matters."""
    return SequenceMatcher(None, a, b).ratio()


def close_word(probe: str, words: list[tuple[str, int]], least: float) -> int | None:
    """M1: where the first similar word of about the same length begins."""
    return next((at for w, at in words if len(w) > 3 and abs(len(w) - len(probe)) < 4 and alike(probe, w) >= least), None)


def match_tier(name: str, heard: str) -> tuple[str, float] | None:
    """M3: how ``name`` occurs in ``heard`` (both in lower case), and how far in: exact, fuzzy or phonetic."""
    share = lambda at: at / max(len(heard), 1)
    if (at := heard.find(name)) >= 0:
        return "exact", share(at)
    parts = name.split()
    given = parts[1] if parts[0] in HONORIFICS and len(parts) > 2 else parts[0]
    family = parts[-1].split("-")
    long = [s for s in family if len(s) >= LONG_SURNAME]
    for s in long:
        if (at := heard.find(s)) >= 0:
            return "exact", share(at)
    words = [(m[0], m.start()) for m in WORDS.finditer(heard)]
    for s in long:
        if (hit := close_word(s, words, 0.75)) is not None:
            return "fuzzy", share(hit)
    first_at = next((at for w, at in words if w == given), None)
    if len(given) >= 4 and first_at is not None:
        hits = [h for s in family if (h := close_word(s, words, 0.45)) is not None]
        if hits:
            return "fuzzy", share(min(first_at, *hits))
    key, keys = phonetic_key(given), {phonetic_key(s) for s in family}
    for (a, at), (b, _) in zip(words, words[1:]):
        if key and phonetic_key(a) == key and phonetic_key(b) in keys:
            return "phonetic", share(at)
    return None


@F.pandas_udf(T.StringType())
def phonetic(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else phonetic_key(w))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else alike(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("tier", T.StringType()), T.StructField("at", T.DoubleType())]))
def name_tier(name: pd.Series, heard: pd.Series) -> pd.DataFrame:
    """Null names, blank names and null texts match nothing."""
    got = [match_tier(n, h) if n and n.strip() and h is not None else None for n, h in zip(name, heard)]
    return pd.DataFrame({"tier": [g and g[0] for g in got], "at": [g and g[1] for g in got]})


def said_words(s: str) -> list[str]:
    """T11, the same as ``functions.text.tokens``."""
    return [w for w in LONG_WORDS.findall(s.lower()) if w not in STOPS]


def choose_sentences(parts: Iterable[str], title: str, k: int, min_len: int = 11) -> list[str]:
    """The k sentences that say most; shorter ones than min_len aren't chosen, but their words count."""
    long = [p for p in parts if len(p) >= min_len]
    if len(long) <= k:
        return long
    counts: Counter[str] = Counter()
    for p in parts:
        counts.update(said_words(p))
    titled, top, scored = set(said_words(title)), max(counts.values(), default=1), []
    for i, s in enumerate(long):
        if not (words := said_words(s)):
            continue
        freq = sum(counts[w] for w in words) / top / len(words)
        overlap = len(titled.intersection(words)) / len(titled) if titled else 0.0
        value = freq * 0.3 + 0.3 / (1.0 + math.log1p(i)) + overlap * 0.25 + (0.15 if 8 <= len(words) <= 30 else 0.075)
        scored.append((-math.floor(value * 1e12 + 0.5), i))
    return [long[i] for i in sorted(i for _, i in nsmallest(k, scored))]


@F.pandas_udf(T.StringType())
def best_sentences(parts: pd.Series, title: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([" ".join(choose_sentences(*x)) for x in zip(parts, title, k)], dtype="object")


def clean_organization(c: Column | str) -> Column:
    """M5: without a job title in front of the first comma."""
    flat = F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))
    head, tail = F.split_part(flat, F.lit(","), F.lit(1)), F.trim(F.regexp_replace(flat, "^[^,]*,?", ""))
    last = F.lower(F.regexp_extract(F.regexp_replace(F.trim(head), r"\.+$", ""), r"(\S+)$", 1))
    return F.when((tail != "") & last.isin(TITLE_ENDS), tail).otherwise(flat)


def organization_label(c: Column | str) -> Column:
    return F.coalesce(F.nullif(clean_organization(c), F.lit("")), F.lit("Resident"))


def organization_color(c: Column | str, colours: int = 10) -> Column:
    """M4: a stable colour by name, null without one."""
    name = F.lower(clean_organization(c))
    return F.when(name != "", F.crc32(name.cast("binary")) % colours)


def normalized(c: Column | str) -> Column:
    flat = F.regexp_replace(text(c), r"(?i)\[(?:cc|file no\.?)[^\]]*\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(flat), "[^a-z0-9 ]+", " "), r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


ECHO_LEAD = r"^(?:\w+ )?(?:adopted|approved|deferred|defeated|discussed|recommended|referred)\b[: ]*"


def title_echo(chip: Column | str, title: Column | str) -> Column:
    """M6: the chip says what the title does: under a quarter of its distinct words are new."""
    t, body = normalized(title), F.trim(F.regexp_replace(normalized(chip), ECHO_LEAD, ""))
    mine = F.array_distinct(words(body))
    new = F.size(F.array_except(mine, words(t))) / F.size(mine)
    return F.when((t == "") | (body == ""), False).otherwise(F.contains(t, body) | F.contains(body, t) | (new < 0.25))


def description_echo(bullets: Column, title: Column | str) -> Column:
    """M6: over half of the description's words, each time they occur, stand in the title."""
    from folkmoot.functions.text import clean_bullets

    d, t = words(normalized(F.array_join(clean_bullets(bullets), " "))), words(normalized(title))
    new = F.size(F.filter(d, lambda w: ~F.array_contains(t, w)))
    return F.when((F.size(d) == 0) | (F.size(t) == 0), False).otherwise(new / F.size(d) < 0.5)


def continued_bullets(bullets: Column, openers: tuple[str, ...] = ("also ", "and ", "it ", "that ", "the change ", "the decision ", "the move ", "the plan ", "these ", "they ", "this ", "those ", "which ")) -> Column:
    """Bullets after the first that go on from the one above."""
    rest = F.slice(bullets, 2, 1 << 20)
    return F.filter(rest, lambda b: F.exists(F.array(*[F.lit(o) for o in openers]), lambda o: F.startswith(F.lower(b), o)))


def name_candidates(c: Column | str, roster: Column | None = None) -> Column:
    """M7: distinct capitalised words inside sentences that no roster of known names holds."""
    found = F.regexp_extract_all(text(c), F.lit(r"(?<!^)(?<![.!?]\s{1,3})(?<![.!?]['\"’”)\]]\s{1,3})\b([A-Z][a-zA-Z'’-]+)"), F.lit(1))
    found = F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in ("I", "I'm", "I've", "I'd", "I'll", "OK")]))
    return F.array_sort(found if roster is None else F.filter(found, lambda w: ~F.array_contains(roster, F.lower(w))))


def file_key(c: Column | str) -> Column:
    """An attachment's name without number, extension and redaction mark, in lower case."""
    steps = ((r"(?U)\.\w{2,4}$", ""), (r"\(\d+\)\s*$", ""), (r"(?i)_redacted\s*$", ""), (r"(?U)^\w\w\w?\w?\d\d\d\d-\d{3,5}\s+", ""), (r"^\d+(?:[.]\d+)*\s+", ""))
    out = text(c)
    for p, r in steps:
        out = F.regexp_replace(out, p, r)
    return F.lower(F.trim(out))


PLAIN_STOPS = "and are for from that the this was with".split()
TITLE_STOPS = PLAIN_STOPS + "city committee council policy report standing".split()


def file_words(c: Column | str) -> Column:
    """The words that say what a filed comment is about."""
    dash = r"\s*[-–—]\s*"
    bare = F.regexp_replace(text(c), rf"(?i)^(?:comments|request to speak|rts|submitting comments){dash}", "")
    last = F.element_at(F.split(bare, dash, 3), -1)
    bare = F.regexp_replace(F.regexp_replace(last, r"(?i)_redacted(?:[(]\d+[)])?\.\w{2,4}$", ""), r"(?U)\.\w{2,4}$", "")
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit("[a-z]{3,}"), F.lit(0))), F.array(*map(F.lit, PLAIN_STOPS))))


def title_words(c: Column | str) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z]{3,}"), F.lit(0))), F.array(*map(F.lit, TITLE_STOPS)))


KEYWORD_STOPS = (
    "which who those these they them their this with will were was to the that or on of its it is in have has from for by be at as are and an a "
    "agenda city committee council item overview policy public recommendation report section standing update"
).split()


def keywords(c: Column | str) -> Column:
    """A title's distinctive words, longest first, ties as they stand."""
    flat = F.lower(F.regexp_replace(F.regexp_replace(text(c), r"\[.*?\]", ""), r"(?U)[^\w\s-]", " "))
    got = F.filter(F.split(F.trim(flat), r"(?U)\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(KEYWORD_STOPS))
    ranked = F.array_sort(F.transform(got, lambda w, i: F.struct(-F.length(w), i, w.alias("w"))))
    return F.transform(ranked, lambda x: x["w"])
