"""Personal data and secrets by a semi-Markov conditional random field.

Segments, not tokens, are scored: features look at a whole candidate span (does
all of it read as an address, is its checksum right, would it go on beyond its
end) and at what stands before it. Dynamic programming over segments of bounded
length chooses boundaries and types jointly; what belongs to no entity is
covered by segments of one token.

The weights are fitted here, by the gradient of the exact conditional
likelihood, on sentences made from templates with a seed; no text of the corpus
is used. A text is searched whole. An entity holds a digit, an at sign, a long
run of letters and digits, a private key's armour or the assignment of a secret,
and is at most ``REACH`` characters and ``LONGEST`` tokens long, so that far from
any of those everything is outside; only the regions around them are decoded,
with the same result as decoding the text at once. An unbroken run of 32 letters,
digits, dashes and underscores or more, and an armoured key, is one token and
counts as ``COUNTED`` characters, so keys of any length are found whole.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folkmoot.llm.common import Intake

OUTSIDE = 0
KINDS = ("outside", "email", "phone", "ip", "card", "secret", "national_id", "iban")
REACH, LONGEST, SPACES, COUNTED = 80, 24, 8, 24
ASSIGNED = r"(?:password|passwd|pwd|pass|token|secret|api[_-]?key|apikey|access[_-]?key|auth)"
PEM = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:(?!-----).)*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
RUN = r"[A-Za-z0-9_-]{32,}"
TRIGGER = re.compile(rf"{PEM}|{RUN}|\d|@|[A-Z0-9]{{16,}}|(?i:{ASSIGNED})\s{{0,8}}[=:]", re.S)
TOKEN = re.compile(rf"{PEM}|{RUN}|[^\W_]+|\s+|.", re.S)
OPEN, CLOSE = set("+(\"'"), set(")\"'")
SHAPES = [
    (name, re.compile(p, re.I if name in ("assign", "assign_quoted") else re.S if name == "pem" else 0))
    for name, p in (
        ("email", r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"),
        ("email_host", r"[\w.%+-]+@[\w-]+"),
        ("octets", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
        ("dotted", r"\d+(?:\.\d+){1,2}"),
        ("phone_plus", r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}"),
        ("phone_area", r"\(\d{3}\) ?\d{3}[ .-]\d{4}"),
        ("phone_plain", r"\d{3}[.-]\d{3}[.-]\d{4}"),
        ("card_run", r"[3-6]\d{12,18}"),
        ("card_groups", r"[3-6]\d{3}(?:[ -]\d{4}){3}"),
        ("digits_16", r"\d{16}"),
        ("digits", r"\d+"),
        ("ssn", r"\d{3}-\d{2}-\d{4}"),
        ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"),
        ("aws", r"AKIA[A-Z0-9]{16}"),
        ("prefixed_key", r"(?:sk|pk|ghp|gho|xox[abp])[_-][\w-]{16,}"),
        ("assign", ASSIGNED + r"\s*[=:]\s*[\w.+/-]{8,}"),
        ("assign_quoted", ASSIGNED + r"\s*[=:]\s*([\"'])[^\"'\s]{8,}\1"),
        ("hex", r"[0-9a-f]{16,}"),
        ("pem", PEM),
        ("signed_token", r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}"),
        ("date", r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}"),
        ("time", r"\d{1,2}:\d{2}(?::\d{2})?"),
        ("word", r"[^\W\d_]+"),
    )
]
FEATURES = ["bias"] + [n for n, _ in SHAPES] + [
    "luhn", "at", "space", "two_spaces", "no_digit", "digits_1_5", "digits_6_9", "digits_10_12", "digits_13_19", "digits_20", "more_right", "more_left",
    "opens_mark", "closes_mark", "odd_quotes", "after_assign", "letters_most", "starts_word", "ends_word", "capitals16", "more_group",
]
AT = {n: i for i, n in enumerate(FEATURES)}
TOKEN_KINDS = ("word", "digits", "mixed", "space", "at", "mark")
LETTERS = re.compile(r"[^\W\d_]")
BEFORE_ASSIGN = re.compile(ASSIGNED + r"\s*[=:]\s*[\"']?$", re.I)
CAPITALS = re.compile(r"[A-Z0-9]{16,}")
SHAPE = dict(SHAPES)
PAIRS, NEXT_PAIR = re.compile(r"(?:\+\d{1,3}|\d{2}) \d{2}$"), re.compile(r" \d{2}(?![\w.])")
NEXT_GROUP = re.compile(r" (?=[A-Z]*\d)[A-Z0-9]{1,4}(?!\w)")
FIRST_WORD, LAST_WORD = re.compile(r"[^\W\d_]+\s"), re.compile(r"\s[^\W\d_]+$")


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c in "0123456789"]
    return bool(d) and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


@lru_cache(maxsize=200_000)
def span_features(s: str) -> tuple[int, ...]:
    f = [AT[n] for n, p in SHAPES if p.fullmatch(s)]
    f.append(0)
    digits = sum(c.isdigit() for c in s)
    if 13 <= digits <= 19 and luhn(s):
        f.append(AT["luhn"])
    if "@" in s:
        f.append(AT["at"])
    spaces = sum(c.isspace() for c in s)
    if spaces:
        f.append(AT["space" if spaces == 1 else "two_spaces"])
    f.append(AT["no_digit" if not digits else "digits_1_5" if digits < 6 else "digits_6_9" if digits < 10 else "digits_10_12" if digits < 13 else "digits_13_19" if digits < 20 else "digits_20"])
    if s[0] in OPEN:
        f.append(AT["opens_mark"])
    if s[-1] in CLOSE:
        f.append(AT["closes_mark"])
    if s.count('"') % 2 or s.count("'") % 2 or s.count("(") != s.count(")"):
        f.append(AT["odd_quotes"])
    if 2 * len(LETTERS.findall(s)) > len(s):
        f.append(AT["letters_most"])
    if FIRST_WORD.match(s):
        f.append(AT["starts_word"])
    if LAST_WORD.search(s):
        f.append(AT["ends_word"])
    if CAPITALS.fullmatch(s):
        f.append(AT["capitals16"])
    return tuple(f)


def features(text: str, a: int, b: int) -> list[int]:
    f = list(span_features(text[a:b]))
    right, left = text[b : b + 2], text[max(0, a - 2) : a]
    if right[:1] and (right[0] in "@-_=" or right[0].isalnum() or (right[0] in ".:/" and right[1:].isalnum())):
        f.append(AT["more_right"])
    if left[-1:] and (left[-1] in "@-_=+(/" or left[-1].isalnum() or (left[-1] in ".:" and left[:1].isalnum())):
        f.append(AT["more_left"])
    if BEFORE_ASSIGN.search(text[max(0, a - 24) : a]):
        f.append(AT["after_assign"])
    if more_group(text, a, b):
        f.append(AT["more_group"])
    return f


def more_group(text: str, a: int, b: int) -> bool:
    """Whether a group beyond the span would go on with it: a pair of digits after pairs, or a group of an IBAN."""
    if b >= len(text) or text[b] != " ":
        return False
    if text[a] == "+":
        m, shape = PAIRS.search(text, a, b) and NEXT_PAIR.match(text, b), "phone_plus"
    else:
        m, shape = text[a : a + 2].isupper() and NEXT_GROUP.match(text, b), "iban"
    return bool(m and SHAPE[shape].fullmatch(text, a, m.end()))


def token_kind(t: str) -> int:
    if t[0].isspace():
        return 3
    if t.isdigit():
        return 1
    if t.isalpha():
        return 0
    return 2 if t[0].isalnum() or len(t) > 1 else 4 if t == "@" else 5


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that hold every possible entity, cut at white space, or anywhere a character ends a long run."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _inner(c: str) -> bool:
    return c.isalnum() or c in "_-"


class Region:
    """Tokens of a stretch of text and the candidate segments over them."""

    def __init__(self, text: str, start: int, stop: int):
        # Whole tokens at both ends, so that a stretch never begins or ends within one.
        while start and _inner(text[start - 1]) and _inner(text[start]):
            start -= 1
        while stop < len(text) and _inner(text[stop - 1]) and _inner(text[stop]):
            stop += 1
        self.at, self.kinds = [], []
        hot = []
        for m in TOKEN.finditer(text, start, stop):
            t = m.group()
            self.at.append(m.start())
            self.kinds.append(token_kind(t))
            hot.append(bool(TRIGGER.search(t)) or (t[0] in "=:" and bool(BEFORE_ASSIGN.search(text, max(0, m.start() - 24), m.end()))))
        n = len(self.at)
        room = np.concatenate([[0], np.cumsum([min(b - a, COUNTED) for a, b in zip(self.at, [*self.at[1:], stop])])]).tolist()
        self.at.append(stop)
        self.spans, self.features = [], []
        soon = [n] * (n + 1)  # the first hot token at or after i
        for i in range(n - 1, -1, -1):
            soon[i] = i if hot[i] else soon[i + 1]
        for i in range(n):
            a = self.at[i]
            if self.kinds[i] in (3, 4) or (self.kinds[i] == 5 and text[a] not in OPEN) or soon[i] >= i + LONGEST or soon[i] == n:
                continue
            spaces = 0
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                last, b = j - 1, self.at[j]
                if self.kinds[last] == 3:
                    spaces += 1
                    if spaces > SPACES or "\n" in text[self.at[last] : b]:
                        break
                if room[j] - room[i] > REACH:
                    break
                if last < soon[i] or self.kinds[last] in (3, 4) or (self.kinds[last] == 5 and text[self.at[last]] not in CLOSE):
                    continue
                self.spans.append((i, j))
                self.features.append(features(text, a, b))


class Crf:
    """Weights: of span features by kind, of tokens outside, and between neighbouring segments' kinds."""

    def __init__(self, span: np.ndarray, token: np.ndarray, follow: np.ndarray):
        self.span, self.token, self.follow = span, token, follow

    def scores(self, found: list[list[int]]) -> np.ndarray:
        if not found:
            return np.empty((0, len(KINDS)))
        starts = np.concatenate([[0], np.cumsum([len(f) for f in found])[:-1]])
        return np.add.reduceat(self.span[np.array([x for f in found for x in f])], starts, axis=0)

    def decode(self, r: Region, scores: np.ndarray) -> list[tuple[int, int, int, float]]:
        """The best segmentation's entities: (first character, end, kind, score over leaving it outside)."""
        n = len(r.kinds)
        plain = self.token[np.array(r.kinds, dtype=np.int64)] if n else np.empty(0)
        sums = np.concatenate([[0.0], np.cumsum(plain)])
        gains = [] if not len(scores) else scores[:, 1:].max(1)
        # No segment can be in the best segmentation if tokens outside in its place do at least as well whatever surrounds it.
        slack = (LONGEST + 1) * float(self.follow.max() - self.follow.min())
        arcs: list[list[int]] = [[] for _ in range(n + 1)]
        for c, (i, j) in enumerate(r.spans):
            if gains[c] + slack > sums[j] - sums[i]:
                arcs[j].append(c)
        kinds = len(KINDS)
        best = np.full((n + 1, kinds), -np.inf)
        best[0, OUTSIDE] = 0.0
        enter = np.empty((n + 1, kinds))
        back: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(n + 1)]
        come = np.empty((n + 1, kinds), dtype=np.int64)
        for j in range(n + 1):
            if j:
                best[j, OUTSIDE] = enter[j - 1, OUTSIDE] + plain[j - 1]
                back[j][OUTSIDE] = (j - 1, -1, int(come[j - 1, OUTSIDE]))
                for c in arcs[j]:
                    i = r.spans[c][0]
                    v = enter[i, 1:] + scores[c, 1:]
                    for y in np.flatnonzero(v > best[j, 1:]).tolist():
                        best[j, y + 1] = v[y]
                        back[j][y + 1] = (i, c, int(come[i, y + 1]))
            t = best[j][:, None] + self.follow
            come[j], enter[j] = t.argmax(0), t.max(0)
        j, y, out = n, int(best[n].argmax()), []
        while j:
            i, c, before = back[j][y]
            if c >= 0:
                out.append((r.at[i], r.at[j], y, float(scores[c, y] - (sums[j] - sums[i]))))
            j, y = i, before
        return out[::-1]


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "ción", "os", "é", "eau", "sch", "ung", "ä", "ost", "la", "mi")) for _ in range(rng.randint(1, 4)))


def _entity(rng: random.Random) -> tuple[str, str]:
    d = lambda n: _digits(rng, n)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    caps = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    small = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    octets = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    card = rng.choice("3456") + d(rng.choice((12, 14, 15, 15, 15)))
    key = rng.choice(("password", "token", "secret", "api_key", "pwd"))
    made = {
        "email": lambda: f"{_word(rng)}{rng.choice(('', '.', '_'))}{rng.choice((_word(rng), d(2)))}@{rng.choice((_word(rng), 'mail' + d(1)))}.{rng.choice(('example.com', 'org', 'net', 'co.uk', 'de'))}",
        "phone": lambda: rng.choice((f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{rng.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"+{rng.randint(1, 99)}-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{rng.randint(1, 99)} " + " ".join(d(2) for _ in range(rng.randint(4, 5))))),
        "ip": lambda: octets,
        "card": lambda: rng.choice((card, f"4{d(3)} {d(4)} {d(4)} {d(4)}", f"5{d(3)}-{d(4)}-{d(4)}-{d(4)}", "4" + d(15), d(16))),
        "secret": lambda: rng.choice((f'{key} = "{hexa(rng.choice((24, 32, 40)))}"', f"{key}={hexa(rng.choice((16, 18, 20)))}", f"{key}: {hexa(20)}", "AKIA" + caps(16), "AKIA" + caps(16), "ghp_" + hexa(30), f"{key}={small(rng.randint(8, 20))}", f"{key}: {small(rng.randint(8, 20))}", f'{key} = "{hexa(rng.choice((64, 96, 128)))}"', f"{key}: {hexa(rng.choice((64, 96)))}", f"eyJ{mixed(30)}.eyJ{mixed(60)}.{mixed(43)}", f"-----BEGIN {rng.choice(('', 'RSA ', 'EC '))}PRIVATE KEY-----\n{mixed(64)}\n{mixed(64)}\n{mixed(20)}==\n-----END PRIVATE KEY-----")),
        "national_id": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "iban": lambda: rng.choice(("DE", "FR", "ES", "GB")) + d(2) + rng.choice(("", " ")).join(["", rng.choice((d(4), d(4), caps(4))), *[d(4) for _ in range(rng.choice((3, 3, 4, 6)))], d(rng.choice((2, 2, 3)))]),
    }
    kind = rng.choice(KINDS[1:])
    return kind, made[kind]()


def _decoy(rng: random.Random) -> str:
    d = lambda n: _digits(rng, n)
    return rng.choice((f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", str(rng.randint(1, 3000)), f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"{rng.randint(1, 12)}:{rng.randint(10, 59)}", f"{rng.randint(1, 900)},{d(3)}", f"@{_word(rng)}", d(rng.randint(5, 11)), f"No. {d(5)}", f"{_word(rng)}{d(2)}", f"{rng.randint(1, 999)}%", f"v{rng.randint(1, 9)}.{d(1)}", f"password reset {d(2)}", f"{rng.choice(('token', 'secret', 'pass'))}: {_word(rng)[:6]}", "_" * 40, "-" * 40, "x" * 40, f"{_word(rng)}-{_word(rng)}-{_word(rng)}-{_word(rng)}-{_word(rng)}-{_word(rng)}-{_word(rng)}", f"{d(3)}-{d(4)}", f"999.{rng.randint(256, 999)}.{d(3)}.{d(1)}", "THE" + "AND" * 6 if rng.random() < 0.3 else d(20)))


def sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made sentence and its entities: (first character, end, kind)."""
    text, spans = "", []
    for _ in range(rng.randint(4, 9)):
        roll = rng.random()
        lead = " " if text and not text.endswith("\n") else ""
        if roll < 0.3:
            kind, s = _entity(rng)
            a = len(text) + len(lead)
            text += lead + s
            spans.append((a, len(text), KINDS.index(kind)))
            if rng.random() < 0.35:
                text += rng.choice((".", ",", "###", "$$$", "%%%", "&&&", "***", "!!", ";", ")"))
        elif roll < 0.5:
            text += lead + _decoy(rng)
        else:
            text += lead + " ".join(_word(rng) for _ in range(rng.randint(1, 3))) + rng.choice(("", "", ".", ",", "\n"))
    return text, spans


def fit(sentences: int = 350, epochs: int = 12, seed: int = 13, rate: float = 0.3, l2: float = 1e-3) -> Crf:
    """Maximise the conditional likelihood of made sentences' segmentations by AdaGrad, one sentence at a time."""
    rng = random.Random(seed)
    kinds = len(KINDS)
    data = []
    for _ in range(sentences):
        text, spans = sentence(rng)
        r = Region(text, 0, len(text))
        where = {(r.at[i], r.at[j]): c for c, (i, j) in enumerate(r.spans)}
        if lost := [text[a:b] for a, b, _ in spans if (a, b) not in where]:
            raise ValueError(f"no candidate spans for {lost}")
        data.append((r, {where[a, b]: y for a, b, y in spans}))
    params = [np.zeros((len(FEATURES), kinds)), np.zeros(len(TOKEN_KINDS)), np.zeros((kinds, kinds))]
    seen = [np.full_like(p, 1e-2) for p in params]
    for _ in range(epochs):
        rng.shuffle(data)
        for r, gold in data:
            crf = Crf(*params)
            grads = [-l2 * p for p in params]
            s = crf.scores(r.features)
            _expect(r, gold, crf, s, grads)
            for p, g, h in zip(params, grads, seen):
                h += g * g
                p += rate * g / np.sqrt(h)
    return Crf(*params)


def _logsum(x: np.ndarray, axis: int = 0) -> np.ndarray:
    m = x.max(axis)
    m = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis)) + m


def _expect(r: Region, gold: dict[int, int], crf: Crf, s: np.ndarray, grads: list[np.ndarray]) -> None:
    """Add to the gradients what the true segmentation has less what the model expects."""
    n, kinds = len(r.kinds), len(KINDS)
    into: list[list[int]] = [[] for _ in range(n + 1)]
    out: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (i, j) in enumerate(r.spans):
        into[j].append(c)
        out[i].append(c)
    plain = crf.token[np.array(r.kinds)]
    alpha = np.full((n + 1, kinds), -np.inf)
    alpha[0, OUTSIDE] = 0.0
    enter = np.empty((n + 1, kinds))
    for j in range(n + 1):
        if j:
            alpha[j, OUTSIDE] = enter[j - 1, OUTSIDE] + plain[j - 1]
            if into[j]:
                alpha[j, 1:] = _logsum(np.array([enter[r.spans[c][0], 1:] + s[c, 1:] for c in into[j]]))
        enter[j] = _logsum(alpha[j][:, None] + crf.follow)
    # leave[i, y]: the rest, once a segment of kind y ends at i. begin[i, y]: the rest from i, its first segment of kind y.
    leave = np.full((n + 1, kinds), -np.inf)
    begin = np.full((n + 1, kinds), -np.inf)
    leave[n] = 0.0
    for i in range(n - 1, -1, -1):
        begin[i, OUTSIDE] = plain[i] + leave[i + 1, OUTSIDE]
        if out[i]:
            begin[i, 1:] = _logsum(np.array([s[c, 1:] + leave[r.spans[c][1], 1:] for c in out[i]]))
        leave[i] = _logsum(crf.follow + begin[i][None, :], 1)
    z = leave[0, OUTSIDE]
    for c, (i, j) in enumerate(r.spans):
        p = np.exp(enter[i, 1:] + s[c, 1:] + leave[j, 1:] - z)
        d = -p
        if c in gold:
            d[gold[c] - 1] += 1.0
        if np.abs(d).max() > 1e-6:
            grads[0][r.features[c], 1:] += d
    for i in range(n):
        grads[1][r.kinds[i]] -= math.exp(min(0.0, enter[i, OUTSIDE] + plain[i] + leave[i + 1, OUTSIDE] - z))
        grads[2] -= np.exp(np.minimum(0.0, alpha[i][:, None] + crf.follow + begin[i][None, :] - z))
    j, y = 0, OUTSIDE
    starts = {r.spans[c][0]: (r.spans[c][1], k) for c, k in gold.items()}
    while j < n:
        stop, k = starts.get(j, (j + 1, OUTSIDE))
        grads[2][y, k] += 1.0
        if k == OUTSIDE:
            grads[1][r.kinds[j]] += 1.0
        j, y = stop, k


def find(crf: Crf, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """Entities of every text, left to right."""
    out: list[list] = [[] for _ in texts]
    some = [(n, Region(t, a, b)) for n, t in enumerate(texts) if t for a, b in regions(t)]
    scores = crf.scores([f for _, r in some for f in r.features])
    at = 0
    for n, r in some:
        if r.spans:
            out[n] += crf.decode(r, scores[at : at + len(r.spans)])
        at += len(r.spans)
    return out


def redact(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    for a, b, y, _ in reversed(spans):
        text = text[:a] + f"[{KINDS[y]}]" + text[b:]
    return text


def mask_private(df: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 128) -> DataFrame:
    """(doc_id, text, spans) of every row: the text with each entity replaced by its kind in brackets, and
    the entities' places in the text as it was (``start``, ``stop`` in characters), kinds and scores.

    A null text stays null with no spans. Null and repeated ids are kept, a row
    for each row; equal texts get equal results, and of segmentations that tie
    the first found is taken. Other columns aren't read.
    """
    rows = Intake(df, id_col, text_col).narrow(doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                texts = batch.column(1).to_pylist()
                got = find(crf, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([redact(t, g) if g else t for t, g in zip(texts, got)], pa.string()),
                        pa.array([[{"start": a, "stop": b, "kind": KINDS[y], "score": round(s, 6)} for a, b, y, s in g] for g in got], span),
                    ],
                    names=["doc_id", "text", "spans"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, text string, spans array<struct<start:int,stop:int,kind:string,score:double>>")
