"""Benchmark decontamination by a BM25 index of test items with block-max WAND.

Every training text is cut into overlapping passages, and every passage is a
query. An item's own length alone says how long the passages are that it is
looked for in (``span_of``), so what is found of it doesn't depend on which items
share its index. An item's score is its BM25 score over the score it would give
itself, so one threshold serves items of all lengths. All items at or above the
threshold are retrieved, exactly:

1. Term lists are split as WAND splits them. Common terms, which together can't
   bring any item to a third of the threshold, are not essential: no passage is
   looked up by them.
2. Items stand in blocks. For every passage the postings of its essential terms
   are walked block by block and their block maxima added up, with what common
   terms can add at most; blocks that stay under the threshold are skipped. Only
   blocks on those postings cost anything, however many there are.
3. In the blocks left, items' own bounds are added up likewise; those that pass
   are scored in full.

These steps run over all passages of a batch at once. What is retrieved is then
verified: an item is leaked where the passage holds enough of the n-grams of its
question and of its answer.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkmoot.llm.common import Intake, stored

WORD = re.compile(r"\w+")
THRESHOLD = 0.6
OVERLAP = 0.5
INDEX_CHARS = 20_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and answer: its last sentence is the answer; of a single sentence, its last third."""
    parts = [w for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := words_of(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    w = parts[0] if parts else []
    cut = len(w) - len(w) // 3
    return w[:cut], w[cut:]


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    if not words:
        return set()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap(part: list[str], passage: list[str], n: int = 3) -> float:
    """The share of a part's n-grams that the passage holds; 1 for a part without words."""
    g = grams(part, n)
    if not g:
        return 1.0
    m = len(next(iter(g)))
    held = {tuple(passage[i : i + m]) for i in range(len(passage) - m + 1)}
    return len(g & held) / len(g)


@dataclass
class Statistics:
    """Of all test items, however many indexes they are spread over."""

    n: int = 0
    words: int = 0
    df: Counter = field(default_factory=Counter)

    def add(self, text: str) -> None:
        w = words_of(text)
        if w:
            self.n += 1
            self.words += len(w)
            self.df.update(set(w))

    def weights(self, words: list[str], k1: float = 1.2, b: float = 0.75) -> dict[str, float]:
        """BM25 weights of an item's terms, over their sum."""
        norm = k1 * (1 - b + b * len(words) / max(1e-9, self.words / max(1, self.n)))
        got = {t: math.log(1 + (self.n - self.df[t] + 0.5) / (self.df[t] + 0.5)) * f * (k1 + 1) / (f + norm) for t, f in Counter(words).items()}
        total = sum(got.values()) or 1.0
        return {t: x / total for t, x in got.items()}


def span_of(words: int) -> int:
    """An item of so many words is looked for in passages of twice this many, which begin every so many: any copy up to a quarter longer lies in one whole."""
    return max(32, 1 << math.ceil(math.log2(1.25 * words)))


def _flat(lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), np.array([v for x in lists for v in x])


def _expand(ptr: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every term its postings: (index into t, index into the postings)."""
    n = ptr[t + 1] - ptr[t]
    row = np.repeat(np.arange(len(t)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[t], n)


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(value[order], first) if len(first) else np.empty(0)


class Postings:
    """Term lists with block maxima, of the items of one span."""

    def __init__(self, items: list[int], weights: list[dict[str, float]], df: Counter, span: int, threshold: float, block: int):
        self.items, self.weights, self.span, self.threshold, self.block = items, weights, span, threshold, block
        # The commonest terms aren't essential, as long as no item has a third of the threshold from them.
        self.common = np.zeros(len(items))
        holders: dict[str, list[int]] = {}
        for i, w in enumerate(weights):
            for t in w:
                holders.setdefault(t, []).append(i)
        essential = []
        for t in sorted(holders, key=lambda t: (-df[t], t)):
            added = np.array([weights[i][t] for i in holders[t]])
            if (self.common[holders[t]] + added <= threshold / 3).all():
                self.common[holders[t]] += added
            else:
                essential.append(t)
        self.essential = essential
        self.ptr, self.item = _flat([holders[t] for t in essential])
        self.weight = np.array([weights[i][t] for t in essential for i in holders[t]], dtype=np.float64)
        self.item = self.item.astype(np.int64)
        blocks = []
        for t in essential:
            most: dict[int, float] = {}
            for i in holders[t]:
                most[i // block] = max(most.get(i // block, 0.0), weights[i][t])
            blocks.append(list(most.items()))
        self.bptr, flat = _flat(blocks)
        self.bid = flat[:, 0].astype(np.int64) if len(flat) else np.empty(0, np.int64)
        self.bmax = flat[:, 1].astype(np.float64) if len(flat) else np.empty(0)
        self.n_blocks = -(-len(items) // block)
        self.bcommon = np.array([self.common[b * block : (b + 1) * block].max() for b in range(self.n_blocks)])

    def candidates(self, p: np.ndarray, t: np.ndarray, entries: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) pairs that bounds don't rule out; (p, t) are passages' distinct essential terms, in order of passages."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        done = np.cumsum(self.bptr[t + 1] - self.bptr[t])
        begin = 0
        while begin < len(p):
            # Whole passages, of about so many entries of postings at once.
            last = p[min(len(p) - 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + entries)))]
            end = int(np.searchsorted(p, last, side="right"))
            out.append(self._candidates(p[begin:end], t[begin:end]))
            begin = end
        return tuple(np.concatenate(x) for x in zip(*out))

    def _candidates(self, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, nb, n = self.threshold - 1e-9, self.n_blocks, len(self.items)
        row, e = _expand(self.bptr, t)
        key, bound = _summed(p[row] * nb + self.bid[e], self.bmax[e])
        key = key[bound + self.bcommon[key % nb] >= low]
        if not len(key):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        some = np.isin(p, key // nb)
        p, t = p[some], t[some]
        row, e = _expand(self.ptr, t)
        at = p[row] * nb + self.item[e] // self.block
        left = key[np.minimum(np.searchsorted(key, at), len(key) - 1)] == at
        cell, part = _summed(p[row[left]] * n + self.item[e[left]], self.weight[e[left]])
        cell = cell[part + self.common[cell % n] >= low]
        return cell // n, cell % n


class Index:
    """Some of the test items, by span."""

    def __init__(self, items: list[tuple[object, str]], stats: Statistics, threshold: float = THRESHOLD, block: int = 4):
        self.threshold = threshold
        self.items = [(k, t) for k, t in items if t and words_of(t)]
        words = [words_of(t) for _, t in self.items]
        self.parts = [question_answer(t) for _, t in self.items]
        self.weights = [stats.weights(w) for w in words]
        self.spans = [span_of(len(w)) for w in words]
        by: dict[int, list[int]] = {}
        for i, span in enumerate(self.spans):
            by.setdefault(span, []).append(i)
        self.postings = [Postings(own, [self.weights[i] for i in own], stats.df, span, threshold, block) for span, own in sorted(by.items())]
        self.term: dict[str, int] = {}
        for x in self.postings:
            for t in x.essential:
                self.term.setdefault(t, len(self.term))
        # By span, a term's number there, or -1.
        self.local = [np.full(len(self.term) + 1, -1, dtype=np.int64) for _ in self.postings]
        for x, local in zip(self.postings, self.local):
            local[[self.term[t] for t in x.essential]] = np.arange(len(x.essential))

    def search(self, docs: list[list[str]]) -> list[list[tuple[int, int, float]]]:
        """For every text (item, first word of the passage, score) of all passages and items at or above the threshold."""
        found: list[list[tuple[int, int, float]]] = [[] for _ in docs]
        if not self.items or not docs:
            return found
        get, none = self.term.get, repeat(len(self.term))
        words = np.concatenate([np.fromiter(map(get, w, none), dtype=np.int64, count=len(w)) for w in docs])
        doc = np.repeat(np.arange(len(docs)), [len(w) for w in docs])
        start = np.cumsum([0, *[len(w) for w in docs]])
        hot = np.flatnonzero(words < len(self.term))
        words, doc, place = words[hot], doc[hot], hot - start[doc[hot]]
        for x, local in zip(self.postings, self.local):
            # Passages of 2 * span words begin every span words.
            step = x.span
            many = np.array([max(1, -(-len(w) // step) - 1) for w in docs])
            base = np.concatenate([[0], np.cumsum(many)])
            term = local[words]
            at = np.flatnonzero(term >= 0)
            term, d, nth = term[at], doc[at], place[at] // step
            last = many[d] - 1
            # A word is also in the passage before, unless that is the same one.
            again = (nth > 0) & (nth - 1 <= last)
            p = np.concatenate([np.minimum(nth, last) + base[d], nth[again] - 1 + base[d[again]]])
            key = np.unique(p * len(x.essential) + np.concatenate([term, term[again]]))
            if not len(key):
                continue
            passages, items = x.candidates(key // len(x.essential), key % len(x.essential))
            for passage, i in zip(passages.tolist(), items.tolist()):
                n = int(np.searchsorted(base, passage, side="right")) - 1
                first = (passage - int(base[n])) * step
                w = set(docs[n][first : first + 2 * step])
                score = sum(v for t, v in x.weights[i].items() if t in w)
                if score >= self.threshold - 1e-9:
                    found[n].append((x.items[i], first, score))
        return found

    def leaks(self, docs: list[list[str]], least: float = OVERLAP) -> list[list[tuple[object, int, float, float, float]]]:
        """For every text the items leaked into it: (key, first word of the best passage, score, question overlap, answer overlap)."""
        out = []
        for words, hits in zip(docs, self.search(docs)):
            best: dict[int, tuple] = {}
            for i, first, score in hits:
                passage = words[first : first + 2 * self.spans[i]]
                q, a = (overlap(x, passage) for x in self.parts[i])
                if q >= least and a >= least and (i not in best or (q + a, score, -first) > best[i][0]):
                    best[i] = ((q + a, score, -first), (self.items[i][0], first, score, q, a))
            out.append([best[i][1] for i in sorted(best)])
        return out


class Benchmark:
    """Test items, in parts of about ``max_chars`` of text at most; weights come from the statistics of all.

    The size of the items is checked first. Items that fit make one index, sent
    to the executors; more make several, of which the driver holds one at a time.
    """

    def __init__(self, benchmark: DataFrame, threshold: float = THRESHOLD, max_chars: int = INDEX_CHARS, id_col: str = "item_id", text_col: str = "text"):
        self.threshold = threshold
        self.rows = Intake(benchmark, id_col, text_col).narrow(id=id_col, text=text_col).where("text IS NOT NULL")
        self.id_type = self.rows.schema["id"].dataType.simpleString()
        chars = self.rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        self.n = max(1, -(-chars // max_chars))
        self.stats, self._only = Statistics(), None
        for k in range(self.n):
            items = self._part(k)
            for _, t in items:
                self.stats.add(t)
        if self.n == 1:
            self._only = Index(items, self.stats, threshold)

    def _part(self, k: int) -> list[tuple[object, str]]:
        part = F.pmod(F.xxhash64("text"), F.lit(self.n)) == k
        return [(r["id"], r["text"]) for r in self.rows.where(part).orderBy("id", "text").collect()]

    def index(self, k: int) -> Index:
        return self._only or Index(self._part(k), self.stats, self.threshold)


def _scan(rows: DataFrame, index: Index, id_type: str, slice_rows: int) -> DataFrame:
    """What leaked into rows of (doc_id, text), of one index."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["item_id", "first_word", "score", "question_overlap", "answer_overlap"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), slice_rows):
                pdf = whole.iloc[at : at + slice_rows]
                got = index.leaks([words_of(t) for t in pdf["text"]])
                out = [(n, *x) for n, xs in enumerate(got) for x in xs]
                if out:
                    res = pd.DataFrame(out, columns=["n", *names])
                    res["doc_id"] = pdf["doc_id"].iloc[res["n"].to_numpy()].to_numpy()
                    yield res[["doc_id", *names]]

    return rows.mapInPandas(run, f"doc_id {kind}, item_id {id_type}, first_word long, score double, question_overlap double, answer_overlap double")


def find_leaks(df: DataFrame, benchmark: Benchmark, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 256) -> DataFrame:
    """(doc_id, item_id, first_word, score, question_overlap, answer_overlap): a row for each text and test item leaked into it.

    Texts are searched whole. Null and empty texts leak nothing, null and empty
    items have nothing to leak. Rows that repeat give their rows again; null ids
    stay; equal passages tie for the first. No test items, no rows. Other columns
    aren't read. Where the items make several indexes, the texts are read and the
    leaks written once for each.
    """
    rows = Intake(df, id_col, text_col).narrow(doc_id=id_col, text=text_col).where("text IS NOT NULL")
    if benchmark.n == 1:
        return _scan(rows, benchmark.index(0), benchmark.id_type, slice_rows)
    return reduce(DataFrame.unionByName, [stored(_scan(rows, benchmark.index(k), benchmark.id_type, slice_rows)) for k in range(benchmark.n)])


def drop_leaked(df: DataFrame, benchmark: Benchmark, text_col: str = "text", slice_rows: int = 256) -> DataFrame:
    """``df`` without the rows into which a test item has leaked; all columns stay as they are. Null texts stay."""
    took = Intake(df, text_col)
    if benchmark.n == 1:
        return took.restore(took.rows.where(~_leaked(benchmark.index(0), slice_rows)(took[text_col])))
    # Equal texts leak alike, so the text's hash is key enough.
    key = [F.xxhash64(F.lit(n), took[text_col]).alias(f"t{n}") for n in (1, 2)]
    texts = took.rows.where(took[text_col].isNotNull()).select(F.struct(*key).alias("doc_id"), took[text_col].alias("text"))
    leaks = [stored(_scan(texts, benchmark.index(k), benchmark.id_type, slice_rows).select("doc_id").distinct()) for k in range(benchmark.n)]
    gone = reduce(DataFrame.unionByName, leaks).select(F.col("doc_id.t1").alias("g1"), F.col("doc_id.t2").alias("g2")).distinct()
    rows = took.rows.select("*", *key)
    return took.restore(rows.join(gone, (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")), "left_anti"))


def _leaked(index: Index, slice_rows: int):
    @F.pandas_udf("boolean")
    def leaked(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), slice_rows):
            some = [words_of(t) if t else [] for t in texts.iloc[at : at + slice_rows]]
            out += [bool(x) for x in index.leaks(some)]
        return pd.Series(out, dtype=bool)

    return leaked
