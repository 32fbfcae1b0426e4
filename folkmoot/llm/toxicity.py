"""Toxicity by averaged subword embeddings under a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the
word itself, all hashed into one table; a passage's vector is the mean over its
words. The table and the softmax are trained jointly in numpy. Misspellings
that were never seen share n-grams, and so vectors, with what was.

As everything from the table to the softmax is linear, a trained model comes
down to one weight for each bucket; a word's weight is the mean over its
n-grams and is worked out once per process.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkmoot.llm.common import Intake, kept

WORD = re.compile(r"[^\W\d_]+(?:[^\W_]*[^\W\d_]+)*")
BUCKETS = 1 << 14
REMEMBERED = 200_000


def buckets_of(word: str, size: int = BUCKETS) -> list[int]:
    """Buckets of a word: its 3- to 5-grams within brackets, and itself."""
    w = f"<{word}>"
    n = len(w)
    grams = [w[i : i + k] for k in (3, 4, 5) for i in range(n - k + 1)]
    grams.append(w + "=")
    return [crc32(g.encode("utf-8", "surrogatepass")) % size for g in grams]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Weights(dict):
    """A word's weight, from those of its buckets."""

    def __init__(self, by_bucket: np.ndarray):
        self.by_bucket = by_bucket.tolist()

    def __missing__(self, word: str) -> float:
        b, v = buckets_of(word, len(self.by_bucket)), self.by_bucket
        got = sum([v[i] for i in b]) / len(b)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got
        return got


@dataclass
class Model:
    """One weight a bucket and a bias: log odds of the toxic class; ``cut`` is where a document's score rejects it."""

    by_bucket: np.ndarray
    bias: float
    window: int
    cut: float = 0.0

    def scorer(self):
        weights = Weights(self.by_bucket)
        of, bias, window = weights.__getitem__, self.bias, self.window

        def score(text: str) -> tuple[float, int]:
            """The highest log odds of any window of words, and where it starts; a shorter text is one window."""
            w = np.fromiter(map(of, words_of(text)), dtype=np.float64)
            if not len(w):
                return float("-inf"), 0
            if len(w) <= window:
                return float(w.sum()) / window + bias, 0
            sums = np.concatenate([[0.0], np.cumsum(w)])
            means = (sums[window:] - sums[:-window]) / window
            at = int(means.argmax())
            return float(means[at]) + bias, at

        return score


def bags(texts: list[str], size: int = BUCKETS) -> np.ndarray:
    """Row by row the average bag of subwords: each word weighs 1, spread over its buckets."""
    known: dict[str, np.ndarray] = {}
    out = np.zeros((len(texts), size), dtype=np.float32)
    for row, text in zip(out, texts):
        counts: dict[str, int] = {}
        for w in words_of(text):
            counts[w] = counts.get(w, 0) + 1
        if not counts:
            continue
        at, by = [], []
        for w, n in counts.items():
            b = known.get(w)
            if b is None:
                b = known[w] = np.array(buckets_of(w, size))
            at.append(b)
            by.append(np.full(len(b), n / len(b)))
        row[:] = np.bincount(np.concatenate(at), weights=np.concatenate(by), minlength=size) / sum(counts.values())
    return out


def adam(x: np.ndarray, toxic: np.ndarray, params: dict[str, np.ndarray], rounds: int, l2: float, rate: float = 0.03) -> None:
    """Fit table and softmax together on all passages at once, in place."""
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v2 = {k: np.zeros_like(v) for k, v in params.items()}
    weight = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean())).astype(np.float32)
    want = np.eye(2, dtype=np.float32)[toxic]
    for t in range(1, rounds + 1):
        hidden = x @ params["e"]
        logits = hidden @ params["w"] + params["b"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - want) * weight[:, None] / len(x)
        grads = {"w": hidden.T @ d, "b": d.sum(0), "e": x.T @ (d @ params["w"].T) + l2 * params["e"]}
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.999 * v2[k] + 0.001 * g * g
            params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)


def train(texts: list[str], toxic: np.ndarray, dim: int = 4, rounds: int = 60, passes: int = 3, seed: int = 5, window: int = 3, l2: float = 2e-6) -> Model:
    """Fit on whole texts first, then again on the worst window of every text.

    A label says that something in a text is toxic, not where: after the first
    fit, the model's own worst window stands for each text, in toxic ones what
    is most likely meant and in clean ones the hardest negative. With one class
    only, or no text, the model rejects nothing. The cut is the one at which the
    training texts make the fewest errors, classes weighing alike.
    """
    toxic = np.asarray(toxic, dtype=int)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, window, float("inf"))
    rng = np.random.default_rng(seed)
    params = {"e": rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32), "w": rng.normal(0, 0.5, (dim, 2)).astype(np.float32), "b": np.zeros(2, np.float32)}
    passages = texts
    for k in range(passes + 1):
        x = bags(passages)
        scale = float(np.sqrt(np.einsum("ij,ij->", x, x) / len(x))) or 1.0
        x /= scale
        adam(x, toxic, params, rounds, l2)
        side = (params["w"][:, 1] - params["w"][:, 0]).astype(np.float64)
        model = Model(params["e"].astype(np.float64) @ side / scale, float(params["b"][1] - params["b"][0]), window)
        score = model.scorer()
        found = [score(t) for t in texts]
        if k < passes:
            passages = [" ".join(words_of(t)[at : at + window]) for t, (_, at) in zip(texts, found)]
    model.cut = best_cut(np.array([s for s, _ in found]), toxic)
    return model


def best_cut(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap with the fewest errors, classes weighing alike, false rejections double."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], toxic[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    wrong = np.concatenate([[0], np.cumsum(1 - y)])
    wrong = (wrong[-1] - wrong) / max(1, (1 - y).sum())
    i = int((missed + 2 * wrong).argmin())
    if i in (0, len(s)):
        return float(s[0] - 1 if i == 0 else s[-1] + 1)
    return float((s[i - 1] + s[i]) / 2) if np.isfinite(s[i - 1]) else float(s[i] - 1)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = 1000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """(text, toxic): at most ``per_class`` labelled texts of either class, chosen by a hash of their id.

    The bound is what lets a model be fitted on the driver at any size of the
    corpus; labelled rows without a text, a label or an id aren't used. Of an id
    that repeats, the least text and the label toxic count.
    """
    took = Intake(labels, id_col, "toxic").narrow(id=id_col, toxic="toxic").where("id IS NOT NULL AND toxic IN (0, 1)")
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")))
    few = [took.where(F.col("toxic") == c).distinct().orderBy(order, "id").limit(per_class) for c in (0, 1)]
    # At most 2 * per_class rows of two numbers: small by construction.
    chosen = F.broadcast(few[0].unionByName(few[1]).groupBy("id").agg(F.max("toxic").alias("toxic")))
    texts = Intake(docs, id_col, text_col).narrow(id=id_col, text=text_col).where("text IS NOT NULL").join(chosen, "id")
    return texts.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", "id").toPandas().sort_values(["id", "text"], ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, seed: int = 5) -> Model:
    rows = training_rows(docs, labels, per_class, seed)
    return train(rows["text"].tolist(), rows["toxic"].to_numpy(), seed=seed)


def toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, at, toxic) of every row: log odds of its worst window, that window's first word, and the verdict.

    Long texts are scored whole, window by window. A null text, an empty one or
    one without a word has the score null and isn't toxic. Rows that repeat get
    equal results; null ids stay.
    """
    took = Intake(df, id_col, text_col)
    rows = took.narrow(doc_id=id_col, text=text_col)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer_of(model)
        for pdf in batches:
            got = [(float("-inf"), 0) if t is None else score(t) for t in pdf["text"]]
            s = np.array([x for x, _ in got], dtype=float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": pd.Series(s, index=pdf.index).where(np.isfinite(s)), "at": [x for _, x in got], "toxic": s > model.cut})

    return rows.mapInPandas(judge, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, at int, toxic boolean")


def scorer_of(model: Model):
    """A model's scorer, kept with its word weights as long as the process has no other work."""
    return kept(("scorer", model.by_bucket.tobytes(), model.bias), model.scorer)


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` without the rows that the model rejects; all columns stay as they are."""
    took = Intake(df, text_col)

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        score = scorer_of(model)
        return pd.Series([t is not None and score(t)[0] > model.cut for t in texts], dtype=bool)

    return took.restore(took.rows.where(~rejected(took[text_col])))
