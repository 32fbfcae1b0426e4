"""Quality rules from tokeniser fertility.

Public vocabularies made for ordinary text spend few tokens on it. Per text and
vocabulary, one of pieces with byte fallback and one of byte pairs: characters a
token, the share of tokens that are bytes spelled out (of byte pairs: that are no
whole characters), and the entropy of tokens within blocks of equal length (so
that long texts compare with short ones). What is usual differs by language and,
in short texts, by length, so the rejection bands are quantiles of the whole
corpus, language by language, or by script where the language isn't known; texts
shorter than a block have bands of their own for every doubling of their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkmoot.llm.common import TOKENIZERS, Intake, byte_ranks, kept, pretoken_pattern, settle, vocabulary

BLOCK = 128
MEASURES = ("chars_per_token", "byte_share", "entropy")
SECOND = tuple(f"multi_{m}" for m in MEASURES)
SCRIPTS = (
    ("latin", "\\p{IsLatin}"),
    ("cyrillic", "\\p{IsCyrillic}"),
    ("greek", "\\p{IsGreek}"),
    ("arabic", "\\p{IsArabic}"),
    ("hebrew", "\\p{IsHebrew}"),
    ("devanagari", "\\p{IsDevanagari}"),
    ("han", "\\p{IsHan}"),
    ("kana", "[\\p{IsHiragana}\\p{IsKatakana}]"),
    ("hangul", "\\p{IsHangul}"),
    ("thai", "\\p{IsThai}"),
)


def script(text):
    """The script of most letters, the first named on a tie; 'none' without any."""
    counts = [F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, p) in enumerate(SCRIPTS)]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["name"]).otherwise("none")


def block_entropies(ids: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
    """Mean over a text's whole blocks of the entropy of the block's tokens, over its greatest; nan for texts shorter than a block.

    The tokens after the last whole block are covered by one more block that ends
    with the text.
    """
    cut, owner = [], []
    for n, x in enumerate(ids):
        if len(x) >= block:
            whole = len(x) // block
            cut.append(x[: whole * block].reshape(-1, block))
            if len(x) % block:
                cut.append(x[-block:][None])
                whole += 1
            owner.append(np.full(whole, n))
    out = np.full(len(ids), np.nan)
    if not cut:
        return out
    b, owner = np.sort(np.concatenate(cut), axis=1), np.concatenate(owner)
    edge = np.ones(b.shape, dtype=bool)
    edge[:, 1:] = b[:, 1:] != b[:, :-1]
    starts = np.flatnonzero(edge.ravel())
    runs = np.diff(np.append(starts, b.size))
    bits = np.bincount(starts // block, weights=runs * np.log2(runs), minlength=len(b)) / block
    h = (np.log2(block) - bits) / np.log2(block)
    n = np.bincount(owner, minlength=len(ids))
    has = n > 0
    out[has] = np.bincount(owner, weights=h, minlength=len(ids))[has] / n[has]
    return out


def processors(model: str, pairs: str, folder: str):
    """[(encode, whether an id is bytes spelled out)] of both vocabularies, kept as long as the process has no other work."""

    def make():
        import sentencepiece
        import tiktoken

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(model, folder))
        ranks = byte_ranks(vocabulary(pairs, folder))
        broken = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for token, i in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                broken[i] = True
        enc = tiktoken.Encoding("pairs", pat_str=pretoken_pattern(folder), mergeable_ranks=ranks, special_tokens={})
        pieces = lambda texts: [np.array(x, dtype=np.int32) for x in sp.encode(texts, num_threads=1)]
        merged = lambda texts: [np.array(enc.encode_ordinary(t), dtype=np.int32) for t in texts]
        return [(pieces, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])), (merged, broken)]

    return kept(("fertility", model, pairs, folder), make)


def measured_by(texts: list[str], encode, is_byte: np.ndarray, spelled_breaks: bool) -> tuple[np.ndarray, ...]:
    """Numbers of tokens and the three measures, nan where they can't be taken."""
    ids = encode(texts)
    n = np.array([len(x) for x in ids])
    chars = np.array([len(t) for t in texts])
    spelled = np.array([int(is_byte[x].sum()) for x in ids])
    if spelled_breaks:
        # Line breaks are spelled out as bytes by design and say nothing of the text.
        spelled = np.maximum(spelled - np.array([t.count("\n") for t in texts]), 0)
    some = np.maximum(n, 1)
    return n, np.where(n > 0, np.round(chars / some, 3), np.nan), np.where(n > 0, np.round(spelled / some, 4), np.nan), np.round(block_entropies(ids), 4)


def measures(df: DataFrame, model: str = "piece_bpe_32k.model", pairs: str = "byte_bpe_multi_50k.tiktoken", folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", slice_rows: int = 256) -> DataFrame:
    """(doc_id, grp, n_tokens, three measures of either vocabulary) of every row; null measures where they can't be taken."""
    took = Intake(df, id_col, text_col, lang_col)
    lang = F.lower(F.trim(took[lang_col].cast("string")))
    text = took[text_col].cast("string")
    grp = F.when(F.coalesce(lang, F.lit("")) != "", F.concat(F.lit("lang:"), lang)).otherwise(F.concat(F.lit("script:"), F.coalesce(script(text), F.lit("none"))))
    rows = took.rows.select(took[id_col].alias("doc_id"), text.alias("text"), grp.alias("grp"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = processors(model, pairs, folder)
        for whole in batches:
            for at in range(0, len(whole), slice_rows):
                pdf = whole.iloc[at : at + slice_rows].reset_index(drop=True)
                texts = [t or "" for t in pdf["text"]]
                n, *first = measured_by(texts, *both[0], True)
                _, *second = measured_by(texts, *both[1], False)
                null = pdf["text"].isna().to_numpy()
                out = {"doc_id": pdf["doc_id"], "grp": pdf["grp"], "n_tokens": pd.array(np.where(null, 0, n), dtype="Int64").copy()}
                yield pd.DataFrame(out | dict(zip(MEASURES + SECOND, first + second)))

    got = rows.mapInPandas(measure, f"doc_id {kind}, grp string, n_tokens long, " + ", ".join(f"{c} double" for c in MEASURES + SECOND))
    return got.select("doc_id", "grp", "n_tokens", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in MEASURES + SECOND])


def length_class() -> Column:
    """Of texts of a block or more 7 for all, else the doublings of their number of tokens."""
    return F.least(F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int"), F.lit(int(math.log2(BLOCK))))


def bands(measured: DataFrame, reach: float = 4.0, least: tuple[float, float, float] = (0.1, 0.02, 0.02)) -> DataFrame:
    """(band_grp, band_len, lo_.., hi_..): for every group and class of length, quartiles widened by ``reach`` times their distance, which counts as ``least`` at least.

    Texts without tokens don't count. Measures are rounded, so the exact
    percentiles keep a bounded number of values.
    """
    q = measured.where(F.col("n_tokens") > 0).groupBy(F.col("grp").alias("band_grp"), length_class().alias("band_len")).agg(*[F.percentile(c, [0.25, 0.75]).alias(c) for c in MEASURES + SECOND])
    out = ["band_grp", "band_len"]
    for c, floor in zip(MEASURES + SECOND, 2 * least):
        wide = reach * F.greatest(F.col(c)[1] - F.col(c)[0], F.lit(floor))
        out += [(F.col(c)[0] - wide).alias(f"lo_{c}"), (F.col(c)[1] + wide).alias(f"hi_{c}")]
    return q.select(*out)


def fertility_rules(df: DataFrame, reach: float = 4.0, **columns) -> DataFrame:
    """(doc_id, grp, n_tokens, three measures of either vocabulary, reason, keep) of every row.

    ``reason`` names the first rule that a text breaks: ``empty`` (null or no
    tokens), ``chars_per_token`` outside its band, ``byte_share`` above it,
    ``entropy`` below it, then the same of byte pairs, ``multi_..``; null if none,
    and then ``keep``. Texts shorter than a block of ``BLOCK`` tokens have no
    entropy. Null languages are judged by script. Rows that repeat are judged
    alike and count each time; null ids stay.
    """
    measured = settle(measures(df, **columns))
    judged = measured.join(bands(measured, reach), (F.col("grp") == F.col("band_grp")) & (length_class() == F.col("band_len")), "left")
    reason = F.when(F.coalesce(F.col("n_tokens"), F.lit(0)) == 0, "empty")
    for chars, share, entropy in (MEASURES, SECOND):
        reason = (
            reason.when((F.col(chars) < F.col(f"lo_{chars}")) | (F.col(chars) > F.col(f"hi_{chars}")), chars)
            .when(F.col(share) > F.col(f"hi_{share}"), share)
            .when(F.col(entropy) < F.col(f"lo_{entropy}"), entropy)
        )
    return judged.select("doc_id", "grp", "n_tokens", *MEASURES, *SECOND, reason.alias("reason")).withColumn("keep", F.col("reason").isNull())
