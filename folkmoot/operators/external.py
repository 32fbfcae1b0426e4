"""Calls of a model outside the engine. Off unless a callable is given; errors are a column, never an empty answer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkmoot.functions.text import field, text

WAITS = (5.0, 15.0, 40.0)


class Quota(Exception):
    """The day's quota is used up; no more calls are made in this partition."""


def error_kind(e: Exception) -> str:
    """``quota`` for a day's limit, ``rate`` for a short one, ``down`` for an outage, else ``other``."""
    code, status, told = getattr(e, "code", None), getattr(e, "status", None), str(getattr(e, "details", "") or e).lower()
    if isinstance(e, Quota) or "perday" in told:
        return "quota"
    if code == 429 or status == "RESOURCE_EXHAUSTED":
        return "rate"
    return "down" if code == 503 or status == "UNAVAILABLE" else "other"


def retry_delay(e: Exception, most: float = 60.0) -> float | None:
    """The seconds that the service asks to wait, if it says so and they are few enough."""
    for d in getattr(e, "details", None) or []:
        raw = str(d.get("retryDelay", "")).rstrip("s") if isinstance(d, dict) else ""
        if raw.replace(".", "", 1).isdigit():
            return float(raw) if float(raw) <= most else None
    return None


def call_with_retry(call: Callable[[str], str], prompt: str, sleep: Callable[[float], None] = time.sleep, attempts: int = 3) -> str:
    """Limits wait as told, outages longer each time; a day's quota and other errors are raised at once."""
    for n in range(attempts):
        try:
            return call(prompt)
        except Exception as e:
            kind = error_kind(e)
            if kind == "quota":
                raise Quota(str(e)) from e
            if kind == "other" or n + 1 == attempts:
                raise
            sleep(retry_delay(e) or WAITS[min(n, len(WAITS) - 1)])
    raise AssertionError("no attempts")


def call_model(df: DataFrame, prompt: Column, call: Callable[[str], str] | None, parallel: int | None = None) -> DataFrame:
    """``df`` with ``answer`` and ``error``. Filter before: nothing is pushed down past Python.

    ``parallel`` bounds the partitions, and so the calls at once.
    """
    rows = df.withColumn("prompt", prompt)
    if call is None:
        return rows.drop("prompt").withColumns({"answer": F.lit(None).cast("string"), "error": F.lit("disabled")})
    if parallel:
        rows = rows.coalesce(parallel)
    out = rows.drop("prompt").withColumns({"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent = False
        for pdf in batches:
            answers, errors = [], []
            for p in pdf["prompt"]:
                answer = error = None
                try:
                    if spent:
                        raise Quota("the day's quota is used up")
                    answer = call_with_retry(call, p)
                except Exception as e:
                    spent = spent or isinstance(e, Quota)
                    error = f"{error_kind(e)}: {e}"
                answers.append(answer)
                errors.append(error)
            yield pdf.drop(columns="prompt").assign(answer=answers, error=errors)

    return rows.mapInPandas(run, out)


ANSWER = "description array<string>, chips array<struct<category:string,text:string,usefulness:string>>"
REMARKS = "speakers array<struct<name:string,organization:string,said:array<string>,stance:string>>"


def summary_prompt(allowed: Column, heard: Column, limit: int = 20_000) -> Column:
    """What a summary is asked from: the item's own record, what was said, and the categories still open."""
    lines = [F.concat(F.lit(f"{n}: "), field(c, limit)) for n, c in (("Title", "title"), ("Motion", "recommendation"), ("Result", "vote_result"), ("Record", "content"))]
    return F.concat_ws("\n", F.lit("Answer as JSON: description (array of short bullets), chips (array of category, text, usefulness)."), *lines, F.concat(F.lit("Categories: "), F.array_join(allowed, ", ")), F.concat(F.lit("Said: "), field(heard, limit)))


def judge_prompt(title: Column, source: Column, description: Column, chips: Column) -> Column:
    """U3."""
    return F.concat_ws("\n", F.lit("Score faithfulness, specificity and non_redundancy from 1 to 5 as JSON, with a quote and a list of claims."), F.concat(F.lit("Title: "), text(title)), F.concat(F.lit("Source: "), text(source)), F.concat(F.lit("Summary: "), F.array_join(description, " ")), F.concat(F.lit("Chips: "), F.to_json(chips)))


def parse_summary(answer: Column) -> Column:
    return F.from_json(answer, ANSWER)


def parse_verdict(answer: Column) -> Column:
    """Scores within 1 to 5; null, which means unknown and never a pass, where a score is missing."""
    v = F.from_json(answer, "faithfulness double, specificity double, non_redundancy double, quote string, claims array<string>")
    clamp = lambda n: F.greatest(F.lit(1), F.least(F.lit(5), F.round(v[n]).cast("int"))).alias(n)
    scores = [clamp(n) for n in ("faithfulness", "specificity", "non_redundancy")]
    whole = v["faithfulness"].isNotNull() & v["specificity"].isNotNull() & v["non_redundancy"].isNotNull()
    return F.when(whole, F.struct(*scores, text(v["quote"]).alias("quote"), v["claims"].alias("claims")))


def sane_remarks(answer: Column, roster: Column, most: int = 3) -> Column:
    """Remarks of people on the roster, under the roster's spelling, each once and only with something said."""
    from folkmoot.functions.classify import first_per
    from folkmoot.functions.text import clean_entities, sane_bullets

    given = F.coalesce(F.from_json(answer, REMARKS)["speakers"], F.array().cast("array<struct<name:string,organization:string,said:array<string>,stance:string>>"))
    spelled = lambda n: F.try_element_at(F.filter(roster, lambda r: F.lower(r) == F.lower(F.trim(n))), F.lit(-1))
    rows = F.transform(
        given,
        lambda s: F.struct(
            spelled(s["name"]).alias("name"), clean_entities(s["organization"]).alias("organization"), F.slice(sane_bullets(s["said"]), 1, most).alias("said"),
            F.when(F.lower(F.trim(s["stance"])).isin("support", "concern"), F.lower(F.trim(s["stance"]))).otherwise("").alias("stance"),
        ),
    )
    return first_per(F.filter(rows, lambda s: s["name"].isNotNull() & s["said"].isNotNull()), lambda s: s["name"])


def pdf_text(files: DataFrame, reader: Callable[[bytes], str] | None, most: int = 30_000) -> DataFrame:
    """(path, text) of ``binaryFile`` rows; blank where a document can't be read. No PDF library is bundled, so the reader is given."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        def one(b):
            try:
                return reader(b)[:most] if reader else ""
            except Exception:
                return ""

        return contents.map(one)

    return files.select("path", read("content").alias("text"))
