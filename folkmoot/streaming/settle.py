"""A3 as a stream: a day's meetings are given out once all of them have summaries, or once event time is a week past the day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "day string, meetings int, reason string"
STATE = "seen string, expected int, given boolean"


def settled_days(updates: DataFrame, days: int = 7) -> DataFrame:
    """``updates`` has (day, at, meeting_id, has_summaries, expected): ``at`` is event time, ``expected`` the meetings of the day.

    Late updates of a day already given out change nothing. A day is given out
    once. State is one row a day, dropped at the time-out.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, expected, given = state.get if state.exists else ("", 0, False)
        day = key[0]
        if state.hasTimedOut:
            state.remove()
            if not given:
                yield pd.DataFrame({"day": [day], "meetings": [len([x for x in seen.split("\n") if x])], "reason": ["time"]})
            return
        done = {x for x in seen.split("\n") if x}
        for pdf in batches:
            done |= set(pdf.loc[pdf["has_summaries"].fillna(False).astype(bool), "meeting_id"].dropna().astype(str))
            expected = max(expected, int(pdf["expected"].fillna(0).max()))
        full = not given and expected > 0 and len(done) >= expected
        state.update(("\n".join(sorted(done)), expected, given or full))
        end = int(pd.Timestamp(day).timestamp() * 1000) + days * 86_400_000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if full:
            yield pd.DataFrame({"day": [day], "meetings": [len(done)], "reason": ["complete"]})

    rows = updates.where(F.col("day").isNotNull()).withWatermark("at", "0 seconds")
    return rows.groupBy("day").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
