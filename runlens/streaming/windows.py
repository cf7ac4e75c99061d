"""Streaming forms: hourly calls under a watermark, and episodes as per-session state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import GAP


def hourly_calls(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(hour, event_type, calls), final once the watermark has passed the hour."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("calls")).select(F.col("w.start").alias("hour"), "event_type", "calls")


def episodes(hits: DataFrame, gap: int = GAP) -> DataFrame:
    """Closed episodes of a stream ``hits(session, i)`` that is in order within a session.

    State is the open episode: first and last hit and their number. It closes when a hit is more than ``gap`` events later.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n = state.get if state.exists else (None, None, 0)
        out = []
        for i in sorted(x for f in frames for x in f["i"].tolist()):
            if last is not None and i - last > gap:
                out.append((key[0], start, last, n))
                start, n = None, 0
            start, last, n = (i if start is None else start), i, n + 1
        if last is not None:
            state.update((start, last, n))
        yield pd.DataFrame(out, columns=["session", "start_event", "end_event", "hits"])

    return hits.groupBy("session").applyInPandasWithState(
        step, "session long, start_event long, end_event long, hits long", "start long, last long, n long", "append", GroupStateTimeout.NoTimeout
    )
