"""Directly-follows counts over an unbounded stream of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _advance(key, frames, state: GroupState):
    last = state.get if state.exists else (None,)
    last, found = last[0], {}
    for f in frames:
        for a in f.sort_values(["us", "event_idx"])["activity"]:
            if last is not None:
                found[last, a] = found.get((last, a), 0) + 1
            last = a
    state.update((last,))
    yield pd.DataFrame([(s, t, n) for (s, t), n in found.items()], columns=["source", "target", "n"])


def stream_dfg(events: DataFrame) -> DataFrame:
    """Increments (source, target, n) of each micro-batch: a case's state is its last activity. Sum them for the graph."""
    return events.select("case_id", "activity", "us", "event_idx").groupBy("case_id").applyInPandasWithState(_advance, "source string, target string, n long", "last string", "append", GroupStateTimeout.NoTimeout)
