"""Streaming forms of the telemetry log and of the workflow check (an extension of the batch operators)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions import constants as K
from skein.operators.ranges import Guard


def windowed_latency(stages: DataFrame, *, at: str = "created_at", stage: str = "stage", ms: str = "duration_ms", window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Count, sum, least and greatest latency per window and stage; rows later than the watermark are left out."""
    out = stages.withWatermark(at, lateness).groupBy(F.window(at, window).alias("w"), stage)
    out = out.agg(F.count("*").alias("n"), F.sum(ms).alias("total_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))
    return out.select(F.col("w.start").alias("window_start"), stage, "n", "total_ms", "min_ms", "max_ms")


def illegal_transitions(events: DataFrame, *, by: str = "encounter_id", status: str = "status", ord: str = "ord", transitions: Sequence[tuple[str, str]] = K.TRANSITIONS, initial: Sequence[str] = K.INITIAL) -> DataFrame:
    """Events that the state of their group does not allow, as they come; they leave the state as it was. Within a batch events are taken by ``ord``.

    A group begins without a state, in which only ``initial`` ones are accepted.
    """
    guard = Guard(transitions, initial)

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = guard.code[state.get[0]] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(ord, kind="stable")
        found = []
        for asked, n in zip(rows[status], rows[ord]):
            target = guard.target(asked)
            if (now, target) not in guard.allowed:
                found.append((key[0], n, guard.names[now], asked))
            now = guard.after[target][now]
        if now:
            state.update((guard.names[now],))
        yield pd.DataFrame(found, columns=[by, ord, "from_status", "to_status"])

    kinds = {c: events.schema[c].dataType.simpleString() for c in (by, ord)}
    return events.groupBy(by).applyInPandasWithState(check, f"{by} {kinds[by]}, {ord} {kinds[ord]}, from_status string, to_status string", "state string", "append", GroupStateTimeout.NoTimeout)
