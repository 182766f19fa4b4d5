"""Streams of stage results: a result of an older generation is late and dropped.

State is one number for each document. ``gated`` works on streams and tables alike; on a table it sees all rows of a
document at once, in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "doc long, seq long, generation long, accepted boolean"
STATE = "generation long"


def _step(live: int, rows: pd.DataFrame) -> tuple[int, pd.DataFrame]:
    rows = rows.sort_values("seq")
    taken = []
    for g in rows["generation"]:
        live = max(live, int(g))
        taken.append(g == live)
    return live, rows.assign(accepted=taken)[["doc", "seq", "generation", "accepted"]]


def gated(parts: DataFrame) -> DataFrame:
    """parts (doc, seq, generation): whether each was current when it came."""
    if parts.isStreaming:

        def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            live = state.get[0] if state.exists else -1
            found = pd.concat(list(frames))
            live, out = _step(live, found)
            state.update((live,))
            yield out

        return parts.select("doc", "seq", "generation").groupBy("doc").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    from pyspark.sql.window import Window

    live = F.max("generation").over(Window.partitionBy("doc").orderBy("seq"))
    return parts.select("doc", "seq", "generation", (F.col("generation") == live).alias("accepted"))


def latest_stage(parts: DataFrame) -> DataFrame:
    """doc, stage and the newest payload of the newest generation; for streams in update or complete mode."""
    return parts.groupBy("doc", "stage").agg(F.max(F.struct("generation", "seq", "payload")).alias("x")).select("doc", "stage", "x.generation", "x.payload")


def relaunch_order(flags: DataFrame) -> DataFrame:
    """doc and the job to start first: a dirty strip, then a dirty full render, then a queued one."""
    job = F.when(F.col("strip_dirty"), "strip").when(F.col("full_dirty"), "full").when(F.col("full_queued"), "queued")
    return flags.select("doc", job.alias("job")).where("job is not null")


def gated_by_session(events: DataFrame) -> DataFrame:
    """events (doc, seq, generation, kind: ``live`` or ``part``): whether each part's generation is the one its document last declared live.

    The declared generation is the state, so a stale part is refused also before the first new one comes. Streams and tables alike.
    """
    if events.isStreaming:

        def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            live = state.get[0] if state.exists else -1
            rows = pd.concat(list(frames)).sort_values(["seq", "kind"])
            taken = []
            for g, kind in zip(rows["generation"], rows["kind"], strict=True):
                if kind == "live":
                    live = int(g)
                taken.append(g == live)
            state.update((live,))
            yield rows.assign(accepted=taken)[rows["kind"] == "part"][["doc", "seq", "generation", "accepted"]]

        return events.select("doc", "seq", "generation", "kind").groupBy("doc").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    from gridloom.operators.changes import accepted

    return accepted(events.where("kind = 'part'"), events.where("kind = 'live'"), ["doc"], "seq")
