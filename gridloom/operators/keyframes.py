"""Time series of properties: duplicate and unneeded keys, as windows over (property, time)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drop_repeats(keys: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Keys whose value differs from the last kept one (the one before: the run's first is kept). ``hold``: repeats of it were dropped."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = keys.withColumn("_same", F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1))
    marked = marked.withColumn("hold", F.coalesce(F.lead("_same").over(w), F.lit(False)))
    return marked.where(~F.col("_same")).drop("_same")


def trim(keys: DataFrame, by: Sequence[str], time: str, start: Column, end: Column, tie: str) -> DataFrame:
    """Keys inside [start, end), the last one before it and the first one at or after its end; a property's lone key goes."""
    w = Window.partitionBy(*by)
    marked = (
        keys.withColumn("_before", F.max(F.when(F.col(time) < start, F.struct(time, tie))).over(w))
        .withColumn("_after", F.min(F.when(F.col(time) >= end, F.struct(time, tie))).over(w))
        .withColumn("_n", F.count("*").over(w))
    )
    here = F.struct(time, tie)
    inside = (F.col(time) >= start) & (F.col(time) < end)
    keep = inside | here.eqNullSafe(F.col("_before")) | here.eqNullSafe(F.col("_after"))
    return marked.where((F.col("_n") > 1) & keep).drop("_before", "_after", "_n")


def missing_keys(wanted: DataFrame, keys: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Wanted (by, time) that have no key there."""
    return wanted.join(keys.select(*by, time), [*by, time], "left_anti")


def relative_to_start(keys: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Values less the value of the property's first key."""
    first = F.min_by(value, time).over(Window.partitionBy(*by))
    return keys.withColumn(value, F.col(value) - first)


def copied(sources: DataFrame, targets: DataFrame, by: Sequence[str], series: str, time: str) -> DataFrame:
    """Keys with all their columns (value, easing, interpolation) for each target (by, series, source): those of its source series, but for times at which the target has a key already.

    sources: keys (by, series, time, ...); what has an expression is sampled first (sample_needed).
    """
    asked = targets.select(*by, F.col("source").alias(series), F.col(series).alias("_to"))
    given = sources.join(asked, [*by, series]).withColumn(series, F.col("_to")).select(*sources.columns)
    return missing_keys(given, sources, [*by, series], time)


def sample_needed(values: DataFrame, by: Sequence[str], step: float, threshold: float) -> DataFrame:
    """Adaptive sampling of series (by, t, v): both ends, and by halves a middle key wherever the straight line strays by more than the threshold.

    Order-dependent, so one kernel for each series; a series is bounded by its clip's frames.
    """
    by = list(by)
    schema = ", ".join([*(f"`{c}` {dict(values.dtypes)[c]}" for c in by), "t double, v double"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        t, v = rows["t"].to_numpy(float), rows["v"].to_numpy(float)
        kept = {0, len(t) - 1}
        todo = [(0, len(t) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            line = v[a] + (v[b] - v[a]) * (t[a : b + 1] - t[a]) / (t[b] - t[a])
            if (np.abs(line - v[a : b + 1]) > threshold).any():
                middle = t[a] + round((t[b] - t[a]) / 2 / step) * step
                m = int(np.clip(np.searchsorted(t, middle - 1e-9), a + 1, b - 1))
                kept.add(m)
                todo += [(a, m), (m, b)]
        at = sorted(kept)
        return pd.DataFrame({**{c: rows[c].iloc[0] for c in by}, "t": t[at], "v": v[at]})

    return values.select(*by, F.col("t").cast("double"), F.col("v").cast("double")).groupBy(*by).applyInPandas(run, schema)
