"""Change logs: table differences, coalesced gestures, replay, caps, generations, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def difference(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, old, new for each key whose value differs, NULL-safely (a missing row is NULL)."""
    a = before.select(*keys, F.col(value).alias("old"))
    b = after.select(*keys, F.col(value).alias("new"))
    return a.join(b, list(keys), "full").where(~F.col("old").eqNullSafe(F.col("new")))


def coalesce_gestures(log: DataFrame, by: Sequence[str], order: Sequence[str], kind: str, seal: Column) -> DataFrame:
    """Consecutive changes of one kind become one, until a seal: seq of the first, kind, n, first old and last new value.

    log has old and new; a row for which seal holds ends the gesture before it and is none itself.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    log = log.withColumn("_seals", F.count_if(seal).over(w)).where(~seal)
    fresh = F.row_number().over(w) == 1
    fresh = fresh | ~F.lag(kind).over(w).eqNullSafe(F.col(kind)) | (F.lag("_seals").over(w) != F.col("_seals"))
    log = log.withColumn("_fresh", fresh).withColumn("gesture", F.sum(F.col("_fresh").cast("long")).over(w))
    at = F.struct(*order)
    return log.groupBy(*by, "gesture", kind).agg(F.count("*").alias("n"), F.min_by("old", at).alias("old"), F.max_by("new", at).alias("new"))


def newest(log: DataFrame, by: Sequence[str], order: Sequence[str], cap: int = 100) -> DataFrame:
    """The newest ``cap`` commands of each log."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def replay(log: DataFrame, by: Sequence[str], target: str, order: Sequence[str], upto: Column) -> DataFrame:
    """State after the changes for which upto holds: the last new value of each target, or its first old one if all are undone."""
    at = F.struct(*order)
    done = F.max_by("new", F.when(upto, at))
    return log.groupBy(*by, target).agg(F.when(F.bool_or(upto), done).otherwise(F.min_by("old", at)).alias("value"))


def current_generation(parts: DataFrame, by: Sequence[str], generation: str) -> DataFrame:
    """Parts of each document's newest generation; older ones came too late."""
    newest_ = F.max(generation).over(Window.partitionBy(*by))
    return parts.withColumn("_g", newest_).where(F.col(generation) == F.col("_g")).drop("_g")


def open_only(results: DataFrame, open_documents: DataFrame, key: str) -> DataFrame:
    return results.join(open_documents.select(key), key, "left_semi")


def content_sums(columns: Sequence[str]) -> list[Column]:
    """Aggregates that name a multiset of rows, in any order: their number and two wrapped sums of the halves of each row's MD5. Repeated rows add up."""
    shown = F.concat(*(x for c in columns for x in (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")), F.lit("\x1f"))))
    half = lambda at: F.conv(F.substring(F.md5(shown.cast("binary")), at, 15), 16, 10).cast("decimal(20,0)")
    wrapped = lambda at: (F.sum(half(at)) % F.lit(1 << 60).cast("decimal(20,0)")).cast("long")
    return [F.count("*").alias("n"), wrapped(1).alias("content"), wrapped(17).alias("content2")]


def fingerprint(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """An order-free content hash of each group: n, content, content2."""
    return rows.groupBy(*by).agg(*content_sums(columns))


def first_divergence(current: DataFrame, baseline: DataFrame, keys: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """keys and status: missing, extra, or the first stage whose digest differs; equal rows are absent."""
    a = current.select(*keys, F.struct(*stages).alias("c"))
    b = baseline.select(*keys, F.struct(*stages).alias("b"))
    first = F.coalesce(*(F.when(~F.col(f"c.{s}").eqNullSafe(F.col(f"b.{s}")), F.lit(s)) for s in stages))
    status = F.when(F.col("c").isNull(), "missing").when(F.col("b").isNull(), "extra").otherwise(first)
    return a.join(b, list(keys), "full").withColumn("status", status).where("status is not null").drop("c", "b")


def touch(recents: DataFrame, opened: DataFrame, cap: int = 40) -> DataFrame:
    """Recents after opening: one row a path with its newest time, pinned if it was; pinned and newest first, ``cap`` at most."""
    both = recents.unionByName(opened)
    merged = both.groupBy("path").agg(F.max("opened").alias("opened"), F.bool_or("pinned").alias("pinned"), F.bool_or("folder").alias("folder"))
    return merged.orderBy(F.desc("pinned"), F.desc("opened"), "path").limit(cap)


def stage_report(timings: DataFrame, stage: str, micros: str) -> DataFrame:
    """Each stage's sum and its share of all, in per cent, slowest first. The sums (one row a stage) meet in one task, nothing else."""
    sums = timings.groupBy(stage).agg(F.sum(micros).alias("total"), F.count("*").alias("n"))
    everything = F.sum("total").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return sums.withColumn("share", F.round(100 * F.col("total") / everything, 6)).orderBy(F.desc("total"), stage)


def best_of(timings: DataFrame, by: Sequence[str], run: str, micros: str) -> DataFrame:
    """The least total of the runs but the first (warm-up)."""
    totals = timings.groupBy(*by, run).agg(F.sum(micros).alias("total"))
    return totals.where(F.col(run) > 0).groupBy(*by).agg(F.min("total").alias("best"))


def misses(wanted: DataFrame, cache: DataFrame, key: Sequence[str]) -> DataFrame:
    """What the cache table lacks and so must be computed."""
    return wanted.join(cache.select(*key), list(key), "left_anti")


def bumped(switches: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The live generation after each switch to another layer: one more each time, so that parts under way become stale."""
    return switches.withColumn("generation", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def accepted(parts: DataFrame, live: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """parts (by, order, generation) with whether each was live when it came: live (by, order, generation) says which generation holds from when on."""
    both = live.select(*by, order, F.col("generation").alias("_live"), F.lit(None).cast("long").alias("generation")).unionByName(
        parts.select(*by, order, F.lit(None).cast("long").alias("_live"), F.col("generation").cast("long").alias("generation")))
    w = Window.partitionBy(*by).orderBy(order, F.col("_live").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_now", F.last("_live", ignorenulls=True).over(w)).where("_live is null")
    return found.select(*by, order, "generation", F.col("generation").eqNullSafe(F.col("_now")).alias("accepted"))


def latched(requests: DataFrame, by: Sequence[str], start: str, took: str) -> DataFrame:
    """Requests (by, start, took in the same unit) of which one runs at a time: those that begin a run; what comes while one is running becomes one run after it.

    One pass over each document's requests, in order.
    """
    import pandas as pd

    by = list(by)
    kinds = dict(requests.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, busy_till, waiting, last = [], None, 0, 0
        for at, length in rows.sort_values(start)[[start, took]].itertuples(index=False):
            while busy_till is not None and busy_till <= at and waiting:
                out.append((busy_till, waiting))
                busy_till, waiting = busy_till + last, 0
            if busy_till is not None and busy_till > at:
                waiting += 1
                last = length
            else:
                out.append((at, 1))
                busy_till = at + length
        if waiting:
            out.append((busy_till, waiting))
        return pd.DataFrame({**{c: rows[c].iloc[0] for c in by}, "began": [int(a) for a, _ in out], "requests": [n for _, n in out]})

    return requests.select(*by, start, took).groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "began long, requests long"]))
