"""Shared borders: unit segments met by several rings, runs of equal partners, direction changes, canonical order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def partners(segments: DataFrame, ring: str, ends: Sequence[str] = ("x0", "y0", "x1", "y1"), by: Sequence[str] = ()) -> DataFrame:
    """Segments (by, ring, ends, ...) with ``partners``, the other rings on the same undirected segment, ascending."""
    a, b = (F.struct(F.col(ends[k]).alias("x"), F.col(ends[k + 1]).alias("y")) for k in (0, 2))
    keyed = segments.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b))
    shared = keyed.groupBy(*by, "_lo", "_hi").agg(F.sort_array(F.collect_set(ring)).alias("_all"))  # few rings meet at a unit segment
    return keyed.join(shared, [*by, "_lo", "_hi"]).withColumn("partners", F.array_except("_all", F.array(ring))).drop("_lo", "_hi", "_all")


def shared_runs(points: DataFrame, ring: str, k: str = "k", value: str = "partners") -> DataFrame:
    """Circular runs of equal value around each ring: ring, first, size, value. The first run starts where the value changes; a ring without a change is one run from its first point."""
    w = Window.partitionBy(ring).orderBy(k)
    whole = Window.partitionBy(ring)
    marked = points.withColumn("_n", F.count("*").over(whole)).withColumn("_before", F.coalesce(F.lag(value).over(w), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    marked = marked.withColumn("_start", (~F.col("_before").eqNullSafe(F.col(value))).cast("long"))
    marked = marked.withColumn("_run", F.sum("_start").over(w)).withColumn("_runs", F.sum("_start").over(whole))
    marked = marked.withColumn("_run", F.when(F.col("_run") == 0, F.col("_runs")).otherwise(F.col("_run")))  # what lies before the first change belongs to the last run
    first = F.coalesce(F.min(F.when(F.col("_start") == 1, F.col(k))), F.min(k))
    return marked.groupBy(ring, "_run").agg(first.alias("first"), F.count("*").alias("size"), F.first(value).alias(value)).drop("_run")


def direction_changes(points: DataFrame, ring: str, k: str = "k") -> DataFrame:
    """Points of an open chain where the direction differs from the one before; both ends stay."""
    w = Window.partitionBy(ring).orderBy(k)
    near = lambda f, c: f(c).over(w)
    p = points.withColumns({"_ix": F.col("x") - near(F.lag, "x"), "_iy": F.col("y") - near(F.lag, "y"), "_ox": near(F.lead, "x") - F.col("x"), "_oy": near(F.lead, "y") - F.col("y")})
    same = (F.col("_ix") * F.col("_oy") == F.col("_iy") * F.col("_ox")) & (F.col("_ix") * F.col("_ox") + F.col("_iy") * F.col("_oy") > 0)
    return p.where(F.coalesce(~same, F.lit(True))).drop("_ix", "_iy", "_ox", "_oy")


def densify(points: DataFrame, ring: str, k: str = "k", closed: bool = True) -> DataFrame:
    """Lattice points at unit steps from each vertex to the next (axis-parallel edges), of a ring also from the last to the first."""
    w = Window.partitionBy(ring).orderBy(k)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) if closed else F.lead(c).over(w)
    p = points.withColumns({"_x": after("x"), "_y": after("y")}).where("_x is not null")
    steps = F.greatest(F.abs(F.col("_x") - F.col("x")), F.abs(F.col("_y") - F.col("y"))).cast("int")
    p = p.withColumn("_s", F.explode(F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))))
    return p.select(ring, k, F.col("_s").alias("step"), (F.col("x") + F.signum(F.col("_x") - F.col("x")) * F.col("_s")).alias("x"), (F.col("y") + F.signum(F.col("_y") - F.col("y")) * F.col("_s")).alias("y"))


def canonical_open(chain: Column) -> Column:
    """The chain or its reverse, whichever sorts first."""
    return F.least(chain, F.reverse(chain))


def canonical_cycle(ring: Column) -> Column:
    """The least of the ring's rotations in both directions."""
    n = F.size(ring)
    turns = lambda r: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.concat(r, r), i + 1, n))
    return F.array_min(F.concat(turns(ring), turns(F.reverse(ring))))


def adjacent_groups(shapes: DataFrame, by: Sequence[str], order: str, color: str) -> DataFrame:
    """Neighbouring shapes of equal colour in paint order as one group: by, group, colour, shapes in order."""
    w = Window.partitionBy(*by).orderBy(order)
    fresh = (~F.lag(color).over(w).eqNullSafe(F.col(color)) | (F.row_number().over(w) == 1)).cast("long")
    return shapes.withColumn("_f", fresh).withColumn("group", F.sum("_f").over(w)).groupBy(*by, "group", color).agg(F.sort_array(F.collect_list(order)).alias("shapes"))
