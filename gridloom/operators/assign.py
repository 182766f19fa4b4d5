"""Nearest colours, plain and held to a neighbourhood, and comparisons of two images.

Palettes are small by definition (a few hundred colours at most) and checked before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.plans.lineage import cut

MOST_COLORS = 4096


def _small(palette: DataFrame) -> DataFrame:
    if palette.limit(MOST_COLORS + 1).count() > MOST_COLORS:
        raise ValueError(f"a palette has at most {MOST_COLORS} colours")
    return F.broadcast(palette)


def nearest_color(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """pixels (r, g, b, ...) with the idx of the nearest palette colour (ties: lowest) and its squared distance.

    The palette becomes one array, so a pixel stays one row and nothing is shuffled.
    """
    entries = _small(palette).select("idx", C.lab(F.col("r"), F.col("g"), F.col("b")).alias("q")).agg(F.sort_array(F.collect_list(F.struct("idx", "q"))).alias("palette"))
    own = C.lab(F.col("r"), F.col("g"), F.col("b"))
    found = pixels.withColumn("p", own).join(F.broadcast(entries), F.lit(True))
    each = F.transform("palette", lambda e: F.struct(F.round(C.dist2(F.col("p"), e["q"]), 9).alias("d2"), e["idx"].alias("idx")))
    return found.withColumn("best", F.array_min(each)).select(*pixels.columns, F.col("best.idx").alias("idx"), F.col("best.d2").alias("d2"))


def constrained_nearest(targets: DataFrame, sources: DataFrame, scale: int, cost: Column, by: Sequence[str] = (), palette: DataFrame | None = None) -> DataFrame:
    """targets (x, y, ...), each with the idx of least cost among the 3 x 3 source cells (x, y, idx) around its own.

    A target lies over the source cell (x div scale, y div scale). Equal costs go to the cell met first, row by row.
    Targets whose neighbourhood has no idx get the one of least cost in the palette (by, idx), ties to the least, or NULL
    without a palette; ``targets`` gives cost's columns beside idx.
    """
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit((dy + 1) * 3 + dx + 1).alias("place")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    columns = [c for c in targets.columns if c != "idx"]
    asked = targets.select(*columns).withColumn("s", around)
    asked = asked.withColumn("sx", F.floor(F.col("x") / scale) + F.col("s.dx")).withColumn("sy", F.floor(F.col("y") / scale) + F.col("s.dy"))
    given = sources.select(*by, F.col("x").cast("long").alias("sx"), F.col("y").cast("long").alias("sy"), "idx").where("idx is not null")
    joined = asked.join(given, [*by, "sx", "sy"], "left")
    best = F.min_by("idx", F.when(F.col("idx").isNotNull(), F.struct(cost.alias("cost"), F.col("s.place").alias("place"))))
    found = joined.groupBy(*columns).agg(best.alias("idx"))
    if palette is None:
        return found
    found = cut(found)  # read twice
    left = found.where("idx is null").drop("idx")
    offered = palette.select(*by, "idx")
    every = left.join(offered, list(by)) if by else left.join(_small(offered), F.lit(True))
    return found.where("idx is not null").unionByName(every.groupBy(*columns).agg(F.min_by("idx", F.struct(cost.alias("cost"), "idx")).alias("idx")))


def swatch_gaps(palette: DataFrame) -> DataFrame:
    """For each palette entry its distance to the nearest other, NULL when alone."""
    lab = _small(palette).select("idx", C.lab(F.col("r"), F.col("g"), F.col("b")).alias("p"))
    other = F.broadcast(lab.select(F.col("idx").alias("j"), F.col("p").alias("q")))
    return lab.join(other, F.col("idx") != F.col("j"), "left").groupBy("idx").agg(F.min(C.dist(F.col("p"), F.col("q"))).alias("gap"))


def image_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over cells painted in either image (r, g, b; unpainted is white): mean distance, share of 0.06 at least, differing cells, worst channel."""
    other = b.select(*keys, *(F.col(c).alias(f"{c}2") for c in "rgb"))
    both = a.select(*keys, "r", "g", "b").join(other, list(keys), "full")
    both = both.select(*(F.coalesce(c, F.lit(255)).alias(c) for c in ("r", "g", "b", "r2", "g2", "b2")))
    e = C.dist(C.lab(F.col("r"), F.col("g"), F.col("b")), C.lab(F.col("r2"), F.col("g2"), F.col("b2")))
    worst = F.greatest(*(F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb"))
    return both.select(e.alias("e"), worst.alias("w")).agg(
        F.count("*").alias("painted"),
        F.round(F.avg("e"), 6).alias("mean_distance"),
        F.round(F.avg(F.when(F.col("e") >= 0.06, 1.0).otherwise(0.0)), 6).alias("visible"),
        F.count_if(F.col("w") > 0).alias("differing"),
        F.max("w").alias("worst"),
    )
