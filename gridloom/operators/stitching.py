"""Borders that several rings share: both sides have the very same curves.

Rings are cut where the set of rings beside them changes. Each stretch is put in a direction of its own that doesn't depend
on the ring it came from, and is smoothed and fitted with its ends held; a ring that is one stretch (no neighbour, or the same
all around) is fitted closed from its least point. A fit sees nothing but the stretch's form, so both sides' are equal, and a
task makes those of one form once. Joins find what lies beside a unit step; then a task takes one ring after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import curves, seams

NAMES = ["x0", "y0", "c1x", "c1y", "c2x", "c2y", "ex", "ey"]
Point = tuple[float, float]


def steps(rings: DataFrame, by: list[str], image: str | None = None) -> DataFrame:
    """rings (by, k, x, y: lattice corners): by, pos, x, y of each unit step, and p, q: what names the rings on its other side in the same image (one of by), in 128 bits."""
    named = rings.withColumn("id", F.struct(*by))
    dense = seams.densify(named, "id")
    order = Window.partitionBy("id").orderBy("k", "step")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {f"{c}1": F.coalesce(F.lead(c).over(order), F.first(c).over(every)) for c in ("x", "y")}
    each = dense.withColumns({"pos": F.row_number().over(order), **ends}).withColumnsRenamed({"x": "x0", "y": "y0"})
    met = seams.partners(each.select("id", "pos", "x0", "y0", "x1", "y1", *([F.col(f"id.{image}").alias("image")] if image else [])), "id", by=["image"] if image else [])
    return met.select("id.*", "pos", F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"), F.xxhash64("partners").alias("p"), F.xxhash64(F.lit("again"), "partners").alias("q"))


def stretches(points: list[Point], beside: list) -> list[tuple[list[Point], bool]]:
    """A ring's stretches of equal neighbours, in the ring's order from the first change on, and whether that is the whole ring."""
    n = len(points)
    cuts = [k for k in range(n) if beside[k] != beside[k - 1]]
    if not cuts:
        return [(points, True)]
    around = points + points + points[:1]
    return [(around[a : (b if b > a else b + n) + 1], False) for a, b in zip(cuts, cuts[1:] + cuts[:1], strict=True)]


def _canonical(points: list[Point], whole: bool) -> tuple[list[Point], bool]:
    """The points in the direction of their own, and whether that is the other one; whole rings from the least point."""
    back = points[::-1]
    if whole:
        turn = lambda p: p[(k := p.index(min(p))) :] + p[:k]
        points, back = turn(points), turn(back)
    flip = back < points
    return (back if flip else points), flip


def _bare(points: np.ndarray, whole: bool) -> np.ndarray:
    """Without the points where the direction stays the same."""
    before = np.roll(points, 1, 0)
    after = np.roll(points, -1, 0)
    turns = ((points - before) != (after - points)).any(1)
    if not whole:
        turns[[0, -1]] = True
    return points[turns]


def stitched(rings: DataFrame, by: list[str], tolerance: float = 0.5, threshold: float = 1.2, arm: float = 2.0, radius: float = 1.0, image: str | None = None) -> DataFrame:
    """rings (by, k, x, y): by, seg and the cubic's eight coordinates, as ``curves.fit_rings`` gives them, shared borders equal on both sides."""
    kinds = dict(rings.dtypes)

    def fit(points: np.ndarray, whole: bool) -> list[np.ndarray]:
        points = _bare(points, whole)
        if whole:
            fixed = curves.corners(points, threshold, arm)
            return curves.fit_closed(curves.smooth(points, fixed, radius), fixed, tolerance)
        fixed = curves.corners_open(points, threshold, arm)
        smooth = curves.smooth_open(points, fixed, radius)
        cuts = [0, *fixed.tolist(), len(points) - 1]
        return [c for a, b in zip(cuts, cuts[1:], strict=False) for c in curves.fit_open(smooth[a : b + 1], tolerance)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        fits = curves.Fits(fit)
        schema = pa.schema([*(first.schema.field(c) for c in by), ("seg", pa.int32()), *((c, pa.float64()) for c in NAMES)])

        def rows() -> Iterator[tuple]:
            for key, own in curves.sequences(chain([first], batches), by):
                cubics = []
                for points, whole in stretches(list(zip(own["x"], own["y"], strict=True)), list(zip(own["p"], own["q"], strict=True))):
                    points, flip = _canonical(points, whole)
                    found = fits.of(points, whole)
                    cubics += [c[6:] + c[4:6] + c[2:4] + c[:2] for c in reversed(found)] if flip else found
                yield *([x] * len(cubics) for x in key), range(len(cubics)), *zip(*cubics, strict=True)

        yield from curves.in_batches(rows(), schema)

    order = steps(rings, by, image).repartition(*by).sortWithinPartitions(*by, "pos")
    return order.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "seg int", *(f"{c} double" for c in NAMES)]))
