"""Curve and box arithmetic as Column expressions. Points are STRUCT<x,y DOUBLE>, cubics STRUCT<c1,c2,e>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def sub(p: Column, q: Column) -> Column:
    return point(p["x"] - q["x"], p["y"] - q["y"])


def add(p: Column, q: Column) -> Column:
    return point(p["x"] + q["x"], p["y"] + q["y"])


def mul(p: Column, k) -> Column:
    return point(p["x"] * k, p["y"] * k)


def dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"]


def length(p: Column) -> Column:
    return F.sqrt(dot(p, p))


def norm(p: Column) -> Column:
    """The unit vector, (0, 0) for lengths to 1e-12."""
    n = length(p)
    return F.when(n > 1e-12, point(p["x"] / n, p["y"] / n)).otherwise(point(F.lit(0), F.lit(0)))


def bezier_point(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    u = 1 - t
    w = (u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t)
    return point(*(sum(k * p[c] for k, p in zip(w, (p0, p1, p2, p3), strict=True)) for c in ("x", "y")))


def sample_count(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """The control hull's length rounded up, 4 to 64."""
    hull = length(sub(p1, p0)) + length(sub(p2, p1)) + length(sub(p3, p2))
    return F.least(F.greatest(F.ceil(hull), F.lit(4)), F.lit(64)).cast("int")


def sample_cubic(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """k + 1 points, k as in sample_count. For many curves, explode the numbers first and take bezier_point of each row."""
    k = sample_count(p0, p1, p2, p3)
    return F.transform(F.sequence(F.lit(0), k), lambda i: bezier_point(p0, p1, p2, p3, i / k))


def sample_pair(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The samples of two cubics (four points each) that join, the joint once."""
    second = sample_cubic(*b)
    return F.concat(sample_cubic(*a), F.slice(second, 2, F.size(second) - 1))


def central_tangent(ring: Column, i: Column) -> Column:
    """The direction from the ring's point before to the one after."""
    n = F.size(ring)
    return norm(sub(F.get(ring, F.pmod(i + 1, n)), F.get(ring, F.pmod(i - 1, n))))


def dist2_to_segment(p: Column, a: Column, b: Column) -> Column:
    d = sub(b, a)
    size = dot(d, d)
    t = F.when(size <= 0, 0.0).otherwise(F.least(F.greatest(dot(sub(p, a), d) / size, F.lit(0.0)), F.lit(1.0)))
    off = sub(p, add(a, mul(d, t)))
    return dot(off, off)


def dist2_to_polyline(p: Column, line: Column) -> Column:
    """The least over consecutive pairs, infinite for fewer than two points."""
    each = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: dist2_to_segment(p, F.get(line, i - 1), F.get(line, i)))
    return F.when(F.size(line) < 2, F.lit(float("inf"))).otherwise(F.array_min(each))


def box_dist2(p: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx = F.greatest(x0 - p["x"], p["x"] - x1, F.lit(0.0))
    dy = F.greatest(y0 - p["y"], p["y"] - y1, F.lit(0.0))
    return dx * dx + dy * dy


def boxes_overlap(a: str, b: str) -> Column:
    """Closed boxes with columns {a}x0 .. {a}y1 and {b}x0 .. {b}y1."""
    c = F.col
    return (c(f"{a}x0") <= c(f"{b}x1")) & (c(f"{a}x1") >= c(f"{b}x0")) & (c(f"{a}y0") <= c(f"{b}y1")) & (c(f"{a}y1") >= c(f"{b}y0"))


def chord_lengths(points: Column) -> Column:
    """Cumulative chord length of each point, from 0 to 1 (all 0 if the chain has none)."""
    steps = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: length(sub(F.get(points, i), F.get(points, i - 1))))
    sums = F.when(F.size(points) < 2, F.array(F.lit(0.0))).otherwise(
        F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    )
    total = F.element_at(sums, -1)
    return F.transform(sums, lambda s: F.when(total > 0, s / total).otherwise(F.lit(0.0)))


def translate(cubics: Column, dx, dy) -> Column:
    move = lambda p: point(p["x"] + dx, p["y"] + dy)
    return F.transform(cubics, lambda c: F.struct(*(move(c[k]).alias(k) for k in ("c1", "c2", "e"))))


def scale(cubics: Column, k) -> Column:
    return F.transform(cubics, lambda c: F.struct(*(mul(c[x], k).alias(x) for x in ("c1", "c2", "e"))))


def place(start: Column, cubics: Column, ratio, dx, dy) -> Column:
    """STRUCT<start, cubics> rescaled, then moved: from a layer's scale and origin to the document's."""
    moved = translate(scale(cubics, ratio), dx, dy)
    return F.struct(add(mul(start, ratio), point(F.lit(dx), F.lit(dy))).alias("start"), moved.alias("cubics"))


def span_key(start: Column, cubics: Column) -> Column:
    """A 64-bit name of a curve, the same in both directions."""
    back = reverse_cubics(start, cubics)
    return F.least(F.xxhash64(start, cubics), F.xxhash64(back["start"], back["cubics"]))


def reverse_cubics(start: Column, cubics: Column) -> Column:
    """The same path from its end: STRUCT<start, cubics>."""
    n = F.size(cubics)
    ends = F.concat(F.array(start), F.transform(cubics, lambda c: c["e"]))
    back = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.get(cubics, n - i)["c2"].alias("c1"), F.get(cubics, n - i)["c1"].alias("c2"), F.get(ends, n - i).alias("e")))
    return F.struct(F.element_at(ends, -1).alias("start"), back.alias("cubics"))


def circular_slice(points: Column, a: Column, b: Column) -> Column:
    """Points a..b of a ring, both included; a = b is the whole ring and its first point again."""
    n = F.size(points)
    count = F.pmod(b - a - 1, n) + 2
    return F.slice(F.concat(points, points), a + 1, count)


def undirected(p: Column, q: Column) -> Column:
    """One key for a segment in either direction."""
    return F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"))


def inside_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against a ring of points."""
    n = F.size(ring)

    def crosses(i):
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def mean_thickness(area: Column, perimeter: Column) -> Column:
    return area / (0.5 * F.greatest(perimeter, F.lit(1)))


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A rectangle by its edges, y upwards: STRUCT<left, top, right, bottom>."""
    return F.struct(x.alias("left"), y.alias("top"), (x + w).alias("right"), (y - h).alias("bottom"))


def rect_size(r: Column) -> Column:
    return F.struct((r["right"] - r["left"]).alias("w"), (r["top"] - r["bottom"]).alias("h"))


def fit_square(w: Column, h: Column, side: int = 512, padded: bool = False) -> Column:
    """How layers of a w x h board come to a square of the side (twice as large with padding): STRUCT<ratio, dx, dy>, centred.

    A padded board must be a multiple of the side; else NULL.
    """
    target = 2 * side if padded else side
    ratio = F.lit(float(target)) / F.greatest(w, h)
    out = F.struct(ratio.alias("ratio"), ((target - w * ratio) / 2).alias("dx"), ((target - h * ratio) / 2).alias("dy"))
    return F.when((w % side == 0) & (h % side == 0), out) if padded else out
