"""Contours and curves: ring walking, corners, arc-length smoothing, cubic fitting and anchor removal.

Rings are sequences: a task reads them one after the other and holds one; nothing but rings is gathered. ``fit_rings`` takes
one row for each point and gives one row for each cubic. Fits are made with the first point at 0, 0 and moved, so those of one
form are equal but for their place, and a task makes each once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import grid
from gridloom.plans.lineage import cut


def boundary_edges(cells: DataFrame, label: str = "region") -> DataFrame:
    """Directed unit edges around each label's cells, the cells on their right: label, x0, y0, x1, y1. Labels may overlap."""
    sides = grid.beside(cells.select("x", "y", label, F.lit(True).alias("on")), "on", [label]).where(F.col("other").isNull())
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    x0 = F.when(dy == -1, F.col("x")).when(dx == 1, F.col("x") + 1).when(dy == 1, F.col("x") + 1).otherwise(F.col("x"))
    y0 = F.when(dy == -1, F.col("y")).when(dx == 1, F.col("y")).when(dy == 1, F.col("y") + 1).otherwise(F.col("y") + 1)
    x1 = F.when(dy == -1, F.col("x") + 1).when(dx == 1, F.col("x") + 1).otherwise(F.col("x"))
    y1 = F.when(dy == -1, F.col("y")).when(dx == 1, F.col("y") + 1).when(dy == 1, F.col("y") + 1).otherwise(F.col("y"))
    return sides.select(label, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def link_rings(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Rings of the vertices where the direction changes; at a crossing the walk turns right. Rings of fewer than 3 go."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x0, y0, x1, y1 in sorted(edges):
        out.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    for start in sorted(out):
        while out[start]:
            at, ring, heading = start, [], None
            while True:
                ways = out[at]
                if heading is not None and len(ways) > 1:
                    right = (at[0] - heading[1], at[1] + heading[0])
                    to = right if right in ways else ways[0]
                else:
                    to = ways[0]
                ways.remove(to)
                step = (to[0] - at[0], to[1] - at[1])
                if step != heading:
                    ring.append(at)
                at, heading = to, step
                if at == start:
                    break
            if len(ring) > 2 and (ring[0][0] - ring[-1][0]) * (ring[1][1] - ring[0][1]) == (ring[0][1] - ring[-1][1]) * (ring[1][0] - ring[0][0]):
                ring = ring[1:]
            if len(ring) >= 3:
                rings.append(ring)
    return rings


def sequences(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Of rows sorted by ``by``: each sequence of equal rows there, and the lists of its other columns."""
    key, held = None, None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        keys = list(zip(*(columns.pop(c) for c in by), strict=True))
        starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        for first, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            part = {c: x[first:end] for c, x in columns.items()}
            if held is not None and keys[first] == key:
                for c, x in part.items():
                    held[c] += x
                continue
            if held is not None:
                yield key, held
            key, held = keys[first], part
    if held is not None:
        yield key, held


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """rows of lists, one for each column, as batches of about so many rows."""
    out: list[list] = [[] for _ in schema]
    for row in rows:
        for column, x in zip(out, row, strict=True):
            column += x
        if len(out[0]) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
            out = [[] for _ in schema]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)


class Fits:
    """Cubics (n x 8) of a chain of points by ``fit``, which sees it with its first point at 0, 0; so many forms are kept."""

    def __init__(self, fit: Callable[[np.ndarray, bool], list[np.ndarray]], most: int = 20_000):
        self.fit, self.most, self.known = fit, most, {}

    def of(self, points: list[tuple[float, float]], whole: bool = True) -> list[list[float]]:
        x0, y0 = points[0]
        form = (whole, *((x - x0, y - y0) for x, y in points))
        if (found := self.known.get(form)) is None:
            cubics = self.fit(np.array(form[1:], float), whole)
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[form] = np.array(cubics).reshape(len(cubics), 8).tolist()
        return [[a + x0, b + y0, c + x0, d + y0, e + x0, f + y0, g + x0, h + y0] for a, b, c, d, e, f, g, h in found]


def rings(cells: DataFrame, label: str = "region") -> DataFrame:
    """label, ring, k, x, y of each label's boundary rings."""
    edges = boundary_edges(cells, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field(label), ("ring", pa.int32()), ("k", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])

        def rows() -> Iterator[tuple]:
            for (name,), own in sequences(chain([first], batches), [label]):
                for r, ring in enumerate(link_rings(list(zip(own["x0"], own["y0"], own["x1"], own["y1"], strict=True)))):
                    yield [name] * len(ring), [r] * len(ring), range(len(ring)), [x for x, _ in ring], [y for _, y in ring]

        yield from in_batches(rows(), schema)

    return edges.repartition(label).sortWithinPartitions(label).mapInArrow(run, f"{label} {dict(edges.dtypes)[label]}, ring int, k int, x double, y double")


def _turn(points: np.ndarray, i: int, before: Iterable[int], after: Iterable[int], arm: float) -> float:
    """The turn at a point between the directions to the first points on either side that are ``arm`` away as the crow flies, else to the last ones."""

    def direction(places: Iterable[int]) -> np.ndarray:
        off = np.zeros(2)
        for j in places:
            off = points[j] - points[i]
            if off @ off >= arm * arm:
                break
        return _unit(off)

    return float(np.arccos(np.clip(-direction(before) @ direction(after), -1, 1)))


def _sharpest(turns: np.ndarray, threshold: float) -> list[int]:
    """Of each run of turns from the threshold on the largest, the first of equal ones; turns are equal that agree to 9 digits."""
    sharp = np.flatnonzero(turns >= threshold)
    runs = np.split(sharp, np.flatnonzero(np.diff(sharp) > 1) + 1) if len(sharp) else []
    return [int(r[np.argmax(np.round(turns[r], 9))]) for r in runs]


def corners(points: np.ndarray, threshold: float, arm: float) -> np.ndarray:
    """Corner indices of a ring: where the turn reaches the threshold, of a run of such points the sharpest (first); a run may go on past the last point."""
    n = len(points)
    if n < 3:
        return np.arange(n)
    # Back at the point itself (no point is that far) there is no direction, which counts as a right angle.
    turns = np.array([_turn(points, i, ((i - k) % n for k in range(1, n + 1)), ((i + k) % n for k in range(1, n + 1)), arm) for i in range(n)])
    out = _sharpest(turns, threshold)
    if len(out) > 1 and turns[0] >= threshold and turns[-1] >= threshold:
        out.pop(-1 if round(turns[out[0]], 9) >= round(turns[out[-1]], 9) else 0)
    return np.array(out, int)


def smooth(points: np.ndarray, fixed: np.ndarray, radius: float) -> np.ndarray:
    """Arc-length window means on a ring; the window shrinks to the nearest fixed point, which stays."""
    n = len(points)
    if n < 3 or radius <= 0:
        return points.copy()
    steps = np.linalg.norm(np.roll(points, -1, 0) - points, axis=1)
    at = np.concatenate([[0], np.cumsum(steps)[:-1]])
    whole = steps.sum()
    out = points.copy()
    for i in range(n):
        gap = np.abs(at - at[i])
        gap = np.minimum(gap, whole - gap)
        reach = min(radius, whole / 2, *(gap[fixed].min(),) if len(fixed) else ())
        if reach > 0:
            out[i] = points[gap <= reach].mean(axis=0)
    return out


def corners_open(points: np.ndarray, threshold: float, arm: float) -> np.ndarray:
    """Corners of an open chain, its ends excluded: as ``corners``, but arms stop at the ends."""
    n = len(points)
    turns = np.full(max(n, 1), -1.0)
    for i in range(1, n - 1):
        turns[i] = _turn(points, i, range(i - 1, -1, -1), range(i + 1, n), arm)
    return np.array(_sharpest(turns, threshold), int)


def smooth_open(points: np.ndarray, fixed: np.ndarray, radius: float) -> np.ndarray:
    """Arc-length window means along an open chain; ends and fixed points stay, and the window shrinks to the nearest of them."""
    n = len(points)
    if n < 3 or radius <= 0:
        return points.copy()
    at = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(points, axis=0), axis=1))])
    held = at[np.unique(np.concatenate([[0, n - 1], np.asarray(fixed, int)]))]
    out = points.copy()
    for i in range(n):
        reach = min(radius, np.abs(held - at[i]).min())
        if reach > 0:
            out[i] = points[np.abs(at - at[i]) <= reach].mean(axis=0)
    return out


def clearance(points: np.ndarray, others: np.ndarray) -> float:
    """Least distance of the points to the segments (n, 2, 2) of other paths, infinite without any."""
    if not len(others):
        return float("inf")
    a, d = others[:, 0], others[:, 1] - others[:, 0]
    size = np.maximum((d * d).sum(1), 1e-12)
    t = np.clip(((points[:, None] - a) * d).sum(2) / size, 0, 1)
    return float(np.sqrt((((points[:, None] - a - t[..., None] * d) ** 2).sum(2)).min()))


def narrow_places(points: np.ndarray) -> np.ndarray:
    """For each ring point the index of the nearest other point that is more than twice as far along the ring as straight, -1 for none."""
    n = len(points)
    steps = np.linalg.norm(np.roll(points, -1, 0) - points, axis=1)
    at = np.concatenate([[0], np.cumsum(steps)[:-1]])
    along = np.abs(at[:, None] - at[None])
    along = np.minimum(along, steps.sum() - along)
    straight = np.linalg.norm(points[:, None] - points[None], axis=2)
    straight = np.where((along > 2 * straight) & ~np.eye(n, dtype=bool), straight, np.inf)
    best = straight.argmin(axis=1)
    return np.where(np.isfinite(straight.min(axis=1)), best, -1)


def simplify_clear(cubics: list[np.ndarray], others: np.ndarray, tolerance: float, threshold: float, keep: float = 0.5) -> list[np.ndarray]:
    """``simplify``, undone where it takes more than half of 1 - keep of the distance to other paths."""
    before = clearance(np.vstack([bezier(c, np.linspace(0, 1, 9)) for c in cubics]), others)
    out = simplify(cubics, tolerance, threshold)
    after = clearance(np.vstack([bezier(c, np.linspace(0, 1, 9)) for c in out]), others)
    return out if not np.isfinite(before) or after >= (1 + keep) / 2 * before else cubics


def bezier(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    t = np.asarray(t)[:, None]
    u = 1 - t
    return u**3 * p[0] + 3 * u**2 * t * p[1] + 3 * u * t**2 * p[2] + t**3 * p[3]


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 1e-12 else np.zeros(2)


def _solve(points: np.ndarray, t: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least-squares handle lengths along fixed end directions; a third of the chord where that is degenerate, inverted or longer than ten chords."""
    b = np.stack([(1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t**2 * (1 - t), t**3])
    chord = np.linalg.norm(points[-1] - points[0])
    a1, a2 = b[1][:, None] * u, b[2][:, None] * v
    rest = points - (b[0] + b[1])[:, None] * points[0] - (b[2] + b[3])[:, None] * points[-1]
    m = np.array([[(a1 * a1).sum(), (a1 * a2).sum()], [(a1 * a2).sum(), (a2 * a2).sum()]])
    y = np.array([(a1 * rest).sum(), (a2 * rest).sum()])
    det = np.linalg.det(m)
    handles = np.linalg.solve(m, y) if abs(det) > 1e-12 else np.zeros(2)
    if not np.isfinite(handles).all() or handles.min() < 1e-6 * chord or handles.max() > 10 * chord:
        handles = np.full(2, chord / 3)
    return np.array([points[0], points[0] + u * handles[0], points[-1] + v * handles[1], points[-1]])


def _worst(points: np.ndarray, p: np.ndarray, t: np.ndarray, slack: np.ndarray) -> tuple[float, int]:
    """The largest squared error, each over its squared slack, and where to split.

    It is taken at the inner points, and between points, where a curve can bow off the chord it should follow, at samples.
    """
    at_points = ((bezier(p, t[1:-1]) - points[1:-1]) ** 2).sum(1) / slack[1:-1] ** 2
    chords = points[1:] - points[:-1]
    sizes = np.sqrt((chords**2).sum(1))
    k = np.clip(np.ceil(0.5 * sizes), 1, 32).astype(int)
    owner = np.repeat(np.arange(len(k)), k)
    share = (np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k) + 1) / (k[owner] + 1)
    curve = bezier(p, t[owner] + (t[owner + 1] - t[owner]) * share)
    along = np.clip(((curve - points[owner]) * chords[owner]).sum(1) / np.maximum(sizes[owner] ** 2, 1e-24), 0, 1)
    off = curve - points[owner] - along[:, None] * chords[owner]
    between = (off**2).sum(1) / np.minimum(slack[owner], slack[owner + 1]) ** 2
    errors = np.concatenate([at_points, between])
    worst = int(np.argmax(errors))
    if errors[worst] <= 0:
        return 0.0, len(points) // 2
    return float(errors[worst]), worst + 1 if worst < len(at_points) else min(int(owner[worst - len(at_points)]) + 1, len(points) - 2)


def _nearer(p: np.ndarray, points: np.ndarray, t: np.ndarray) -> np.ndarray:
    """One Newton step of each parameter towards its point's foot."""
    d1, d2 = 3 * (p[1:] - p[:-1]), 6 * (p[2:] - 2 * p[1:-1] + p[:-2])
    s = t[:, None]
    first = (1 - s) ** 2 * d1[0] + 2 * s * (1 - s) * d1[1] + s**2 * d1[2]
    second = (1 - s) * d2[0] + s * d2[1]
    off = bezier(p, t) - points
    below = (first**2).sum(1) + (off * second).sum(1)
    step = np.divide((off * first).sum(1), below, out=np.zeros_like(t), where=np.abs(below) > 1e-12)
    return np.clip(t - step, 0, 1)


def fit_open(points: np.ndarray, tolerance: float, u: np.ndarray | None = None, v: np.ndarray | None = None, slack: np.ndarray | None = None, depth: int = 33) -> list[np.ndarray]:
    """Cubics (4 x 2) along an open chain within the tolerance times each point's slack; split at the worst place where one isn't enough."""
    todo = [(points, u, v, np.ones(len(points)) if slack is None else slack, depth)]
    out = []
    while todo:
        points, u, v, slack, depth = todo.pop()
        u = _unit(points[1] - points[0]) if u is None else u
        v = _unit(points[-2] - points[-1]) if v is None else v
        if len(points) == 2:  # nothing inside can be checked, so handles off the chord are cut to what keeps the bow within the tolerance
            chord = points[1] - points[0]
            along = _unit(chord)
            bow = max(abs(u[0] * along[1] - u[1] * along[0]), abs(v[0] * along[1] - v[1] * along[0]))
            third, allowed = np.linalg.norm(chord) / 3, tolerance * slack.min()
            if 0.75 * third * bow > allowed:
                third = allowed / (0.75 * bow)
            out.append(np.array([points[0], points[0] + u * third, points[1] + v * third, points[1]]))
            continue
        sums = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(points, axis=0), axis=1))])
        t = sums / max(sums[-1], 1e-12)
        p = _solve(points, t, u, v)
        error, worst = _worst(points, p, t, slack)
        for _ in range(4 if tolerance**2 < error <= 16 * tolerance**2 else 0):  # a close miss may lie in the parameters
            t = _nearer(p, points, t)
            p = _solve(points, t, u, v)
            error, worst = _worst(points, p, t, slack)
            if error <= tolerance**2:
                break
        if error <= tolerance**2 or depth <= 0:
            out.append(p)
            continue
        middle = _unit(points[worst - 1] - points[worst + 1])
        todo += [(points[worst:], -middle, v, slack[worst:], depth - 1), (points[: worst + 1], u, middle, slack[: worst + 1], depth - 1)]
    return out


def fit_closed(points: np.ndarray, fixed: np.ndarray, tolerance: float, slack: np.ndarray | None = None) -> list[np.ndarray]:
    """Cubics around a ring, cut at its fixed points; without any at two opposite points with common tangents, with one also at the opposite."""
    n = len(points)
    slack = np.ones(n) if slack is None else slack
    cuts = sorted({int(k) for k in fixed}) or [0, n // 2]
    if len(cuts) == 1:
        cuts = sorted({cuts[0], (cuts[0] + n // 2) % n})
    tangent = {k: _unit(points[(k + 1) % n] - points[(k - 1) % n]) for k in cuts}
    out = []
    for a, b in zip(cuts, cuts[1:] + cuts[:1], strict=True):
        span = [(a + k) % n for k in range((b - a) % n + 1 if a != b else n + 1)]
        ends = (None, None) if len(fixed) else (tangent[a], -tangent[b])
        out += fit_open(points[span], tolerance, *ends, slack[span])
    return out


def simplify(cubics: list[np.ndarray], tolerance: float, threshold: float) -> list[np.ndarray]:
    """Anchors of a ring go one by one where one cubic for both neighbours stays within the tolerance and the turn is below the threshold; 3 anchors stay."""
    cubics = [c.copy() for c in cubics]
    changed = tolerance > 0
    while changed and len(cubics) > 3:
        changed, k = False, 0
        while k < len(cubics) and len(cubics) > 3:
            a, b = cubics[k], cubics[(k + 1) % len(cubics)]
            u, v = _unit(a[3] - a[2]), _unit(b[1] - b[0])
            if np.arccos(np.clip(u @ v, -1, 1)) < threshold:
                dense = np.vstack([bezier(a, np.linspace(0, 1, 9)), bezier(b, np.linspace(0, 1, 9))[1:]])
                one = fit_open(dense, tolerance, _unit(a[1] - a[0]), _unit(b[2] - b[3]), depth=0)[0]
                sums = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(dense, axis=0), axis=1))])
                curve = bezier(one, np.linspace(0, 1, 65))
                if sums[-1] > 0 and max(np.min(np.linalg.norm(curve - q, axis=1)) for q in dense) <= tolerance:
                    cubics[k] = one
                    del cubics[(k + 1) % len(cubics)]
                    changed = True
            k += 1
    return cubics


def fit_rings(points: DataFrame, by: list[str], tolerance: float = 0.5, threshold: float = 1.2, arm: float = 2.0, radius: float = 1.0, drop: float = 0.0) -> DataFrame:
    """points (by, k, x, y): by, seg and the cubic's eight coordinates."""
    kinds = dict(points.dtypes)
    names = ["x0", "y0", "c1x", "c1y", "c2x", "c2y", "ex", "ey"]

    def fit(ring: np.ndarray, _: bool) -> list[np.ndarray]:
        fixed = corners(ring, threshold, arm)
        cubics = fit_closed(smooth(ring, fixed, radius), fixed, tolerance)
        return simplify(cubics, drop, threshold) if drop > 0 else cubics

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        fits = Fits(fit)
        schema = pa.schema([*(first.schema.field(c) for c in by), ("seg", pa.int32()), *((c, pa.float64()) for c in names)])

        def rows() -> Iterator[tuple]:
            for key, own in sequences(chain([first], batches), by):
                cubics = fits.of(list(zip(own["x"], own["y"], strict=True)))
                yield *([x] * len(cubics) for x in key), range(len(cubics)), *zip(*cubics, strict=True)

        yield from in_batches(rows(), schema)

    rows = points.select(*by, "k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.repartition(*by).sortWithinPartitions(*by, "k").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "seg int", *(f"{c} double" for c in names)]))


def _met(points: DataFrame, segments: DataFrame, most: float, by: list[str]) -> DataFrame:
    """by, id and the distance of each segment of another path that is within ``most`` of the point. Segments are entered in every grid cell that their widened box meets, so a point only meets its own cell's."""
    cell = 2 * most
    seg = segments.withColumn("sx", F.explode(F.sequence(F.floor((F.least("ax", "bx") - most) / cell), F.floor((F.greatest("ax", "bx") + most) / cell))))
    seg = seg.withColumn("sy", F.explode(F.sequence(F.floor((F.least("ay", "by") - most) / cell), F.floor((F.greatest("ay", "by") + most) / cell))))
    p = points.withColumn("sx", F.floor(F.col("x") / cell)).withColumn("sy", F.floor(F.col("y") / cell))
    d = [F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")]
    size = d[0] * d[0] + d[1] * d[1]
    t = F.when(size > 0, F.least(F.greatest(((F.col("x") - F.col("ax")) * d[0] + (F.col("y") - F.col("ay")) * d[1]) / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    off = F.sqrt(F.pow(F.col("x") - F.col("ax") - t * d[0], 2) + F.pow(F.col("y") - F.col("ay") - t * d[1], 2))
    met = p.join(seg, [*by, "sx", "sy"]).where(F.col("own") != F.col("path"))
    if "own_key" in points.columns and "path_key" in segments.columns:  # the same curve, met from both sides
        met = met.where(~F.coalesce(F.col("own_key") == F.col("path_key"), F.lit(False)))
    return met.withColumn("distance", off).select(*by, "id", "distance")


def nearest_segment(points: DataFrame, segments: DataFrame, first: float, most: float | None = None, by: list[str] = ()) -> DataFrame:
    """For each point (by, id, own, x, y) the least distance to a segment (by, path, ax, ay, bx, by) of another path, NULL without any.

    ``own_key`` and ``path_key``, if there, exclude segments of equal key as well. The search starts within ``first`` and
    doubles that for the points that met nothing, until all of them have or the distance spans everything; ``most`` ends it before.
    """
    by = list(by)
    ends = [*segments.agg(*(f(c) for c in ("ax", "bx", "ay", "by") for f in (F.min, F.max))).first(), *points.agg(*(f(c) for c in ("x", "y") for f in (F.min, F.max))).first()]
    span = max((abs(v) for v in ends if v is not None), default=0.0) * 4 + 1
    left, reach, parts = points, first, []
    while True:
        reach = reach if most is None else min(reach, most)
        found = cut(_met(left, segments, reach, by).where(F.col("distance") <= reach).groupBy(*by, "id").agg(F.min("distance").alias("distance")))
        parts.append(found)
        left = cut(left.join(found.select(*by, "id"), [*by, "id"], "left_anti"))
        if reach >= span or most is not None and reach >= most or not left.limit(1).count():
            break
        reach *= 2
    out = left.select(*by, "id", F.lit(None).cast("double").alias("distance"))
    for found in parts:
        out = out.unionByName(found)
    return out


def within(points: DataFrame, segments: DataFrame, distance: float, by: list[str] = ()) -> DataFrame:
    """The points (by, id, own, x, y) that are nearer than the distance to a segment of another path."""
    by = list(by)
    near = _met(points, segments, distance, by).where(F.col("distance") < distance).select(*by, "id").distinct()
    return points.join(near, [*by, "id"], "left_semi")
