"""Palette building: features grown in scan order, leader groups, and selection by eviction; one kernel call for each image."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridloom.operators.merging import Roots, lab

DETECT = 0.015
LEAST_AREA = 3


def grow(labs: np.ndarray, there: np.ndarray, tolerance: float = DETECT) -> tuple[np.ndarray, list[int]]:
    """Component of each cell of an (h, w) image (-1: none) and each component's root.

    In scan order a cell joins the component to its left, else above, whose mean is within the tolerance; a second that
    would take it too fuses with the first only if their means agree as well, into the one met first.
    """
    h, w = there.shape
    label = np.full((h, w), -1, int)
    sums: list[np.ndarray] = []
    counts: list[int] = []
    roots = Roots(0)
    limit = tolerance * tolerance

    def far(p, q) -> float:
        d = p - q
        return float(d @ d)

    for y in range(h):
        for x in range(w):
            if not there[y, x]:
                continue
            own, joined = labs[y, x], -1
            for ny, nx in ((y, x - 1), (y - 1, x)):
                if nx < 0 or ny < 0 or label[ny, nx] < 0:
                    continue
                r = roots.find(label[ny, nx])
                if joined < 0:
                    if far(sums[r] / counts[r], own) <= limit:
                        sums[r] = sums[r] + own
                        counts[r] += 1
                        label[y, x] = joined = r
                elif r != joined and far(sums[r] / counts[r], own) <= limit and far(sums[r] / counts[r], sums[joined] / counts[joined]) <= limit:
                    low, high = min(r, joined), max(r, joined)
                    roots.up[high] = low
                    sums[low] = sums[low] + sums[high]
                    counts[low] += counts[high]
                    joined = low
            if joined < 0:
                label[y, x] = len(counts)
                roots.up.append(len(counts))
                sums.append(own.copy())
                counts.append(1)
    return label, [roots.find(k) for k in range(len(counts))]


def features(cells: DataFrame, tolerance: float = DETECT) -> DataFrame:
    """cells (image, x, y, r, g, b; missing: transparent): image, x, y and the feature's first cell as (fx, fy)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        px, py = x - x.min(), y - y.min()
        shape = (py.max() + 1, px.max() + 1)
        labs, there = np.zeros((*shape, 3)), np.zeros(shape, bool)
        labs[py, px] = lab(rows[["r", "g", "b"]].to_numpy())
        there[py, px] = True
        label, root = grow(labs, there, tolerance)
        own = np.array(root)[label[py, px]]
        firsts: dict[int, tuple[int, int]] = {}
        for k in np.lexsort((x, y)):
            firsts.setdefault(int(own[k]), (int(x[k]), int(y[k])))
        return pd.DataFrame({"image": rows["image"].iloc[0], "x": x, "y": y, "fx": [firsts[int(k)][0] for k in own], "fy": [firsts[int(k)][1] for k in own]})

    return cells.select("image", "x", "y", "r", "g", "b").groupBy("image").applyInPandas(run, f"image {dict(cells.dtypes)['image']}, x int, y int, fx int, fy int")


def leader_groups(rows: pd.DataFrame, tolerance: float = DETECT) -> pd.DataFrame:
    """Features (r, g, b, area) by area, then colour, each to the first group whose founder is within the tolerance: r, g, b, largest, aggregate, best first."""
    rows = rows[rows["area"] >= LEAST_AREA].sort_values(["area", "r", "g", "b"], ascending=[False, True, True, True])
    founders, groups = np.zeros((0, 3)), []
    for (r, g, b, area), p in zip(rows[["r", "g", "b", "area"]].to_numpy(), lab(rows[["r", "g", "b"]].to_numpy()) if len(rows) else (), strict=True):
        near = np.flatnonzero(np.linalg.norm(founders - p, axis=1) <= tolerance)
        if len(near):
            groups[near[0]][4] += area
        else:
            founders = np.vstack([founders, p])
            groups.append([r, g, b, area, area])
    out = pd.DataFrame(groups, columns=["r", "g", "b", "largest", "aggregate"]).astype("int64")
    return out.sort_values(["largest", "aggregate", "r", "g", "b"], ascending=[False, False, True, True, True]).reset_index(drop=True)


def choose(groups: pd.DataFrame, most: int, locked: Sequence[tuple[int, int, int]] = (), dedup: float = DETECT) -> list[tuple[int, int, int]]:
    """Locked colours, then groups not within ``dedup`` of a kept one; while too many, the one with least area x nearest gap goes (never a locked one)."""
    slots: list[tuple[tuple, np.ndarray, float]] = []
    for c in locked:
        if all(s[0] != tuple(c) for s in slots):
            slots.append((tuple(c), lab([c])[0], 0.0))
    n_locked = len(slots)
    for r, g, b, total in groups[["r", "g", "b", "aggregate"]].to_numpy():
        p = lab([(r, g, b)])[0]
        if all(np.linalg.norm(p - s[1]) >= dedup for s in slots):
            slots.append(((int(r), int(g), int(b)), p, float(total)))
    while len(slots) > max(most, n_locked):
        points = np.array([s[1] for s in slots])
        gaps = np.linalg.norm(points[:, None] - points[None], axis=2)
        np.fill_diagonal(gaps, np.finfo(np.float32).max)
        costs = [slots[k][2] * gaps[k].min() for k in range(n_locked, len(slots))]
        del slots[n_locked + int(np.argmin(costs))]
    return [s[0] for s in slots]


def select(found: DataFrame, most: int, locked: Sequence[tuple[int, int, int]] = ()) -> DataFrame:
    """features (image, r, g, b, area): image, idx, r, g, b of each image's palette."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        colors = choose(leader_groups(rows), most, locked)
        return pd.DataFrame({"image": rows["image"].iloc[0], "idx": range(len(colors)), **{c: [x[k] for x in colors] for k, c in enumerate("rgb")}})

    return found.groupBy("image").applyInPandas(run, f"image {dict(found.dtypes)['image']}, idx int, r int, g int, b int")


def groups(found: DataFrame) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = leader_groups(rows)
        out.insert(0, "image", rows["image"].iloc[0])
        return out

    return found.groupBy("image").applyInPandas(run, f"image {dict(found.dtypes)['image']}, r long, g long, b long, largest long, aggregate long")
