"""Order-dependent merging of region and feature graphs: one kernel call for each image, or rounds over tables for large ones.

Pixels never enter a kernel: regions, their colours and borders are made with joins and aggregates, and a call sees one
image's graph (a few thousand nodes; in paint order of any size, as arrays). Batches follow the reference order: choices of a round see the round's start, and
are carried out one after the other through the current roots. Where an image has more regions than ``MOST_REGIONS``, specks,
strokes and bands make a round's choices with joins, and carry out each group of regions that its choices connect by itself.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import color as C
from gridloom.operators import grid
from gridloom.operators.components import components
from gridloom.plans.lineage import cut

LINEAR = np.array([c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in range(256)])
TO_LMS = np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]])
TO_LAB = np.array([[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]])


def lab(rgb) -> np.ndarray:
    """OKLab of an (n, 3) array of 0..255."""
    return np.cbrt(LINEAR[np.asarray(rgb, int)] @ TO_LMS.T) @ TO_LAB.T


class Roots:
    """Union-find by explicit direction, with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


class Graph:
    """Regions by dense id with colour, area, perimeter, depth, box, and borders to others."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        nodes = nodes.sort_values("region").reset_index(drop=True)
        self.ids = nodes["region"].to_numpy()
        place = {r: k for k, r in enumerate(self.ids)}
        n = len(nodes)
        self.rgb = [tuple(map(int, c)) for c in nodes[["r", "g", "b"]].to_numpy()]
        self.lab = list(lab(self.rgb)) if n else []
        self.area = nodes["area"].astype(int).tolist()
        self.perimeter = nodes["perimeter"].astype(int).tolist() if "perimeter" in nodes else [0] * n
        self.depth = nodes["depth"].astype(int).tolist() if "depth" in nodes else [1] * n
        self.box = [tuple(map(int, b)) for b in nodes[["x0", "y0", "x1", "y1"]].to_numpy()] if "x0" in nodes else [(0, 0, 0, 0)] * n
        self.pinned = nodes["pinned"].astype(bool).tolist() if "pinned" in nodes else [False] * n
        self.near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for a, b, s in zip(edges["lo"], edges["hi"], edges["sides"], strict=True):
            if a in place and b in place:
                self.near[place[a]].append((place[b], int(s)))
                self.near[place[b]].append((place[a], int(s)))
        self.roots = Roots(n)

    def gap(self, i: int, j: int) -> float:
        return float(np.linalg.norm(self.lab[i] - self.lab[j]))

    def neighbors(self, i: int) -> list[tuple[int, int]]:
        """(root, border) by longest border, then id."""
        sums: dict[int, int] = defaultdict(int)
        for j, s in self.near[i]:
            if (r := self.roots.find(j)) != i:
                sums[r] += s
        return sorted(sums.items(), key=lambda x: (-x[1], x[0]))

    def merge(self, s: int, t: int, larger_color: bool) -> None:
        if larger_color and self.area[s] > self.area[t]:
            self.rgb[t], self.lab[t] = self.rgb[s], self.lab[s]
        self.area[t] += self.area[s]
        a, b = self.box[s], self.box[t]
        self.box[t] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        self.near[t] += self.near[s]
        self.near[s] = []
        self.roots.up[s] = t

    def rounds(self, choose, carry_out, most: int | None) -> None:
        """choose(i) gives a target or None; only roots near a change are asked again."""
        ask = range(len(self.ids))
        done = 0
        while most is None or done < most:
            done += 1
            picks = [(i, t) for i in ask if self.roots.find(i) == i and (t := choose(i)) is not None]
            if not picks:
                return
            touched: set[int] = set()
            for i, target in picks:
                s, t = self.roots.find(i), self.roots.find(target)
                if s != t:
                    carry_out(s, t)
            for i, target in picks:
                r = self.roots.find(target)
                touched |= {r, *(self.roots.find(j) for j, _ in self.near[r])}
            ask = sorted(touched)

    def table(self) -> pd.DataFrame:
        top = [self.roots.find(i) for i in range(len(self.ids))]
        return pd.DataFrame({"region": self.ids, "root": self.ids[top] if len(top) else self.ids, **{c: [self.rgb[t][k] for t in top] for k, c in enumerate("rgb")}, "area": [self.area[t] for t in top]})


def speckles(g: Graph, floor: int) -> None:
    """Until nothing changes, regions below the floor join the neighbour nearest in colour (then border, then id); pins take no part; the larger keeps its colour."""

    def choose(i):
        if g.pinned[i] or g.area[i] >= floor:
            return None
        near = [(g.gap(i, j), -s, j) for j, s in g.neighbors(i) if not g.pinned[j]]
        return min(near)[2] if near else None

    g.rounds(choose, lambda s, t: g.merge(s, t, True), None)


def strokes(g: Graph, width: float, distance: float) -> None:
    """Thin regions join the first thin neighbour (longest border) within the distance; 8 rounds at most."""
    thin = [2 * d < width for d in g.depth]

    def choose(i):
        if not thin[i]:
            return None
        return next((j for j, _ in g.neighbors(i) if thin[j] and g.gap(i, j) < distance), None)

    g.rounds(choose, lambda s, t: g.merge(s, t, True), 8)


def bands(g: Graph, distance: float, mean_width: float, most_width: float) -> None:
    """Transition bands join a dominant neighbour: thin, between two regions neither of which they enclose, on the colour line between them; 8 rounds at most."""

    def inside(outer, inner):
        return outer[0] <= inner[0] and outer[1] <= inner[1] and outer[2] >= inner[2] and outer[3] >= inner[3]

    def choose(i):
        if 2 * g.area[i] / max(g.perimeter[i], 1) >= mean_width:
            return None
        near = g.neighbors(i)
        if len(near) < 2:
            return None
        a, b = near[0][0], near[1][0]
        if inside(g.box[i], g.box[a]) or inside(g.box[i], g.box[b]):
            return None
        da, db = g.gap(i, a), g.gap(i, b)
        if min(da, db) >= distance or da + db > 1.25 * g.gap(a, b) or 2 * g.depth[i] >= most_width:
            return None
        return a if da < distance else b

    def carry_out(s, t):
        shared = sum(n for j, n in g.near[s] if g.roots.find(j) == t)
        g.perimeter[t] = max(0, g.perimeter[t] + g.perimeter[s] - 2 * shared)
        g.depth[t] += g.depth[s]
        g.merge(s, t, False)

    g.rounds(choose, carry_out, 8)


def shades(g: Graph, split: float, noise: float) -> None:
    """Agglomerative merging, nearest pair of means first (held back by half the representatives' distance), to a stop that is looser for small areas."""
    n = len(g.ids)
    sums = [v * a for v, a in zip(g.lab, g.area, strict=True)]
    chief, chief_area = list(range(n)), list(g.area)
    first = list(g.lab)
    near = [{j for j, _ in x} - {i} for i, x in enumerate(g.near)]
    version = [0] * n

    def cost(i, j):
        return max(float(np.linalg.norm(first[chief[i]] - first[chief[j]])) / 2, float(np.linalg.norm(sums[i] / g.area[i] - sums[j] / g.area[j])))

    heap = [(cost(i, j), i, j, 0, 0) for i in range(n) for j in near[i] if i < j]
    heapq.heapify(heap)
    while heap:
        d, a, b, va, vb = heapq.heappop(heap)
        if d >= split + noise:
            break
        if g.roots.up[a] != a or g.roots.up[b] != b or (va, vb) != (version[a], version[b]) or d >= split + noise / min(g.area[a], g.area[b]):
            continue
        sums[a] = sums[a] + sums[b]
        if chief_area[b] > chief_area[a] or chief_area[b] == chief_area[a] and chief[b] < chief[a]:
            chief[a], chief_area[a] = chief[b], chief_area[b]
        g.merge(b, a, False)
        version[a] += 1
        for j in near[b]:
            near[j].discard(b)
            if j != a:
                near[j].add(a)
                near[a].add(j)
        near[a] -= {a, b}
        near[b] = set()
        for j in near[a]:
            x, y = min(a, j), max(a, j)
            heapq.heappush(heap, (cost(x, y), x, y, version[x], version[y]))
    rgb = list(g.rgb)
    for i in range(n):
        if g.roots.up[i] == i:
            g.rgb[i] = rgb[chief[i]]


def residue(g: Graph, thin: float = 2.0, deviation: float = 0.01, margin: float = 0.075, least_diagonal: float = 6.0, near_color: float = 0.02, sliver: int = 15) -> None:
    """Fold what isn't drawn on purpose into a larger neighbour.

    Folded are: thin blends between two of the three dominant neighbours, thin slivers that lie on such a line close to one
    end (into that end), specks, and what has nearly its parent's colour; the parent is the larger neighbour nearest in
    colour. Dark features beside dark ones join each other and don't fold otherwise. Of what comes together the largest that
    need not fold stands for all.
    """
    n = len(g.ids)
    near = [g.neighbors(i) for i in range(n)]
    dark = [max(c) <= 30 and max(c) - min(c) <= 8 for c in g.rgb]
    inky = [dark[i] and any(dark[j] for j, _ in near[i]) for i in range(n)]

    def folds_into(i: int) -> int | None:
        larger = [j for j, _ in near[i] if (g.area[j], -j) > (g.area[i], -i)]
        if not larger:
            return None
        parent = min(larger, key=lambda j: (g.gap(i, j), j))
        blend, hugged = False, None
        tops = [j for j, _ in near[i][:3]]
        for k, a in enumerate(tops):
            for b in tops[k + 1 :]:
                line = g.lab[b] - g.lab[a]
                t = np.clip((g.lab[i] - g.lab[a]) @ line / max(line @ line, 1e-12), 0, 1)
                if np.linalg.norm(g.lab[i] - g.lab[a] - t * line) >= deviation:
                    continue
                da, db = g.gap(i, a), g.gap(i, b)
                end = a if da <= db else b
                blend |= min(da, db) > margin
                if hugged is None and min(da, db) <= margin and g.area[i] < sliver and g.area[end] > g.area[i]:
                    hugged = end
        x0, y0, x1, y1 = g.box[i]
        ribbon = g.area[i] / (0.5 * max(g.perimeter[i], 1)) <= thin and (blend or hugged is not None)
        if ribbon and hugged is not None:
            return hugged
        return parent if ribbon or np.hypot(x1 - x0 + 1, y1 - y0 + 1) < least_diagonal or g.gap(i, parent) < near_color else None

    target = [folds_into(i) for i in range(n)]
    together = Roots(n)
    links = [(i, t) for i, t in enumerate(target) if t is not None and not inky[i]]
    links += [(i, j) for i in range(n) if inky[i] for j, _ in near[i] if dark[j]]
    for i, j in links:
        a, b = sorted((together.find(i), together.find(j)))
        together.up[b] = a
    members: dict[int, list[int]] = defaultdict(list)
    for i in range(n):
        members[together.find(i)].append(i)
    area = list(g.area)
    for group in members.values():
        chief = max(group, key=lambda i: (target[i] is None, area[i], i))
        for i in group:
            if i != chief:
                g.merge(i, chief, False)


KERNELS = {"speckles": speckles, "strokes": strokes, "bands": bands, "shades": shades, "residue": residue}
#: Of an image that a kernel call takes; larger ones go by rounds, but for shades and residue.
MOST_REGIONS = 50_000
NAME = ["image", "region"]


def _speckle_picks(near: DataFrame, floor: int) -> DataFrame:
    near = near.where(~F.col("p.pinned") & (F.col("p.area") < floor) & ~F.col("q.pinned"))
    return near.groupBy("image", "i").agg(F.min(F.struct(C.dist(F.col("p.lab"), F.col("q.lab")).alias("d"), (-F.col("s")).alias("s"), "j"))["j"].alias("target"))


def _stroke_picks(near: DataFrame, width: float, distance: float) -> DataFrame:
    near = near.where((2 * F.col("p.depth") < width) & (2 * F.col("q.depth") < width) & (C.dist(F.col("p.lab"), F.col("q.lab")) < distance))
    return near.groupBy("image", "i").agg(F.min(F.struct((-F.col("s")).alias("s"), "j"))["j"].alias("target"))


def _band_picks(near: DataFrame, distance: float, mean_width: float, most_width: float) -> DataFrame:
    thin = (2 * F.col("p.area") / F.greatest("p.perimeter", F.lit(1)) < mean_width) & (2 * F.col("p.depth") < most_width)
    first = Window.partitionBy("image", "i").orderBy(F.desc("s"), "j")
    tops = near.where(thin).withColumn("rank", F.row_number().over(first)).where("rank <= 2")
    two = tops.groupBy("image", "i").agg(F.first("p").alias("p"), *(F.max(F.when(F.col("rank") == k, F.struct("j", "q"))).alias(n) for k, n in ((1, "a"), (2, "b"))))
    inside = lambda n: (F.col("p.x0") <= F.col(f"{n}.q.x0")) & (F.col("p.y0") <= F.col(f"{n}.q.y0")) & (F.col("p.x1") >= F.col(f"{n}.q.x1")) & (F.col("p.y1") >= F.col(f"{n}.q.y1"))
    da, db, ab = (C.dist(F.col(f"{x}.lab"), F.col(f"{y}.lab")) for x, y in (("p", "a.q"), ("p", "b.q"), ("a.q", "b.q")))
    found = two.where("b is not null").where(~inside("a") & ~inside("b")).withColumns({"da": da, "db": db, "ab": ab})
    found = found.where((F.least("da", "db") < distance) & (F.col("da") + F.col("db") <= 1.25 * F.col("ab")))
    return found.select("image", "i", F.when(F.col("da") < distance, F.col("a.j")).otherwise(F.col("b.j")).alias("target"))


#: The choices, whether a round's larger colour stays, and the most rounds.
ROUNDS = {"speckles": (_speckle_picks, True, None), "strokes": (_stroke_picks, True, 8), "bands": (_band_picks, False, 8)}


def _by_rounds(nodes: DataFrame, edges: DataFrame, kind: str, **settings) -> DataFrame:
    """What the kernel of this kind gives, in rounds over tables."""
    picks_of, larger_color, most = ROUNDS[kind]
    absent = {"perimeter": 0, "depth": 1, **dict.fromkeys(("x0", "y0", "x1", "y1"), 0), "pinned": False}
    here = lambda c: F.col(c) if c in nodes.columns else F.lit(absent[c])
    colored = F.struct(*(F.col(c).cast("int").alias(c) for c in "rgb"), C.lab(F.col("r"), F.col("g"), F.col("b")).alias("lab"))
    state = cut(nodes.select(
        *NAME, colored.alias("color"), *(here(c).cast("long").alias(c) for c in ("area", "perimeter", "depth", "x0", "y0", "x1", "y1")), here("pinned").alias("pinned")
    ))
    values = [c for c in state.columns if c not in NAME]
    borders = cut(edges.select("image", "lo", "hi", F.col("sides").cast("long").alias("s")))
    shape = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    moves, done = [], 0
    carried = f"image {shape['image']}, region {shape['region']}, root {shape['region']}, own struct<{', '.join(f'{c}: {shape[c]}' for c in values)}>"

    def carry_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's groups: members with their targets, and the borders inside of a group; no group is in two tasks."""
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in NAME])
        members, inner = (table.filter(f(table["s"])) for f in (pc.is_null, pc.is_valid))
        names = list(zip(*(members[c].to_pylist() for c in NAME), strict=True))
        place = {x: k for k, x in enumerate(names)}
        own = {c: members[f"own_{c}"].to_pylist() for c in values}
        near: list[list[tuple[int, int]]] = [[] for _ in names]
        for image, a, b, n in zip(*(inner[c].to_pylist() for c in (*NAME, "target", "s")), strict=True):
            x, y = place[(image, a)], place[(image, b)]
            near[x].append((y, n))
            near[y].append((x, n))
        roots = Roots(len(names))
        for i, (image, target) in enumerate(zip(members["image"].to_pylist(), members["target"].to_pylist(), strict=True)):
            if target is None or (s := roots.find(i)) == (t := roots.find(place[(image, target)])):
                continue
            if kind == "bands":
                shared = sum(n for j, n in near[s] if roots.find(j) == t)
                own["perimeter"][t] = max(0, own["perimeter"][t] + own["perimeter"][s] - 2 * shared)
                own["depth"][t] += own["depth"][s]
                near[t] += near[s]
                near[s] = []
            if larger_color and own["area"][s] > own["area"][t]:
                own["color"][t] = own["color"][s]
            own["area"][t] += own["area"][s]
            for c, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max)):
                own[c][t] = f(own[c][s], own[c][t])
            roots.up[s] = t
        top = [roots.find(i) for i in range(len(names))]
        now = [{c: own[c][i] for c in values} if i == t else None for i, t in enumerate(top)]
        kind_of = pa.struct([(c, members.schema.field(f"own_{c}").type) for c in values])
        columns = {**{c: members[c] for c in NAME}, "root": pa.array([names[t][1] for t in top], members.schema.field("region").type), "own": pa.array(now, kind_of)}
        yield from pa.table(columns).to_batches()

    while most is None or done < most:
        done += 1
        side = lambda end, as_: state.select("image", F.col("region").alias(end), F.struct(F.col("color.lab").alias("lab"), *(c for c in values if c != "color")).alias(as_))  # noqa: E731, B023
        known = borders.join(side("lo", "v"), ["image", "lo"]).join(side("hi", "w"), ["image", "hi"])
        way = lambda i, j, p, q: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(p).alias("p"), F.col(q).alias("q"))
        near = known.select("image", "s", F.explode(F.array(way("lo", "hi", "v", "w"), way("hi", "lo", "w", "v"))).alias("e")).select("image", "s", "e.*")
        picks = cut(picks_of(near, **settings))
        if not picks.limit(1).count():
            break
        end = lambda c: F.struct("image", F.col(c).alias("region"))
        groups = cut(components(picks.select(end("i").alias("a"), end("target").alias("b"))).select("node.image", "node.region", F.col("root").alias("group")))
        members = groups.join(state, NAME).join(picks.withColumnRenamed("i", "region"), NAME, "left")
        rows = members.select("group", *NAME, "target", F.lit(None).cast("long").alias("s"), *(F.col(c).alias(f"own_{c}") for c in values))
        if kind == "bands":
            ends = [groups.select("image", F.col("region").alias(e), F.col("group").alias(f"{e}_group")) for e in ("lo", "hi")]
            inner = borders.join(ends[0], ["image", "lo"]).join(ends[1], ["image", "hi"]).where("lo_group = hi_group")
            nothing = [F.lit(None).cast(shape[c]).alias(f"own_{c}") for c in values]
            rows = rows.unionByName(inner.select(F.col("lo_group").alias("group"), "image", F.col("lo").alias("region"), F.col("hi").alias("target"), "s", *nothing))
        n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        moved = cut(rows.repartition(n, "group").drop("group").mapInArrow(carry_out, carried))
        moves.append(moved.where("region <> root").select(*NAME, "root"))
        state = cut(state.join(moved.select(*NAME, "root", "own"), NAME, "left").where("root is null or root = region").select(*NAME, *(F.coalesce(f"own.{c}", c).alias(c) for c in values)))
        for c in ("lo", "hi"):
            borders = borders.join(moves[-1].select("image", F.col("region").alias(c), "root"), ["image", c], "left").withColumn(c, F.coalesce("root", c)).drop("root")
        borders = borders.where("lo <> hi").groupBy("image", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(F.sum("s").alias("s"))
        borders = cut(borders)
    found = nodes.select(*NAME, F.col("region").alias("root"))
    for moved in moves:
        found = found.join(moved.select("image", F.col("region").alias("root"), F.col("root").alias("next")), ["image", "root"], "left").select(*NAME, F.coalesce("next", "root").alias("root"))
    return found.join(state.select("image", F.col("region").alias("root"), *(F.col(f"color.{c}").alias(c) for c in "rgb"), "area"), ["image", "root"]).select(*NAME, "root", *"rgb", "area")


def merged(nodes: DataFrame, edges: DataFrame, kind: str, **settings) -> DataFrame:
    """nodes (image, region, r, g, b, area, ...) and edges (image, lo, hi, sides): (image, region, root, r, g, b, area) after one kind of merging."""
    if kind not in ROUNDS:
        return _by_kernel(nodes, edges, kind, **settings)
    nodes = cut(nodes)
    sizes = nodes.groupBy("image").agg((F.count("*") > MOST_REGIONS).alias("large"))
    kinds = {r.large for r in sizes.select("large").distinct().collect()}
    if True not in kinds:
        return _by_kernel(nodes, edges, kind, **settings)
    if False not in kinds:
        return _by_rounds(nodes, edges, kind, **settings)
    edges = cut(edges)
    part = lambda df, large: df.join(sizes.where(F.col("large") == large).select("image"), "image", "left_semi")
    return _by_kernel(part(nodes, False), part(edges, False), kind, **settings).unionByName(_by_rounds(part(nodes, True), part(edges, True), kind, **settings))


def _by_kernel(nodes: DataFrame, edges: DataFrame, kind: str, **settings) -> DataFrame:
    kernel = KERNELS[kind]

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        g = Graph(n, e)
        kernel(g, **settings)
        out = g.table()
        out.insert(0, "image", n["image"].iloc[0] if len(n) else None)
        return out

    kind_of = dict(nodes.dtypes)["image"]
    edges = edges.select(F.col("image").alias("of"), "lo", "hi", "sides")  # another column, should both come from one table
    return nodes.groupBy("image").cogroup(edges.groupBy("of")).applyInPandas(run, f"image {kind_of}, region long, root long, r int, g int, b int, area long")


def region_graph(cells: DataFrame, width: int, pins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each image's regions; cells (image, x, y, r, g, b), without image all are one, 0."""
    by = ["image"]
    if "image" not in cells.columns:
        cells = cells.withColumn("image", F.lit(0))
        pins = pins if pins is None else pins.withColumn("image", F.lit(0))
    runs = grid.region_runs(cells.select(*by, "x", "y", F.struct("r", "g", "b").alias("color")), width, by)
    labelled = grid.region_cells(runs, by).select(*by, "x", "y", "region")
    name = [*by, "region"]
    nodes = grid.region_table(runs, by).join(grid.perimeters(labelled, "region", by).select(*name, "perimeter"), name)
    deep = grid.depth(labelled, "region", by).join(labelled, [*by, "x", "y"]).groupBy(*name).agg(F.max("depth").alias("depth"))
    nodes = nodes.join(deep, name)
    if pins is not None:
        held = pins.select(*by, "x", "y").join(labelled, [*by, "x", "y"]).select(*name).distinct().withColumn("pinned", F.lit(True))
        nodes = nodes.join(held, name, "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    more = [c for c in nodes.columns if c not in (*name, "color")]
    return nodes.select(*name, "color.r", "color.g", "color.b", *more), grid.adjacency_counts(labelled, "region", by).select(*by, "lo", "hi", "sides")


def _least_reachable(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that links lead to: roots hook to lesser ones, and what is linked still goes on as their links."""
    up = np.arange(n, dtype=np.int32)
    while True:
        lo, hi = up[lo], up[hi]
        apart = lo != hi
        if not apart.any():
            return up
        lo, hi = lo[apart], hi[apart]
        np.minimum.at(up, np.maximum(lo, hi), np.minimum(lo, hi))
        while not np.array_equal(up, above := up[up]):
            up = above


def _by_end(n: int, end: np.ndarray, other: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The borders by one end: where each node's begin, the other ends, and the sides."""
    order = np.argsort(end, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(end, minlength=n))]), other[order], sides[order]


def _painted(open_len: np.ndarray, area: np.ndarray, lo: np.ndarray, hi: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes 0..n-1 in paint order, and the parent of each in that order (-1: none)."""
    n = len(area)
    group = _least_reachable(n, lo, hi)
    rank = np.lexsort((-np.arange(n), area, open_len, group))
    roots = rank[np.append(group[rank][1:] != group[rank][:-1], True)].tolist()
    del group, rank
    (at_lo, to_hi, s_hi), (at_hi, to_lo, s_lo) = _by_end(n, lo, hi, sides), _by_end(n, hi, lo, sides)
    del lo, hi, sides
    at_lo, at_hi = (memoryview(x) for x in (at_lo, at_hi))
    order, parents, inside = np.empty(n, np.int32), np.empty(n, np.int32), bytearray(n)
    put_order, put_parent = memoryview(order), memoryview(parents)
    done, push, pop = 0, heapq.heappush, heapq.heappop
    for root in roots:
        heaps: dict[int, list[int]] = defaultdict(list)  # for each number of sides, child * n + parent
        listed, tops = set(), []  # the numbers of sides whose heap may have entries
        child, parent = root, -1
        while True:
            inside[child] = 1
            put_order[done], put_parent[done] = child, parent
            done += 1
            a, b, c, d = at_lo[child], at_lo[child + 1], at_hi[child], at_hi[child + 1]
            for j, s in zip(to_hi[a:b].tolist() + to_lo[c:d].tolist(), s_hi[a:b].tolist() + s_lo[c:d].tolist(), strict=True):
                if not inside[j]:
                    push(heaps[s], j * n + child)
                    if s not in listed:
                        listed.add(s)
                        push(tops, -s)
            child = None
            while tops and child is None:
                heap = heaps[-tops[0]]
                while heap:
                    child, parent = divmod(pop(heap), n)
                    if not inside[child]:
                        break
                    child = None
                if child is None:
                    listed.discard(-pop(tops))
            if child is None:
                break
    return order, parents


def paint_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Maximum spanning tree of each component: image, region, parent (NULL: root), place in paint order.

    nodes (image, region, open_len, area). The root has the longest open border, then area, then least id; trees grow by
    the heaviest seam, then least child, then least parent; a tree's place goes by its least region. A task reads its images
    one after the other, and holds one as arrays: by estimate 60 bytes a region and a border, and 45 for each entry of the heaps.
    """
    kind_of = dict(nodes.dtypes)["image"]
    no = lambda c: F.lit(None).cast("long").alias(c)
    rows = nodes.select("image", F.col("region").cast("long").alias("a"), no("b"), F.col("open_len").cast("long").alias("v"), F.col("area").cast("long").alias("w"))
    rows = rows.unionByName(edges.select("image", F.col("lo").cast("long").alias("a"), F.col("hi").cast("long").alias("b"), F.col("sides").cast("long").alias("v"), no("w")))

    def of_image(image: pa.Scalar, parts: list[list[np.ndarray]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Empties parts: chunks of regions, open_len, area, lo, hi and sides."""
        whole = lambda k: np.concatenate(parts[k]) if parts[k] else np.zeros(0, np.int64)
        ids = whole(0)
        if not len(ids):
            return
        by_id = np.argsort(ids)
        ids, open_len, area = ids[by_id], whole(1)[by_id], whole(2)[by_id]
        for x in parts[:3]:
            x.clear()
        ends: tuple[list, list, list] = ([], [], [])
        while parts[3]:
            chunks = [x.pop() for x in parts[3:]]
            places = [np.minimum(np.searchsorted(ids, c), len(ids) - 1).astype(np.int32) for c in chunks[:2]]
            known = (ids[places[0]] == chunks[0]) & (ids[places[1]] == chunks[1])
            for out, x in zip(ends, (*places, chunks[2]), strict=True):
                out.append(x[known])
        lo, hi, sides = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in ends)
        del ends
        order, parents = _painted(open_len, area, lo, hi, sides)
        for k in range(0, len(order), 100_000):
            up = parents[k : k + 100_000]
            columns = [pa.array(ids[order[k : k + 100_000]]), pa.array(ids[up], mask=up < 0), pa.array(np.arange(k, k + len(up)))]
            yield pa.RecordBatch.from_arrays([pa.array([image] * len(up), schema.field("image").type), *columns], names=["image", "region", "parent", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, schema = None, [[] for _ in range(6)], None
        for batch in batches:
            if not batch.num_rows:
                continue
            images = batch.column("image")
            one = images[0].as_py() == images[-1].as_py()
            values = [images[0].as_py()] if one else images.to_pylist()
            starts = [0, *(k for k in range(1, len(values)) if values[k] != values[k - 1])]
            for first, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if schema is not None and values[first] != last:
                    yield from of_image(last, parts, schema)
                    parts = [[] for _ in range(6)]
                last, schema, part = values[first], batch.schema, batch.slice(first, end - first)
                border = pc.is_valid(part.column("b"))
                for own, names, into in ((part.filter(pc.invert(border)), "avw", parts[:3]), (part.filter(border), "abv", parts[3:])):
                    if own.num_rows:
                        for c, x in zip(names, into, strict=True):
                            x.append(own.column(c).to_numpy(zero_copy_only=False).astype(np.int32 if x is parts[5] else np.int64))
        if schema is not None:
            yield from of_image(last, parts, schema)

    return rows.repartition("image").sortWithinPartitions("image").mapInArrow(run, f"image {kind_of}, region long, parent long, place long")


def subtree_areas(tree: DataFrame, areas: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, region) with the sum of the areas (by, region, area) of its subtree, through the tree's ancestor closure."""
    from gridloom.operators.components import ancestors

    key = lambda c: F.struct(*by, F.col(c).alias("region"))
    above = ancestors(tree.select(key("region").alias("child"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent")))
    above = above.select("node", "ancestor").unionByName(areas.select(key("region").alias("node"), key("region").alias("ancestor")))
    sums = areas.select(key("region").alias("node"), "area").join(above, "node").groupBy("ancestor").agg(F.sum("area").alias("area"))
    return sums.select(*(F.col(f"ancestor.{c}").alias(c) for c in (*by, "region")), "area")
