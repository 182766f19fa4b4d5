"""The whole trace: cells of many images to fitted paths, each stage a table keyed by image.

Stages that SQL can say are joins and aggregates over all images at once; the order-dependent ones (feature growing,
merging, selection, fitting) are one kernel call for each image's graph or ring.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.operators import assign, curves, grid, merging, palette, stitching
from gridloom.operators.components import ancestors
from gridloom.plans.lineage import cut

BY = ["image"]


@dataclass(frozen=True)
class Settings:
    scale: int = 1
    alpha_threshold: int = 128
    shade_split: float = 0.045
    shade_noise: float = 0.2
    max_colors: int = 8
    locked: tuple[tuple[int, int, int], ...] = ()
    floor: int = 4
    #: Of the images in cells, for the regions' numbers; None: what the widest one has.
    width: int | None = None
    absorb_distance: float = 0.08
    absorb_mean_width: float = 2.5
    absorb_most_width: float = 4.0
    stroke_width: float = 3.0
    stroke_distance: float = 0.08
    least_hole: int = 16
    fringe_slack: float = 3.0
    slack_distance: float = 0.06
    stitch: bool = True
    tolerance: float = 0.5
    corner: float = 1.2
    smoothing: float = 1.0


def features(cells: DataFrame, s: Settings) -> DataFrame:
    """image, x, y, feature, and the feature's colour after merging shades and folding residue."""
    grown = palette.features(cells).withColumn("region", F.col("fy").cast("long") * s.width + F.col("fx")).select("image", "x", "y", "region")
    labelled = cut(grown.join(cells.select("image", "x", "y", "r", "g", "b"), [*BY, "x", "y"]))
    for kind, settings in (("shades", {"split": s.shade_split, "noise": s.shade_noise}), ("residue", {})):
        mean = [F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"]
        boxes = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
        nodes = labelled.groupBy("image", "region").agg(*mean, F.count("*").alias("area"), *boxes)
        nodes = nodes.join(grid.perimeters(labelled, "region", BY).select("image", "region", "perimeter"), ["image", "region"])
        out = merging.merged(nodes, grid.adjacency_counts(labelled, "region", BY), kind, **settings)
        labelled = cut(labelled.drop("r", "g", "b").join(out.drop("area"), ["image", "region"]).select("image", "x", "y", F.col("root").alias("region"), "r", "g", "b"))
    return labelled.withColumnRenamed("region", "feature")


def quantized(cells: DataFrame, s: Settings) -> DataFrame:
    """image, x, y (scaled) and the palette colour r, g, b of each opaque cell."""
    opaque = cells.where(F.col("a") >= s.alpha_threshold)
    found = features(opaque, s)
    kinds = found.groupBy("image", "feature", "r", "g", "b").agg(F.count("*").alias("area"))
    colors = cut(palette.select(kinds.select("image", "r", "g", "b", "area"), s.max_colors, s.locked))
    # What is compared is made once for each colour and cell, before the joins that multiply them.
    own = C.lab(F.col("r"), F.col("g"), F.col("b"))
    offered = cut(colors.select("image", F.struct("idx", *(F.col(c).alias(f"p{c}") for c in "rgb"), own.alias("lab")).alias("idx")))
    gap = F.round(C.dist2(F.col("lab"), F.col("idx.lab")), 9)
    judged = cut(kinds.select("image", "feature", own.alias("lab"))).join(offered, "image")
    mapped = judged.groupBy("image", "feature").agg(F.min_by("idx", F.struct(gap.alias("d"), F.col("idx.idx").alias("at"))).alias("idx"))
    near = found.join(mapped, ["image", "feature"]).select("image", "x", "y", "idx")
    large = grid.upsampled(opaque, s.scale, s.alpha_threshold, BY) if s.scale > 1 else opaque
    target = cut(large.select("image", "x", "y", own.alias("lab")))
    cost = F.round(C.dist2(F.col("lab"), F.col("idx.lab")), 9)
    out = assign.constrained_nearest(target, near, s.scale, cost, BY, offered)
    return out.where("idx is not null").select("image", "x", "y", F.col("idx.pr").alias("r"), F.col("idx.pg").alias("g"), F.col("idx.pb").alias("b"))


def absorbed(colored: DataFrame, s: Settings) -> DataFrame:
    """image, x, y, region, r, g, b: the regions of equal colour, after transition bands and then thin strokes are merged away."""
    labelled = cut(grid.region_cells(grid.region_runs(colored.select("image", "x", "y", F.struct("r", "g", "b").alias("color")), s.width * s.scale, BY), BY))
    labelled = labelled.select("image", "x", "y", "region", "color.*")
    for kind, wanted, settings in (
        ("bands", s.absorb_distance > 0, {"distance": s.absorb_distance, "mean_width": s.absorb_mean_width * s.scale, "most_width": s.absorb_most_width * s.scale}),
        ("strokes", s.stroke_width > 0 and s.stroke_distance > 0, {"width": s.stroke_width * s.scale, "distance": s.stroke_distance}),
    ):
        if wanted:
            labelled = _merged(labelled, kind, s, **settings)
    return labelled


def _merged(labelled: DataFrame, kind: str, s: Settings, pins: DataFrame | None = None, **settings) -> DataFrame:
    """labelled (image, x, y, region, r, g, b) with the regions and colours after one kind of merging."""
    name = ["image", "region"]
    boxes = [f(c).alias(f"{c}{k}") for c in ("x", "y") for f, k in ((F.min, 0), (F.max, 1))]
    nodes = labelled.groupBy(*name).agg(*(F.first(c).alias(c) for c in "rgb"), F.count("*").alias("area"), *boxes)
    nodes = nodes.join(grid.perimeters(labelled, "region", BY).select(*name, "perimeter"), name)
    if kind != "speckles":
        deep = grid.depth(labelled, "region", BY).join(labelled.select(*name, "x", "y"), ["image", "x", "y"])
        nodes = nodes.join(deep.groupBy(*name).agg(F.max("depth").alias("depth")), name)
    if pins is not None:
        held = pins.join(labelled, ["image", "x", "y"]).select(*name).distinct().withColumn("pinned", F.lit(True))
        nodes = nodes.join(held, name, "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    joined = merging.merged(nodes, grid.adjacency_counts(labelled, "region", BY), kind, **settings).drop("area")
    moved = labelled.select(*name, "x", "y").join(joined, name)
    return cut(moved.select("image", "x", "y", F.col("root").alias("region"), "r", "g", "b"))


def merge_plan(colored: DataFrame, s: Settings, pins: DataFrame | None = None) -> DataFrame:
    """image, x, y, region, r, g, b of the regions that are drawn: specks are merged, and what stays below the floor goes unless it is pinned (image, x, y)."""
    settled = _merged(absorbed(colored, s), "speckles", s, pins, floor=s.floor)
    drawn = settled.groupBy("image", "region").agg(F.count("*").alias("area")).where(F.col("area") >= s.floor).select("image", "region")
    if pins is not None:
        drawn = drawn.union(settled.join(pins, ["image", "x", "y"], "left_semi").select("image", "region")).distinct()
    return cut(settled.join(drawn, ["image", "region"], "left_semi"))


def shapes(cells: DataFrame, s: Settings, pins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells (image, x, y, shape) of each shape, its subtree's union with small holes filled, and the shapes' order and colour."""
    colored = cut(quantized(cells, s))
    settled = merge_plan(colored, s, pins)
    tree = cut(merging.paint_order(grid.perimeters(settled, "region", BY).select("image", "region", "open_len", "area"), grid.adjacency_counts(settled, "region", BY)))
    key = lambda c: F.struct("image", F.col(c).alias("region"))
    above = ancestors(tree.select(key("region").alias("child"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent")))
    above = above.select("node.image", "node.region", F.col("ancestor.region").alias("shape")).unionByName(tree.select("image", "region", F.col("region").alias("shape")))
    own = settled.groupBy("image", "region").agg(*(F.first(c).alias(c) for c in "rgb"))
    order = tree.join(own, ["image", "region"]).select("image", F.col("region").alias("shape"), "place", C.to_hex(F.col("r"), F.col("g"), F.col("b")).alias("color"))
    covered = cut(settled.select("image", "x", "y", "region").join(above, ["image", "region"]).select("image", "x", "y", "shape"))
    if s.least_hole <= 0:
        return covered, order
    # A hole is filled unless another drawn region lies in it, or it is large and partly transparent.
    whole = ["image", "shape", "hole"]
    inside = cut(grid.holes(covered, ["image", "shape"]))
    named = lambda df, c: df.select(*whole).distinct().withColumn(c, F.lit(True))
    clear = named(inside.join(colored.select("image", "x", "y"), ["image", "x", "y"], "left_anti"), "clear")
    foreign = inside.join(settled.select("image", "x", "y"), ["image", "x", "y"], "left_semi").select(*whole).distinct()
    judged = inside.groupBy(*whole).agg(F.count("*").alias("size")).join(foreign, whole, "left_anti").join(clear, whole, "left")
    filled = inside.join(judged.where((F.col("size") < s.least_hole) | F.col("clear").isNull()), whole, "left_semi")
    return cut(covered.unionByName(filled.select("image", "x", "y", "shape"))), order


def slack_cells(covered: DataFrame, colored: DataFrame, s: Settings) -> DataFrame:
    """image, shape, x, y of the shapes' cells beside a cell outside of them whose colour is hardly another: there the fit has slack."""
    painted = colored.select("image", "x", "y", C.lab(F.col("r"), F.col("g"), F.col("b")).alias("p"))
    own = covered.join(painted, ["image", "x", "y"])
    beside = grid.beside(own, "shape", ["image", "shape"]).where(F.col("other").isNull()).select("image", "shape", "x", "y", "p", "nx", "ny")
    there = painted.select("image", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("p").alias("q"))
    return beside.join(there, ["image", "nx", "ny"]).where(C.dist(F.col("p"), F.col("q")) < s.slack_distance).select("image", "shape", "x", "y").distinct()


def trace(cells: DataFrame, s: Settings = Settings(), pins: DataFrame | None = None) -> DataFrame:
    """cells (image, x, y, r, g, b, a): image, place (paint order), color, ring, start and cubics, in source coordinates.

    pins (image, x, y; scaled cells) keep their regions whatever the size.
    """
    if s.width is None:
        s = replace(s, width=(cells.agg(F.max("x")).first()[0] or 0) + 1)
    covered, order = shapes(cells, s, pins)
    rings = curves.rings(covered.withColumn("label", F.concat_ws(":", "image", "shape")).select("x", "y", "label"), "label")
    if s.stitch:
        rings = rings.join(order.select("image", F.concat_ws(":", "image", "shape").alias("label")), "label")
        fitted = stitching.stitched(rings, ["image", "label", "ring"], s.tolerance, s.corner, 2.0, s.smoothing, "image").drop("image")
    else:
        fitted = curves.fit_rings(rings, ["label", "ring"], s.tolerance, s.corner, 2.0, s.smoothing)
    p = lambda x, y: F.struct((F.col(x) / s.scale).alias("x"), (F.col(y) / s.scale).alias("y"))
    cubic = F.struct("seg", F.struct(p("c1x", "c1y").alias("c1"), p("c2x", "c2y").alias("c2"), p("ex", "ey").alias("e")).alias("c"))
    paths = fitted.groupBy("label", "ring").agg(F.min_by(p("x0", "y0"), "seg").alias("start"), F.transform(F.sort_array(F.collect_list(cubic)), lambda x: x["c"]).alias("cubics"))
    return paths.join(order.withColumn("label", F.concat_ws(":", "image", "shape")), "label").select("image", "place", "color", "ring", "start", "cubics")


def counts(paths: DataFrame) -> DataFrame:
    """Paths and anchors of each image."""
    return paths.groupBy("image").agg(F.count("*").alias("paths"), F.sum(F.size("cubics")).alias("anchors"))
