"""Rasters as tables of cells (x, y, color ...): neighbours, runs, borders, boxes, regions, depth, holes.

Every operator on cells takes ``by``, the columns that name an image; cells of different images never meet. A missing cell
is transparent. Neighbour joins shuffle on (by, y, x) and never on colour, so one common colour doesn't skew them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.components import components
from gridloom.plans.lineage import cut

SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def grid(df: DataFrame, key: str, width: int, color: Column, *more: Column) -> DataFrame:
    """A table with keys 0..n-1 as an image of the given width."""
    return df.select((F.col(key) % width).cast("int").alias("x"), F.floor(F.col(key) / width).cast("int").alias("y"), color.alias("color"), *more)


def beside(cells: DataFrame, value: str = "color", by: Sequence[str] = (), sides=SIDES) -> DataFrame:
    """Each cell once for each side, with the value there as ``other`` (NULL: transparent or outside)."""
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in sides]))
    facing = cells.withColumn("step", step).withColumn("nx", F.col("x") + F.col("step.dx")).withColumn("ny", F.col("y") + F.col("step.dy")).drop("step")
    there = cells.select(*by, F.col("x").alias("nx"), F.col("y").alias("ny"), F.col(value).alias("other"))
    return facing.join(there, [*by, "nx", "ny"], "left")


def row_runs(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs of equal colour in each row: y, x0, x1, color."""
    order = Window.partitionBy(*by, "y", "color").orderBy("x")
    return (
        cells.withColumn("island", F.col("x") - F.row_number().over(order))
        .groupBy(*by, "y", "color", "island")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("island")
    )


def adjacency_counts(cells: DataFrame, label: str = "color", by: Sequence[str] = ()) -> DataFrame:
    """Borders between labels: lo < hi and the number of cell sides between them."""
    pairs = beside(cells.select(*by, "x", "y", label), label, by, ((1, 0), (0, 1))).where(F.col("other") != F.col(label))
    return pairs.groupBy(*by, F.least(label, "other").alias("lo"), F.greatest(label, "other").alias("hi")).agg(F.count("*").alias("sides"))


def perimeters(cells: DataFrame, label: str = "color", by: Sequence[str] = ()) -> DataFrame:
    """For each label its cells, the sides that face another label or nothing, and those that face nothing."""
    sides = beside(cells.select(*by, "x", "y", label), label, by)
    return sides.groupBy(*by, label).agg(
        (F.count("*") / len(SIDES)).cast("long").alias("area"),
        F.count_if(F.col("other").isNull() | (F.col("other") != F.col(label))).alias("perimeter"),
        F.count_if(F.col("other").isNull()).alias("open_len"),
    )


def dominant_neighbors(cells: DataFrame, label: str = "color", most: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """For each label its neighbours with the longest common borders; ties go to the lesser label."""
    both = adjacency_counts(cells, label, by)
    both = both.select(*by, F.col("lo").alias(label), F.col("hi").alias("neighbor"), "sides").union(both.select(*by, F.col("hi"), F.col("lo"), "sides"))
    rank = F.row_number().over(Window.partitionBy(*by, label).orderBy(F.desc("sides"), "neighbor"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most)


def bounding_box(cells: DataFrame, pad: int = 0, size: tuple[int, int] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Box of the cells, widened by pad and held inside the image."""
    box = cells.groupBy(*by).agg(*(f(c).alias(f"{c}{k}") for c in ("x", "y") for f, k in ((F.min, 0), (F.max, 1))))
    if pad:
        w, h = size
        for c, most in (("x", w - 1), ("y", h - 1)):
            box = box.withColumn(f"{c}0", F.greatest(F.col(f"{c}0") - pad, F.lit(0))).withColumn(f"{c}1", F.least(F.col(f"{c}1") + pad, F.lit(most)))
    return box


def crop(cells: DataFrame, box: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells inside their image's box, with coordinates in the box. The box table has one row for each image."""
    joined = cells.join(box, list(by)) if by else cells.join(F.broadcast(box), F.lit(True))
    return joined.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).select(
        *by, (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), *[c for c in cells.columns if c not in ("x", "y", *by)]
    )


def uniform_color(cells: DataFrame, by: Sequence[str], color: str = "color") -> DataFrame:
    """The only colour of each image, else NULL."""
    return cells.groupBy(*by).agg(F.when(F.min(color) == F.max(color), F.min(color)).alias("uniform"), F.count("*").alias("n"))


def run_links(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs (with id) of equal colour that touch in consecutive rows: (a, b)."""
    up = runs.select(*by, F.col("y"), "color", F.col("id").alias("a"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"))
    down = runs.select(*by, (F.col("y") - 1).alias("y"), "color", F.col("id").alias("b"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    return up.join(down, [*by, "y", "color"]).where("ax0 <= bx1 and ax1 >= bx0").select("a", "b")


def regions(cells: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """4-connected regions of equal colour: by, region (its first cell's y * width + x), color, area and box.

    Cells become runs first, so the component rounds see runs only.
    """
    return region_table(region_runs(cells, width, by), by)


def region_runs(cells: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Runs with their region; regions of different images may have equal numbers."""
    at = F.col("y").cast("long") * width + F.col("x0")
    runs = cut(row_runs(cells, by).withColumn("id", F.struct(*by, at.alias("at")) if by else at))
    roots = components(run_links(runs, by))
    root = F.coalesce("root", "id")
    return runs.join(roots, runs["id"] == roots["node"], "left").select(*by, "y", "x0", "x1", "color", (root["at"] if by else root).alias("region"))


def region_table(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return runs.groupBy(*by, "region").agg(
        F.min("color").alias("color"),
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"),
        F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"),
    )


def region_cells(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return runs.select(*by, F.explode(F.sequence("x0", "x1")).alias("x"), "y", "color", "region")


def rim_residue(cells: DataFrame, label: str, ink: Column, thin: float = 2.0, most: int = 100, share: float = 0.25, least_contact: float = 0.6, by: Sequence[str] = ()) -> DataFrame:
    """Thin chips on the rim that mostly touch ink: by, label and the ink neighbour each joins.

    A chip faces nothing somewhere, has at most ``most`` cells and ``share`` of its image's, mean thickness up to ``thin``, is no ink itself.
    """
    names = [*by, label]
    kind = cells.groupBy(*names).agg(F.bool_or(ink).alias("own_ink"))
    whole = cells.groupBy(*by).agg(F.count("*").alias("whole"))
    found = perimeters(cells, label, by).join(kind, names).join(contacts(cells, label, ink, by), names)
    found = found.join(whole, list(by)) if by else found.join(F.broadcast(whole), F.lit(True))  # one row without images
    thickness = F.col("area") / (0.5 * F.greatest("perimeter", F.lit(1)))
    keep = F.col("on_rim") & ~F.col("own_ink") & (F.col("area") <= most) & (F.col("area") <= share * F.col("whole")) & (thickness <= thin)
    return found.where(keep & F.col("ink_neighbor").isNotNull() & (F.col("ink_contact") >= least_contact * F.col("contact"))).select(*names, "ink_neighbor")


def soft_cells(cells: DataFrame, label: str, distance: Column, by: Sequence[str] = ()) -> DataFrame:
    """cells (x, y, v: a struct with the label): those beside another label for which a condition on v and other holds, so where a border has slack."""
    return beside(cells, "v", by).where(F.col("other").isNotNull() & (F.col(f"other.{label}") != F.col(f"v.{label}")) & distance).select(*by, "x", "y", F.col(f"v.{label}").alias(label)).distinct()


def grown(cells: DataFrame, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """The cells and all within ``steps`` in both directions (a square neighbourhood), each axis apart."""
    out = cells.select(*by, "x", "y")
    for axis in ("x", "y"):
        out = out.withColumn("d", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).withColumn(axis, F.col(axis) + F.col("d")).drop("d").distinct()
    return out


def split_layer(cells: DataFrame, width: int, gap: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """by, x, y and part of each layer's cells: parts are 4-connected once gaps of up to 2 x gap cells are closed."""
    joined = grown(cells, gap, by) if gap else cells.select(*by, "x", "y")
    runs = region_runs(joined.select(*by, (F.col("x") + gap).alias("x"), (F.col("y") + gap).alias("y"), F.lit(0).alias("color")), width + 2 * gap, by)
    parts = region_cells(runs, by).select(*by, (F.col("x") - gap).alias("x"), (F.col("y") - gap).alias("y"), F.col("region").alias("part"))
    return cells.select(*by, "x", "y").join(parts, [*by, "x", "y"])


def part_names(parts: DataFrame, layer: str, by: Sequence[str] = (), confirm: int = 20) -> DataFrame:
    """by, part, name ("layer - N" in order of the parts' first cells), and whether there are so many parts of the layer that one would ask first."""
    each = parts.groupBy(*by, "part").agg(F.count("*").alias("area"))
    names = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    number = F.row_number().over(names.orderBy("part"))
    return each.select(*by, "part", "area", F.concat(F.lit(f"{layer} - "), number.cast("string")).alias("name"), (F.count("*").over(names) > confirm).alias("many"))


def lowest_around(cells: DataFrame, value: str, steps: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """A minimum filter: the least value in the square neighbourhood."""
    sides = [(dx, dy) for dx in range(-steps, steps + 1) for dy in range(-steps, steps + 1)]
    return beside(cells.select(*by, "x", "y", value), value, by, sides=sides).groupBy(*by, "x", "y").agg(F.min("other").alias(value))


def upsampled(cells: DataFrame, scale: int, threshold: int, by: Sequence[str] = ()) -> DataFrame:
    """Premultiplied bilinear enlargement (x, y, r, g, b, a): alpha first, colours only where it reaches the threshold.

    Each source cell gives its weighted part to the scaled cells it reaches, and the parts are summed before the shuffle.
    """
    k = F.col("k")
    reach = F.explode(F.sequence(F.lit(0), F.lit(2 * scale - 1)))
    out = cells
    for axis in ("x", "y"):
        place = F.col(axis) * scale - F.lit(scale) + F.floor(F.lit(scale) / 2) + k
        weight = 1 - F.abs((place + 0.5) / scale - (F.col(axis) + 0.5))
        out = out.withColumn("k", reach).withColumn(f"w{axis}", weight).withColumn(axis, place.cast("int")).where(F.col(f"w{axis}") > 0).drop("k")
    w = F.col("wx") * F.col("wy") * F.col("a")
    out = out.where("x >= 0 and y >= 0").groupBy(*by, "x", "y").agg(F.sum(w).alias("sa"), *(F.sum(w * F.col(c)).alias(f"s{c}") for c in "rgb"))
    out = out.where(F.floor(F.col("sa") + 0.5) >= threshold)
    return out.select(*by, "x", "y", *(F.floor(F.col(f"s{c}") / F.col("sa") + 0.5).cast("int").alias(c) for c in "rgb"), F.lit(255).alias("a"))


def depth(cells: DataFrame, label: str = "color", by: Sequence[str] = ()) -> DataFrame:
    """Steps to leave a cell's own label: 1 beside another label or nothing. Rounds go on until the frontier is empty, and carry only it.

    What a frontier reaches lies in it, in the one before, or is new, so a round looks at these two and rewrites nothing.
    """
    at = [*by, "x", "y"]
    cells = cells.select(*at, F.col(label).alias("label"))
    front = cut(beside(cells, "label", by).where(F.col("other").isNull() | (F.col("other") != F.col("label"))).select(*at, "label").distinct())
    levels, before = [front], None
    while True:
        steps = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in SIDES]))
        near = front.select(*by, "label", steps.alias("p")).select(*by, "p.x", "p.y", "label").distinct()
        fresh = near.join(cells, [*at, "label"], "left_semi").join(front, at, "left_anti")
        fresh = cut((fresh.join(before, at, "left_anti") if before is not None else fresh).select(*at, "label"))
        if not fresh.limit(1).count():
            break
        before, front = front, fresh
        levels.append(fresh)
    out = levels[0].withColumn("depth", F.lit(1))
    for k, level in enumerate(levels[1:], 2):
        out = out.unionByName(level.withColumn("depth", F.lit(k)))
    return out


def holes(mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The 4-connected holes of a mask (by, x, y): cells outside of it that can't reach its box's surrounding ring.

    by, hole (its first cell as y * width + x in the ringed box), x, y for each cell. The empty cells of a row are found as
    the runs between its cells, so nothing is as large as the box.
    """
    mask = mask.select(*by, "x", "y")
    box = mask.groupBy(*by).agg(F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"))
    rows = box.select(*by, F.explode(F.sequence(F.col("by0") - 1, F.col("by1") + 1)).alias("y"), "bx0", "bx1", "by0")
    ends = rows.select(*by, "y", F.explode(F.array(F.col("bx0") - 2, F.col("bx1") + 2)).alias("x"), "bx0", "bx1", "by0")  # as if painted just outside of the ring
    inner = mask.join(box.select(*by, "bx0", "bx1", "by0"), list(by)) if by else mask.join(F.broadcast(box.select("bx0", "bx1", "by0")), F.lit(True))
    painted = inner.select(*by, "y", "x", "bx0", "bx1", "by0").unionByName(ends)
    after = F.lead("x").over(Window.partitionBy(*by, "y").orderBy("x"))
    gaps = painted.withColumn("next", after).where("next - x > 1").withColumn("x0", F.col("x") + 1).withColumn("x1", F.col("next") - 1)
    number = (F.col("y") - F.col("by0") + 1).cast("long") * (F.col("bx1") - F.col("bx0") + 3) + F.col("x0") - F.col("bx0") + 1
    runs = cut(gaps.select(*by, "y", "x0", "x1", F.lit(0).alias("color"), (F.struct(*by, number.alias("at")) if by else number).alias("id")))
    roots = components(run_links(runs, by))
    root = F.coalesce("root", "id")
    named = runs.join(roots, runs["id"] == roots["node"], "left").select(*by, "y", "x0", "x1", (root["at"] if by else root).alias("hole"))
    return named.where(F.col("hole") != 0).select(*by, "hole", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def fill_holes(mask: DataFrame, least: int, keep_open: DataFrame | None = None, opaque: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The mask and its holes, but for holes with a cell of keep_open, and for those of ``least`` cells or more that touch a cell missing from opaque."""
    at, name = [*by, "x", "y"], [*by, "hole"]
    cells = cut(holes(mask, by))
    judged = cells.groupBy(*name).agg(F.count("*").alias("size"))
    if opaque is not None:
        clear = cells.join(opaque.select(*at), at, "left_anti").select(*name).distinct().withColumn("clear", F.lit(True))
        judged = judged.join(clear, name, "left").where(F.col("clear").isNull() | (F.col("size") < least))
    if keep_open is not None:
        judged = judged.join(cells.join(keep_open.select(*at), at, "left_semi").select(*name).distinct(), name, "left_anti")
    return mask.select(*at).unionByName(cells.join(judged, name, "left_semi").select(*at))


def contacts(cells: DataFrame, label: str, ink: Column, by: Sequence[str] = ()) -> DataFrame:
    """For each label: border to others, of that to ink labels, its longest ink neighbour (ties: lesser), and whether it faces nothing.

    ink: a condition on the cells, the same for all cells of a label.
    """
    marked = cells.select(*by, "x", "y", F.struct(F.col(label).alias("id"), ink.alias("ink")).alias("v"))
    sides = beside(marked, "v", by).where(F.col("other").isNull() | (F.col("other.id") != F.col("v.id")))
    each = sides.groupBy(*by, F.col("v.id").alias(label), F.col("other.id").alias("to"), F.col("other.ink").alias("to_ink")).agg(F.count("*").alias("n"))
    return each.groupBy(*by, label).agg(
        F.coalesce(F.sum(F.when(F.col("to").isNotNull(), F.col("n"))), F.lit(0)).alias("contact"),
        F.coalesce(F.sum(F.when(F.col("to_ink"), F.col("n"))), F.lit(0)).alias("ink_contact"),
        F.max_by("to", F.when(F.col("to_ink"), F.struct("n", (-F.col("to")).alias("k")))).alias("ink_neighbor"),
        F.bool_or(F.col("to").isNull()).alias("on_rim"),
    )


def touched_corners(corners: DataFrame, mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The lattice corners (by, x, y) of which one of the four cells around is in the mask."""
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0) for dy in (-1, 0)]))
    asked = corners.withColumn("_d", around).select(*corners.columns, (F.col("x") + F.col("_d.dx")).alias("_x"), (F.col("y") + F.col("_d.dy")).alias("_y"))
    there = mask.select(*by, F.col("x").alias("_x"), F.col("y").alias("_y"))
    return asked.join(there, [*by, "_x", "_y"], "left_semi").select(*corners.columns).distinct()


def covered(points: DataFrame, runs: DataFrame) -> DataFrame:
    """The region under each point (x, y), NULL for none."""
    p, r = points.alias("p"), runs.alias("r")
    return p.join(r, (F.col("p.y") == F.col("r.y")) & F.col("p.x").between(F.col("r.x0"), F.col("r.x1")), "left").select(*(F.col(f"p.{c}") for c in points.columns), F.col("r.region"))
