"""Lists, selections and counts over documents, layers and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import color as C


def search(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column contains the trimmed query, whatever the case; all for an empty query."""
    wanted = query.strip().lower()
    return rows.where(F.contains(F.lower(column), F.lit(wanted))) if wanted else rows


def filtered_recents(recents: DataFrame, folders: bool, query: str) -> DataFrame:
    return search(recents.where(F.col("folder") == folders), "path", query)


def full_path_name(parent: Column, name: Column) -> Column:
    return F.when(parent.isNull() | (parent == "Root"), name).otherwise(F.concat_ws(" ", parent, name))


def swatch_color(locked: Column, stroke: Column, default: str) -> Column:
    """The first locked colour, else the stroke's, if a valid hex text, else the default."""
    first = F.coalesce(F.get(locked, F.lit(0)), stroke)
    return F.when(C.from_hex(first).isNotNull(), first).otherwise(F.lit(default))


def toggled(selection: Column, item: Column) -> Column:
    """The selection with the item in or out; it never becomes empty."""
    out = F.when(F.array_contains(selection, item), F.array_except(selection, F.array(item))).otherwise(F.array_append(selection, item))
    return F.when(F.size(out) == 0, selection).otherwise(out)


def between_ids(layers: DataFrame, a: Column, b: Column, by: Sequence[str], order: str, key: str) -> DataFrame:
    """The layers from one id to another, both included, by position."""
    w = Window.partitionBy(*by)
    lo, hi = (F.max(F.when(F.col(key) == x, F.col(order))).over(w) for x in (a, b))
    marked = layers.withColumn("_a", lo).withColumn("_b", hi)
    return marked.where(F.col(order).between(F.least("_a", "_b"), F.greatest("_a", "_b"))).drop("_a", "_b")


def layer_counts(layers: DataFrame, by: Sequence[str]) -> DataFrame:
    return layers.groupBy(*by).agg(
        F.count_if(F.col("visible") & F.col("enabled")).alias("active"),
        F.count_if(~F.col("enabled")).alias("excluded"),
        F.count_if(F.col("matte")).alias("mattes"),
        (F.count_if(F.col("matte")) >= 15).alias("too_many_mattes"),
    )


def cut_points(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(a, b)))


def lock_toggled(locked: Column, color: Column) -> Column:
    return F.when(F.array_contains(locked, color), F.array_except(locked, F.array(color))).otherwise(F.array_append(locked, color))


def fate_report(regions: DataFrame, merges: DataFrame, floor: int) -> DataFrame:
    """regions (region, area, pinned), merges (region, root): fate (merged, traced, culled), into, and the settled area."""
    joined = regions.join(merges, "region", "left").withColumn("root", F.coalesce("root", "region"))
    settled = joined.groupBy("root").agg(F.sum("area").alias("settled"), F.bool_or("pinned").alias("held"))
    fate = F.when(F.col("region") != F.col("root"), "merged").when((F.col("settled") >= floor) | F.col("held"), "traced").otherwise("culled")
    return joined.join(settled, "root").select("region", fate.alias("fate"), F.when(F.col("region") != F.col("root"), F.col("root")).alias("into"), "settled")


def fate_tints(fates: DataFrame, cells: DataFrame) -> DataFrame:
    """x, y, tint of the cells whose region doesn't survive; no row if all do."""
    tint = F.when(F.col("fate") == "merged", "#ffaa00").when(F.col("fate") == "culled", "#ff0044")
    return cells.join(fates.where("fate <> 'traced'").select("region", tint.alias("tint")), "region").select("x", "y", "tint")


def culled(paths: DataFrame, view: tuple[float, float, float, float]) -> DataFrame:
    """Colour runs (doc, group, x0 .. y1, stroke) whose stroke-widened union box meets the view."""
    box = paths.groupBy("doc", "group").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("stroke").alias("stroke"))
    half = F.col("stroke") / 2
    return box.where((F.col("x0") - half <= view[2]) & (F.col("x1") + half >= view[0]) & (F.col("y0") - half <= view[3]) & (F.col("y1") + half >= view[1]))


def selected_entries(manifest: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layers that the manifest asks for, and asked names that no layer has."""
    asked = manifest.where("layer is not null").select("source", "layer").distinct()
    whole = manifest.where("layer is null").select("source").distinct()
    named = layers.join(asked, ["source", "layer"], "left_semi")
    return named.unionByName(layers.join(whole, "source", "left_semi")).distinct(), asked.join(layers.select("source", "layer"), ["source", "layer"], "left_anti")


def zipped(a: DataFrame, b: DataFrame, by: Sequence[str], place: str) -> DataFrame:
    """Rows of equal place; what one side has more is left out."""
    return a.join(b, [*by, place])


def bottom_first(layers: DataFrame, by: Sequence[str], place: str) -> DataFrame:
    """z, the layer's height in paint order: places count from the top."""
    return layers.withColumn("z", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(place))) - 1)


def sub_path_anchors(paths: DataFrame) -> DataFrame:
    """paths (path, subs: an array of arrays of points): the first anchor of each sub-path, in order; empty ones have none."""
    each = paths.select("path", F.posexplode("subs").alias("sub", "points"))
    return each.where(F.size("points") > 0).select("path", "sub", F.get("points", F.lit(0)).alias("anchor"))


def expression_owners(properties: DataFrame, by: Sequence[str]) -> DataFrame:
    """properties (by, node, parent, expression, enabled): the groups and properties with an enabled expression in or under them.

    The steps upward double, so deep trees take few rounds.
    """
    from gridloom.operators.components import with_above

    key = lambda c: F.struct(*by, F.col(c).alias("node"))
    own = properties.where(F.col("enabled") & (F.length("expression") > 0)).select(key("node").alias("node"))
    links = properties.select(key("node").alias("child"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent"))
    return with_above(links, own).select("node.*")


def covering(shapes: DataFrame, survivors: DataFrame, at: Sequence[str], label: str) -> DataFrame:
    """The shapes (label) with a cell (at) of a survivor of another label."""
    other = survivors.select(*at, F.col(label).alias("_other"))
    return shapes.join(other, list(at)).where(F.col(label) != F.col("_other")).select(label).distinct()


def representatives(members: DataFrame, by: Sequence[str], keep: str, area: str, key: str) -> DataFrame:
    """For each group the member that stands for it (kept ones first, then area, then the highest key), and all their area."""
    return members.groupBy(*by).agg(F.max_by(key, F.struct(keep, area, key)).alias("chief"), F.sum(area).alias("total"))


def merged_boxes(members: DataFrame, by: Sequence[str], color: str, area: str, key: str) -> DataFrame:
    """For each group the union box, the area, and the colour of the largest member (ties: least key)."""
    box = (f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max)))
    return members.groupBy(*by).agg(*box, F.sum(area).alias(area), F.max_by(color, F.struct(area, (-F.col(key)).alias("k"))).alias(color))


def exported(layers: DataFrame) -> DataFrame:
    """Layers that go into a document: the enabled ones, hidden or not."""
    return layers.where("enabled")


def composited(layers: DataFrame) -> DataFrame:
    """Layers that are seen in the composite."""
    return layers.where("enabled and visible")
