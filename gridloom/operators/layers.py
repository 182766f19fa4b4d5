"""Layer names and layer trees: derived-key joins, candidate look-ups, re-parenting, ancestor closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators.components import ancestors, with_above

SHY = ("Fill", "Depth Fix", "DF", "Border", "Balls")
RIG = ("B < ", "IK < ", "C < ", "N < ")


def contains_any(name: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(name, w))


def is_rig(name: Column) -> Column:
    return contains_any(name, RIG)


def fill_target(name: Column) -> Column:
    """The base layer of a fill layer (the name before its first " Fill"), NULL for others."""
    return F.when(F.contains(name, F.lit(" Fill")), F.element_at(F.split(name, " Fill"), 1))


def depth_fix_target(name: Column) -> Column:
    """The fill layer that a depth fix is merged into, NULL for others."""
    for mark in ("Depth Fix Fill", "DF Fill"):
        hit = F.concat(F.element_at(F.split(name, mark), 1), F.lit("Fill"))
        found = F.when(F.contains(name, F.lit(mark)), hit) if mark == "Depth Fix Fill" else found.when(F.contains(name, F.lit(mark)), hit)
    return found


def with_base(layers: DataFrame) -> DataFrame:
    """Fill layers with their base layer's name where one exists."""
    base = layers.select(F.col("name").alias("base")).distinct()
    return layers.withColumn("base", fill_target(F.col("name"))).join(base, "base", "left_semi").select(*layers.columns, "base")


def parent_by_rules(layers: DataFrame, rules: DataFrame) -> DataFrame:
    """layers (name), rules (ordinal, part, candidates): the last rule whose part the name contains; of its candidates the first that exists, else NULL."""
    matched = layers.select("name").distinct().join(F.broadcast(rules), F.contains(F.col("name"), F.col("part")))
    rule = matched.groupBy("name").agg(F.max_by("candidates", "ordinal").alias("candidates"))
    tried = rule.select("name", F.posexplode("candidates").alias("place", "candidate"))
    there = layers.select(F.col("name").alias("candidate")).distinct()
    found = tried.join(there, "candidate").groupBy("name").agg(F.min_by("candidate", "place").alias("parent"))
    return layers.select("name").distinct().join(found, "name", "left")


def outline_parents(layers: DataFrame) -> DataFrame:
    """layers (name, parent): the parent's outline layer where it exists."""
    there = layers.select(F.col("name").alias("outline")).distinct()
    asked = layers.withColumn("outline", F.concat("parent", F.lit(" Outlines")))
    found = there.withColumn("hit", F.col("outline"))
    return asked.join(found, "outline", "left").withColumn("parent", F.coalesce("hit", "parent")).select(*layers.columns)


def tree_ancestors(layers: DataFrame, key: str = "name", parent: str = "parent") -> DataFrame:
    return ancestors(layers.select(F.col(key).alias("child"), F.col(parent).alias("parent")))


def skip_parents(layers: DataFrame, skipped: Column) -> DataFrame:
    """layers (name, parent): parents that are skipped are replaced by their nearest ancestor that isn't, NULL if none."""
    marked = layers.select(F.col("name").alias("ancestor"), skipped.alias("skip"))
    above = tree_ancestors(layers).join(marked, "ancestor").where(~F.col("skip"))
    nearest = above.groupBy("node").agg(F.min_by("ancestor", "steps").alias("parent"))
    return layers.drop("parent").join(nearest, layers["name"] == nearest["node"], "left").drop("node").select(*layers.columns)


def with_ancestors(layers: DataFrame, seeds: DataFrame) -> DataFrame:
    """The layers that are seeds (name) or an ancestor of one."""
    kept = with_above(layers.select(F.col("name").alias("child"), "parent"), seeds.select(F.col("name").alias("node")))
    return layers.join(kept.select(F.col("node").alias("name")), "name", "left_semi")


def last_by_name(layers: DataFrame, name: str, ordinal: str, value: str) -> DataFrame:
    """A map by name in which the last writer wins."""
    return layers.groupBy(name).agg(F.max_by(value, ordinal).alias(value))


def topmost(hits: DataFrame, by: str, z: str, layer: str) -> DataFrame:
    return hits.groupBy(by).agg(F.max_by(layer, z).alias(layer))


def renamed(name: Column) -> Column:
    return S.without_first(S.without_suffix(name, " Image"), " Outlines")


def pruned(layers: DataFrame, keep: Column) -> DataFrame:
    """layers (name, parent): leaves that aren't kept go, again and again until none is left: what stays is kept or above a kept one."""
    return with_ancestors(layers, layers.where(keep).select("name"))


def mattes(layers: DataFrame, comps: dict[str, float]) -> DataFrame:
    """One row for each layer and comp (name: matte scale in per cent), its matte the layer's own fill, inverted."""
    copies = F.array(*[F.struct(F.lit(c).alias("comp"), F.lit(float(k)).alias("scale")) for c, k in comps.items()])
    return layers.withColumn("c", F.explode(copies)).select("c.comp", *layers.columns, F.concat("name", F.lit(" Fill")).alias("matte"), F.lit(True).alias("inverted"), "c.scale")


def outlines_only(layers: DataFrame) -> DataFrame:
    """After shapes were made from layers: a layer that has an outline layer goes, and the outline takes its name and its parent's outline."""
    outline = layers.where(F.endswith("name", F.lit(" Outlines"))).select(F.expr("left(name, length(name) - 9)").alias("name"))
    rest = layers.join(outline, "name", "left_anti")
    return outline_parents(rest).withColumn("name", S.without_first(F.col("name"), " Outlines"))
