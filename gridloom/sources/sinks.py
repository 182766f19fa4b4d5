"""Paths as JSON documents and SVG text, built from arrays by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry as G

NEAR = 1e-6


def path_arrays(start: Column, cubics: Column, scale: float) -> Column:
    """STRUCT<v, i, o>: vertices and the relative in and out tangents; a last vertex on the first is dropped and its in tangent kept there."""
    down = lambda p: G.mul(p, 1.0 / scale)
    n = F.size(cubics)
    ends = F.transform(F.concat(F.array(start), F.transform(cubics, lambda c: c["e"])), down)
    outs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: G.sub(down(F.get(cubics, k)["c1"]), F.get(ends, k)))
    ins = F.transform(F.sequence(F.lit(0), n - 1), lambda k: G.sub(down(F.get(cubics, k)["c2"]), F.get(ends, k + 1)))
    zero = G.point(F.lit(0), F.lit(0))
    first, last = F.get(ends, F.lit(0)), F.element_at(ends, -1)
    closed = (F.abs(first["x"] - last["x"]) < NEAR) & (F.abs(first["y"] - last["y"]) < NEAR)
    return F.when(
        closed,
        F.struct(F.slice(ends, 1, n).alias("v"), F.concat(F.array(F.element_at(ins, -1)), F.slice(ins, 1, n - 1)).alias("i"), outs.alias("o")),
    ).otherwise(F.struct(ends.alias("v"), F.concat(F.array(zero), ins).alias("i"), F.concat(outs, F.array(zero)).alias("o")))


def documents_json(paths: DataFrame, scale: float, frames: DataFrame | None = None) -> DataFrame:
    """paths (doc, layer, z, group, color, path, start, cubics): one JSON text a document; order is z, group, path.

    frames (doc, width, height, stroke: a nullable struct) puts size, scale and stroke in front; a document without paths has no layers.
    """
    pair = lambda a: F.transform(a, lambda p: F.array(p["x"], p["y"]))
    arrays = path_arrays(F.col("start"), F.col("cubics"), scale)
    shaped = paths.withColumn("p", arrays).withColumn("p", F.struct(pair(F.col("p.v")).alias("v"), pair(F.col("p.i")).alias("i"), pair(F.col("p.o")).alias("o")))
    inner = lambda column: F.transform(F.sort_array(F.collect_list(column)), lambda x: x["x"])
    groups = shaped.groupBy("doc", "layer", "z", "group", "color").agg(inner(F.struct("path", F.col("p").alias("x"))).alias("paths"))
    layers = groups.groupBy("doc", "layer", "z").agg(inner(F.struct("group", F.struct("color", "paths").alias("x"))).alias("groups"))
    docs = layers.groupBy("doc").agg(inner(F.struct("z", F.struct(F.col("layer").alias("name"), "groups").alias("x"))).alias("layers"))
    if frames is None:
        return docs.select("doc", F.to_json(F.struct("doc", "layers")).alias("json"))
    whole = frames.select("doc", "width", "height", "stroke").join(docs, "doc", "left")
    empty = F.array().cast(dict((f.name, f.dataType) for f in docs.schema.fields)["layers"])
    return whole.select("doc", F.to_json(F.struct("doc", "width", "height", F.lit(scale).alias("scale"), "stroke", F.coalesce("layers", empty).alias("layers"))).alias("json"))


def export(paths: DataFrame, layers: DataFrame, scale: float, frames: DataFrame, folder: str) -> None:
    """Each document's enabled layers (doc, layer, enabled), hidden or not, as JSON under the folder."""
    kept = paths.join(layers.where("enabled").select("doc", "layer"), ["doc", "layer"], "left_semi")
    write_documents(documents_json(kept, scale, frames), "json", folder)


def number(v: Column) -> Column:
    """Up to three decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", v.cast("double")), r"0+$", ""), r"\.$", "")


def path_data(start: Column, cubics: Column, scale: float) -> Column:
    xy = lambda p: F.concat_ws(" ", number(p["x"] / scale), number(p["y"] / scale))
    return F.concat(F.lit("M"), xy(start), F.array_join(F.transform(cubics, lambda c: F.concat(F.lit("C"), xy(c["c1"]), F.lit(" "), xy(c["c2"]), F.lit(" "), xy(c["e"]))), ""), F.lit("Z"))


def documents_svg(paths: DataFrame, scale: float, width: int, height: int, pad: float = 0.0) -> DataFrame:
    """One SVG text a document: a path element for each colour run, holes as further subpaths."""
    data = paths.withColumn("d", path_data(F.col("start"), F.col("cubics"), scale))
    runs = data.groupBy("doc", "z", "group", "color").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "d"))), lambda x: x["d"]), "").alias("d"))
    line = F.concat(F.lit('<path fill="'), F.col("color"), F.lit('" d="'), F.col("d"), F.lit('"/>'))
    docs = runs.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("z", "group", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{-pad:g} {-pad:g} {width + 2 * pad:g} {height + 2 * pad:g}">'
    return docs.select("doc", F.concat(F.lit(head + "\n"), F.col("body"), F.lit("\n</svg>")).alias("svg"))


def tidy_opacity(entries: DataFrame) -> DataFrame:
    """Numbers to three decimals, and no entry that only says full opacity."""
    return entries.where("not (key = 'opacity' and value = 1)").withColumn("value", F.round(F.col("value") * 1000) / 1000)


def write_documents(texts: DataFrame, column: str, folder: str) -> None:
    """One folder a document."""
    texts.select("doc", F.col(column).alias("value")).write.mode("overwrite").partitionBy("doc").text(folder)
