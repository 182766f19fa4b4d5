"""Region merging, palette, seam and curve queries over the supplied tables. Order-dependent kernels have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import curves, grid, merging, palette, seams, stitching
from gridloom.plans.tables import ORDERS_SQL, ORDERS_W, orders_grid, table
from gridloom.sources import sinks
from gridloom.streaming import gate

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _rgb_orders(spark, d):
    level = F.substring("color", 1, 1).cast("int")
    return orders_grid(spark, d).select("x", "y", (level * 20).alias("r"), (level * 20 + 10).alias("g"), (255 - level * 8).alias("b"))


def _images(spark, d):
    """Small images of 16 x 16 parts or orders."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.floor(k / 256).alias("image"), (k % 16).cast("int").alias("x"), F.floor(k % 256 / 16).cast("int").alias("y"),
        *(F.floor((k % 16 * m + F.floor(k % 256 / 16) * n) / 64).cast("int").alias(c) for c, m, n in (("r", 500, 7), ("g", 11, 300), ("b", 90, 90))),
    )


def _features(spark, d):
    found = palette.features(_images(spark, d))
    whole = found.join(_images(spark, d), ["image", "x", "y"])
    region = (F.col("fy") * 16 + F.col("fx")).cast("long").alias("region")
    labelled = whole.select("image", "x", "y", "r", "g", "b", region)
    nodes = labelled.groupBy("image", "region").agg(*(F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"), F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return labelled, nodes


@query("feature_growing")
def feature_growing(spark, d):
    return _features(spark, d)[1]


def _feature_graph(spark, d):
    labelled, nodes = _features(spark, d)
    edges = grid.adjacency_counts(labelled, "region", ["image"])
    return nodes.join(grid.perimeters(labelled, "region", ["image"]).select("image", "region", "perimeter"), ["image", "region"]), edges


@query("shade_merge")
def shade_merge(spark, d):
    return merging.merged(*_feature_graph(spark, d), "shades", split=0.045, noise=0.2)


@query("residue_fold")
def residue_fold(spark, d):
    return merging.merged(*_feature_graph(spark, d), "residue")


@query("leader_groups")
def leader_groups(spark, d):
    return palette.groups(_features(spark, d)[1].select("image", "r", "g", "b", "area"))


@query("palette_select")
def palette_select(spark, d):
    return palette.select(_features(spark, d)[1].select("image", "r", "g", "b", "area"), 6, [(10, 10, 10)])


@query("speckle_merge")
def speckle_merge(spark, d):
    return merging.merged(*merging.region_graph(_rgb_orders(spark, d), ORDERS_W), "speckles", floor=4)


@query("stroke_merge")
def stroke_merge(spark, d):
    return merging.merged(*merging.region_graph(_rgb_orders(spark, d), ORDERS_W), "strokes", width=4.0, distance=0.08)


@query("band_absorb")
def band_absorb(spark, d):
    return merging.merged(*merging.region_graph(_rgb_orders(spark, d), ORDERS_W), "bands", distance=0.08, mean_width=2.5, most_width=4.0)


@query("mst_paint_order")
def mst_paint_order(spark, d):
    runs = grid.region_runs(orders_grid(spark, d), ORDERS_W)
    labelled = grid.region_cells(runs).select("x", "y", "region")
    image = F.lit(0).alias("image")
    return merging.paint_order(grid.perimeters(labelled, "region").select(image, "region", "open_len", "area"), grid.adjacency_counts(labelled, "region").select(image, "lo", "hi", "sides"))


SEGMENTS = f"""g AS ({ORDERS_SQL}), s AS (
SELECT a.color, CASE WHEN dx = 1 THEN a.x + 1 ELSE a.x END AS ax, CASE WHEN dy = 1 THEN a.y + 1 ELSE a.y END AS ay, CASE WHEN dx = -1 THEN a.x ELSE a.x + 1 END AS bx, CASE WHEN dy = -1 THEN a.y ELSE a.y + 1 END AS by_
FROM g a CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(dx, dy) LEFT JOIN g b ON b.x = a.x + dx AND b.y = a.y + dy WHERE b.x IS NULL OR b.color <> a.color)"""


@query("segment_match", f"""WITH {SEGMENTS} SELECT least(a.color, b.color) AS ring, greatest(a.color, b.color) AS partner, count(*) AS segments FROM s a JOIN s b USING (ax, ay, bx, by_) WHERE a.color < b.color GROUP BY ALL""")
def segment_match(spark, d):
    edges = curves.boundary_edges(orders_grid(spark, d), "color")
    met = seams.partners(edges, "color").select(F.col("color").alias("ring"), F.explode("partners").alias("partner"))
    return met.where("ring < partner").groupBy("ring", "partner").agg(F.count("*").alias("segments"))


@query("shared_runs", """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY k), last_value(event_type) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b FROM e),
r AS (SELECT *, sum(CASE WHEN b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k) AS run, sum(CASE WHEN b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS runs FROM m)
SELECT user_id, CAST(coalesce(min(CASE WHEN b <> event_type THEN k END), min(k)) AS INT) AS first, count(*) AS size, any_value(event_type) AS event_type FROM r GROUP BY user_id, CASE WHEN run = 0 THEN runs ELSE run END""")
def shared_runs(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return seams.shared_runs(e.select("user_id", "k", "event_type"), "user_id", "k", "event_type")


@query("color_groups", """WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS f FROM events),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM e)
SELECT user_id, CAST(grp AS BIGINT) AS "group", event_type, count(*) AS shapes FROM g GROUP BY user_id, grp, event_type""")
def color_groups(spark, d):
    shapes = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return seams.adjacent_groups(shapes, ["user_id"], "event_id", "event_type").withColumn("shapes", F.size("shapes").cast("long"))


CURVE = "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x3, (p_partkey % 40)::DOUBLE AS y3, (p_partkey % 17)::DOUBLE AS x1, (p_partkey % 23)::DOUBLE AS y1, (p_partkey % 29)::DOUBLE AS x2, (p_partkey % 31)::DOUBLE AS y2 FROM part"


def _curves(spark, d):
    k = F.col("p_partkey")
    p = lambda x, y: G.point(x, y)
    return table(spark, d, "part").select("p_partkey", p(F.lit(0), F.lit(0)).alias("p0"), p(k % 17, k % 23).alias("p1"), p(k % 29, k % 31).alias("p2"), p(F.col("p_size"), k % 40).alias("p3"))


@query("bezier_samples", f"""WITH c AS ({CURVE}), h AS (SELECT *, least(greatest(ceil(sqrt(x1 * x1 + y1 * y1) + sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) + sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2)), 4), 64) AS k FROM c),
s AS (SELECT *, i / k::DOUBLE AS t, 1 - i / k::DOUBLE AS u FROM (SELECT *, unnest(range(0, CAST(k AS BIGINT) + 1)) AS i FROM h))
SELECT p_partkey, CAST(i AS INT) AS i, round(3 * u * u * t * x1 + 3 * u * t * t * x2 + t * t * t * x3 + 1e-9, 6) AS x, round(3 * u * u * t * y1 + 3 * u * t * t * y2 + t * t * t * y3 + 1e-9, 6) AS y FROM s""")
def bezier_samples(spark, d):
    ends = [F.col(f"p{k}") for k in range(4)]
    rows = _curves(spark, d).withColumn("k", G.sample_count(*ends)).withColumn("i", F.explode(F.sequence(F.lit(0), "k")))
    points = rows.select("p_partkey", "i", G.bezier_point(*ends, F.col("i") / F.col("k")).alias("p"))
    return points.select("p_partkey", "i", F.round(F.col("p.x") + 1e-9, 6).alias("x"), F.round(F.col("p.y") + 1e-9, 6).alias("y"))


NEAR_POINTS = "SELECT c_custkey AS id, c_custkey % 5 AS own, (c_custkey * 37 % 211)::DOUBLE AS x, (c_custkey // 7)::DOUBLE AS y FROM customer"
NEAR_SEGMENTS = """SELECT s_suppkey % 5 AS path, (s_suppkey * 53 % 211)::DOUBLE AS ax, (s_suppkey * 15 // 7)::DOUBLE AS ay,
(s_suppkey * 53 % 211 + 3)::DOUBLE AS bx, (s_suppkey * 15 // 7 + 2)::DOUBLE AS by_ FROM supplier"""
NEAR_GAPS = """t AS (SELECT p.*, s.*, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2), 0), 1) AS t FROM p, s WHERE own <> path),
d AS (SELECT id, sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2) AS e FROM t)"""


def _near(spark, d):
    """Points and segments over an area that grows with the tables."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, d, "customer").select(k.alias("id"), (k % 5).alias("own"), (k * 37 % 211).cast("double").alias("x"), F.floor(k / 7).cast("double").alias("y"))
    ax, ay = s * 53 % 211, F.floor(s * 15 / 7)
    ends = [x.cast("double").alias(c) for c, x in (("ax", ax), ("ay", ay), ("bx", ax + 3), ("by", ay + 2))]
    return points, table(spark, d, "supplier").select((s % 5).alias("path"), *ends)


@query("nearest_segment", f"""WITH p AS ({NEAR_POINTS}), s AS ({NEAR_SEGMENTS}), {NEAR_GAPS}
SELECT p.id, round(min(e), 6) AS distance FROM p LEFT JOIN d ON d.id = p.id GROUP BY p.id""")
def nearest_segment(spark, d):
    return curves.nearest_segment(*_near(spark, d), 8.0).select("id", F.round("distance", 6).alias("distance"))


@query("points_within", f"""WITH p AS ({NEAR_POINTS}), s AS ({NEAR_SEGMENTS}), {NEAR_GAPS} SELECT id FROM d GROUP BY id HAVING min(e) < 6""")
def points_within(spark, d):
    return curves.within(*_near(spark, d), 6.0).select("id")


@query("ring_points")
def ring_points(spark, d):
    cells = table(spark, d, "part").where("p_size >= 12").selectExpr("int(p_partkey % 50) as x", "int(floor(p_partkey / 50)) as y", "1 as color")
    return curves.rings(grid.region_cells(grid.region_runs(cells, 50)).select("x", "y", "region"))


@query("stitched_paths")
def stitched_paths(spark, d):
    """Regions of equal priority in images of 16 x 16 orders, each border between two fitted once."""
    k = F.col("o_orderkey")
    cells = table(spark, d, "orders").select(F.floor(k / 256).alias("image"), (k % 16).cast("int").alias("x"), F.floor(k % 256 / 16).cast("int").alias("y"), F.col("o_orderpriority").alias("color"))
    found = grid.region_cells(grid.region_runs(cells, 16, ["image"]), ["image"])
    label = F.concat_ws(":", "image", "region").alias("label")
    rings = curves.rings(found.select("x", "y", label), "label")
    rings = rings.withColumn("image", F.element_at(F.split("label", ":"), 1).cast("long"))
    return stitching.stitched(rings, ["image", "label", "ring"], image="image").drop("image")


@query("bezier_fit")
def bezier_fit(spark, d):
    return curves.fit_rings(ring_points(spark, d), ["region", "ring"])


@query("simplified_fit")
def simplified_fit(spark, d):
    return curves.fit_rings(ring_points(spark, d), ["region", "ring"], drop=0.75)


def _paths(spark, d):
    p = lambda x, y: G.point(F.col(x), F.col(y))
    cubic = F.struct("seg", F.struct(p("c1x", "c1y").alias("c1"), p("c2x", "c2y").alias("c2"), p("ex", "ey").alias("e")).alias("c"))
    paths = bezier_fit(spark, d).groupBy("region", "ring").agg(F.min_by(p("x0", "y0"), "seg").alias("start"), F.transform(F.sort_array(F.collect_list(cubic)), lambda x: x["c"]).alias("cubics"))
    return paths.select((F.col("region") % 3).alias("doc"), F.lit("layer").alias("layer"), F.lit(0).alias("z"), F.col("region").alias("group"), F.lit("#336699").alias("color"), F.col("ring").alias("path"), "start", "cubics")


@query("document_json")
def document_json(spark, d):
    return sinks.documents_json(_paths(spark, d), 2.0)


@query("document_svg")
def document_svg(spark, d):
    return sinks.documents_svg(_paths(spark, d), 2.0, 512, 512)


@query("gated_parts", """SELECT doc, seq, generation, generation = g AS accepted FROM (SELECT user_id AS doc, event_id AS seq, event_id // 1000 + event_id % 2 AS generation, max(event_id // 1000 + event_id % 2) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)""")
def gated_parts(spark, d):
    e = F.col("event_id")
    return gate.gated(table(spark, d, "events").select(F.col("user_id").alias("doc"), e.alias("seq"), (F.floor(e / 1000) + e % 2).alias("generation")))


@query("layer_parts", """WITH RECURSIVE m AS (SELECT CAST(p_partkey % 50 AS INT) AS x, CAST(p_partkey // 50 AS INT) AS y FROM part WHERE p_size > 30), r(x, y, ox, oy) AS (
SELECT x, y, x, y FROM m UNION SELECT r.x, r.y, m.x, m.y FROM r JOIN m ON abs(m.x - r.ox) + abs(m.y - r.oy) = 1)
SELECT x, y, CAST(min(oy * 50 + ox) AS BIGINT) AS part FROM r GROUP BY x, y""")
def layer_parts(spark, d):
    return grid.split_layer(table(spark, d, "part").where("p_size > 30").selectExpr("int(p_partkey % 50) as x", "int(floor(p_partkey / 50)) as y"), 50)


@query("minimum_filter", """WITH m AS (SELECT CAST(p_partkey % 50 AS INT) AS x, CAST(p_partkey // 50 AS INT) AS y, p_size FROM part)
SELECT a.x, a.y, min(b.p_size) AS p_size FROM m a JOIN m b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.x, a.y""")
def minimum_filter(spark, d):
    return grid.lowest_around(table(spark, d, "part").selectExpr("int(p_partkey % 50) as x", "int(floor(p_partkey / 50)) as y", "p_size"), "p_size")


@query("rim_residue", """WITH g AS (SELECT CAST(p_partkey % 50 AS INT) AS x, CAST(p_partkey // 50 AS INT) AS y, p_size AS label FROM part),
s AS (SELECT a.label, b.label AS other FROM g a CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(dx, dy) LEFT JOIN g b ON b.x = a.x + dx AND b.y = a.y + dy),
m AS (SELECT label, count(*) / 4 AS area, count(*) FILTER (WHERE other IS NULL OR other <> label) AS perimeter, count(*) FILTER (WHERE other <> label) AS contact,
  count(*) FILTER (WHERE other <> label AND other < 38) AS ink, bool_or(other IS NULL) AS rim FROM s GROUP BY label),
n AS (SELECT label, arg_max(other, n * 1000 - other) AS ink_neighbor FROM (SELECT label, other, count(*) AS n FROM s WHERE other <> label AND other < 38 GROUP BY ALL) GROUP BY label)
SELECT label, ink_neighbor FROM m JOIN n USING (label) WHERE rim AND label >= 38 AND area <= 1000 AND area <= 0.25 * (SELECT count(*) FROM g) AND area / (0.5 * greatest(perimeter, 1)) <= 3.0 AND ink >= 0.6 * contact""")
def rim_residue(spark, d):
    cells = table(spark, d, "part").selectExpr("int(p_partkey % 50) as x", "int(floor(p_partkey / 50)) as y", "p_size as label")
    return grid.rim_residue(cells, "label", F.col("label") < 38, thin=3.0, most=1000)


@query("traced_images")
def traced_images(spark, d):
    from gridloom.plans import trace

    images = _images(spark, d).withColumn("a", F.lit(255))
    light = trace.Settings(absorb_distance=0, stroke_width=0, least_hole=0, stitch=False)
    return trace.counts(trace.trace(images, light))
