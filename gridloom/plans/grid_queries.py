"""Raster queries over the supplied tables, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.operators import assign, grid
from gridloom.plans.tables import MASK_SQL, ORDERS_SQL, ORDERS_W, PART_SQL, orders_grid, part_grid, part_mask, table

QUERIES, ORACLES = {}, {}

STEPS = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS s(dx, dy)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


RUNS_SQL = f"""g AS ({ORDERS_SQL}), n AS (SELECT *, x - row_number() OVER (PARTITION BY y, color ORDER BY x) AS island FROM g),
runs AS (SELECT y, color, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) AS x1, CAST(y AS BIGINT) * {ORDERS_W} + min(x) AS id FROM n GROUP BY y, color, island)"""


@query("row_runs", f"WITH {RUNS_SQL} SELECT y, color, x0, x1 FROM runs")
def row_runs(spark, d):
    return grid.row_runs(orders_grid(spark, d))


@query("adjacency_counts", f"""WITH g AS ({ORDERS_SQL}), e AS (
SELECT a.color AS p, b.color AS q FROM g a JOIN g b ON b.y = a.y AND b.x = a.x + 1 UNION ALL
SELECT a.color, b.color FROM g a JOIN g b ON b.x = a.x AND b.y = a.y + 1)
SELECT least(p, q) AS lo, greatest(p, q) AS hi, count(*) AS sides FROM e WHERE p <> q GROUP BY ALL""")
def adjacency_counts(spark, d):
    return grid.adjacency_counts(orders_grid(spark, d))


@query("perimeters", f"""WITH g AS ({PART_SQL})
SELECT a.color, CAST(count(*) // 4 AS BIGINT) AS area, count(*) FILTER (WHERE b.x IS NULL OR b.color <> a.color) AS perimeter, count(*) FILTER (WHERE b.x IS NULL) AS open_len
FROM g a CROSS JOIN {STEPS} LEFT JOIN g b ON b.x = a.x + dx AND b.y = a.y + dy GROUP BY a.color""")
def perimeters(spark, d):
    return grid.perimeters(part_grid(spark, d))


@query("dominant_neighbors", f"""WITH g AS ({PART_SQL}), e AS (
SELECT a.color, b.color AS neighbor, count(*) AS sides FROM g a CROSS JOIN {STEPS} JOIN g b ON b.x = a.x + dx AND b.y = a.y + dy WHERE a.color <> b.color GROUP BY ALL)
SELECT color, neighbor, sides, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY color ORDER BY sides DESC, neighbor) AS rank FROM e) WHERE rank <= 3""")
def dominant_neighbors(spark, d):
    return grid.dominant_neighbors(part_grid(spark, d))


REACH_SQL = f"""{RUNS_SQL}, links AS (
SELECT a.id AS p, b.id AS q FROM runs a JOIN runs b ON b.y = a.y + 1 AND a.color = b.color AND a.x0 <= b.x1 AND a.x1 >= b.x0),
both_ways AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
reach(id, other) AS (SELECT id, id FROM runs UNION SELECT r.id, l.q FROM reach r JOIN both_ways l ON l.p = r.other),
roots AS (SELECT id, min(other) AS region FROM reach GROUP BY id)"""


@query("regions", f"""WITH RECURSIVE {REACH_SQL}
SELECT region, min(color) AS color, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) AS y1
FROM runs JOIN roots USING (id) GROUP BY region""")
def regions(spark, d):
    return grid.regions(orders_grid(spark, d), ORDERS_W)


@query("pin_regions", f"""WITH RECURSIVE {REACH_SQL}
SELECT c_custkey AS pin, CAST(c_custkey % 150 AS INT) AS x, CAST((c_custkey * 7) % 120 AS INT) AS y, region
FROM customer LEFT JOIN (SELECT * FROM runs JOIN roots USING (id)) r ON r.y = (c_custkey * 7) % 120 AND c_custkey % 150 BETWEEN r.x0 AND r.x1""")
def pin_regions(spark, d):
    pins = table(spark, d, "customer").select(F.col("c_custkey").alias("pin"), F.expr("int(c_custkey % 150)").alias("x"), F.expr("int((c_custkey * 7) % 120)").alias("y"))
    return grid.covered(pins, grid.region_runs(orders_grid(spark, d), ORDERS_W))


@query("surviving_regions", f"""WITH RECURSIVE {REACH_SQL}, t AS (
SELECT region, sum(x1 - x0 + 1) AS area, bool_or(y = 5 AND 20 BETWEEN x0 AND x1 OR y = 11 AND 33 BETWEEN x0 AND x1) AS pinned FROM runs JOIN roots USING (id) GROUP BY region)
SELECT region, CAST(area AS BIGINT) AS area, pinned, CASE WHEN area >= 4 OR pinned THEN 'traced' ELSE 'culled' END AS fate FROM t""")
def surviving_regions(spark, d):
    pins = spark.createDataFrame([(20, 5), (33, 11)], "x int, y int")
    runs = grid.region_runs(orders_grid(spark, d), ORDERS_W)
    pinned = grid.covered(pins, runs).select("region").distinct().withColumn("pinned", F.lit(True))
    out = grid.region_table(runs).select("region", "area").join(pinned, "region", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    return out.withColumn("fate", F.when((F.col("area") >= 4) | F.col("pinned"), "traced").otherwise("culled"))


MASK_EDGE = f"""m AS ({MASK_SQL}), edge AS (SELECT DISTINCT a.x, a.y FROM m a CROSS JOIN {STEPS} LEFT JOIN m b ON b.x = a.x + dx AND b.y = a.y + dy WHERE b.x IS NULL)"""


@query("region_depth", f"""WITH RECURSIVE {MASK_EDGE}, r(x, y, depth) AS (SELECT x, y, 1 FROM edge UNION
SELECT m.x, m.y, r.depth + 1 FROM r CROSS JOIN {STEPS} JOIN m ON m.x = r.x + dx AND m.y = r.y + dy WHERE r.depth < 30)
SELECT x, y, CAST(min(depth) AS INT) AS depth FROM r GROUP BY ALL""")
def region_depth(spark, d):
    return grid.depth(part_mask(spark, d).withColumn("color", F.lit(1))).select("x", "y", "depth")


HOLES_SQL = f"""m AS ({MASK_SQL}), box AS (SELECT min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM m),
field AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM box, unnest(range(x0, x1 + 1)) AS a(x), unnest(range(y0, y1 + 1)) AS b(y) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.x = a.x AND m.y = b.y)),
outside(x, y) AS (SELECT CAST(x0 AS INT), CAST(y0 AS INT) FROM box UNION SELECT f.x, f.y FROM outside o CROSS JOIN {STEPS} JOIN field f ON f.x = o.x + dx AND f.y = o.y + dy),
hole AS (SELECT x, y FROM field WHERE NOT EXISTS (SELECT 1 FROM outside o WHERE o.x = field.x AND o.y = field.y))"""


@query("hole_cells", f"WITH RECURSIVE {HOLES_SQL} SELECT x, y FROM hole")
def hole_cells(spark, d):
    return grid.holes(part_mask(spark, d)).select("x", "y")


@query("filled_mask", f"""WITH RECURSIVE {HOLES_SQL},
near(x, y, ox, oy) AS (SELECT x, y, x, y FROM hole UNION SELECT n.x, n.y, h.x, h.y FROM near n CROSS JOIN {STEPS} JOIN hole h ON h.x = n.ox + dx AND h.y = n.oy + dy),
sized AS (SELECT x, y, count(*) AS size FROM near GROUP BY ALL)
SELECT y, CAST(count(*) AS BIGINT) AS cells FROM (SELECT x, y FROM m UNION ALL SELECT x, y FROM sized WHERE size < 3) GROUP BY y""")
def filled_mask(spark, d):
    mask = part_mask(spark, d)
    return grid.fill_holes(mask, 3, opaque=mask).groupBy("y").agg(F.count("*").alias("cells"))


@query("ink_contact", f"""WITH g AS ({PART_SQL}), v AS (SELECT x, y, size AS id, size <= 9 AS ink FROM g),
e AS (SELECT a.id, b.id AS t, b.ink AS t_ink, count(*) AS n FROM v a CROSS JOIN {STEPS} LEFT JOIN v b ON b.x = a.x + dx AND b.y = a.y + dy WHERE b.id IS NULL OR b.id <> a.id GROUP BY ALL)
SELECT id AS size, CAST(coalesce(sum(n) FILTER (WHERE t IS NOT NULL), 0) AS BIGINT) AS contact, CAST(coalesce(sum(n) FILTER (WHERE t_ink), 0) AS BIGINT) AS ink_contact,
arg_min(t, -n * 1000 + t) FILTER (WHERE t_ink) AS ink_neighbor, bool_or(t IS NULL) AS on_rim FROM e GROUP BY id""")
def ink_contact(spark, d):
    return grid.contacts(part_grid(spark, d), "size", F.col("size") <= 9)


@query("bbox_crop", f"""WITH m AS (SELECT * FROM ({PART_SQL}) WHERE color = 'Brand#11' OR size > 40), b AS (
SELECT color, greatest(min(x) - 1, 0) AS x0, least(max(x) + 1, 49) AS x1, greatest(min(y) - 1, 0) AS y0, least(max(y) + 1, 99999) AS y1 FROM m GROUP BY color)
SELECT m.color, CAST(m.x - x0 AS INT) AS x, CAST(m.y - y0 AS INT) AS y, m.key FROM m JOIN b USING (color)""")
def bbox_crop(spark, d):
    cells = part_grid(spark, d).where("color = 'Brand#11' or size > 40")
    box = grid.bounding_box(cells, 1, (50, 100000), ["color"])
    return grid.crop(cells, box, ["color"]).drop("size")


@query("uniform_groups", """SELECT l_partkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS uniform, count(*) AS n FROM lineitem GROUP BY l_partkey""")
def uniform_groups(spark, d):
    return grid.uniform_color(table(spark, d, "lineitem"), ["l_partkey"], "l_returnflag")


RGB = "CAST((p_partkey * 37) % 256 AS INT) AS r, CAST((p_partkey * 91) % 256 AS INT) AS g, CAST((p_partkey * 151) % 256 AS INT) AS b"


def lab_sql(prefix: str = "") -> str:
    lin = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
    return f"""lin AS (SELECT *, {lin("r")} AS lr, {lin("g")} AS lg, {lin("b")} AS lb FROM rgb),
lms AS (SELECT *, cbrt(0.4122214708::DOUBLE * lr + 0.5363325363::DOUBLE * lg + 0.0514459929::DOUBLE * lb) AS l_, cbrt(0.2119034982::DOUBLE * lr + 0.6806995451::DOUBLE * lg + 0.1073969566::DOUBLE * lb) AS m_,
cbrt(0.0883024619::DOUBLE * lr + 0.2817188376::DOUBLE * lg + 0.6299787005::DOUBLE * lb) AS s_ FROM lin),
lab AS (SELECT *, 0.2104542553::DOUBLE * l_ + 0.7936177850::DOUBLE * m_ - 0.0040720468::DOUBLE * s_ AS ll, 1.9779984951::DOUBLE * l_ - 2.4285922050::DOUBLE * m_ + 0.4505937099::DOUBLE * s_ AS la,
0.0259040371::DOUBLE * l_ + 0.7827717662::DOUBLE * m_ - 0.8086757660::DOUBLE * s_ AS lb2 FROM lms)"""


def rgb_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", *(F.expr(x) for x in RGB.split(", ")))


@query("palette_oklab", f"""WITH rgb AS (SELECT p_partkey, {RGB} FROM part), {lab_sql()}
SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS hex, round(ll, 6) AS l, round(la, 6) AS a, round(lb2, 6) AS b, greatest(r, g, b) <= 30 AND greatest(r, g, b) - least(r, g, b) <= 8 AS ink,
g >= 200 AND r <= 100 AND b <= 100 AS key_fill FROM lab""")
def palette_oklab(spark, d):
    rows = rgb_parts(spark, d)
    parsed = rows.withColumn("hex", C.to_hex(F.col("r"), F.col("g"), F.col("b"))).withColumn("p", C.from_hex(F.col("hex")))
    lab = C.lab(F.col("p.r"), F.col("p.g"), F.col("p.b"), 6)
    return parsed.select("p_partkey", "hex", lab["l"].alias("l"), lab["a"].alias("a"), lab["b"].alias("b"), C.is_ink(F.col("r"), F.col("g"), F.col("b")).alias("ink"), C.is_key_fill(F.col("r"), F.col("g"), F.col("b")).alias("key_fill"))


PALETTE = [(0, 10, 10, 10), (1, 230, 230, 230), (2, 200, 50, 50), (3, 50, 80, 192), (4, 60, 180, 75), (5, 240, 200, 60)]


@query("nearest_color", f"""WITH pal(idx, r, g, b) AS (VALUES {", ".join(map(str, PALETTE))}),
rgb AS (SELECT p_partkey AS k, {RGB} FROM part UNION ALL SELECT -1 - idx, r, g, b FROM pal), {lab_sql()},
d AS (SELECT p.k AS p_partkey, -1 - q.k AS idx, round((p.ll - q.ll) ** 2 + (p.la - q.la) ** 2 + (p.lb2 - q.lb2) ** 2, 9) AS d2 FROM lab p JOIN lab q ON p.k >= 0 AND q.k < 0)
SELECT p_partkey, CAST(idx AS INT) AS idx, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d2, idx) AS n FROM d) WHERE n = 1""")
def nearest_color(spark, d):
    palette = spark.createDataFrame(PALETTE, "idx int, r int, g int, b int")
    return assign.nearest_color(rgb_parts(spark, d), palette).select("p_partkey", "idx", F.round("d2", 6).alias("d2"))


@query("constrained_nearest", f"""WITH g AS (SELECT CAST(o_orderkey % 150 AS INT) AS x, CAST(o_orderkey // 150 AS INT) AS y, CAST(substr(o_orderpriority, 1, 1) AS INT) AS idx, CAST(floor(o_totalprice % 256) AS INT) AS v FROM orders),
c AS (SELECT a.x, a.y, a.v, b.idx, min((dy + 1) * 3 + dx + 1) AS place FROM g a, (VALUES (-1), (0), (1)) AS s(dx), (VALUES (-1), (0), (1)) AS t(dy), g b WHERE b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL)
SELECT x, y, idx FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY abs(v - idx * 50), place) AS n FROM c) WHERE n = 1""")
def constrained_nearest(spark, d):
    cells = table(spark, d, "orders").selectExpr("int(o_orderkey % 150) as x", "int(floor(o_orderkey / 150)) as y", "int(substr(o_orderpriority, 1, 1)) as idx", "int(floor(o_totalprice % 256)) as v")
    return assign.constrained_nearest(cells, cells, 1, F.abs(F.col("v") - F.col("idx") * 50)).select("x", "y", "idx")


@query("swatch_gaps", f"""WITH pal(idx, r, g, b) AS (VALUES {", ".join(map(str, PALETTE))}), rgb AS (SELECT * FROM pal), {lab_sql()}
SELECT p.idx, round(min(sqrt((p.ll - q.ll) ** 2 + (p.la - q.la) ** 2 + (p.lb2 - q.lb2) ** 2)), 6) AS gap FROM lab p JOIN lab q ON p.idx <> q.idx GROUP BY p.idx""")
def swatch_gaps(spark, d):
    return assign.swatch_gaps(spark.createDataFrame(PALETTE, "idx int, r int, g int, b int")).select("idx", F.round("gap", 6).alias("gap"))


@query("perceptual_diff", f"""WITH a AS (SELECT p_partkey, {RGB} FROM part WHERE p_size % 7 <> 0), b AS (SELECT p_partkey, {RGB.replace("37", "38")} FROM part WHERE p_size % 5 <> 0),
j AS (SELECT coalesce(a.r, 255) AS r, coalesce(a.g, 255) AS g, coalesce(a.b, 255) AS b, coalesce(b.r, 255) AS r2, coalesce(b.g, 255) AS g2, coalesce(b.b, 255) AS b2 FROM a FULL JOIN b USING (p_partkey)),
rgb AS (SELECT row_number() OVER () AS k, * FROM j), rgb2 AS (SELECT k, r2 AS r, g2 AS g, b2 AS b FROM rgb), {lab_sql().replace("FROM rgb)", "FROM (SELECT k, 0 AS side, r, g, b FROM rgb UNION ALL SELECT k, 1, r, g, b FROM rgb2))")},
d AS (SELECT sqrt((p.ll - q.ll) ** 2 + (p.la - q.la) ** 2 + (p.lb2 - q.lb2) ** 2) AS e, greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b)) AS w FROM lab p JOIN lab q ON p.k = q.k AND p.side = 0 AND q.side = 1)
SELECT count(*) AS painted, round(avg(e), 6) AS mean_distance, round(avg(CASE WHEN e >= 0.06 THEN 1.0 ELSE 0.0 END), 6) AS visible, count(*) FILTER (WHERE w > 0) AS differing, max(w) AS worst FROM d""")
def perceptual_diff(spark, d):
    a = rgb_parts(spark, d).join(table(spark, d, "part").where("p_size % 7 <> 0").select("p_partkey"), "p_partkey", "left_semi")
    b = table(spark, d, "part").where("p_size % 5 <> 0").select("p_partkey", *(F.expr(x) for x in RGB.replace("37", "38").split(", ")))
    return assign.image_difference(a, b, ["p_partkey"])
