"""Small projections, joins and tallies over the supplied tables, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.functions import geometry as G
from gridloom.functions import scalars as S
from gridloom.operators import assign, changes, grid, keyframes, layers, library, palette, rules, seams
from gridloom.plans.tables import ORDERS_SQL, orders_grid, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


LINEAR = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
SHADE = "SELECT p_partkey, (p_partkey * 7 % 256)::DOUBLE AS r, (p_size * 5)::DOUBLE AS g, (p_partkey * 13 % 256)::DOUBLE AS b FROM part"
#: Published matrices of the colour space.
LAB = """lin AS (SELECT p_partkey, r, g, b, {r} AS lr, {g} AS lg, {b} AS lb FROM shade),
cone AS (SELECT *, cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) AS c1, cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) AS c2,
  cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb) AS c3 FROM lin),
lab AS (SELECT *, 0.2104542553 * c1 + 0.7936177850 * c2 - 0.0040720468 * c3 AS l, 1.9779984951 * c1 - 2.4285922050 * c2 + 0.4505937099 * c3 AS a,
  0.0259040371 * c1 + 0.7827717662 * c2 - 0.8086757660 * c3 AS q FROM cone)""".format(**{c: LINEAR.format(c) for c in "rgb"})  # noqa: UP032


def _shades(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", (k * 7 % 256).alias("r"), (F.col("p_size") * 5).alias("g"), (k * 13 % 256).alias("b"))


@query("color_lines", f"""WITH shade AS ({SHADE}), {LAB},
n AS (SELECT x.p_partkey, x.l, x.a, x.q, y.l AS l1, y.a AS a1, y.q AS q1, z.l AS l2, z.a AS a2, z.q AS q2 FROM lab x JOIN lab y ON y.p_partkey = x.p_partkey + 1 JOIN lab z ON z.p_partkey = x.p_partkey + 2),
t AS (SELECT *, (l2 - l1) ** 2 + (a2 - a1) ** 2 + (q2 - q1) ** 2 AS size, (l - l1) * (l2 - l1) + (a - a1) * (a2 - a1) + (q - q1) * (q2 - q1) AS along FROM n),
u AS (SELECT *, CASE WHEN size <= 0 THEN 0 ELSE least(greatest(along / size, 0), 1) END AS t FROM t)
SELECT p_partkey, round(sqrt((l - l1 - t * (l2 - l1)) ** 2 + (a - a1 - t * (a2 - a1)) ** 2 + (q - q1 - t * (q2 - q1)) ** 2), 6) AS deviation,
sqrt((l - l1) ** 2 + (a - a1) ** 2 + (q - q1) ** 2) > 0.075 AND sqrt((l - l2) ** 2 + (a - a2) ** 2 + (q - q2) ** 2) > 0.075
AND sqrt((l - l1 - t * (l2 - l1)) ** 2 + (a - a1 - t * (a2 - a1)) ** 2 + (q - q1 - t * (q2 - q1)) ** 2) < 0.1 AS blend FROM u""")
def color_lines(spark, d):
    lab = _shades(spark, d).select("p_partkey", C.lab(F.col("r"), F.col("g"), F.col("b")).alias("p"))
    ends = [lab.select((F.col("p_partkey") - k).alias("p_partkey"), F.col("p").alias(f"p{k}")) for k in (1, 2)]
    both = lab.join(ends[0], "p_partkey").join(ends[1], "p_partkey")
    p, a, b = F.col("p"), F.col("p1"), F.col("p2")
    return both.select("p_partkey", F.round(C.segment_deviation(p, a, b), 6).alias("deviation"), C.blend_between(p, a, b, 0.075, 0.1).alias("blend"))


@query("recolored", """SELECT p_partkey, CASE WHEN contains(p_name, '1') AND greatest(p_partkey % 9, p_size) <= 5 THEN 255 ELSE p_partkey % 9 END::INT AS r,
CASE WHEN contains(p_name, '1') AND greatest(p_partkey % 9, p_size) <= 5 THEN 255 ELSE p_size END::INT AS g, round(((p_size * 3) * (p_partkey % 256) + 255 * (255 - p_partkey % 256)) / 255.0, 6) AS over FROM part""")
def recolored(spark, d):
    k = F.col("p_partkey")
    r, g = k % 9, F.col("p_size")
    name = F.regexp_replace("p_name", "1", "Fill")
    out = C.recolored(r, g, r, name)
    return table(spark, d, "part").select("p_partkey", out["r"].alias("r"), out["g"].alias("g"), F.round(C.over_white(F.col("p_size") * 3, k % 256), 6).alias("over"))


@query("board_fit", """SELECT p_partkey, round(512.0 / greatest(p_size, p_partkey % 40 + 1), 9) AS ratio, round((512 - p_size * (512.0 / greatest(p_size, p_partkey % 40 + 1))) / 2, 6) AS dx,
round((512 - (p_partkey % 40 + 1) * (512.0 / greatest(p_size, p_partkey % 40 + 1))) / 2, 6) AS dy, p_partkey + p_size AS "right", p_size - p_partkey % 40 - 1 AS bottom FROM part""")
def board_fit(spark, d):
    w, h, k = F.col("p_size"), F.col("p_partkey") % 40 + 1, F.col("p_partkey")
    fit, box = G.fit_square(w, h), G.rect(k, w, w, h)
    return table(spark, d, "part").select("p_partkey", F.round(fit["ratio"], 9).alias("ratio"), F.round(fit["dx"], 6).alias("dx"), F.round(fit["dy"], 6).alias("dy"), box["right"].alias("right"), box["bottom"].alias("bottom"))


POINTS = "SELECT p_partkey AS k, (p_partkey % 17)::DOUBLE AS x, (p_size % 13)::DOUBLE AS y, (p_partkey % 7)::DOUBLE AS ax, (p_size % 5)::DOUBLE AS ay, (p_partkey % 11 + 1)::DOUBLE AS bx, (p_size % 9 + 2)::DOUBLE AS by_ FROM part"


def _points(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(k.alias("k"), G.point(k % 17, z % 13).alias("p"), G.point(k % 7, z % 5).alias("a"), G.point(k % 11 + 1, z % 9 + 2).alias("b"))


@query("point_distances", f"""WITH p AS ({POINTS}), s AS (SELECT *, (bx - ax) ** 2 + (by_ - ay) ** 2 AS size FROM p),
t AS (SELECT *, CASE WHEN size <= 0 THEN 0 ELSE least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / size, 0), 1) END AS t FROM s)
SELECT k, round((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2, 6) AS to_segment, round(greatest(least(ax, bx) - x, x - greatest(ax, bx), 0) ** 2 + greatest(least(ay, by_) - y, y - greatest(ay, by_), 0) ** 2, 6) AS to_box,
round((x - ax) * (bx - ax) + (y - ay) * (by_ - ay), 6) AS dot, round(CASE WHEN size > 0 THEN (bx - ax) / sqrt(size) ELSE 0 END, 6) AS unit_x, least(ax, bx) <= y AND greatest(ax, bx) >= x AND least(ay, by_) <= y AND greatest(ay, by_) >= x AS overlap FROM t""")
def point_distances(spark, d):
    p, a, b = F.col("p"), F.col("a"), F.col("b")
    lo, hi = (G.point(f(a["x"], b["x"]), f(a["y"], b["y"])) for f in (F.least, F.greatest))
    rows = _points(spark, d).withColumns({"ux0": lo["x"], "uy0": lo["y"], "ux1": hi["x"], "uy1": hi["y"], "vx0": p["x"], "vy0": p["x"], "vx1": p["y"], "vy1": p["y"]})
    return rows.select(
        "k", F.round(G.dist2_to_segment(p, a, b), 6).alias("to_segment"), F.round(G.box_dist2(p, lo["x"], lo["y"], hi["x"], hi["y"]), 6).alias("to_box"),
        F.round(G.dot(G.sub(p, a), G.sub(b, a)), 6).alias("dot"), F.round(G.norm(G.sub(b, a))["x"], 6).alias("unit_x"), G.boxes_overlap("u", "v").alias("overlap"),
    )


@query("placed_paths", f"""WITH p AS ({POINTS}) SELECT k, round(x * 2.5 + 10, 6) AS sx, round(y * 2.5 - 4, 6) AS sy, round(bx * 2.5 + 10, 6) AS ex, round(by_ * 2.5 - 4, 6) AS ey, round(bx, 6) AS back_x, round(ax, 6) AS back_c2x FROM p""")
def placed_paths(spark, d):
    cubics = F.array(F.struct(F.col("a").alias("c1"), F.col("p").alias("c2"), F.col("b").alias("e")))
    rows = _points(spark, d).withColumn("cubics", cubics)
    out, back = G.place(F.col("p"), F.col("cubics"), 2.5, 10.0, -4.0), G.reverse_cubics(F.col("p"), F.col("cubics"))
    last = F.get(out["cubics"], F.lit(0))["e"]
    named = rows.withColumns({"o": F.struct(out["start"].alias("s"), last.alias("e")), "b2": back, "same": G.span_key(F.col("p"), F.col("cubics")) == G.span_key(back["start"], back["cubics"])}).where("same")
    return named.select("k", *(F.round(F.col(c), 6).alias(n) for c, n in (("o.s.x", "sx"), ("o.s.y", "sy"), ("o.e.x", "ex"), ("o.e.y", "ey"), ("b2.start.x", "back_x"))), F.round(F.get("b2.cubics", F.lit(0))["c2"]["x"], 6).alias("back_c2x"))


@query("polylines", f"""WITH p AS ({POINTS}), l AS (SELECT *, sqrt((ax - x) ** 2 + (ay - y) ** 2) AS s1, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS s2 FROM p)
SELECT k, round(CASE WHEN s1 + s2 > 0 THEN s1 / (s1 + s2) ELSE 0 END, 6) AS middle, least(4 + 0, 64) + 0 > 0 AS ok,
(CASE WHEN (y > 3) <> (ay > 3) AND 5 < (ax - x) * (3 - y) / (ay - y) + x THEN 1 ELSE 0 END + CASE WHEN (ay > 3) <> (by_ > 3) AND 5 < (bx - ax) * (3 - ay) / (by_ - ay) + ax THEN 1 ELSE 0 END + CASE WHEN (by_ > 3) <> (y > 3) AND 5 < (x - bx) * (3 - by_) / (y - by_) + bx THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM l""")
def polylines(spark, d):
    ring = F.array("p", "a", "b")
    whole = G.circular_slice(ring, F.lit(1), F.lit(1))
    return _points(spark, d).select("k", F.round(F.get(G.chord_lengths(ring), F.lit(1)), 6).alias("middle"), (F.size(whole) == 4).alias("ok"), G.inside_polygon(F.lit(5.0), F.lit(3.0), ring).alias("inside"))


@query("setting_scalars", """SELECT p_partkey, round(greatest(0.0, p_size - 10) * 2.5)::DOUBLE AS radius, CASE WHEN p_size > 10 THEN p_size END AS stroke, lower(CASE WHEN p_partkey < 36 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', (p_partkey + 1)::INT, 1)
ELSE (WITH RECURSIVE b(n, s) AS (SELECT p_partkey, '' UNION ALL SELECT n // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', (n % 36 + 1)::INT, 1) || s FROM b WHERE n > 0) SELECT s FROM b WHERE n = 0) END) AS code,
format('{:,}', (p_retailprice * 100)::BIGINT) AS grouped, round(p_retailprice / 7, 3) AS tidy, round(least(greatest(p_size / 40.0, 0), 1), 6) AS heat, round(p_size / (0.5 * greatest(p_partkey % 30, 1)), 6) AS thick FROM part""")
def setting_scalars(spark, d):
    z, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey", S.smooth_radius(z - 10.0, F.lit(2.5)).alias("radius"), S.stroke_of(F.when(z > 10, z).otherwise(0), F.lit("#000000"))["width"].alias("stroke"),
        S.base36(k).alias("code"), S.thousands((F.col("p_retailprice") * 100).cast("long")).alias("grouped"), F.round(S.tidy_number(F.col("p_retailprice") / 7), 3).alias("tidy"),
        F.round(S.ramp(z, F.lit(40)), 6).alias("heat"), F.round(G.mean_thickness(z, k % 30), 6).alias("thick"),
    )


@query("scaled_pins", """SELECT p_partkey, ((p_partkey % 60) - 8) * 3 + 1 AS x, (p_size - 16) * 3 + 1 AS y FROM part WHERE p_partkey % 60 BETWEEN 8 AND 39 AND p_size BETWEEN 16 AND 39""")
def scaled_pins(spark, d):
    pin = S.scaled_pin(F.col("p_partkey") % 60, F.col("p_size"), F.lit(8), F.lit(16), F.lit(3), F.lit(32), F.lit(24))
    return table(spark, d, "part").select("p_partkey", pin.alias("p")).where("p is not null").select("p_partkey", "p.x", "p.y")


@query("view_round_trip", """SELECT p_partkey, round(p_size * least(300.0 / (p_partkey % 50 + 10), 200.0 / p_size) + (300 - (p_partkey % 50 + 10) * least(300.0 / (p_partkey % 50 + 10), 200.0 / p_size)) / 2, 6) AS x, round(p_size, 6)::DOUBLE AS back FROM part""")
def view_round_trip(spark, d):
    z = F.col("p_size").cast("double")
    view = S.fit_view(F.col("p_partkey") % 50 + 10, z, F.lit(300.0), F.lit(200.0))
    rows = table(spark, d, "part").select("p_partkey", z.alias("z"), view.alias("view"))
    at = S.to_screen(F.col("z"), F.col("z"), F.col("view"))
    return rows.withColumn("at", at).select("p_partkey", F.round("at.x", 6).alias("x"), F.round(S.to_image(F.col("at.x"), F.col("at.y"), F.col("view"))["x"], 6).alias("back"))


@query("settings_routed", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 END AS size, p_brand AS brand, p_partkey % 3 = 0 AS size_set, 1 + (p_partkey % 3 = 0)::INT AS n FROM part""")
def settings_routed(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("s"))
    own = F.when(F.col("p_partkey") % 3 == 0, S.with_setting(F.col("s"), "size", F.col("p_size") + 1)).otherwise(S.with_setting(F.col("s"), "size", None))
    rows = rows.withColumn("s", own)
    return rows.select("p_partkey", "s.size", "s.brand", S.is_set(F.col("s"), "size").alias("size_set"), rules.overrides_set("s", ["size", "brand"]).alias("n"))


@query("swatches", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '#' || lpad((c_custkey % 900 + 100)::VARCHAR, 6, '0') WHEN c_custkey % 3 = 1 THEN '#336699' ELSE '#888888' END AS swatch, c_custkey % 4 <> 0 OR c_custkey % 3 <> 0 AS has_lock FROM customer""")
def swatches(spark, d):
    k = F.col("c_custkey")
    own = F.concat(F.lit("#"), F.lpad((k % 900 + 100).cast("string"), 6, "0"))
    locked = F.when(k % 3 == 0, F.array(own)).otherwise(F.array().cast("array<string>"))
    stroke = F.when(k % 3 == 1, "#336699").otherwise("no colour")
    toggled = library.lock_toggled(locked, F.when(k % 4 == 0, own).otherwise(F.lit("#000000")))
    return table(spark, d, "customer").select("c_custkey", library.swatch_color(locked, stroke, "#888888").alias("swatch"), (F.size(toggled) > 0).alias("has_lock"))


@query("cut_points", """SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list(event_id % 20), list(event_id % 7)))), ',') AS cuts FROM events GROUP BY user_id""")
def cut_points(spark, d):
    k = F.col("event_id")
    both = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(k % 20).alias("a"), F.collect_set(k % 7).alias("b"))
    return both.select("user_id", F.array_join(library.cut_points(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("cuts"))


@query("stacked", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) - 1 AS z FROM customer")
def stacked(spark, d):
    return library.bottom_first(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey").select("c_nationkey", "c_custkey", F.col("z").cast("long").alias("z"))


@query("zipped_rows", """WITH a AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer), b AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier)
SELECT c_nationkey, CAST(place AS INT) AS place, c_custkey, s_suppkey FROM a JOIN b USING (place) WHERE s_nationkey = c_nationkey""")
def zipped_rows(spark, d):
    from pyspark.sql.window import Window

    place = lambda k, by: F.row_number().over(Window.partitionBy(by).orderBy(k)).alias("place")
    a = table(spark, d, "customer").select("c_nationkey", "c_custkey", place("c_custkey", "c_nationkey"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey", place("s_suppkey", "s_nationkey"))
    return library.zipped(a, b, ["c_nationkey"], "place")


@query("sub_path_anchors", "SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS sub, min(o_orderkey) AS anchor FROM orders GROUP BY o_custkey, o_orderpriority")
def sub_path_anchors(spark, d):
    subs = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sort_array(F.collect_list("o_orderkey")).alias("points"))
    paths = subs.groupBy(F.col("o_custkey").alias("path")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderpriority", "points"))), lambda s: s["points"]).alias("subs"))
    return library.sub_path_anchors(paths).select("path", F.col("sub").cast("long").alias("sub"), "anchor")


TREE = "tree AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 0 THEN c_custkey - 1 - c_custkey % 40 % 2 END AS parent, c_acctbal < -500 AS enabled FROM customer)"


def _deep(spark, d):
    """Chains of over a thousand nodes."""
    k = F.col("c_custkey")
    parent = F.when(k > 0, F.greatest(k - 1 - k % 40 % 2, F.lit(-1)))
    return table(spark, d, "customer").where("c_custkey <> 1").select(k.alias("node"), parent.alias("parent"), "c_acctbal")


@query("expression_owners", f"""WITH RECURSIVE {TREE}, own AS (SELECT * FROM tree WHERE node <> 1), k(node) AS (SELECT node FROM own WHERE enabled UNION SELECT t.parent FROM k JOIN own t ON t.node = k.node WHERE t.parent IS NOT NULL) SELECT node FROM k""")
def expression_owners(spark, d):
    rows = _deep(spark, d).select("node", "parent", F.lit("wiggle(1, 2)").alias("expression"), (F.col("c_acctbal") < -500).alias("enabled"))
    return library.expression_owners(rows, [])


@query("pruned_layers", f"""WITH RECURSIVE {TREE}, own AS (SELECT * FROM tree WHERE node <> 1), k(node) AS (SELECT node FROM own WHERE node % 97 = 5 UNION SELECT t.parent FROM k JOIN own t ON t.node = k.node WHERE t.parent IS NOT NULL) SELECT node AS name FROM k WHERE node IN (SELECT node FROM own)""")
def pruned_layers(spark, d):
    rows = _deep(spark, d).select(F.col("node").alias("name"), "parent")
    return layers.pruned(rows, F.col("name") % 97 == 5).select("name")


@query("touched_corners", f"""WITH g AS ({ORDERS_SQL}), c AS (SELECT (s_suppkey * 7 % 150)::INT AS x, (s_suppkey * 3 % 110)::INT AS y FROM supplier)
SELECT DISTINCT c.x, c.y FROM c JOIN g ON g.x BETWEEN c.x - 1 AND c.x AND g.y BETWEEN c.y - 1 AND c.y WHERE g.color = '1-URGENT'""")
def touched_corners(spark, d):
    corners = table(spark, d, "supplier").selectExpr("int(s_suppkey * 7 % 150) as x", "int(s_suppkey * 3 % 110) as y")
    return grid.touched_corners(corners, orders_grid(spark, d).where("color = '1-URGENT'"))


@query("covering", """SELECT DISTINCT a.c_mktsegment AS label FROM customer a JOIN customer b ON b.c_custkey % 50 = a.c_custkey % 50 AND b.c_nationkey = a.c_nationkey AND b.c_mktsegment <> a.c_mktsegment WHERE b.c_acctbal > 9000""")
def covering(spark, d):
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("x"), F.col("c_nationkey").alias("y"), F.col("c_mktsegment").alias("label"), "c_acctbal")
    return library.covering(rows.drop("c_acctbal"), rows.where("c_acctbal > 9000"), ["x", "y"], "label")


@query("representatives", """SELECT p_brand, arg_max(p_partkey, (p_size > 20)::INT * 1000000000 + p_size * 10000000 + p_partkey) AS chief, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand""")
def representatives(spark, d):
    return library.representatives(table(spark, d, "part").withColumn("keep", F.col("p_size") > 20), ["p_brand"], "keep", "p_size", "p_partkey")


@query("merged_boxes", """SELECT p_brand, min(p_partkey % 50) AS x0, min(p_partkey // 50) AS y0, max(p_partkey % 50 + 3) AS x1, max(p_partkey // 50 + 3) AS y1, CAST(sum(p_size) AS BIGINT) AS area, arg_max(p_type, p_size * 10000000 - p_partkey) AS color FROM part GROUP BY p_brand""")
def merged_boxes(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_type").alias("color"), F.col("p_size").alias("area"), (k % 50).alias("x0"), F.floor(k / 50).alias("y0"), (k % 50 + 3).alias("x1"), (F.floor(k / 50) + 3).alias("y1"))
    return library.merged_boxes(rows, ["p_brand"], "color", "area", "p_partkey")


@query("export_gate", """SELECT c_nationkey, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS exported, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_acctbal > 0) AS composited FROM customer GROUP BY c_nationkey""")
def export_gate(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 3 != 0).alias("enabled"), (F.col("c_acctbal") > 0).alias("visible"))
    seen = library.composited(rows).groupBy("c_nationkey").agg(F.count("*").alias("composited"))
    every = rows.select("c_nationkey").distinct()
    out = every.join(library.exported(rows).groupBy("c_nationkey").agg(F.count("*").alias("exported")), "c_nationkey", "left").join(seen, "c_nationkey", "left")
    return out.select("c_nationkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("exported", "composited")))


@query("session_gate", """WITH e AS (SELECT user_id AS doc, event_id AS seq, event_id // 700 AS generation, event_type = 'click' AS live FROM events),
n AS (SELECT *, last_value(CASE WHEN live THEN generation END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq) AS now FROM e) SELECT doc, seq, generation, generation IS NOT DISTINCT FROM now AS accepted FROM n WHERE NOT live""")
def session_gate(spark, d):
    from gridloom.streaming import gate

    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "live").otherwise("part")
    return gate.gated_by_session(table(spark, d, "events").select(F.col("user_id").alias("doc"), e.alias("seq"), F.floor(e / 700).alias("generation"), kind.alias("kind")))


@query("bumped_generations", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS generation FROM events")
def bumped_generations(spark, d):
    return changes.bumped(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("relaunch_order", """SELECT c_custkey AS doc, CASE WHEN c_custkey % 5 = 0 THEN 'strip' WHEN c_custkey % 3 = 0 THEN 'full' WHEN c_acctbal < 0 THEN 'queued' END AS job FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR c_acctbal < 0""")
def relaunch_order(spark, d):
    from gridloom.streaming import gate

    k = F.col("c_custkey")
    return gate.relaunch_order(table(spark, d, "customer").select(k.alias("doc"), (k % 5 == 0).alias("strip_dirty"), (k % 3 == 0).alias("full_dirty"), (F.col("c_acctbal") < 0).alias("full_queued")))


@query("latest_stages", """SELECT user_id AS doc, event_type AS stage, max(event_id // 500) AS generation, arg_max(value, event_id) AS payload FROM events GROUP BY ALL""")
def latest_stages(spark, d):
    from gridloom.streaming import gate

    e = F.col("event_id")
    return gate.latest_stage(table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("stage"), F.floor(e / 500).alias("generation"), e.alias("seq"), F.col("value").alias("payload")))


@query("fate_tints", f"""WITH g AS ({ORDERS_SQL}) SELECT x, y, CASE WHEN color = '1-URGENT' THEN '#ffaa00' ELSE '#ff0044' END AS tint FROM g WHERE color IN ('1-URGENT', '2-HIGH')""")
def fate_tints(spark, d):
    cells = orders_grid(spark, d).withColumnRenamed("color", "region")
    fate = F.when(F.col("region") == "1-URGENT", "merged").when(F.col("region") == "2-HIGH", "culled").otherwise("traced")
    return library.fate_tints(cells.select("region").distinct().withColumn("fate", fate), cells)


@query("outline_layers", """WITH n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 1 THEN 'Part ' || (s_suppkey - 1) || ' Outlines' ELSE 'Part ' || s_suppkey END AS name, 'Part ' || (s_suppkey // 4 * 4 + (s_suppkey // 4) % 3) AS parent FROM supplier)
SELECT k, name, CASE WHEN parent || ' Outlines' IN (SELECT name FROM n) THEN parent || ' Outlines' ELSE parent END AS parent FROM n""")
def outline_layers(spark, d):
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 1, F.concat(F.lit("Part "), k - 1, F.lit(" Outlines"))).otherwise(F.concat(F.lit("Part "), k))
    base = F.floor(k / 4)
    return layers.outline_parents(table(spark, d, "supplier").select(k.alias("k"), name.alias("name"), F.concat(F.lit("Part "), base * 4 + base % 3).alias("parent")))


@query("matte_layers", """SELECT comp, n_name AS name, n_name || ' Fill' AS matte, true AS inverted, scale FROM nation CROSS JOIN (VALUES ('main', 100.0::DOUBLE), ('fill', 102.0), ('border', 104.0)) AS c(comp, scale)""")
def matte_layers(spark, d):
    return layers.mattes(table(spark, d, "nation").select(F.col("n_name").alias("name")), {"main": 100.0, "fill": 102.0, "border": 104.0})


@query("copied_keys", """WITH k AS (SELECT DISTINCT event_type AS series, user_id, event_id // 100 AS t, 'linear' AS easing FROM events)
SELECT s.user_id, 'copy' AS series, s.t, s.easing FROM k s WHERE s.series = 'click'""")
def copied_keys(spark, d):
    keys = table(spark, d, "events").select("user_id", F.col("event_type").alias("series"), F.floor(F.col("event_id") / 100).alias("t"), F.lit("linear").alias("easing")).distinct()
    targets = keys.select("user_id").distinct().select("user_id", F.lit("copy").alias("series"), F.lit("click").alias("source"))
    return keyframes.copied(keys, targets, ["user_id"], "series", "t").select("user_id", "series", "t", "easing")


@query("overriding_fields", """SELECT s_suppkey, count(*) FILTER (WHERE p_size > 45) AS overridden FROM supplier LEFT JOIN part ON p_partkey % 100 = s_suppkey GROUP BY s_suppkey""")
def overriding_fields(spark, d):
    part = table(spark, d, "part").select((F.col("p_partkey") % 100).alias("s_suppkey"), F.struct(F.when(F.col("p_size") > 45, F.col("p_size")).alias("size")).alias("own"))
    counted = part.groupBy("s_suppkey").agg(F.sum(rules.overrides_set("own", ["size"])).alias("n"))
    return table(spark, d, "supplier").select("s_suppkey").join(counted, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("overridden"))


@query("stale_assignments", "SELECT c_name AS name, p_key AS key FROM (SELECT c_name, 'Brand#' || (c_custkey % 60) AS p_key FROM customer) WHERE p_key NOT IN (SELECT p_brand FROM part)")
def stale_assignments(spark, d):
    given = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit("Brand#"), F.col("c_custkey") % 60).alias("key"))
    return rules.stale_assignments(given, table(spark, d, "part").select(F.col("p_brand").alias("key"))).select("name", "key")


@query("free_keys", """WITH t AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'Key ' || s_suppkey % 7 ELSE 'Key ' || s_suppkey % 7 || ' ' || (s_suppkey % 5 + 2) END AS key FROM supplier), w AS (SELECT 'Key ' || i AS key FROM range(9) AS r(i))
SELECT key, CASE WHEN key NOT IN (SELECT key FROM t) THEN key ELSE key || ' ' || (SELECT min(n) FROM range(2, 20) AS r(n) WHERE w.key || ' ' || n NOT IN (SELECT key FROM t)) END AS free FROM w""")
def free_keys(spark, d):
    k = F.col("s_suppkey")
    stem = F.concat(F.lit("Key "), k % 7)
    taken = table(spark, d, "supplier").select(F.when(k % 3 == 0, stem).otherwise(F.concat(stem, F.lit(" "), k % 5 + 2)).alias("key"))
    return rules.unique_key(spark.range(9).select(F.concat(F.lit("Key "), "id").alias("key")), taken)


@query("unit_steps", """WITH p AS (SELECT s_suppkey % 5 AS ring, s_suppkey AS k, s_suppkey * 3 % 11 AS x, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 % 11 ELSE s_suppkey END AS d FROM supplier),
v AS (SELECT n.n_nationkey AS ring, c.k, c.x, c.y FROM nation n, (VALUES (0, 0, 0), (1, 5, 0), (2, 5, 3), (3, 2, 3), (4, 2, 6), (5, 0, 6)) AS c(k, x, y)),
l AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v WINDOW w AS (PARTITION BY ring ORDER BY k))
SELECT ring, k, CAST(step AS INT) AS step, x + sign(nx - x) * step AS x, y + sign(ny - y) * step AS y FROM (SELECT *, unnest(range(0, greatest(abs(nx - x), abs(ny - y)))) AS step FROM l)""")
def unit_steps(spark, d):
    corners = spark.createDataFrame([(0, 0, 0), (1, 5, 0), (2, 5, 3), (3, 2, 3), (4, 2, 6), (5, 0, 6)], "k int, x int, y int")
    rings = table(spark, d, "nation").select(F.col("n_nationkey").alias("ring")).join(F.broadcast(corners), F.lit(True))  # six rows
    return seams.densify(rings, "ring").select("ring", "k", "step", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


@query("canonical_runs", """WITH l AS (SELECT user_id, list(event_type ORDER BY event_id) AS c FROM events GROUP BY user_id) SELECT user_id, array_to_string(least(c, list_reverse(c)), ',') AS run FROM l""")
def canonical_runs(spark, d):
    chains = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("c"))
    return chains.select("user_id", F.array_join(seams.canonical_open(F.col("c")), ",").alias("run"))


@query("direction_changes", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id % 4 AS x, event_id % 3 AS y FROM events),
s AS (SELECT *, x - lag(x) OVER w AS ix, y - lag(y) OVER w AS iy, lead(x) OVER w - x AS ox, lead(y) OVER w - y AS oy FROM e WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, CAST(k AS INT) AS k FROM s WHERE NOT coalesce(ix * oy = iy * ox AND ix * ox + iy * oy > 0, false)""")
def direction_changes(spark, d):
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select("user_id", k.alias("k"), (F.col("event_id") % 4).alias("x"), (F.col("event_id") % 3).alias("y"))
    return seams.direction_changes(rows, "user_id").select("user_id", "k")


@query("candidate_order", """SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INT) AS place FROM part WHERE p_size >= 3""")
def candidate_order(spark, d):
    from pyspark.sql.window import Window

    kept = table(spark, d, "part").where(F.col("p_size") >= palette.LEAST_AREA)
    return kept.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")).alias("place"))


@query("palette_fallback", f"""WITH g AS ({ORDERS_SQL}), t AS (SELECT x, y, substr(color, 1, 1)::INT AS v FROM g), s AS (SELECT x, y, substr(color, 1, 1)::INT AS idx FROM g WHERE color = '1-URGENT'),
n AS (SELECT t.x, t.y, t.v, arg_min(s.idx, abs(t.v - s.idx) * 100 + (s.y - t.y + 1) * 3 + s.x - t.x + 1) AS near FROM t LEFT JOIN s ON s.x BETWEEN t.x - 1 AND t.x + 1 AND s.y BETWEEN t.y - 1 AND t.y + 1 GROUP BY t.x, t.y, t.v)
SELECT x, y, CAST(coalesce(near, (SELECT arg_min(i, abs(v - i) * 100 + i) FROM (VALUES (2), (4)) AS p(i))) AS INT) AS idx FROM n""")
def palette_fallback(spark, d):
    value = F.substring("color", 1, 1).cast("int")
    cells = orders_grid(spark, d)
    offered = spark.createDataFrame([(2,), (4,)], "idx int")
    found = assign.constrained_nearest(cells.select("x", "y", value.alias("v")), cells.where("color = '1-URGENT'").select("x", "y", value.alias("idx")), 1, F.abs(F.col("v") - F.col("idx")), (), offered)
    return found.select("x", "y", "idx")


@query("repeated_content", """WITH h AS (SELECT l_returnflag, md5('=' || l_linestatus || chr(31) || '=' || l_linenumber || chr(31)) AS m FROM lineitem)
SELECT l_returnflag, count(*) AS n, CAST(sum(('0x' || substr(m, 1, 15))::BIGINT) % 1152921504606846976 AS BIGINT) AS content, CAST(sum(('0x' || substr(m, 17, 15))::BIGINT) % 1152921504606846976 AS BIGINT) AS content2 FROM h GROUP BY l_returnflag""")
def repeated_content(spark, d):
    return changes.fingerprint(table(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus", "l_linenumber"])
