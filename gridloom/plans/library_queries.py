"""Queries over lists, selections, boxes and fates, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import grid, library
from gridloom.plans.tables import ORDERS_W, orders_grid, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


@query("library_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def library_search(spark, d):
    return library.search(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "  RING ")


@query("filtered_recents", "SELECT c_custkey, c_name AS path FROM customer WHERE c_custkey % 2 = 1 AND contains(lower(c_name), '00')")
def filtered_recents(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("path"), (F.col("c_custkey") % 2 == 1).alias("folder"))
    return library.filtered_recents(rows, True, "00").drop("folder")


@query("path_names", "SELECT n_nationkey, CASE WHEN r_name = 'ASIA' THEN n_name ELSE r_name || ' ' || n_name END AS name FROM nation JOIN region ON r_regionkey = n_regionkey")
def path_names(spark, d):
    both = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    parent = F.when(F.col("r_name") == "ASIA", "Root").otherwise(F.col("r_name"))
    return both.select("n_nationkey", library.full_path_name(parent, F.col("n_name")).alias("name"))


@query("layer_tallies", """SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 0 AND c_custkey % 3 <> 0) AS active, count(*) FILTER (WHERE c_custkey % 3 = 0) AS excluded, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS mattes,
count(*) FILTER (WHERE c_mktsegment = 'BUILDING') >= 15 AS too_many_mattes FROM customer GROUP BY c_nationkey""")
def layer_tallies(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", (F.col("c_acctbal") > 0).alias("visible"), (F.col("c_custkey") % 3 != 0).alias("enabled"), (F.col("c_mktsegment") == "BUILDING").alias("matte"))
    return library.layer_counts(rows, ["c_nationkey"])


@query("selection_range", """WITH l AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS z FROM customer),
e AS (SELECT *, max(CASE WHEN z = 3 THEN z END) OVER (PARTITION BY c_nationkey) AS a, max(CASE WHEN z = 9 THEN z END) OVER (PARTITION BY c_nationkey) AS b FROM l)
SELECT c_nationkey, c_custkey FROM e WHERE z BETWEEN least(a, b) AND greatest(a, b) AND a IS NOT NULL AND b IS NOT NULL""")
def selection_range(spark, d):
    from pyspark.sql.window import Window

    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("z"))
    ends = rows.where("z in (3, 9)").groupBy("c_nationkey").agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"), F.count("*").alias("n")).where("n = 2")
    marked = rows.join(ends, "c_nationkey")
    return library.between_ids(marked, F.col("hi"), F.col("lo"), ["c_nationkey"], "z", "c_custkey").select("c_nationkey", "c_custkey")


@query("view_cull", """WITH b AS (SELECT o_custkey AS doc, o_orderstatus AS grp, min(o_orderkey % 997) AS x0, max(o_orderkey % 997 + 5) AS x1, min(o_orderkey % 499) AS y0, max(o_orderkey % 499 + 5) AS y1, 8 AS stroke FROM orders GROUP BY ALL)
SELECT doc, grp AS "group", x0, y0, x1, y1, stroke FROM b WHERE x0 - 4 <= 300 AND x1 + 4 >= 100 AND y0 - 4 <= 200 AND y1 + 4 >= 50""")
def view_cull(spark, d):
    k = F.col("o_orderkey")
    boxes = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("group"), (k % 997).alias("x0"), (k % 997 + 5).alias("x1"), (k % 499).alias("y0"), (k % 499 + 5).alias("y1"), F.lit(8).alias("stroke"))
    return library.culled(boxes, (100, 50, 300, 200))


@query("toggled_selection", """SELECT user_id, CASE WHEN list_contains(s, 'click') THEN CASE WHEN len(s) = 1 THEN s[1] ELSE array_to_string(list_filter(s, lambda x: x <> 'click'), ',') END ELSE array_to_string(list_append(s, 'click'), ',') END AS selection
FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events GROUP BY user_id)""")
def toggled_selection(spark, d):
    chosen = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("s"))
    return chosen.select("user_id", F.array_join(library.toggled(F.col("s"), F.lit("click")), ",").alias("selection"))


@query("fate_report", """WITH r AS (SELECT p_partkey AS region, p_size AS area, p_partkey % 50 = 0 AS pinned, CASE WHEN p_size < 10 THEN p_partkey - p_partkey % 10 ELSE p_partkey END AS root FROM part),
s AS (SELECT root, sum(area) AS settled, bool_or(pinned) AS held FROM r GROUP BY root)
SELECT region, CASE WHEN region <> root THEN 'merged' WHEN settled >= 20 OR held THEN 'traced' ELSE 'culled' END AS fate, CASE WHEN region <> root THEN root END AS into, CAST(settled AS BIGINT) AS settled FROM r JOIN s USING (root)""")
def fate_report(spark, d):
    part = table(spark, d, "part")
    regions = part.select(F.col("p_partkey").alias("region"), F.col("p_size").alias("area"), (F.col("p_partkey") % 50 == 0).alias("pinned"))
    merges = part.where("p_size < 10").select(F.col("p_partkey").alias("region"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("root"))
    return library.fate_report(regions, merges, 20)


@query("missing_layers", "SELECT DISTINCT o_custkey AS source, o_orderpriority AS layer FROM orders WHERE (o_custkey, o_orderpriority) NOT IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F')")
def missing_layers(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("layer"), "o_orderstatus")
    return library.selected_entries(orders.drop("o_orderstatus"), orders.where("o_orderstatus = 'F'").drop("o_orderstatus"))[1]


@query("open_borders", f"""WITH g AS (SELECT CAST(o_orderkey % {ORDERS_W} AS INT) AS x, CAST(o_orderkey // {ORDERS_W} AS INT) AS y, o_orderpriority AS color FROM orders)
SELECT a.color, count(*) FILTER (WHERE b.x IS NULL) AS open_len FROM g a CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS s(dx, dy) LEFT JOIN g b ON b.x = a.x + dx AND b.y = a.y + dy GROUP BY a.color""")
def open_borders(spark, d):
    return grid.perimeters(orders_grid(spark, d)).select("color", "open_len")
