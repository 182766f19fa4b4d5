"""Rule, layer, keyframe and change-log queries over the supplied tables, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import changes, keyframes, layers, rules
from gridloom.plans.tables import table

QUERIES, ORACLES = {}, {}


def seconds(column: str):
    """Whole seconds since 1970 of a time without zone, whatever the session's zone."""
    c = F.col(column)
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


RULES = [(0, "*10", 5), (0, "part#1*", 3), (0, "*", 1), (1, "*5*", 8), (1, "part#2*", 9), (0, "*_%", 7), (1, "part#*7", 4), (0, "", 2), (0, "* ring", 3), (1, "small *", 9), (1, "red widget", 6), (0, "r*t", 11)]
RULES_SQL = f"rules(tier, key, detail) AS (VALUES {', '.join(f'({t}, {chr(39)}{k}{chr(39)}, {d})' for t, k, d in RULES)})"
MATCH_SQL = r"length(key) > 0 AND p_name LIKE replace(replace(replace(replace(key, '\', '\\'), '%', '\%'), '_', '\_'), '*', '%') ESCAPE '\'"


@query("rule_resolution", f"""WITH {RULES_SQL}, m AS (SELECT p_name, tier, key, length(replace(key, '*', '')) AS lits, CAST(starts_with(key, '*') AS INT) AS suffix, length(key) AS size
FROM (SELECT DISTINCT p_name FROM part) JOIN rules ON {MATCH_SQL}),
best AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY lits DESC, suffix DESC, size DESC, tier, key DESC) AS n FROM m)
SELECT p.p_name AS name, CAST(b.tier AS INT) AS tier, b.key, CAST(coalesce(r.detail, 10) AS INT) AS detail
FROM (SELECT DISTINCT p_name FROM part) p LEFT JOIN best b ON b.p_name = p.p_name AND n = 1 LEFT JOIN rules r ON r.tier = b.tier AND r.key = b.key""")
def rule_resolution(spark, d):
    book = spark.createDataFrame(RULES, "tier int, key string, detail int")
    found = rules.best_rule(table(spark, d, "part").select(F.col("p_name").alias("name")), book)
    settings = book.select("tier", "key", F.struct("detail").alias("own"))
    return found.join(F.broadcast(settings), ["tier", "key"], "left").select("name", "tier", "key", *rules.layered({"detail": 10}, "own", fields=["detail"]))


@query("rule_assignment", f"""WITH {RULES_SQL}, m AS (SELECT c_name, tier, key, length(replace(key, '*', '')) AS lits, CAST(starts_with(key, '*') AS INT) AS suffix, length(key) AS size FROM customer JOIN rules ON {MATCH_SQL.replace("p_name", "c_name")}),
best AS (SELECT *, row_number() OVER (PARTITION BY c_name ORDER BY lits DESC, suffix DESC, size DESC, tier, key DESC) AS n FROM m),
given AS (SELECT c_name, CASE WHEN c_custkey % 4 = 0 THEN '*10' ELSE '*5*' END AS key, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS tier FROM customer WHERE c_custkey % 2 = 0)
SELECT c.c_name AS name, CAST(coalesce(g.tier, b.tier) AS INT) AS tier, coalesce(g.key, b.key) AS key, g.key IS NOT NULL AS assigned FROM customer c LEFT JOIN best b ON b.c_name = c.c_name AND n = 1 LEFT JOIN given g ON g.c_name = c.c_name""")
def rule_assignment(spark, d):
    book = spark.createDataFrame(RULES, "tier int, key string, detail int")
    people = table(spark, d, "customer")
    given = people.where("c_custkey % 2 = 0").select(F.expr("int(c_custkey % 4 = 0)").alias("tier"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 == 0, "*10").otherwise("*5*").alias("key"))
    return rules.assigned(people.select(F.col("c_name").alias("name")), book, given)


@query("settings_deviation", """SELECT a.p_partkey, CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN b.p_size END AS size, CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN b.p_brand END AS brand,
CAST(a.p_size IS DISTINCT FROM b.p_size AS INT) + CAST(a.p_brand IS DISTINCT FROM b.p_brand AS INT) AS n
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def settings_deviation(spark, d):
    part = table(spark, d, "part")
    a = part.select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("base"))
    b = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("found"))
    dev = a.join(b, "p_partkey").withColumn("dev", rules.deviations("base", "found", ["size", "brand"]))
    return dev.select("p_partkey", "dev.size", "dev.brand", rules.overrides_set("dev", ["size", "brand"]).alias("n"))


KEYS = "SELECT user_id, ts, event_id, event_type FROM events"


@query("keyframe_dedup", """WITH l AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, n > 1 AND before IS NOT DISTINCT FROM event_type AS same FROM l),
h AS (SELECT *, coalesce(lead(same) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS hold FROM s)
SELECT user_id, event_id, event_type, hold FROM h WHERE NOT same""")
def keyframe_dedup(spark, d):
    return keyframes.drop_repeats(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query("keyframe_trim", """WITH k AS (SELECT user_id, event_id, value, epoch_us(ts) // 3600000000 AS t FROM events),
m AS (SELECT *, max(CASE WHEN t < 473400 THEN t * 10000000 + event_id END) OVER (PARTITION BY user_id) AS b, min(CASE WHEN t >= 473900 THEN t * 10000000 + event_id END) OVER (PARTITION BY user_id) AS a, count(*) OVER (PARTITION BY user_id) AS n FROM k)
SELECT user_id, event_id, t, value FROM m WHERE n > 1 AND (t >= 473400 AND t < 473900 OR t * 10000000 + event_id = b OR t * 10000000 + event_id = a)""")
def keyframe_trim(spark, d):
    keys = table(spark, d, "events").select("user_id", "event_id", F.floor(seconds("ts") / 3600).alias("t"), "value")
    return keyframes.trim(keys, ["user_id"], "t", F.lit(473400), F.lit(473900), "event_id")


@query("missing_keys", """WITH e AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS t FROM events), w AS (SELECT user_id, unnest(range(min(t), max(t) + 1)) AS t FROM e GROUP BY user_id)
SELECT user_id, t FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.t = w.t)""")
def missing_keys(spark, d):
    days = table(spark, d, "events").select("user_id", F.floor(seconds("ts") / 86400).alias("t"))
    wanted = days.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("user_id", F.explode(F.sequence("a", "b")).alias("t"))
    return keyframes.missing_keys(wanted, days, ["user_id"], "t")


@query("start_offsets", """SELECT user_id, event_id, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS value FROM events""")
def start_offsets(spark, d):
    keys = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("t"), "value")
    return keyframes.relative_to_start(keys, ["user_id"], "t", "value").select("user_id", "event_id", F.round("value", 6).alias("value"))


@query("adaptive_sampling")
def adaptive_sampling(spark, d):
    curve = table(spark, d, "events").select(F.col("user_id").alias("series"), (F.col("event_id")).cast("double").alias("t"), F.col("value").alias("v"))
    return keyframes.sample_needed(curve, ["series"], 1.0, 25.0)


@query("change_diff", """WITH b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0)
SELECT o_orderkey, b.o_orderstatus AS old, a.o_orderstatus AS new FROM b FULL JOIN a USING (o_orderkey) WHERE b.o_orderstatus IS DISTINCT FROM a.o_orderstatus""")
def change_diff(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    after = orders.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return changes.difference(orders.where("o_orderkey % 11 <> 0"), after, ["o_orderkey"], "o_orderstatus")


LOG_SQL = "log AS (SELECT user_id, event_id AS seq, event_type AS kind, event_id % 9 = 0 AS seal, CAST(event_id AS VARCHAR) AS old, CAST(event_id + 1 AS VARCHAR) AS new FROM events)"
GESTURE_SQL = f"""WITH {LOG_SQL}, s AS (SELECT *, count(*) FILTER (WHERE seal) OVER (PARTITION BY user_id ORDER BY seq) AS seals FROM log),
f AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND lag(seals) OVER w = seals AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM s WHERE NOT seal WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY seq) AS gesture FROM f)
SELECT user_id, CAST(gesture AS BIGINT) AS gesture, kind, count(*) AS n, arg_min(old, seq) AS old, arg_max(new, seq) AS new FROM g GROUP BY ALL"""


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("old"), (F.col("event_id") + 1).cast("string").alias("new"))


@query("gesture_coalesce", GESTURE_SQL)
def gesture_coalesce(spark, d):
    return changes.coalesce_gestures(_log(spark, d), ["user_id"], ["seq"], "kind", F.col("seq") % 9 == 0)


@query("undo_cap", f"WITH {LOG_SQL} SELECT user_id, seq, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS n FROM log) WHERE n <= 10")
def undo_cap(spark, d):
    return changes.newest(_log(spark, d), ["user_id"], ["seq"], 10).select("user_id", "seq", "kind")


@query("undo_replay", f"WITH {LOG_SQL} SELECT user_id, kind, coalesce(arg_max(new, seq) FILTER (WHERE seq < 5000), arg_min(old, seq)) AS value FROM log GROUP BY ALL")
def undo_replay(spark, d):
    return changes.replay(_log(spark, d), ["user_id"], "kind", ["seq"], F.col("seq") < 5000)


@query("generation_gate", """SELECT user_id, event_id, generation FROM (SELECT user_id, event_id, event_id % 5 AS generation, max(event_id % 5) OVER (PARTITION BY user_id) AS g FROM events) WHERE generation = g""")
def generation_gate(spark, d):
    parts = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 5).alias("generation"))
    return changes.current_generation(parts, ["user_id"], "generation")


@query("open_documents", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def open_documents(spark, d):
    opened = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return changes.open_only(table(spark, d, "orders").select("o_orderkey", "o_custkey"), opened, "o_custkey")


@query("fingerprint", """WITH h AS (SELECT l_returnflag, l_linestatus, md5(concat('=', l_orderkey, chr(31), '=', l_linenumber, chr(31), '=', l_partkey, chr(31), '=', l_quantity, chr(31))) AS m FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(('0x' || substr(m, 1, 15))::BIGINT) % 1152921504606846976 AS BIGINT) AS content,
CAST(sum(('0x' || substr(m, 17, 15))::BIGINT) % 1152921504606846976 AS BIGINT) AS content2 FROM h GROUP BY ALL""")
def fingerprint(spark, d):
    return changes.fingerprint(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


@query("digest_compare", """WITH a AS (SELECT o_orderkey, o_orderstatus AS quant, o_orderpriority AS fit FROM orders WHERE o_orderkey % 13 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'Z' ELSE o_orderstatus END AS quant, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderpriority END AS fit FROM orders WHERE o_orderkey % 17 <> 0)
SELECT * FROM (SELECT o_orderkey, CASE WHEN a.quant IS NULL THEN 'missing' WHEN b.quant IS NULL THEN 'extra' WHEN a.quant <> b.quant THEN 'quant' WHEN a.fit <> b.fit THEN 'fit' END AS status FROM a FULL JOIN b USING (o_orderkey)) WHERE status IS NOT NULL""")
def digest_compare(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("quant"), F.col("o_orderpriority").alias("fit"))
    base = orders.where("o_orderkey % 17 <> 0").withColumns({"quant": F.when(F.col("o_orderkey") % 6 == 0, "Z").otherwise(F.col("quant")), "fit": F.when(F.col("o_orderkey") % 4 == 0, "Z").otherwise(F.col("fit"))})
    return changes.first_divergence(orders.where("o_orderkey % 13 <> 0"), base, ["o_orderkey"], ["quant", "fit"])


@query("recents", """WITH r AS (SELECT c.c_name AS path, max(epoch_us(o.o_orderdate) // 1000000) AS opened, bool_or(c.c_custkey % 10 = 0) AS pinned FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_name)
SELECT path, opened, pinned FROM r ORDER BY pinned DESC, opened DESC, path LIMIT 40""")
def recents(spark, d):
    people = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("path"))
    seen = people.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    seen = seen.select("path", seconds("o_orderdate").alias("opened"), (F.col("c_custkey") % 10 == 0).alias("pinned"), F.lit(False).alias("folder"))
    return changes.touch(seen, seen.limit(0)).drop("folder")


@query("recents_ago", """WITH a AS (SELECT event_id, (event_id * 977) % 3000000 AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 172800 THEN 'yesterday' WHEN s < 604800 THEN (s // 86400) || 'd ago' ELSE (s // 604800) || 'w ago' END AS ago FROM a""")
def recents_ago(spark, d):
    return table(spark, d, "events").select("event_id", S.ago((F.col("event_id") * 977) % 3000000).alias("ago"))


@query("timing_report", """SELECT event_type, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, count(*) AS n, round(100 * sum(CAST(floor(value) AS BIGINT)) / sum(sum(CAST(floor(value) AS BIGINT))) OVER (), 6) AS share FROM events GROUP BY event_type""")
def timing_report(spark, d):
    return changes.stage_report(table(spark, d, "events").withColumn("us", F.floor("value")), "event_type", "us")


@query("best_of_runs", "SELECT event_type, CAST(min(total) AS BIGINT) AS best FROM (SELECT event_type, event_id % 5 AS run, sum(CAST(floor(value) AS BIGINT)) AS total FROM events GROUP BY ALL) WHERE run > 0 GROUP BY event_type")
def best_of_runs(spark, d):
    timed = table(spark, d, "events").select("event_type", (F.col("event_id") % 5).alias("run"), F.floor("value").alias("us"))
    return changes.best_of(timed, ["event_type"], "run", "us")


@query("cache_misses", "SELECT p_partkey, p_brand FROM part WHERE (p_brand, p_size) NOT IN (SELECT p_brand, p_size FROM part WHERE p_partkey % 3 = 0)")
def cache_misses(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return changes.misses(part, part.where("p_partkey % 3 = 0"), ["p_brand", "p_size"]).select("p_partkey", "p_brand")


NAMES_SQL = "names AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'Body ' || s_suppkey WHEN 1 THEN 'Body ' || (s_suppkey - 1) || ' Fill' WHEN 2 THEN 'Body ' || (s_suppkey - 2) || ' DF Fill' WHEN 3 THEN 'Left Arm ' || s_suppkey ELSE 'B < Bone ' || s_suppkey || ' Image' END AS name FROM supplier)"


def _names(spark, d):
    k = F.col("k")
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("Body "), k)).when(k % 5 == 1, F.concat(F.lit("Body "), k - 1, F.lit(" Fill"))).when(k % 5 == 2, F.concat(F.lit("Body "), k - 2, F.lit(" DF Fill")))
        .when(k % 5 == 3, F.concat(F.lit("Left Arm "), k)).otherwise(F.concat(F.lit("B < Bone "), k, F.lit(" Image")))
    )
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).withColumn("name", name)


@query("layer_names", f"""WITH {NAMES_SQL} SELECT k, name, CASE WHEN ends_with(name, ' Image') AND length(name) > 6 THEN left(name, length(name) - 6) ELSE name END AS plain,
contains(name, 'Fill') OR contains(name, 'Depth Fix') OR contains(name, 'DF') OR contains(name, 'Border') OR contains(name, 'Balls') AS shy, contains(name, 'B < ') AS rig,
string_split(trim(name), ' ')[1] || ' *' AS glob, regexp_replace(name, '[^A-Za-z0-9]', '_', 'g') AS slug FROM names""")
def layer_names(spark, d):
    n = F.col("name")
    return _names(spark, d).select("k", "name", layers.renamed(n).alias("plain"), layers.contains_any(n, layers.SHY).alias("shy"), layers.is_rig(n).alias("rig"), S.first_word_glob(n).alias("glob"), S.slug(n).alias("slug"))


@query("fill_layers", f"""WITH {NAMES_SQL}, f AS (SELECT k, name, string_split(name, ' Fill')[1] AS base, CASE WHEN contains(name, 'DF Fill') THEN string_split(name, 'DF Fill')[1] || 'Fill' END AS target FROM names WHERE contains(name, ' Fill'))
SELECT k, name, target, base IN (SELECT name FROM names) AS has_base, target IN (SELECT name FROM names) AS has_target FROM f""")
def fill_layers(spark, d):
    names = _names(spark, d)
    there = names.select("name").distinct()
    f = names.withColumn("base", layers.fill_target(F.col("name"))).withColumn("target", layers.depth_fix_target(F.col("name"))).where("base is not null")
    f = f.join(there.withColumnRenamed("name", "b"), F.col("base") == F.col("b"), "left").join(there.withColumnRenamed("name", "t"), F.col("target") == F.col("t"), "left")
    return f.select("k", "name", "target", F.col("b").isNotNull().alias("has_base"), F.when(F.col("target").isNotNull(), F.col("t").isNotNull()).alias("has_target"))


@query("parent_rules", f"""WITH {NAMES_SQL} SELECT name, CASE WHEN contains(name, 'Bone') THEN (SELECT min(name) FROM names WHERE name = 'Left Arm 3') WHEN contains(name, 'Arm') THEN 'Body 0' WHEN contains(name, 'Fill') THEN 'Body 5' END AS parent FROM names GROUP BY name""")
def parent_rules(spark, d):
    book = [(1, "Fill", ["Body 3", "Body 5"]), (2, "Arm", ["Torso", "Body 0", "Body 5"]), (3, "Bone", ["Left Arm 3", "Body 0"])]
    return layers.parent_by_rules(_names(spark, d), spark.createDataFrame(book, "ordinal int, part string, candidates array<string>"))


TREE_SQL = "tree AS (SELECT c_custkey AS name, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 2 END AS parent FROM customer)"


def _tree(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("name"), F.when(k > 0, F.floor((k - 1) / 2)).alias("parent"))


@query("tree_ancestors", f"WITH RECURSIVE {TREE_SQL}, a(node, ancestor, steps) AS (SELECT name, parent, 1 FROM tree WHERE parent IS NOT NULL UNION ALL SELECT a.node, t.parent, steps + 1 FROM a JOIN tree t ON t.name = a.ancestor WHERE t.parent IS NOT NULL) SELECT node, ancestor, CAST(steps AS BIGINT) AS steps FROM a")
def tree_ancestors(spark, d):
    return layers.tree_ancestors(_tree(spark, d))


@query("reparented", f"""WITH RECURSIVE {TREE_SQL}, a(node, ancestor, steps) AS (SELECT name, parent, 1 FROM tree WHERE parent IS NOT NULL UNION ALL SELECT a.node, t.parent, steps + 1 FROM a JOIN tree t ON t.name = a.ancestor WHERE t.parent IS NOT NULL)
SELECT t.name, (SELECT arg_min(ancestor, steps) FROM a WHERE a.node = t.name AND a.ancestor % 3 <> 0) AS parent FROM tree t""")
def reparented(spark, d):
    return layers.skip_parents(_tree(spark, d), F.col("name") % 3 == 0)


@query("border_closure", f"""WITH RECURSIVE {TREE_SQL}, k(name) AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT t.parent FROM k JOIN tree t ON t.name = k.name WHERE t.parent IS NOT NULL) SELECT name, parent FROM tree WHERE name IN (SELECT name FROM k)""")
def border_closure(spark, d):
    return layers.with_ancestors(_tree(spark, d), table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("name")))


@query("settings_math", """SELECT p_partkey, pow(p_size * 4.0 * 512 / 1026, 2) AS area, CAST(greatest(4, floor(0.5 * pow(p_size * 4.0 * 512 / 1026, 2))) AS INT) AS speck, round(radians(p_size * 90.0 / 50), 9) AS corner FROM part""")
def settings_math(spark, d):
    size = F.col("p_size").cast("double")
    area = S.detail_area(size, F.lit(4.0), F.lit(1026))
    return table(spark, d, "part").select("p_partkey", F.round(area, 6).alias("area"), S.least_speck(size, F.lit(4.0), F.lit(1026)).alias("speck"), F.round(S.corner_threshold(size / 50), 9).alias("corner"))


ORACLES["settings_math"] = ORACLES["settings_math"].replace("pow(p_size * 4.0 * 512 / 1026, 2) AS area", "round(pow(p_size * 4.0 * 512 / 1026, 2), 6) AS area")
