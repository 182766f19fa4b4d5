"""Small hand-built scenes with known results."""

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.functions import geometry as G
from gridloom.functions import scalars as S
from gridloom.operators import changes, curves, grid, keyframes, layers, merging, palette, rules, seams
from gridloom.operators.components import ancestors, components
from gridloom.sources import images, rulebook, sinks
from gridloom.streaming import gate


def cells(spark, rows):
    return spark.createDataFrame([(x, y, v, v, v) for y, row in enumerate(rows) for x, v in enumerate(row) if v is not None], "x int, y int, r int, g int, b int")


def table(df):
    return [tuple(r) for r in df.collect()]


def test_dithered_border_merges_to_line_and_fill(spark):
    rows = [[16 if x // 4 % 2 == 0 else 24 for x in range(12)]] + [[128] * 12] * 3
    nodes, edges = merging.region_graph(cells(spark, rows), 12)
    assert nodes.count() == 4
    for out in (merging.merged(nodes, edges, "speckles", floor=10), merging.merged(nodes, edges, "strokes", width=3.0, distance=0.1)):
        got = {(r.root, r.area) for r in out.collect()}
        assert sorted(a for _, a in got) == [12, 36]
    nodes, edges = merging.region_graph(cells(spark, rows), 12, spark.createDataFrame([(5, 0)], "x int, y int"))
    assert 4 in {r.area for r in merging.merged(nodes, edges, "speckles", floor=10).collect()}


def test_wide_bands_stay(spark):
    nodes, edges = merging.region_graph(cells(spark, [[100] * 4 + [108] * 4] * 8), 8)
    assert len({r.root for r in merging.merged(nodes, edges, "strokes", width=3.0, distance=0.1).collect()}) == 2


def test_isolated_speck_is_one_region(spark):
    out = grid.regions(spark.createDataFrame([(3, 3, "a"), (4, 3, "a")], "x int, y int, color string"), 8).collect()
    assert [(r.area, r.x0, r.x1) for r in out] == [(2, 3, 4)]


def mask(spark, *boxes, holes=()):
    cut = {(x, y) for x0, y0, x1, y1 in holes for x in range(x0, x1) for y in range(y0, y1)}
    return spark.createDataFrame([(x, y) for x0, y0, x1, y1 in boxes for x in range(x0, x1) for y in range(y0, y1) if (x, y) not in cut], "x int, y int")


def test_holes(spark):
    ring = mask(spark, (1, 1, 6, 6), holes=[(2, 2, 5, 5)])
    opaque = mask(spark, (0, 0, 7, 7))
    assert ring.count() == 16 and grid.fill_holes(ring, 4, opaque=opaque).count() == 25
    assert grid.fill_holes(ring, 4, opaque=ring).count() == 16  # a transparent hole of 9
    two = mask(spark, (0, 0, 9, 5), holes=[(1, 1, 3, 4), (5, 1, 7, 4)])
    flag = spark.createDataFrame([(5, 2)], "x int, y int")
    assert grid.fill_holes(two, 4).count() - two.count() == 12
    assert grid.fill_holes(two, 4, keep_open=flag).count() - two.count() == 6


def test_depth_of_a_block(spark):
    out = grid.depth(mask(spark, (0, 0, 5, 5)).withColumn("color", F.lit(1)))
    assert dict(out.groupBy("depth").count().collect()) == {1: 16, 2: 8, 3: 1}


def test_components_and_ancestors(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 70), (70, 80)], "a long, b long")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(k, 0) for k in range(41)} | {(k, 70) for k in (70, 80, 90)}
    up = spark.createDataFrame([(k, k - 1 if k else None) for k in range(20)], "child long, parent long")
    assert {tuple(r) for r in ancestors(up).collect()} == {(a, b, a - b) for a in range(20) for b in range(a)}


def test_chains_of_a_thousand_and_cycles(spark):
    up = spark.createDataFrame([(k, k - 1 if k else None) for k in range(1000)], "child long, parent long")
    found = ancestors(up)
    assert found.count() == 1000 * 999 // 2 and found.where("node - ancestor <> steps").count() == 0
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0)], "child long, parent long")
    assert {tuple(r) for r in ancestors(ring).where("node in (0, 3)").collect()} == {(0, 1, 1), (0, 2, 2), (0, 0, 3), (3, 0, 1), (3, 1, 2), (3, 2, 3)}


def test_images_stay_apart(spark):
    two = spark.createDataFrame([(1, 0, 0, "a"), (2, 0, 0, "a"), (2, 1, 0, "a")], "image int, x int, y int, color string")
    assert sorted((r.image, r.area) for r in grid.regions(two, 8, ["image"]).collect()) == [(1, 1), (2, 2)]
    assert sorted((r.image, r.depth) for r in grid.depth(two, by=["image"]).collect()) == [(1, 1), (2, 1), (2, 1)]
    rings = [(i, x, y) for i in (1, 2) for x in range(3 + i) for y in range(3 + i) if x in (0, 2 + i) or y in (0, 2 + i)]
    inside = grid.holes(spark.createDataFrame(rings, "image int, x int, y int"), ["image"])
    assert sorted((r.image, r.n) for r in inside.groupBy("image").agg(F.count("*").alias("n")).collect()) == [(1, 4), (2, 9)]
    deep = spark.range(41 * 41).select((F.col("id") % 41).cast("int").alias("x"), F.floor(F.col("id") / 41).cast("int").alias("y"), F.lit(0).alias("color"))
    assert grid.depth(deep).agg(F.max("depth"), F.count("*")).first() == (21, 41 * 41)


def test_corners_measure_arms_straight():
    stairs = np.array([[0, 0], [1, 0], [1, 1], [2, 1], [2, 2], [3, 2], [3, 3]], float)
    assert curves.corners_open(stairs, 0.5, 2.0).tolist() == [1, 3, 5]


def test_fits_stay_near(spark):
    chord = curves.fit_open(np.array([[0.0, 0.0], [10.0, 0.0]]), 0.5, np.array([0.0, 1.0]), np.array([0.0, 1.0]))[0]
    assert curves.bezier(chord, np.linspace(0, 1, 101))[:, 1].max() <= 0.5 + 1e-9
    rng = np.random.default_rng(1)
    for _ in range(20):
        line = np.cumsum(rng.normal(size=(12, 2)) * 6, axis=0)
        found = curves.fit_open(line, 0.7)
        curve = np.vstack([curves.bezier(c, np.linspace(0, 1, 65)) for c in found])
        gaps = np.min([np.linalg.norm(curve - a - np.clip(((curve - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1)[:, None] * (b - a), axis=1) for a, b in zip(line, line[1:])], axis=0)
        assert gaps.max() <= 0.7 + 0.05
    loose = curves.fit_open(line, 0.7, slack=np.full(12, 50.0))
    assert len(loose) < len(found)


def test_residue_folds_as_it_should():
    def run(nodes, edges):
        g = merging.Graph(pd.DataFrame(nodes, columns=["region", "r", "g", "b", "area", "perimeter", "x0", "y0", "x1", "y1"]), pd.DataFrame(edges, columns=["lo", "hi", "sides"]))
        merging.residue(g)
        return g.table().set_index("region")["root"].to_dict()

    lone = [(0, 200, 200, 200, 300, 70, 0, 0, 19, 14), (1, 20, 20, 20, 2, 6, 3, 3, 4, 3)]
    assert run(lone, [(0, 1, 6)]) == {0: 0, 1: 0}  # a dark speck with no dark neighbour folds
    hugging = [(0, 41, 41, 41, 140, 48, 0, 0, 9, 13), (1, 51, 51, 51, 14, 30, 10, 0, 10, 13), (2, 217, 217, 217, 140, 48, 11, 0, 20, 13)]
    assert run(hugging, [(0, 1, 14), (1, 2, 14)]) == {0: 0, 1: 0, 2: 2}


def test_pins_are_scaled_to_cell_centres(spark):
    df = spark.createDataFrame([(10, 20), (3, 3), (100, 100)], "x int, y int")
    pin = S.scaled_pin(F.col("x"), F.col("y"), F.lit(8), F.lit(16), F.lit(3), F.lit(8), F.lit(8))
    assert [tuple(r.p) for r in df.select(pin.alias("p")).where("p is not null").collect()] == [(7, 13)]


def test_palette_groups_and_eviction():
    rows = pd.DataFrame([(200, 50, 50, 900), (201, 50, 50, 40), (184, 72, 72, 30), (48, 80, 192, 500), (9, 9, 9, 2)], columns=["r", "g", "b", "area"])
    groups = palette.leader_groups(rows)
    assert groups[["r", "largest", "aggregate"]].values.tolist() == [[200, 900, 940], [48, 500, 500], [184, 30, 30]]
    assert palette.choose(groups, 5) == [(200, 50, 50), (48, 80, 192), (184, 72, 72)]
    assert palette.choose(groups, 2) == [(200, 50, 50), (48, 80, 192)]
    assert palette.choose(groups, 1, [(1, 1, 1), (255, 255, 255)]) == [(1, 1, 1), (255, 255, 255)]


def test_features_grow_in_scan_order(spark):
    rows = [[40] * 4 + [200] * 4] * 4
    img = cells(spark, rows).withColumn("image", F.lit(1))
    out = palette.features(img).select("fx", "fy").distinct().collect()
    assert {tuple(r) for r in out} == {(0, 0), (4, 0)}
    ramp = np.array([[[v / 1000, 0, 0] for v in range(0, 100, 5)]], float)
    label, root = palette.grow(ramp, np.ones((1, 20), bool))
    assert 1 < len(set(root)) < 10  # a gradient is cut into bands


def test_shades_and_residue():
    def run(kind, nodes, edges, **k):
        g = merging.Graph(pd.DataFrame(nodes, columns=["region", "r", "g", "b", "area", "perimeter", "x0", "y0", "x1", "y1"]), pd.DataFrame(edges, columns=["lo", "hi", "sides"]))
        merging.KERNELS[kind](g, **k)
        return g.table().set_index("region")["root"].to_dict()

    plain = [(0, 40, 40, 40, 200, 60, 0, 0, 9, 19), (1, 120, 120, 120, 40, 44, 10, 0, 11, 19), (2, 200, 200, 200, 200, 60, 12, 0, 21, 19)]
    borders = [(0, 1, 20), (1, 2, 20)]
    assert len(set(run("residue", plain, borders).values())) == 2  # a blend ribbon goes
    ink = [(0, 120, 120, 120, 200, 60, 0, 0, 9, 19), (1, 30, 30, 30, 40, 44, 10, 0, 11, 19), (2, 220, 220, 220, 200, 60, 12, 0, 21, 19)]
    assert len(set(run("residue", ink, borders).values())) == 3  # a dark stroke stays
    near = [(0, 100, 100, 100, 50, 30, 0, 0, 4, 9), (1, 104, 104, 104, 60, 30, 5, 0, 9, 9), (2, 220, 220, 220, 50, 30, 10, 0, 14, 9)]
    assert run("shades", near, [(0, 1, 10), (1, 2, 10)], split=0.045, noise=0.2) == {0: 0, 1: 0, 2: 2}


def test_paint_order_is_a_maximum_tree(spark):
    nodes = spark.createDataFrame([(0, 1, 5, 10), (0, 2, 9, 3), (0, 3, 0, 8), (0, 7, 1, 1)], "image int, region long, open_len long, area long")
    edges = spark.createDataFrame([(0, 1, 2, 4), (0, 1, 3, 6), (0, 2, 3, 5)], "image int, lo long, hi long, sides long")
    out = {r.region: (r.parent, r.place) for r in merging.paint_order(nodes, edges).collect()}
    assert out == {2: (None, 0), 3: (2, 1), 1: (3, 2), 7: (None, 3)}
    tree = spark.createDataFrame([(k, p) for k, (p, _) in out.items()], "region long, parent long")
    areas = dict(merging.subtree_areas(tree, nodes.select("region", "area")).collect())
    assert areas == {2: 21, 3: 18, 1: 10, 7: 1}


def test_rules(spark):
    match = lambda k, n: spark.range(1).select(S.key_matches(F.lit(k), F.lit(n))).first()[0]
    cases = [("Deer", "Deer R Hand", False), ("Deer *", "Deerhoof", False), ("* Fill", "Fill", False), ("* L * Fill", "Deer L Hand Fill", True), ("*", "x", True), ("", "x", False), ("a.b", "axb", False), ("a(*)", "a(1)", True), ("[x]*", "[x]y\nz", True)]
    for key, name, expect in cases:
        assert match(key, name) is expect, (key, name)
    book = spark.createDataFrame([(0, "* Fill"), (0, "Deer * Fill"), (1, "Deer L*"), (0, "*x"), (0, "a*")], "tier int, key string")
    names = spark.createDataFrame([("Deer L Hand Fill",), ("Deer L",), ("ax",), ("none",)], "name string")
    assert {r.name: (r.tier, r.key) for r in rules.best_rule(names, book).collect()} == {"Deer L Hand Fill": (0, "Deer * Fill"), "Deer L": (1, "Deer L*"), "ax": (0, "*x"), "none": (None, None)}
    given = spark.createDataFrame([(1, "none", "a*"), (0, "ax", "missing")], "tier int, name string, key string")
    got = {r.name: (r.key, r.assigned) for r in rules.assigned(names, book, given).collect()}
    assert got["none"] == ("a*", True) and got["ax"] == ("*x", False)
    taken = spark.createDataFrame([("a",), ("a 2",), ("a 3",), ("a 5",), ("b",)], "key string")
    free = dict(rules.unique_key(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), taken).collect())
    assert free == {"a": "a 4", "b": "b 2", "c": "c"}
    changed, moved = rules.rename(book, given, 0, "a*", "z*")
    assert changed.where("key = 'z*'").count() == 1 and moved.where("key = 'z*'").count() == 0
    assert table(rules.stale_assignments(given, book).select("name")) == [("ax",)]


def test_rule_files(spark):
    text = '[default]\ndetail = 3\n[profiles."* Fill"]\ndetail = 5\nunknown = 1\n[layers."Nose"]\nscale = 2\n[assign]\nA = "* Fill"\n'
    got = rulebook.rule_table(spark, [text, "broken ="], {"detail": "long", "scale": "long"}).collect()
    assert [(r.kind, r.key, r.settings.detail, r.settings.scale) for r in got] == [("default", None, 3, None), ("profile", "* Fill", 5, None), ("override", "Nose", None, 2), ("assign", "A", None, None)]
    entries = rulebook.manifest(spark, '[[subset]]\nname = "s"\nsource = "f"\nlayers = ["x", "y"]\n[[whole]]\nname = "w"\nsource = "g"\n').collect()
    assert [(r.place, r.name, r.layer) for r in entries] == [(0, "s", "x"), (0, "s", "y"), (1, "w", None)]


def test_keyframes(spark):
    keys = spark.createDataFrame([("p", t, v) for t, v in enumerate([1.0, 1.0, 2.0, 2.0, 2.0, 1.0])] + [("q", 3, 7.0)], "prop string, t int, v double")
    assert [(r.t, r.hold) for r in keyframes.drop_repeats(keys.where("prop = 'p'"), ["prop"], ["t"], "v").orderBy("t").collect()] == [(0, True), (2, True), (5, False)]
    assert sorted(r.t for r in keyframes.trim(keys, ["prop"], "t", F.lit(2), F.lit(4), "v").collect()) == [1, 2, 3, 4]
    line = spark.createDataFrame([(0, float(t), float(t)) for t in range(33)] + [(1, float(t), math.sin(t / 5) * 10) for t in range(33)], "s int, t double, v double")
    got = dict(keyframes.sample_needed(line, ["s"], 1.0, 0.5).groupBy("s").count().collect())
    assert got[0] == 2 and 5 <= got[1] < 33


def test_change_log(spark):
    drag = spark.createDataFrame([(1, k, "drag", str(k), str(k + 1)) for k in range(5)] + [(1, 5, "seal", None, None), (1, 6, "drag", "5", "9")], "doc int, seq long, kind string, old string, new string")
    out = changes.coalesce_gestures(drag, ["doc"], ["seq"], "kind", F.col("kind") == "seal").orderBy("gesture").collect()
    assert [(r.n, r.old, r.new) for r in out] == [(5, "0", "5"), (1, "5", "9")]
    log = spark.createDataFrame([(1, k) for k in range(110)], "doc int, seq long")
    kept = changes.newest(log, ["doc"], ["seq"]).agg(F.count("*"), F.min("seq")).first()
    assert tuple(kept) == (100, 10)
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "k int, v string")
    assert sorted(table(changes.difference(a, b, ["k"], "v"))) == [(2, None, "y"), (3, "z", None)]
    twice = lambda v: changes.fingerprint(spark.createDataFrame([(v,), (v,)], "v string"), [], ["v"]).first()
    assert twice("A") != twice("B") and twice("A").n == 2
    shuffled = changes.fingerprint(a.repartition(3), [], ["k", "v"]).first()
    assert shuffled == changes.fingerprint(a, [], ["k", "v"]).first()


def test_generation_gate_in_batch_and_stream(spark, tmp_path):
    rows = [(1, 1, 5), (1, 2, 6), (1, 3, 5), (2, 4, 0), (2, 5, 0), (1, 6, 6)]
    parts = spark.createDataFrame(rows, "doc long, seq long, generation long")
    expect = {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}
    assert {r.seq: r.accepted for r in gate.gated(parts).collect()} == expect
    source = str(tmp_path / "in")
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1)
    parts.where("seq <= 3").coalesce(1).write.parquet(source)
    query = gate.gated(stream.parquet(source)).writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    parts.where("seq > 3").coalesce(1).write.mode("append").parquet(source)
    assert {r.seq: r.accepted for r in spark.table("gated").collect()} == {k: v for k, v in expect.items() if k <= 3}


def test_layers(spark):
    tree = spark.createDataFrame([("root", None), ("B < a", "root"), ("b", "B < a"), ("c", "b")], "name string, parent string")
    out = {r.name: r.parent for r in layers.skip_parents(tree, layers.is_rig(F.col("name"))).collect()}
    assert out == {"root": None, "B < a": "root", "b": "root", "c": "b"}
    assert {r.name for r in layers.with_ancestors(tree, tree.where("name = 'b'").select("name")).collect()} == {"b", "B < a", "root"}
    both = spark.createDataFrame([("Body",), ("Body Fill",), ("Arm DF Fill",)], "name string")
    assert table(layers.with_base(both)) == [("Body Fill", "Body")]
    assert [r[0] for r in both.select(layers.depth_fix_target(F.col("name"))).collect()] == [None, None, "Arm Fill"]
    outlines = spark.createDataFrame([("a", None), ("a Outlines", "b"), ("c", "a"), ("d", "z")], "name string, parent string")
    assert {r.name: r.parent for r in layers.outline_parents(outlines).collect()} == {"a": None, "a Outlines": "b", "c": "a Outlines", "d": "z"}


def test_seams(spark):
    one, two = mask(spark, (0, 0, 4, 4)).withColumn("region", F.lit(1)), mask(spark, (4, 0, 8, 4)).withColumn("region", F.lit(2))
    edges = curves.boundary_edges(one.union(two))
    met = seams.partners(edges, "region").where(F.size("partners") > 0).groupBy("region").count().collect()
    assert {tuple(r) for r in met} == {(1, 4), (2, 4)}
    ring = spark.createDataFrame([(0, k, v) for k, v in enumerate("aabbba")] + [(1, k, "z") for k in range(3)], "ring int, k int, v string")
    assert {tuple(r) for r in seams.shared_runs(ring, "ring", "k", "v").collect()} == {(0, 5, 3, "a"), (0, 2, 3, "b"), (1, 0, 3, "z")}
    path = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 2, 1)], "ring int, k int, x int, y int")
    assert [r.k for r in seams.direction_changes(path, "ring").orderBy("k").collect()] == [0, 2, 3]
    assert seams.densify(path.where("k <> 1"), "ring", closed=False).count() == 3
    square = spark.createDataFrame([(0, k, x, y) for k, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])], "ring int, k int, x int, y int")
    assert sorted((r.x, r.y) for r in seams.densify(square, "ring").collect()) == sorted([(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)])
    cyc = spark.createDataFrame([([3, 1, 2],), ([2, 1, 3],)], "a array<int>").select(seams.canonical_cycle(F.col("a"))).collect()
    assert cyc[0][0] == cyc[1][0] == [1, 2, 3]


def test_rings_and_curves(spark):
    block = mask(spark, (0, 0, 6, 4)).withColumn("region", F.lit(1))
    assert [(r.x, r.y) for r in curves.rings(block).orderBy("k").collect()] == [(0, 0), (6, 0), (6, 4), (0, 4)]
    holed = mask(spark, (0, 0, 6, 6), holes=[(2, 2, 4, 4)]).withColumn("region", F.lit(1))
    assert curves.rings(holed).select("ring").distinct().count() == 2
    hexagon = np.array([[math.cos(k * math.pi / 3) * 20, math.sin(k * math.pi / 3) * 20] for k in range(6)])
    assert curves.corners(hexagon, 0.5, 1.0).tolist() == [0]  # one run of sharp points, and of equal ones the first
    fixed = np.arange(6)
    cubics = curves.fit_closed(hexagon, fixed, 1.0)
    assert len(cubics) == 6 and all(np.allclose(a[3], b[0]) for a, b in zip(cubics, cubics[1:] + cubics[:1], strict=True))
    assert 3 <= len(curves.simplify(cubics, 1000.0, math.pi)) < 6
    assert len(curves.simplify(cubics, 1000.0, 0.1)) == 6 and len(curves.simplify(cubics, 0.0, math.pi)) == 6
    circle = np.array([[math.cos(t) * 30, math.sin(t) * 30] for t in np.linspace(0, 2 * math.pi, 120, endpoint=False)])
    arcs = curves.fit_closed(circle, np.zeros(0, int), 0.3)
    assert len(arcs) < 20
    assert all(abs(np.linalg.norm(p) - 30) < 0.5 for c in arcs for p in curves.bezier(c, np.linspace(0, 1, 20)))
    triangle = np.array([[0, 0], [10, 0], [0, 10.0]])
    assert curves.smooth(triangle, np.arange(3), 50.0).tolist() == triangle.tolist()


def test_open_chains_and_clearance():
    bend = np.array([[0, 0], [2, 0], [4, 0], [4, 2], [4, 4.0]])
    assert curves.corners_open(bend, 0.5, 2.0).tolist() == [2] and curves.corners_open(bend[:3], 0.5, 2.0).tolist() == []
    out = curves.smooth_open(bend, np.array([2]), 10.0)
    assert out[[0, 2, 4]].tolist() == bend[[0, 2, 4]].tolist()
    assert curves.clearance(np.array([[0, 3.0]]), np.array([[[-5, 0], [5, 0.0]]])) == 3.0 and curves.clearance(bend, np.zeros((0, 2, 2))) == math.inf
    hair = np.array([[k, 0] for k in range(10)] + [[k, 1] for k in range(9, -1, -1)], float)
    near = curves.narrow_places(hair)
    assert near[2] == 17 and near[0] == -1
    ring = np.array([[0, 0], [10, 0], [10, 0.5], [10, 10], [0, 10.0]])
    cubics = [np.array([a, a + (b - a) / 3, b - (b - a) / 3, b]) for a, b in zip(ring, np.roll(ring, -1, 0), strict=True)]
    wall = np.array([[[10.2, -5], [10.2, 15.0]]])
    assert len(curves.simplify_clear(cubics, wall, 0.4, 3.0)) <= len(cubics)


def test_incremental_cache(spark, tmp_path):
    from gridloom.plans.incremental import through_cache

    asked = []

    def double(df):
        asked.append(df.count())
        return df.select("k", (F.col("v") * 2).alias("w"))

    rows = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    more = spark.createDataFrame([(1, 5), (2, 7), (3, 8)], "k int, v int")
    path = str(tmp_path / "cache")
    assert sorted(table(through_cache(rows, ["k"], ["v"], path, double).select("k", "w"))) == [(1, 10), (2, 12)]
    assert sorted(table(through_cache(more, ["k"], ["v"], path, double).select("k", "w"))) == [(1, 10), (2, 14), (3, 16)]
    assert sorted(table(through_cache(more, ["k"], ["v"], path, double).select("k", "w"))) == [(1, 10), (2, 14), (3, 16)]
    assert asked == [2, 2]


def test_geometry_columns(spark):
    p = lambda x, y: G.point(F.lit(x), F.lit(y))
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(G.dist2_to_segment(p(0, 5), p(-5, 0), p(5, 0))) == 25.0
    assert get(G.dist2_to_polyline(p(0, 1), F.array(p(0, 0)))) == float("inf")
    assert get(G.inside_polygon(F.lit(1.0), F.lit(1.0), F.array(p(0, 0), p(4, 0), p(4, 4), p(0, 4)))) is True
    assert get(G.inside_polygon(F.lit(5.0), F.lit(1.0), F.array(p(0, 0), p(4, 0), p(4, 4), p(0, 4)))) is False
    assert get(G.chord_lengths(F.array(p(0, 0), p(3, 4), p(6, 8)))) == [0.0, 0.5, 1.0]
    cubic = lambda *k: F.struct(*(p(x, y).alias(n) for n, (x, y) in zip(("c1", "c2", "e"), k, strict=True)))
    back = get(G.reverse_cubics(p(0, 0), F.array(cubic((1, 0), (2, 0), (3, 0)), cubic((4, 0), (5, 0), (6, 0)))))
    assert back.start.x == 6 and [c.c1.x for c in back.cubics] == [5, 2] and [c.e.x for c in back.cubics] == [3, 0]
    assert [q.x for q in get(G.circular_slice(F.array(p(0, 0), p(1, 0), p(2, 0)), F.lit(2), F.lit(0)))] == [2, 0]
    assert len(get(G.circular_slice(F.array(p(0, 0), p(1, 0), p(2, 0)), F.lit(1), F.lit(1)))) == 4
    assert get(C.to_hex(F.lit(1), F.lit(171), F.lit(255))) == "#01abff" and get(C.from_hex(F.lit("##01ABff"))).g == 171 and get(C.from_hex(F.lit("#12"))) is None
    white = get(C.lab(F.lit(255), F.lit(255), F.lit(255)))
    assert abs(white.l - 1) < 1e-6 and abs(white.a) < 1e-6
    a, m, b = (C.lab(F.lit(v), F.lit(v), F.lit(v)) for v in (40, 120, 200))
    assert get(C.blend_between(m, a, b, 0.075, 0.01)) is True and get(C.blend_between(a, a, b, 0.075, 0.01)) is False
    assert 0 <= get(C.hashed_color(F.lit(7))).r <= 255


def test_sinks(spark):
    p = lambda x, y: {"x": float(x), "y": float(y)}
    square = [{"c1": p(2, 0), "c2": p(4, 0), "e": p(8, 0)}, {"c1": p(8, 2), "c2": p(8, 4), "e": p(8, 8)}, {"c1": p(0, 8), "c2": p(0, 4), "e": p(0, 0)}]
    point = "struct<x: double, y: double>"
    df = spark.createDataFrame([(1, "l", 0, 0, "#ff0000", 0, p(0, 0), square), (1, "l", 0, 0, "#ff0000", 1, p(0, 0), square[:1])], f"doc int, layer string, z int, group int, color string, path int, start {point}, cubics array<struct<c1: {point}, c2: {point}, e: {point}>>")
    paths = json.loads(sinks.documents_json(df, 2.0).first().json)["layers"][0]["groups"][0]["paths"]
    assert paths[0]["v"] == [[0, 0], [4, 0], [4, 4]] and paths[0]["i"][0] == [0, 2] and paths[0]["o"][0] == [1, 0]
    assert paths[1]["v"] == [[0, 0], [4, 0]] and paths[1]["i"] == [[0, 0], [-2, 0]] and paths[1]["o"] == [[1, 0], [0, 0]]
    svg = sinks.documents_svg(df, 2.0, 10, 10, 1.0).first().svg
    assert svg.count("<path") == 1 and svg.count("M0 0") == 2 and 'viewBox="-1 -1 12 12"' in svg


def test_png_source(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    pixels = b"".join(b"\x00" + b"".join(bytes((10 * x, 20 * y, 30, 255 if x else 0)) for x in range(3)) for y in range(2))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")
    (tmp_path / "a b.png").write_bytes(png)
    (tmp_path / "note.txt").write_text("x")
    got = {(r.x, r.y, r.r, r.g, r.b) for r in images.load_images(spark, str(tmp_path)).collect()}
    assert got == {(x, y, 10 * x, 20 * y, 30) for x in (1, 2) for y in (0, 1)}
    assert [r.name for r in images.scan_folder(spark, str(tmp_path)).collect()] == ["a b"]


def test_neighbours_share_their_border(spark):
    from gridloom.operators import stitching

    rows = [(x, y, "a" if x + y % 3 < 9 else "b") for x in range(18) for y in range(12)] + [(x, y, "c") for x in range(30, 36) for y in range(6) if not (32 <= x < 34 and 2 <= y < 4)] + [(x, y, "d") for x in (32, 33) for y in (2, 3)]
    rings = curves.rings(spark.createDataFrame(rows, "x int, y int, region string"))
    out = stitching.stitched(rings, ["region", "ring"]).collect()
    paths = {}
    for r in sorted(out, key=lambda r: (r.region, r.ring, r.seg)):
        paths.setdefault((r.region, r.ring), []).append(tuple(r[c] for c in stitching.NAMES))
    for cubics in paths.values():  # closed, without gaps
        assert all(a[6:] == b[:2] for a, b in zip(cubics, cubics[1:] + cubics[:1], strict=True))
    back = lambda c: c[6:] + c[4:6] + c[2:4] + c[:2]
    a, b = (next(v for k, v in paths.items() if k[0] == x) for x in "ab")
    shared = {c for c in a if back(c) in b}
    assert shared and {c for c in a if any(7 < c[k] < 11 for k in (0, 6)) and 0 < c[1] < 12} <= shared
    assert {back(c) for c in paths["d", 0]} in [set(v) for k, v in paths.items() if k[0] == "c"]


def test_kept_layers_without_the_closure(spark, monkeypatch):
    """Of a chain of n every table has n rows at most, not n * n / 2 pairs; cycles and second parents are followed too."""
    from gridloom.operators import components as module
    from gridloom.operators import library

    sizes, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: (out := cut(df), sizes.append(out.count()))[0])
    chain = spark.range(300).selectExpr("id as name", "if(id > 0, id - 1, null) as parent")
    assert layers.pruned(chain, F.col("name") == 200).count() == 201 and max(sizes) <= 300
    sizes.clear()
    owned = chain.selectExpr("name as node", "parent", "'x' as expression", "name in (40, 250) as enabled")
    assert {r.node for r in library.expression_owners(owned, []).collect()} == set(range(251)) and max(sizes) <= 300
    odd = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("d", "e"), ("e", None), ("f", "d"), ("g", "f")], "child string, parent string")
    pairs = {(r.node, r.ancestor) for r in ancestors(odd).collect()}
    for seeds in (["g"], ["f"], ["d"], ["c"], ["e"], ["a", "e"], []):
        found = module.with_above(odd, spark.createDataFrame([(x,) for x in seeds], "node string"))
        assert sorted(r.node for r in found.collect()) == sorted({*seeds, *(b for a, b in pairs if a in seeds)})


def test_large_images_merge_by_rounds_as_kernels_do(spark, monkeypatch):
    """Random cells: every round has picks that meet, and the second image is small."""
    rng = np.random.default_rng(3)
    rows = [(int(i), x, y, *(int(v) * 20, int(v) * 20 + 10, 255 - int(v) * 8)) for i, h in ((0, 9), (1, 2)) for y in range(h) for x, v in enumerate(rng.integers(1, 6, 12))]
    nodes, edges = (merging.cut(df) for df in merging.region_graph(spark.createDataFrame(rows, "image int, x int, y int, r int, g int, b int"), 12))
    size = nodes.where("image = 0").count()
    assert nodes.where("image = 1").count() < size // 2
    by_rounds = []
    monkeypatch.setattr(merging, "_by_rounds", lambda n, *a, f=merging._by_rounds, **k: (by_rounds.append(n.count()), f(n, *a, **k))[1])
    for kind, settings in (("bands", {"distance": 0.08, "mean_width": 2.5, "most_width": 4.0}), ("strokes", {"width": 4.0, "distance": 0.08}), ("speckles", {"floor": 4})):
        whole = sorted(table(merging._by_kernel(nodes, edges, kind, **settings)))
        monkeypatch.setattr(merging, "MOST_REGIONS", size // 2)
        assert sorted(table(merging.merged(nodes, edges, kind, **settings))) == whole
        assert len({r[2] for r in whole}) < len(whole)
    assert by_rounds == [size] * 3


def test_paint_order_of_one_large_image(spark):
    """Several images in a task come out as a plain search has them, and an image takes some bytes a region and border, not objects."""
    import heapq
    import tracemalloc

    rng = np.random.default_rng(5)
    nodes = [(i, k * 3 + 1, int(rng.integers(0, 3)), int(rng.integers(1, 4))) for i in range(12) for k in range(int(rng.integers(1, 40)))]
    pairs = {(i, *sorted((a, int(rng.integers(0, 40)) * 3 + 1))) for i, a, _, _ in nodes for _ in range(2)}
    edges = [(i, a, b, int(rng.integers(1, 4))) for i, a, b in sorted(pairs) if a != b]
    expected = []
    for image in range(12):
        rank = {r: (o, area, -r) for i, r, o, area in nodes if i == image}
        near = {r: [] for r in rank}
        for i, a, b, s in edges:
            if i == image and a in rank and b in rank:  # borders of other regions than the nodes count for nothing
                near[a].append((b, s))
                near[b].append((a, s))
        inside, place = set(), 0
        for first in sorted(rank):
            group, todo = {first}, [first]
            while todo:
                todo += (new := {j for j, _ in near[todo.pop()]} - group)
                group |= new
            heap = [] if first in inside else [(0, max(group, key=rank.get), None)]
            while heap:
                _, child, parent = heapq.heappop(heap)
                if child not in inside:
                    inside.add(child)
                    expected.append((image, child, parent, place))
                    place += 1
                    for j, s in near[child]:
                        heapq.heappush(heap, (-s, j, child))
    out = merging.paint_order(spark.createDataFrame(nodes, "image int, region long, open_len long, area long"), spark.createDataFrame(edges, "image int, lo long, hi long, sides long"))
    assert sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[3])) == expected

    w, h = 150, 200
    at = np.arange(w * h, dtype=np.int32).reshape(h, w)
    lo, hi = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()]), np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    sides = rng.integers(1, 3, len(lo)).astype(np.int32)
    tracemalloc.start()
    order, parents = merging._painted(np.zeros(w * h, int), np.ones(w * h, int), lo, hi, sides)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(order.tolist()) == list(range(w * h)) and (parents < 0).sum() == 1
    assert most < 110 * (w * h + len(lo))


def test_rings_are_read_in_sequence_and_forms_fitted_once(spark):
    """Many rings come through one task in small batches; chains of one form have one fit, moved."""
    from gridloom.operators import stitching

    made = []
    fits = curves.Fits(lambda points, whole: made.append(len(points)) or [np.array([points[0], points[0], points[-1], points[-1]])], most=2)
    assert fits.of([(3.0, 4.0), (5.0, 4.0)], False) == [[3, 4, 3, 4, 5, 4, 5, 4]] and fits.of([(0.0, 9.0), (2.0, 9.0)], False) == [[0, 9, 0, 9, 2, 9, 2, 9]]
    assert made == [2] and fits.of([(0.0, 9.0), (2.0, 9.0)], True) and made == [2, 2]
    assert stitching.stretches([(0, 0), (1, 0), (1, 1), (0, 1)], ["a", "a", "b", "a"]) == [([(1, 1), (0, 1)], False), ([(0, 1), (0, 0), (1, 0), (1, 1)], False)]

    blob = [(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (1, 2), (2, 2), (3, 2)]
    cells = spark.createDataFrame([(5 * k + x, y, f"r{k}") for k in range(40) for x, y in blob], "x int, y int, region string")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rings, forms, paths = curves.rings(cells).collect(), {}, {}
        for r in sorted(rings, key=lambda r: (r.region, r.ring, r.k)):
            forms.setdefault(r.region, []).append((r.ring, r.x - 5 * int(r.region[1:]), r.y))
        for out in (stitching.stitched(curves.rings(cells), ["region", "ring"]), curves.fit_rings(curves.rings(cells), ["region", "ring"])):
            rows = sorted(out.collect(), key=lambda r: (r.region, r.ring, r.seg))
            for region in forms:
                own = [(r.ring, r.seg, *(round(r[c] - (5 * int(region[1:]) if c.endswith("x") or c == "x0" else 0), 9) for c in stitching.NAMES)) for r in rows if r.region == region]
                paths.setdefault(id(out), []).append(own)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(forms) == 40 and {tuple(v) for v in forms.values()} == {tuple(forms["r0"])} and {r for r, *_ in forms["r0"]} == {0, 1}
    assert all(len(each) == 40 and each[0] and all(p == each[0] for p in each) for each in paths.values())


def test_colours_are_compared_once(spark):
    """The neighbourhoods are joined once though read twice, and no colour is converted behind the joins that multiply cells."""
    from gridloom.operators import assign
    from gridloom.plans import trace

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    targets = spark.createDataFrame([(0, 0, 5), (9, 0, 5)], "x int, y int, v int")
    sources = spark.createDataFrame([(0, 0, 2), (1, 0, 7)], "x int, y int, idx int")
    offered = spark.createDataFrame([(2,), (5,), (7,)], "idx int")
    out = assign.constrained_nearest(targets, sources, 1, F.abs(F.col("v") - F.col("idx")), (), offered)
    assert sorted(map(tuple, out.collect())) == [(0, 0, 5, 7), (9, 0, 5, 5)] and plan(out).count("Join") == 1
    image = [(0, x, y, 200 if x < 4 else 20, 30, 40, 255) for x in range(8) for y in range(6)]
    colored = trace.quantized(spark.createDataFrame(image, "image int, x int, y int, r int, g int, b int, a int"), trace.Settings(width=8))
    assert "cbrt" not in plan(colored).lower()
    assert sorted(map(tuple, colored.collect())) == sorted(r[:6] for r in image)
