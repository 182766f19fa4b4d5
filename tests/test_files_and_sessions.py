"""Rule files, recents, documents' frames, sessions and latches."""

import json

from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import changes, grid, layers
from gridloom.sources import rulebook, sinks
from gridloom.streaming import gate

FIELDS = {"detail": "long", "color": "string", "stitch": "boolean", "locked": "array<string>"}
TEXT = '[default]\ndetail = 3\n[profiles."* Fill"]\ncolor = "#ff\\"00"\nlocked = ["#112233", "#445566"]\n[layers."Nose"]\nstitch = false\n[assign]\n"A b" = "* Fill"\n'


def test_rules_come_back_as_written(spark, tmp_path):
    book = rulebook.rule_table(spark, [TEXT, "[default]\ndetail = 9\n"], FIELDS)
    done, errors = rulebook.write_rules(book, [str(tmp_path / "new" / "rules.toml"), str(tmp_path / "own.toml")])
    assert (done, errors) == (2, [])
    again = rulebook.rule_table(spark, [rulebook.find_rules(str(tmp_path / "new" / "art.png")), (tmp_path / "own.toml").read_text()], FIELDS)
    key = lambda r: (r.tier, r.kind, r.key or "")
    assert sorted(book.collect(), key=key) == sorted(again.collect(), key=key)
    (tmp_path / "file").write_text("")
    assert rulebook.write_rules(book, [str(tmp_path / "file" / "x.toml"), None])[0] == 0


def test_broken_rules_are_passed_over(tmp_path, monkeypatch):
    (tmp_path / "art").mkdir()
    (tmp_path / "art" / rulebook.RULES_FILE).write_text("broken =")
    monkeypatch.chdir(tmp_path)
    assert rulebook.find_rules(str(tmp_path / "art" / "a.png")) is None
    (tmp_path / rulebook.RULES_FILE).write_text("[default]\n")
    assert rulebook.find_rules(str(tmp_path / "art" / "a.png")) == "[default]\n"
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "none"))
    assert rulebook.global_rules() is None


def test_recents_file(spark, tmp_path):
    path = str(tmp_path / "recents.toml")
    assert rulebook.load_recents(spark, path).collect() == []
    rows = [("/a b", False, 5, False), ("/c", True, 9, False), ("/d", False, 1, True)]
    rulebook.save_recents(spark.createDataFrame(rows, rulebook.RECENTS), path, cap=2)
    assert [(r.path, r.folder, r.opened, r.pinned) for r in rulebook.load_recents(spark, path).collect()] == [("/d", False, 1, True), ("/c", True, 9, False)]


def test_documents_have_frames_and_enabled_layers_only(spark, tmp_path):
    p = lambda x, y: G.point(F.lit(x), F.lit(y))
    cubics = F.array(F.struct(p(1.0, 0.0).alias("c1"), p(2.0, 1.0).alias("c2"), p(2.0, 2.0).alias("e")))
    paths = spark.createDataFrame([("d", "on", 0), ("d", "off", 1)], "doc string, layer string, z int").withColumns({"group": F.lit(0), "color": F.lit("#123456"), "path": F.lit(0), "start": p(0.0, 0.0), "cubics": cubics})
    frames = spark.createDataFrame([("d", 640, 480, None), ("empty", 1, 1, (2.0, "#000000"))], "doc string, width int, height int, stroke struct<width: double, color: string>")
    found = {r.doc: json.loads(r.json) for r in sinks.documents_json(paths, 2.0, frames).collect()}
    assert found["d"]["width"] == 640 and found["d"]["scale"] == 2.0 and "stroke" not in found["d"] and len(found["d"]["layers"]) == 2
    assert found["empty"]["layers"] == [] and found["empty"]["stroke"]["width"] == 2.0
    shown = spark.createDataFrame([("d", "on", True), ("d", "off", False)], "doc string, layer string, enabled boolean")
    sinks.export(paths, shown, 2.0, frames, str(tmp_path / "out"))
    out = {r.doc: json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert [x["name"] for x in out["d"]["layers"]] == ["on"]


def test_stale_parts_before_the_first_new_one_are_refused(spark, tmp_path):
    rows = [(1, 1, 5, "live"), (1, 2, 5, "part"), (1, 3, 6, "live"), (1, 4, 5, "part"), (1, 5, 6, "part"), (2, 1, 1, "part")]
    events = spark.createDataFrame(rows, "doc long, seq long, generation long, kind string")
    expect = {(1, 2, True), (1, 4, False), (1, 5, True), (2, 1, False)}
    assert {(r.doc, r.seq, r.accepted) for r in gate.gated_by_session(events).collect()} == expect
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = gate.gated_by_session(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert {(r.doc, r.seq, r.accepted) for r in spark.table("sessions").collect()} == expect


def test_one_run_at_a_time(spark):
    rows = [("a", 0, 10), ("a", 2, 10), ("a", 3, 10), ("a", 25, 10), ("b", 5, 1)]
    out = changes.latched(spark.createDataFrame(rows, "doc string, at long, took long"), ["doc"], "at", "took").collect()
    assert sorted((r.doc, r.began, r.requests) for r in out) == [("a", 0, 1), ("a", 10, 2), ("a", 25, 1), ("b", 5, 1)]


def test_layer_tables(spark):
    rows = spark.createDataFrame([("Arm", None), ("Arm Outlines", None), ("Hand", "Arm"), ("Leg", None)], "name string, parent string")
    assert sorted((r.name, r.parent) for r in layers.outlines_only(rows).collect() if r.parent) == [("Hand", "Arm Outlines")]
    parts = grid.split_layer(spark.createDataFrame([(x, 0) for x in (0, 1, 5, 9)], "x int, y int"), 10)
    assert sorted((r.name, r.area, r.many) for r in grid.part_names(parts, "Ink").collect()) == [("Ink - 1", 2, False), ("Ink - 2", 1, False), ("Ink - 3", 1, False)]
    near = grid.split_layer(spark.createDataFrame([(x, 0) for x in (0, 1, 4, 9)], "x int, y int"), 10, gap=1)
    assert near.select("part").distinct().count() == 2
