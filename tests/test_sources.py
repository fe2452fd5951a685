import io
import json
import math
import tarfile

import pytest
from pyspark.sql import functions as F

from voltmill.functions import geometry as geo
from voltmill.sources.config import config_tables, parse_configs, read_configs, target_nets
from voltmill.sources.editor import fill_rings, path_rings, read_snapshots, run_config, snapshot_tables, via_layers
from voltmill.sources.odb import archive_files, board_polygons, drills, features, net_references, surface_rings

FILES = {
    "./job/steps/pcb/eda/data": "#comment\nLYR TOP BOTTOM\nNET 3V3;ID=1\nFID C 0 0\nFID C 0 2\nFID T 0 1\nNET GND\nFID C 1 0\nFID C 9 0\nFID C x y\n",
    "job/steps/pcb/layers/top/features": "$0 r100\n$1 rect200x100xr20\n$2 oval300x100\n$9 strange\n#Layer features\nL 0 0 1 0 0 P 0\nL 0 0 1 0 0 N 0\nP 2 2 1 P 0 0\nS P 0\nOB 0 0 I\nOS 4 0\nOS 4 4\nOS 0 4\nOE\nOB 1 1 H\nOS 1 2\nOS 2 2\nOE\nOB 9 9 I\nOS 9 8\nOE\nSE\nX ignored\nA 1 0 0 1 0 0 0 P 0 N N\nP 5 5 9 P 0 0\n",
    "job/steps/pcb/layers/bottom/features": "$0 s50\nP 1 1 0 P 0 0\n",
    "job/steps/pcb/layers/comp_+_top/components": "TOP 0 2.0 2.0 90 N 0 0\nBOGUS\n",
    "job/steps/pcb/layers/drill/features": "$0 r300\nP 3 3 0 P 1 0 0\nP 4 4 0 P 2 0 0\n",
    "job/steps/pcb/layers/drill/tools": "NUM=1\nTYPE=VIA\nNUM=2\nTYPE=PLATED\n",
    "job/steps/pcb/profile": "S P 0\nOB 0 0 I\nOS 10 0\nOS 10 10\nOE\nSE\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odb")
    with tarfile.open(folder / "board.tgz", "w:gz") as tar:
        for name, text in FILES.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    (folder / "broken.tgz").write_bytes(b"no archive")
    return archive_files(spark, str(folder / "*.tgz"))


def test_archive_nets_and_features(files):
    assert files.count() == len(FILES)
    assert sorted(map(tuple, net_references(files).collect())) == [("board.tgz", "BOTTOM", 0, "GND"), ("board.tgz", "TOP", 0, "3V3"), ("board.tgz", "TOP", 2, "3V3")]
    top = {r.feature_no: r for r in features(files).filter("layer = 'top'").collect()}
    assert [top[i].kind for i in range(6)] == ["L", "L", "P", "S", "A", "P"]
    assert top[2].symbol.kind == "rect" and top[2].symbol.w == 0.2 and top[2].symbol.r == 0.02


def test_polygons_and_drills(spark, files):
    found = board_polygons(files).select("layer", "feature_no", "net", geo.polygon_area("rings").alias("area"), F.size("rings").alias("rings"), geo.bounds(F.col("rings")[0]).alias("b"))
    rows = {(r.layer, r.feature_no): r for r in found.collect()}
    assert set(rows) == {("top", 0), ("top", 2), ("top", 3), ("top", 4), ("bottom", 0), ("board_outline_layer", 0)}
    assert rows["top", 0].net == "3V3" and rows["top", 0].area == pytest.approx(0.1 + math.pi * 0.05**2, rel=0.02)
    assert rows["top", 3].rings == 2 and rows["top", 3].area == pytest.approx(15.5)
    pad = rows["top", 2].b  # turned by 90 degrees
    assert pad.x1 - pad.x0 == pytest.approx(0.1, abs=1e-6) and pad.y1 - pad.y0 == pytest.approx(0.2, abs=1e-6)
    assert rows["bottom", 0].net == "GND" and rows["bottom", 0].area == pytest.approx(0.0025)
    assert {(r.x, r.diameter, r.is_via) for r in drills(files).collect()} == {(3.0, 0.3, True), (4.0, 0.3, False)}
    assert surface_rings(["OB 0 0 I", "OC 2 0 1 0 Y", "OS 1 -3", "OE", "OB x", "garbage"])[0][0][:1] == [(0.0, 0.0)]


def test_config(spark, tmp_path):
    pad = {"x": 1, "y": 2, "layer": "TopLayer", "net": "3V3", "is_tht": False}
    body = {"project_name": "p", "editor_bounds": {"minX": 1, "maxX": 2.5}, "gnd_net": "GND", "layers": [{"name": "TopLayer", "conductance": 0, "layer_id": 1}], "sources": [{"net": "3V3", "voltage": 3.3, "pads": [pad, pad]}], "loads": [{"net": "3V3", "gnd_net": "AGND", "current": 0.5, "pads": [pad]}]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    (tmp_path / "b.json").write_text("{broken")
    tables = config_tables(read_configs(spark, str(tmp_path / "*.json"), bounds_member="editor_bounds"))
    assert tables["terminals"].count() == 3 and tables["tracks"].count() == 0
    assert tables["layers"].first().conductance == 1.0 and tables["runs"].first().temp_rise == 10.0
    assert tables["runs"].first().bounds.maxX == 2.5
    assert {r.net for r in target_nets(tables).collect()} == {"3V3", "GND", "AGND"}


def test_paths():
    assert path_rings('["R", 0, 10, 5, 4]') == [[(0.0, 10.0), (5.0, 10.0), (5.0, 6.0), (0.0, 6.0)]]
    assert len(path_rings('["CIRCLE", 0, 0, 100]')[0]) == 32
    ring = path_rings('[0, 0, "L", 10, 0, 10, 10, "ARC", 90, 0, 10, "C", 0, 8, 0, 4, 0, 0]')[0]
    assert ring[:3] == [(0, 0), (10, 0), (10, 10)] and len(ring) == 3 + 23 + 16
    assert path_rings("[0, 0, 1]") == [] and path_rings("no json") == [] and path_rings(None) == [] and path_rings('{"a": 1}') == []
    assert len(path_rings('[[0,0,"L",1,0,1,1],[5,5,"L",6,5,6,6]]')) == 2


def test_snapshot_and_run_config(spark, tmp_path):
    body = {"vias": [{"net": "GND", "x": 100, "y": 100}, {"net": "GND", "x": 100.1, "y": 100}, {"net": "3V3", "x": None, "y": 1}], "pads": [{"net": "3V3", "layer": 12, "x": 1, "y": 1}, {"net": "X", "layer": 1, "x": 9, "y": 9}], "lines": [{"net": "3V3", "layer": 1, "startX": 0, "startY": 0, "endX": 5, "endY": 5}, {"net": "3V3", "layer": 3, "startX": 0, "startY": 0, "endX": 5, "endY": 5}], "pours": [{"net": "GND", "layer": 1, "polygon": "[0,0,\"L\",1000,0,1000,1000]"}]}
    (tmp_path / "s.json").write_text(json.dumps(body))
    tables = snapshot_tables(read_snapshots(spark, str(tmp_path / "s.json")))
    assert {n: t.count() for n, t in tables.items()} == {"vias": 1, "pads": 2, "tracks": 1, "pours": 1}
    layers = spark.createDataFrame([("s.json", 1, "TopLayer", 0.035), ("s.json", 2, "BottomLayer", None), ("s.json", 3, "Silk", None)], "board string, layer_id int, name string, thickness double")
    rails = spark.createDataFrame([("s.json", "3V3", 3.3, 0.2), ("s.json", "3V3", 3.3, 0.3)], "board string, net string, voltage double, current double")
    config = json.loads(run_config(tables, layers, rails).first().config)
    assert config["gnd_net"] == "GND" and config["rails"][0]["current"] == pytest.approx(0.5)
    assert [x["layer_id"] for x in config["layers"]] == [1, 2] and config["layers"][0]["conductance"] == pytest.approx(2082.5)
    assert len(config["pads"]) == 1 and config["pads"][0]["is_tht"]
    end = ("s.json", "3V3", "source", False, "U1", "TopLayer", 1.0, 2.0)
    ends = spark.createDataFrame([end, (*end[:3], True, "U1", None, 3.0, 4.0), (*end[:2], "load", False, "U2", None, 5.0, 6.0)], "board string, net string, kind string, is_ground boolean, ref_des string, layer string, x double, y double")
    text = run_config(tables, layers, rails, ends, 20.0).selectExpr("board as run", "config as value")
    back = config_tables(parse_configs(text))
    assert {r.kind: (r.want_net, r.layer, r.x, r.is_tht) for r in back["terminals"].filter("not is_ground").collect()} == {"source": ("3V3", "TopLayer", 1.0, False), "load": ("3V3", None, 5.0, True)}
    assert back["terminals"].filter("is_ground").first().want_net == "GND" and back["loads"].first().current == pytest.approx(0.5)
    assert [r.layer_names for r in back["vias"].collect()] == [["TopLayer", "BottomLayer"]] and back["tracks"].count() == 1 and back["copper_pours"].count() == 1
    run = back["runs"].first()
    assert run.temp_rise == 20.0 and run.bounds.maxX == pytest.approx(2.54) and {r.layer: r.thickness for r in back["thickness"].collect()} == {"TopLayer": 0.035, "BottomLayer": 0.035}


def test_layers_of_vias(spark):
    rows = [(None,), ("Blind: Top-Inner1",), ("Buried: Inner2 - Inner1",), ("Blind: Inner2-Bottom",), ("Blind: Nowhere-Bottom",), ("strange",)]
    names = F.array(*map(F.lit, ("Top Layer", "Inner1", "Inner2", "Bottom Layer")))
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(via_layers(F.col("t"), names)).collect()]
    every = ["Top Layer", "Inner1", "Inner2", "Bottom Layer"]
    assert got == [every, every[:2], every[1:3], every[2:], every, every]


def test_pieces_of_poured_copper():
    assert fill_rings("[0, 0, 2, 0, 2, 1]", None, None) == [[(0.0, 0.0), (20.0, 0.0), (20.0, 10.0)]]
    assert fill_rings("[[0,0,\"L\",9,0,9,9],[1,1,2,1,2,2]]", None, None)[1][0] == (10.0, 10.0)
    assert fill_rings("[0, 0, 4, 0]", None, 2.0) == [[(0.0, 10.0), (40.0, 10.0), (40.0, -10.0), (0.0, -10.0)]]
    assert fill_rings(None, [{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 5.0}], 2.0) == [[(-1.0, 0.0), (-1.0, 5.0), (1.0, 5.0), (1.0, 0.0)]]
    assert fill_rings(None, [{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 5.0}], None) == fill_rings(None, None, 1.0) == fill_rings("broken", None, 1.0) == []
