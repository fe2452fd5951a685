import json

import pytest

from voltmill.functions.electrical import COPPER, SIGMA
from voltmill.operators.shred import ANALYSIS, parse, shred
from voltmill.plans.analyze import Settings, analyze, meshes_within, response, shown_meshes

S = SIGMA * COPPER


def box(x, y, w, h):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


@pytest.fixture(scope="module")
def solved(spark):
    """Two runs: power strip on top, return strip below, source on the left, load on the right; the second's load is
    twice as high. A piece of foreign copper floats."""
    rings = "array<array<struct<x:double,y:double>>>"
    polygons, layers, elements, terminals = [], [], [], []
    for run, amps in (("r1", 1.0), ("r2", 2.0)):
        polygons += [(run, "TopLayer", "VCC", [box(0, 0, 12, 2)]), (run, "TopLayer", "VCC", [box(10, 0, 10, 2)]), (run, "BottomLayer", "GND", [box(0, 0, 20, 2)]), (run, "TopLayer", "NC", [box(0, 5, 2, 2)]), (run, "TopLayer", "NC", [box(50, 5, 0.05, 0.05)])]
        layers += [(run, "TopLayer", 0, S, COPPER), (run, "BottomLayer", 1, S, COPPER)]
        elements += [(run, "source", 1, "VCC", "GND", 5.0), (run, "load", 1, "VCC", "GND", amps)]
        terminals += [(run, "source", 1, False, i, "TopLayer", 0.0, y) for i, y in enumerate((0.0, 1.0, 2.0))] + [(run, "source", 1, True, i, "BottomLayer", 0.0, y) for i, y in enumerate((0.0, 1.0, 2.0))]
        terminals += [(run, "load", 1, False, i, "TopLayer", 20.0, y) for i, y in enumerate((0.0, 1.0, 2.0))] + [(run, "load", 1, True, 0, None, 20.0, 1.0)]
    tables = {
        "polygons": spark.createDataFrame(polygons, f"run string, layer string, net string, rings {rings}"),
        "layers": spark.createDataFrame(layers, "run string, layer string, position int, conductance double, thickness double"),
        "vias": spark.createDataFrame([("r1", 1, "VCC", 10.0, 1.0, 0.3, ["TopLayer", "BottomLayer"])], "run string, via_id long, net string, x double, y double, hole_diameter double, layers array<string>"),
        "tracks": spark.createDataFrame([("r1", 1, "VCC", "TopLayer", 5.0, 1.0, 6.0, 1.0, 0.1)], "run string, track_id long, net string, layer string, x1 double, y1 double, x2 double, y2 double, width double"),
        "elements": spark.createDataFrame(elements, "run string, kind string, element_id long, net string, gnd_net string, value double"),
        "terminals": spark.createDataFrame(terminals, "run string, kind string, element_id long, is_ground boolean, pad_no int, layer string, x double, y double"),
    }
    return analyze(tables, Settings(mesh_size=0.9))


def test_drop_along_a_strip(solved):
    info = {r.run: r for r in solved["info"].collect()}
    assert all(r.message is None and r.residual_norm < 1e-6 * 5 * S for r in info.values()), info  # the solver stops at 1e-7 of the right-hand side
    low = {(r.run, r.net): r for r in solved["ranges"].collect()}
    assert low["r1", "VCC"].meshes == 1 and low["r1", "VCC"].high == pytest.approx(5.0)
    for run, amps in (("r1", 1.0), ("r2", 2.0)):
        drop = 5.0 - low[run, "VCC"].low
        assert drop == pytest.approx(amps * 20 / (S * 2), rel=0.03)
        assert abs(info[run].ground_current) == pytest.approx(amps, rel=1e-3)
    assert ("r1", "NC") not in low  # no target net


def test_fields_and_warnings(solved):
    mid = solved["triangles"].filter("run = 'r2' and net = 'VCC'").join(solved["vertices"].selectExpr("poly", "v as a", "x"), ["poly", "a"]).filter("x between 8 and 12")
    row = mid.selectExpr("avg(jx) j", "avg(power_density) p").first()
    assert row.j == pytest.approx(1.0, rel=0.05)  # 2 A over 2 mm
    assert row.p == pytest.approx(1.0 / S, rel=0.1)
    warned = solved["warnings"].collect()
    assert {(w.run, w.layer) for w in warned} == {(run, layer) for run in ("r1", "r2") for layer in ("TopLayer", "BottomLayer")}
    on_top = next(w for w in warned if (w.run, w.layer) == ("r1", "TopLayer"))
    assert on_top.exceeded and on_top.width == pytest.approx(0.1) and "VCC on TopLayer" in on_top.message  # its own track
    assert all(w.width == pytest.approx(0.2) for w in warned if w.layer == "BottomLayer")  # estimated from the copper


def test_response_can_be_shredded(spark, solved):
    rows = response(solved)
    body = {r.run: json.loads(r.response) for r in rows.collect()}
    assert body["r1"]["success"] and {x["layer_name"] for x in body["r1"]["layer_solutions"]} == {"TopLayer", "BottomLayer"}
    back = shred(rows.select("run", parse("response", "result", "layer_solutions").alias("v")), "run", "v", ANALYSIS, "analysis", {"triangle"})["triangle"]
    assert back.count() == solved["triangles"].count()


def test_budgets(spark):
    rings = "array<array<struct<x:double,y:double>>>"
    copper = spark.createDataFrame([("a", "T", "N", "p", [box(0, 0, 20, 20)]), ("b", "T", "N", "q", [box(0, 0, 2, 2)]), ("b", "T", "N", "s", [box(5, 0, 20, 20)])], f"run string, layer string, net string, poly string, rings {rings}")
    v, t, over = meshes_within(copper, 1.0, most=200)
    assert over.count() == 0 and [r.run for r in meshes_within(copper, 1.0, most=200, attempts=1)[2].orderBy("run").collect()] == ["a", "b"]
    counts = {r.run: r["count"] for r in v.groupBy("run").count().collect()}
    assert set(counts) == {"a", "b"} and max(counts.values()) <= 200 and t.count() > 50
    shown, _ = shown_meshes(copper, copper.filter("poly = 'p'"), 1.0, most=60)
    assert {r.poly for r in shown.select("poly").distinct().collect()} == {"q"}


def test_the_answer_reads_written_tables(solved):
    """What the answer joins is computed before, so that its own plan stays small."""
    for name in ("triangles", "warnings", "diagnostics"):
        assert "Join" not in str(solved[name]._jdf.queryExecution().optimizedPlan()), name
    for name in ("shown", "shown_triangles"):
        assert "MapInArrow" not in str(solved[name]._jdf.queryExecution().optimizedPlan()), name
