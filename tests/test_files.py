"""From an archive in inches and a configuration in millimetres to the answer."""

import io
import json
import tarfile

import pytest

from voltmill.functions.electrical import COPPER, SIGMA
from voltmill.plans.analyze import Settings
from voltmill.plans.files import analyze_files

S = SIGMA * COPPER
INCH = 1 / 25.4


def surface(x0, y0, x1, y1):
    points = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    text = [f"{x * INCH:.9f} {y * INCH:.9f}" for x, y in points]
    return f"S P 0\nOB {text[0]} I\n" + "\n".join(f"OS {p}" for p in text[1:]) + "\nOE\nSE\n"


@pytest.fixture(scope="module")
def answers(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    top = surface(0, 0, 12, 2) + surface(10, 0, 20, 2) + surface(0, 6, 20, 8)
    files = {
        "job/steps/pcb/eda/data": "LYR top bottom\nNET VCC\nFID C 0 0\nNET GND\nFID C 1 0\nNET VAUX\nFID C 0 2\n",
        "job/steps/pcb/layers/top/features": top, "job/steps/pcb/layers/bottom/features": surface(0, 0, 20, 8),
        "job/steps/pcb/profile": surface(-1, -1, 21, 9),
    }
    for board in ("one", "two"):
        with tarfile.open(folder / f"{board}.tgz", "w:gz") as tar:
            for name, text in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(text)
                tar.addfile(info, io.BytesIO(text.encode()))
    pad = lambda x, y, layer, tht=False: {"x": x, "y": y, "layer": layer, "is_tht": tht}
    row = lambda x, y, layer: [pad(x, y + d, layer) for d in (0.0, 1.0, 2.0)]
    body = {
        "gnd_net": "GND", "bounds": {"minX": -1.0, "minY": -1.0, "maxX": 21.0, "maxY": 9.0},
        "layers": [{"name": "Top", "conductance": S, "layer_id": 1}, {"name": "Bottom", "conductance": S, "layer_id": 2}], "layer_cu_thickness": {"Top": 0.07},
        "sources": [{"net": "VCC", "gnd_net": "GND", "voltage": 5.0, "pads": row(0, 0, "Top"), "gnd_pads": [pad(0.5, 4.0, "Bottom")]}, {"net": "VAUX", "gnd_net": "GND", "voltage": 3.0, "pads": row(0, 6, "Top"), "gnd_pads": [pad(0.5, 4.0, "Bottom")]}],
        "loads": [{"net": "VCC", "gnd_net": "GND", "current": 2.0, "pads": row(20, 0, "Top"), "gnd_pads": [pad(19.5, 4.0, None, True)]}, {"net": "VAUX", "gnd_net": "GND", "current": 1.0, "pads": row(20, 6, "Top"), "gnd_pads": [pad(19.5, 4.0, "Bottom")]}],
    }
    (folder / "one.json").write_text(json.dumps(body))
    lost = dict(body, loads=[dict(body["loads"][0], net="VCC", pads=[])])
    (folder / "two.json").write_text(json.dumps(lost))
    rows = analyze_files(spark, str(folder / "*.tgz"), str(folder / "*.json"), Settings(mesh_size=1.0), each_rail=True).collect()
    return {r.run: json.loads(r.response) for r in rows}


def test_runs_and_rails(answers):
    assert set(answers) == {"one", "one/VCC", "one/VAUX", "two", "two/VCC", "two/VAUX"}
    assert {k: a["success"] for k, a in answers.items()} == {"one": True, "one/VCC": True, "one/VAUX": True, "two": False, "two/VCC": False, "two/VAUX": True}
    assert "load 0 on net VCC" in answers["two"]["message"]


def potentials(answer, layer, net):
    meshes = next(x for x in answer["layer_solutions"] if x["layer_name"] == layer)["meshes"]
    return [(p, v) for m in meshes if m["net"] == net for p, v in zip(m["vertices"], m["potentials"])]


def test_answer(answers):
    whole = answers["one"]
    assert abs(whole["solver_info"]["ground_node_current"]) == pytest.approx(3.0, rel=1e-2)
    vcc, aux = potentials(whole, "Top", "VCC"), potentials(whole, "Top", "VAUX")
    assert max(v for _, v in vcc) == pytest.approx(5.0) and max(v for _, v in aux) == pytest.approx(3.0)
    assert 5.0 - min(v for _, v in vcc) == pytest.approx(2.0 * 20 / (S * 2), rel=0.04)  # in millimetres, whatever the archive's unit
    assert min(p[0] for p, _ in vcc) == pytest.approx(0.0, abs=1e-6) and max(p[0] for p, _ in vcc) == pytest.approx(20.0, abs=1e-6)
    alone = answers["one/VCC"]
    assert abs(alone["solver_info"]["ground_node_current"]) == pytest.approx(2.0, rel=1e-2) and not potentials(alone, "Top", "VAUX")


def test_members(answers):
    whole = answers["one"]
    assert set(whole) == {"success", "solver_info", "layer_solutions", "connection_points", "layer_boundaries", "layer_outlines", "diagnostics", "current_warnings"}
    assert len(whole["connection_points"]["Top"]) == 12 and sum(c["is_source"] for c in whole["connection_points"]["Top"]) == 6
    assert sorted(b["net"] for b in whole["layer_boundaries"]["Top"]) == ["VAUX", "VCC", "VCC"]
    assert len(whole["layer_outlines"]["Top"]) == 2
    assert any("polygons carry current" in d for d in whole["diagnostics"])
    on_top = [w["ounces"] for w in whole["current_warnings"] if w["layer"] == "Top"]
    assert on_top and all(o == pytest.approx(0.07 / (1.378 * 0.0254)) for o in on_top)
