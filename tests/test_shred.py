import json

import pytest

from voltmill.operators import shred as shredding
from voltmill.operators.shred import ANALYSIS, MANY, ONE, Child, Element, inline, parse, shred


def tables(spark, payloads, want=None):
    rows = [(i, p, "x") for i, p in enumerate(payloads)]
    frame = spark.createDataFrame(rows, "solution_id long, payload string, layer_no string")
    docs = frame.select("solution_id", parse("payload", "result", "layer_solutions").alias("v"))
    return shred(docs, "solution_id", "v", ANALYSIS, "analysis", want)


MESH = {"net": "A", "vertices": [[0, 1.5], {"x": 2, "y": 3}, None], "triangles": [{"vertices": [0, 1, 2]}, None, [2, 1, 0]], "potentials": ["1.5", 2], "current_densities": [[1, 2], None, [3, 4], [9, 9]]}


def triangles(spark, payload):
    return sorted(tuple(r) for r in tables(spark, [payload], {"triangle"})["triangle"].drop("solution_id", "role").collect())


def test_usual_and_unusual_forms_agree(spark):
    usual = {"success": True, "layer_solutions": [{"layer_name": "Top", "meshes": [MESH]}]}
    expected = triangles(spark, json.dumps(usual))
    assert expected == [(0, 0, 0, 0, 1, 2, None, 1.0, 2.0), (0, 0, 2, 2, 1, 0, None, 3.0, 4.0)]
    layer = usual["layer_solutions"][0]
    for form in (
        {"result": usual}, [layer], {"result": json.dumps(usual)}, {**usual, "layer_solutions": json.dumps([layer])},
        {**usual, "layer_solutions": [json.dumps(layer)]}, {**usual, "layer_solutions": [{**layer, "meshes": MESH}]},
        {**usual, "layer_solutions": [{**layer, "meshes": json.dumps([json.dumps(MESH)])}]}, {**usual, "layer_solutions": layer},
    ):
        assert triangles(spark, json.dumps(form)) == expected, form
        assert triangles(spark, "﻿ \n" + json.dumps(form)) == expected
    assert triangles(spark, json.dumps(json.dumps(usual))) == expected


def test_no_payload_no_rows(spark):
    whole = json.dumps({"layer_solutions": [{"meshes": [MESH]}]})
    out = tables(spark, [None, "", "   ", "null", '"null"', whole[:-9], "{}", "[]", "text", '{"layer_solutions": null}', '{"layer_solutions": 5}'])
    assert all(out[t].count() == 0 for t in ("layer", "mesh", "vertex", "triangle"))
    assert out["analysis"].count() == 4


def test_parents_and_parallel_values(spark):
    body = json.dumps({"message": "ok", "solver_info": {"residual_norm": 1e-9}, "diagnostics": ["a", None, "b"], "layer_solutions": [None, {"layer_name": "L", "meshes": [None, MESH], "disconnected_meshes": [MESH]}]})
    out = {n: sorted((tuple(r) for r in t.drop("solution_id").collect()), key=str) for n, t in tables(spark, [body]).items()}
    assert out["analysis"] == [(None, "ok", None, 1e-9)]
    assert out["diagnostic"] == [(0, "a"), (2, "b")]
    assert out["layer"] == [(1, "L")]
    assert out["mesh"] == [(1, "disconnected_meshes", 0, "A", None), (1, "meshes", 1, "A", None)]
    assert out["vertex"][-2:] == [(1, 1, "meshes", 0, 0.0, 1.5, 1.5), (1, 1, "meshes", 1, 2.0, 3.0, 2.0)]
    assert len(out["triangle"]) == 4


def test_very_long_payload(spark):
    mesh = {"triangles": [[i, i + 1, i + 2] for i in range(100_000)], "net": "é" * 100_000}
    out = tables(spark, [json.dumps({"layer_solutions": [{"meshes": [mesh]}]}), json.dumps({"layer_solutions": [{"meshes": [mesh]}]})], {"triangle"})
    assert out["triangle"].count() == 200_000


def test_inlining_rules():
    graph = {
        "r": Element(children=(Child("one", "a", ONE), Child("many", "b"), Child("s1", "s", ONE), Child("s2", "s", ONE))),
        "a": Element({"v": ("string", (".v",))}, (Child("inner", "c", ONE),)),
        "b": Element({"w": ("string", (".w",))}),
        "c": Element({"z": ("string", (".z",))}),
        "s": Element({"q": ("string", (".q",))}, (Child("sub", "s"),)),
    }
    got = inline(graph, "r")
    assert list(got) == ["r", "b", "s"]
    assert got["r"].columns == {"one_v": ("string", (".one.v",)), "one_inner_z": ("string", (".one.inner.z",))}
    assert got["s"].recursive and got["s"].shared and not got["b"].shared
    with pytest.raises(ValueError):
        inline({"r": Element(children=(Child("x", "missing", MANY),))}, "r")


def test_recursion(spark):
    graph = {"doc": Element(children=(Child("root", "node", ONE),)), "node": Element({"name": ("string", (".name",))}, (Child("kids", "node"),))}
    body = json.dumps({"root": {"name": "a", "kids": [{"name": "b"}, None, {"name": "c", "kids": [{"name": "d"}]}]}})
    docs = spark.createDataFrame([(1, body), (2, "{}"), (3, None)], "id long, j string").selectExpr("id", "try_parse_json(j) as v")
    rows = {r.name: r for r in shred(docs, "id", "v", graph, "doc")["node"].collect()}
    assert set(rows) == {"a", "b", "c", "d"}
    assert rows["a"].parent_path is None and rows["d"].parent_path == rows["c"].node_path and rows["c"].position == 2


def test_large_documents_are_cut(spark, monkeypatch):
    """Documents beyond the parser's size give the same tables, in all their forms."""
    usual = {"success": True, "message": "m", "solver_info": {"residual_norm": 0.5}, "layer_solutions": [None, {"layer_name": "Top", "meshes": [None, MESH, json.dumps(MESH)], "disconnected_meshes": MESH}, json.dumps({"layer_name": "B", "meshes": [MESH]})]}
    payloads = [json.dumps(p) for p in (usual, {"result": usual}, usual["layer_solutions"], {"result": json.dumps(usual)}, {**usual, "success": False})] + ["log: " + json.dumps(usual), json.dumps(usual)[:-20], None, "", "   "]
    frame = spark.createDataFrame(list(enumerate(payloads)), "solution_id long, payload string")

    def all_tables():
        cut = shredding.cut_large(frame, "solution_id", "payload", "result", "layer_solutions", ("meshes", "disconnected_meshes"), ("success",))
        out = {}
        for kind, names in (("head", {"analysis", "layer"}), ("part", {"mesh", "vertex", "triangle"})):
            docs = cut.filter(f"kind is null or kind = '{kind}'").select("solution_id", parse("payload", "result", "layer_solutions").alias("v"))
            out |= {n: sorted(map(str, t.collect())) for n, t in shred(docs, "solution_id", "v", ANALYSIS, "analysis", names).items()}
        return out

    whole = all_tables()
    assert whole["triangle"] and whole["layer"] and whole["analysis"]
    monkeypatch.setattr(shredding, "LARGE", 100)
    assert all_tables() == whole
    monkeypatch.setattr(shredding, "LARGEST", 50)
    with pytest.raises(Exception, match="more than can be parsed"):
        all_tables()
