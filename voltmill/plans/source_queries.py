"""Queries on the sources: board archives, run configurations and editor snapshots.

The tables hold no archives, so each query first writes the records of a board in the format of the source, and then
reads them with the operators of ``sources``. The SQL looks at the tables only: what was written must be read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..sources import config, editor, odb
from ..tables import finite, known, layer_key, table
from .board_queries import MIL, located_pads
from .inventory_queries import once, r
from .inventory_sql import _CTE, _FAR, _FINITE
from .mesh_queries import ringed_pours

STEP = "job/steps/pcb"
TURN = 15  # degrees of the pads


def _text(x: Column) -> Column:
    return x.cast("string")


def _joined(rows: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """The lines of a file in order, as one text; a file holds one board's or layer's records."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda s: s[line]), "\n").alias("content"))


def numbered_features(spark: SparkSession, folder: str) -> DataFrame:
    """Pours, then pads, of a board's layer as numbered features with the text of their record and their net."""
    layers = F.broadcast(table(spark, folder, "layer_map").select(F.col("layer_id").alias("layer"), layer_key("layer_name").alias("name")))  # a fixed table
    ring = lambda v, kind: F.concat(F.lit("OB "), _text(v[0].x), F.lit(" "), _text(v[0].y), F.lit(f" {kind}\n"), F.array_join(F.transform(F.slice(v, F.lit(2), F.size(v) - 1), lambda p: F.concat(F.lit("OS "), _text(p.x), F.lit(" "), _text(p.y))), "\n"), F.lit("\nOE"))
    holes = F.transform(F.slice("rings", F.lit(2), F.size("rings") - 1), lambda h: ring(h, "H"))
    pours = ringed_pours(spark, folder).join(layers, "layer").select("board_id", F.col("name").alias("layer"), F.lit(0).alias("rank"), F.col("pour_id").alias("id"), "net", F.concat(F.lit("S P 0\n"), F.array_join(F.concat(F.array(ring(F.get("rings", F.lit(0)), "I")), holes), "\n"), F.lit("\nSE")).alias("record"))
    pads = located_pads(spark, folder).filter(finite("x") & finite("y")).dropDuplicates(["pad_id"]).withColumn("layer", layer_key("layer")).join(layers.select(F.col("name").alias("layer")), "layer")
    pads = pads.select("board_id", "layer", F.lit(1).alias("rank"), F.col("pad_id").alias("id"), known("net").alias("net"), F.concat(F.lit("P "), _text(F.col("x")), F.lit(" "), _text(F.col("y")), F.lit(f" 0 P {TURN}")).alias("record"))
    both = pours.unionByName(pads)
    return both.withColumn("feature_no", F.row_number().over(Window.partitionBy("board_id", "layer").orderBy("rank", "id")) - 1)


def archive(spark: SparkSession, folder: str) -> DataFrame:
    """``(board, path, content)``: the files of every board's archive."""
    board = _text(F.col("board_id")).alias("board")
    found = numbered_features(spark, folder)
    copper = _joined(found, ["board_id", "layer"], "feature_no", "record").select(board, F.concat(F.lit(f"{STEP}/layers/"), "layer", F.lit("/features")).alias("path"), F.concat(F.lit("$0 rect500x300\n#Layer features\n"), "content").alias("content"))

    stack = table(spark, folder, "layer_map").select("layer_id", layer_key("layer_name").alias("layer"), (F.row_number().over(Window.orderBy("layer_id")) - 1).alias("layer_no"))  # a fixed table
    names = stack.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer_no", "layer"))), lambda s: s.layer), " ").alias("names"))
    refs = found.filter("net is not null").join(F.broadcast(stack.select("layer", "layer_no")), "layer")
    refs = refs.withColumn("line", F.concat(F.lit("NET "), "net", F.lit(" ;attr\nFID C "), _text(F.col("layer_no")), F.lit(" "), _text(F.col("feature_no"))))
    data = _joined(refs, ["board_id"], "id", "line").crossJoin(F.broadcast(names)).select(board, F.lit(f"{STEP}/eda/data").alias("path"), F.concat(F.lit("LYR "), "names", F.lit("\n"), "content").alias("content"))

    pins = located_pads(spark, folder).filter(finite("x") & finite("y")).dropDuplicates(["pad_id"]).withColumn("line", F.concat(F.lit("TOP 0 "), _text(F.col("x")), F.lit(" "), _text(F.col("y")), F.lit(" "), _text(F.pmod("pad_id", F.lit(360)))))
    pins = _joined(pins, ["board_id"], "pad_id", "line").select(board, F.lit(f"{STEP}/layers/comp_+_top/components").alias("path"), "content")

    holes = once(spark, folder, "vias", "board_id", "x", "y", "hole_diameter", "via_type").filter((F.col("hole_diameter") > 0) & finite("x") & finite("y") & finite("hole_diameter"))
    sizes = holes.select("board_id", "hole_diameter").distinct().withColumn("symbol", F.row_number().over(Window.partitionBy("board_id").orderBy("hole_diameter")) - 1)
    symbols = _joined(sizes.withColumn("line", F.concat(F.lit("$"), _text(F.col("symbol")), F.lit(" r"), _text(F.round(F.col("hole_diameter") * 1000, 3)))), ["board_id"], "symbol", "line").withColumnRenamed("content", "symbols")
    drills = holes.join(sizes, ["board_id", "hole_diameter"]).withColumn("line", F.concat(F.lit("P "), _text(F.col("x")), F.lit(" "), _text(F.col("y")), F.lit(" "), _text(F.col("symbol")), F.lit(" P "), F.when(F.col("via_type").isNotNull(), "1").otherwise("2")))
    drills = _joined(drills, ["board_id"], "via_id", "line").join(symbols, "board_id")
    path = f"{STEP}/layers/drill_top_bottom"
    tools = drills.select(board, F.lit(f"{path}/tools").alias("path"), F.lit("UNITS=MM\nNUM=1\nTYPE=VIA\nNUM=2\nTYPE=PLATED").alias("content"))
    drills = drills.select(board, F.lit(f"{path}/features").alias("path"), F.concat("symbols", F.lit("\n"), "content").alias("content"))
    return copper.unionByName(data).unionByName(pins).unionByName(tools).unionByName(drills)


def archive_nets(spark: SparkSession, folder: str) -> DataFrame:
    """The features that nets name, read from the net lists."""
    return odb.net_references(archive(spark, folder)).select("board", "layer", F.col("feature_no").cast("long").alias("feature_no"), "net")


def archive_rotations(spark: SparkSession, folder: str) -> DataFrame:
    """Rotations of component pins by position."""
    return odb.component_rotations(archive(spark, folder))


def archive_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Drill tools and their types."""
    return odb.tools(archive(spark, folder)).select("board", "tool_no", "type")


def archive_drills(spark: SparkSession, folder: str) -> DataFrame:
    """Holes with their size and whether their tool is for vias."""
    return odb.drills(archive(spark, folder)).select("board", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), r(F.col("diameter"), 6).alias("diameter"), "is_via")


def archive_features(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered copper records with the symbol of pads."""
    found = odb.features(archive(spark, folder).filter("path not like '%drill%'"))
    return found.select("board", "layer", F.col("feature_no").cast("long").alias("feature_no"), "kind", F.col("symbol.kind").alias("symbol"), F.col("symbol.w").alias("w"), F.col("symbol.h").alias("h"))


def archive_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Copper polygons of the archives with their nets and areas."""
    found = odb.board_polygons(archive(spark, folder))
    return found.select("board", "layer", "feature_no", "net", (F.size("rings") - 1).cast("long").alias("holes"), r(geo.polygon_area("rings"), 3).alias("area"))


def found_files(spark: SparkSession, folder: str) -> DataFrame:
    """The net list of each archive, found by a part of its path."""
    return odb.find_files(archive(spark, folder), "/EDA/", "/data").select("board", "path")


# --- run configurations -------------------------------------------------------------------------------------------


def configurations(spark: SparkSession, folder: str) -> DataFrame:
    """``(run, value)``: the JSON configuration of each board's run."""
    of = lambda rows, name, *fields: rows.groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    boards = once(spark, folder, "sources", "board_id").select("board_id").unionByName(once(spark, folder, "loads", "board_id").select("board_id")).dropna().distinct()
    sources = of(once(spark, folder, "sources", "board_id", "net", "voltage", "gnd_net", "ref_des", "pads", "gnd_pads"), "sources", F.col("source_id").alias("id"), "net", "voltage", "gnd_net", "ref_des", "pads", "gnd_pads")
    loads = of(once(spark, folder, "loads", "board_id", "net", "load_current", "gnd_net", "ref_des", "pads", "gnd_pads"), "loads", F.col("load_id").alias("id"), "net", F.col("load_current").alias("current"), "gnd_net", "ref_des", "pads", "gnd_pads")
    vias = of(once(spark, folder, "vias", "board_id", "x", "y", "hole_diameter", "diameter", "layer_names", "net", "via_type").filter(finite("x") & finite("y")), "vias", F.col("via_id").alias("id"), "x", "y", "hole_diameter", "diameter", "layer_names", "net", "via_type")
    layers = table(spark, folder, "layer_map").groupBy().agg(F.array_sort(F.collect_list(F.struct("layer_id", F.col("layer_name").alias("name"), "conductance"))).alias("layers"))  # a fixed table
    whole = boards.join(sources, "board_id", "left").join(loads, "board_id", "left").join(vias, "board_id", "left").crossJoin(F.broadcast(layers))
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("minX", -1.0), ("minY", -2.0), ("maxX", 3.0), ("maxY", 4.0))]).alias("bounds")
    return whole.select(_text(F.col("board_id")).alias("run"), F.to_json(F.struct(F.lit("GND").alias("gnd_net"), "layers", "sources", "loads", "vias", box)).alias("value"))


def config_terminals(spark: SparkSession, folder: str) -> DataFrame:
    """Terminals of the elements of each run, with the net they want."""
    found = config.config_tables(config.parse_configs(configurations(spark, folder)))["terminals"].filter(finite("x") & finite("y"))
    return found.select("run", "kind", F.col("element_no").cast("long").alias("element_no"), "is_ground", "want_net", F.col("pad_no").cast("long").alias("pad_no"), "layer", r(F.col("x"), 6).alias("x"), r(F.col("y"), 6).alias("y"))


def config_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The nets each run asks for, the ground net included."""
    return config.target_nets(config.config_tables(config.parse_configs(configurations(spark, folder))))


def config_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with the number of their members, defaults filled in, and the box of the editor."""
    found = config.config_tables(config.parse_configs(configurations(spark, folder)))
    count = lambda name: found[name].groupBy("run").agg(F.count("*").alias(name))
    runs = found["runs"].select("run", "gnd_net", "temp_rise", (F.col("bounds.maxX") - F.col("bounds.minX")).alias("width"))
    for name in ("layers", "vias", "sources", "loads"):
        runs = runs.join(count(name), "run", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return runs


# --- editor snapshots ---------------------------------------------------------------------------------------------


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """``(board, value)``: the JSON snapshot of each board in mil, pours as token paths."""
    mil = lambda c: F.col(c) / MIL
    vias = once(spark, folder, "vias", "board_id", "net", "x", "y", "diameter", "hole_diameter").filter(finite("x") & finite("y"))
    vias = vias.groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct(_text(F.col("via_id")).alias("id"), "net", mil("x").alias("x"), mil("y").alias("y"), mil("diameter").alias("diameter"), mil("hole_diameter").alias("holeDiameter")))).alias("vias"))
    point = lambda p: F.concat(_text(p.x / MIL), F.lit(","), _text(p.y / MIL))
    pours = once(spark, folder, "copper_pours", "board_id", "net", "layer", "vertices").filter("size(vertices) >= 3")
    path = F.concat(F.lit("["), point(F.get("vertices", F.lit(0))), F.lit(',"L",'), F.array_join(F.transform(F.slice("vertices", F.lit(2), F.size("vertices") - 1), point), ","), F.lit("]"))
    pours = pours.groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct(_text(F.col("pour_id")).alias("id"), "net", "layer", path.alias("polygon")))).alias("pours"))
    return vias.join(pours, "board_id", "full").select(_text(F.col("board_id")).alias("board"), F.to_json(F.struct("vias", "pours")).alias("value"))


def snapshot_vias(spark: SparkSession, folder: str) -> DataFrame:
    """Vias of the snapshots in millimetres, one for each net and position to two digits, counted per board."""
    found = editor.snapshot_tables(editor.parse_snapshots(snapshots(spark, folder)))["vias"]
    return found.groupBy("board").agg(F.count("*").alias("vias"), r(F.min("x")).alias("min_x"), r(F.max("y")).alias("max_y"))


def snapshot_pours(spark: SparkSession, folder: str) -> DataFrame:
    """Pours of the snapshots, decoded from their paths: area and points."""
    found = editor.snapshot_tables(editor.parse_snapshots(snapshots(spark, folder)))["pours"]
    return found.groupBy("board", "layer").agg(F.count("*").alias("pours"), r(F.sum(F.abs(geo.ring_area("vertices"))), 2).alias("area"), F.sum(F.size("vertices")).alias("points"))


def poured_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Copper of pours as poured: those with cut-outs as one piece in the unit of poured copper, the others, which were
    poured without any piece, by their border."""
    path = lambda ring, unit: F.concat(F.lit("["), F.array_join(F.transform(ring, lambda p: F.concat(_text(p.x / MIL / unit), F.lit(","), _text(p.y / MIL / unit))), ","), F.lit("]"))
    pours = ringed_pours(spark, folder).filter("net is not null").withColumn("id", _text(F.col("pour_id")))
    piece = F.struct(F.concat(F.lit("["), F.array_join(F.transform("rings", lambda ring: path(ring, editor.POURED_UNIT)), ","), F.lit("]")).alias("path"))
    fills = F.when(F.size("rings") > 1, F.array(piece)).otherwise(F.array().cast("array<struct<path:string>>"))
    rows = pours.groupBy("board_id").agg(F.collect_list(F.struct("id", "net", "layer", path(F.get("rings", F.lit(0)), 1.0).alias("polygon"))).alias("pours"), F.collect_list(F.struct(F.col("id").alias("pour_id"), fills.alias("fills"))).alias("poured"))
    found = editor.poured_copper(editor.parse_snapshots(rows.select(_text(F.col("board_id")).alias("board"), F.to_json(F.struct("pours", "poured")).alias("value"))))
    return found.select("board", F.col("id").cast("long").alias("pour_id"), "net", "layer", "source", (F.size("rings") - 1).cast("long").alias("holes"), r(F.abs(geo.ring_area(F.get("rings", F.lit(0)))), 2).alias("area"))


def outer_layers(spark: SparkSession, folder: str) -> DataFrame:
    """The copper layers of every board that has vias, and which are outer ones."""
    boards = once(spark, folder, "vias", "board_id").select(_text(F.col("board_id")).alias("board")).dropna().distinct()
    layers = boards.crossJoin(F.broadcast(table(spark, folder, "layer_map").select("layer_id")))  # a fixed table
    return editor.outer_layers(layers)


QUERIES = {f.__name__: f for f in (archive_nets, archive_rotations, archive_tools, archive_drills, archive_features, archive_polygons, found_files, config_terminals, config_targets, config_runs, snapshot_vias, snapshot_pours, poured_pieces, outer_layers)}

_FEATURES = (
    _CTE
    + f""", fe as (select board_id, ln layer, 0 k, pour_id id, nullif(c.net, '') net from c join lm on c.layer = lm.layer_id where len(vertices) >= 3 union all
      select board_id, ln, 1, pad_id, nullif(net, '') from p join lm on lower(trim(p.layer)) = ln where {_FINITE}),
    nf as (select *, row_number() over (partition by board_id, layer order by k, id) - 1 feature_no from fe),
    hz as (select pour_id, count(*) holes, sum(a) area from (select pour_id, h, abs(sum(h[i].x * h[i % len(h) + 1].y - h[i % len(h) + 1].x * h[i].y)) / 2 a from (select pour_id, h, unnest(range(1, len(h) + 1)) i from (select pour_id, unnest(holes) h from c) where len(h) >= 3) group by all) group by 1)
"""
)
_HOLES = f"vh as (select * from v where {_FINITE} and {_FAR.format('hole_diameter')} and hole_diameter > 0)"
_RUNS = _CTE + ", bo as (select board_id from so union select board_id from lo), cs as (select *, row_number() over (partition by board_id order by source_id) - 1 no from so), cl as (select *, row_number() over (partition by board_id order by load_id) - 1 no from lo)"

ORACLES = {
    "archive_nets": _FEATURES + "select board_id::varchar board, layer, feature_no, trim(net) net from nf where net is not null",
    "archive_rotations": _CTE + f"select board_id::varchar board, round(px, 6) x, round(py, 6) y, arg_max(pad_id % 360, pad_id)::double degrees from p where {_FINITE} group by 1, 2, 3",
    "archive_tools": _CTE + f", {_HOLES} select board_id::varchar board, unnest([1, 2])::integer tool_no, unnest(['VIA', 'PLATED']) as \"type\" from (select distinct board_id from vh)",
    "archive_drills": _CTE + f", {_HOLES} select board_id::varchar board, round(x, 4) x, round(y, 4) y, round(hole_diameter, 6) diameter, via_type is not null is_via from vh",
    "archive_features": _FEATURES + "select board_id::varchar board, layer, feature_no, case when k = 0 then 'S' else 'P' end kind, case when k = 1 then 'rect' end symbol, case when k = 1 then 0.5::double end w, case when k = 1 then 0.3::double end h from nf",
    "archive_polygons": _FEATURES + """select nf.board_id::varchar board, nf.layer, feature_no, coalesce(trim(nf.net), '') net, coalesce(holes, 0) holes, round(case when k = 1 then 0.15 else abs(a) - coalesce(hz.area, 0) end, 3) area
      from nf left join ga on k = 0 and ga.pour_id = id left join hz on k = 0 and hz.pour_id = id""",
    "found_files": _FEATURES + f"select distinct board_id::varchar board, '{STEP}/eda/data' path from nf where net is not null",
    "config_terminals": _RUNS + f""", cp as (select board_id, 'source' kind, no, false g, net, unnest(range(len(pads))) i, unnest(pads) q from cs union all select board_id, 'source', no, true, gnd_net, unnest(range(len(gnd_pads))), unnest(gnd_pads) from cs union all
      select board_id, 'load', no, false, net, unnest(range(len(pads))), unnest(pads) from cl union all select board_id, 'load', no, true, gnd_net, unnest(range(len(gnd_pads))), unnest(gnd_pads) from cl)
      select board_id::varchar run, kind, no element_no, g is_ground, coalesce(net, '') want_net, i pad_no, q.layer layer, round(q.x, 6) x, round(q.y, 6) y from cp where board_id is not null and {_FAR.format('q.x')} and {_FAR.format('q.y')}""",
    "config_targets": _RUNS + "select board_id::varchar run, net from tn union select board_id::varchar, 'GND' from bo where board_id is not null",
    "config_runs": _RUNS + f"""select board_id::varchar run, 'GND' gnd_net, 10.0::double temp_rise, 4.0::double width, 6::bigint layers, (select count(*) from v where v.board_id = bo.board_id and {_FINITE}) vias,
      (select count(*) from so where so.board_id = bo.board_id) sources, (select count(*) from lo where lo.board_id = bo.board_id) loads from bo where board_id is not null""",
    "snapshot_vias": _CTE + f"select board_id::varchar board, count(*) vias, round(min(x), 4) min_x, round(-min(-y), 4) max_y from (select board_id, coalesce(net, '') net, round(x, 2) kx, round(y, 2) ky, min(x) x, min(y) y from v where {_FINITE} group by all) group by 1",
    "snapshot_pours": _CTE + "select board_id::varchar board, layer, count(*) pours, round(sum(abs(a)), 2) area, sum(n)::bigint points from ga where n >= 3 group by 1, 2",
    "poured_pieces": _FEATURES + """select board_id::varchar board, c.pour_id, c.net, layer, case when coalesce(hz.holes, 0) > 0 then 'poured' else 'border' end source, coalesce(hz.holes, 0) holes, round(abs(a), 2) area
      from (select pour_id, board_id, net, layer from c where len(vertices) >= 3 and net <> '') c join ga using (pour_id, board_id, net, layer) left join hz on hz.pour_id = c.pour_id""",
    "outer_layers": _CTE + "select board_id::varchar board, layer_id, layer_id = (select min(layer_id) from lm) or layer_id = (select max(layer_id) from lm) is_outer from (select distinct board_id from v where board_id is not null), lm",
}
