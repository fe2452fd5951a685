"""Editor snapshots (JSON, lengths in mil) as tables, and run configurations made of them.

A snapshot has ``vias``, ``lines``, ``pads`` and ``pours``; a pour's ``polygon`` is a token path, decoded by
``path_rings``. Positions become millimetres. Primitives of equal net and position (to two digits) are one.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.electrical import COPPER, MIL, is_ground, sheet_conductance

# Default widths and diameters in mil, the layer number that means all layers, and copper layer numbers.
DEFAULTS = {"width": 10.0, "diameter": 23.622, "hole": 11.811, "pad": 23.622}
ALL_LAYERS = 12
COPPER_LAYERS = (1, 2, *range(15, 45))

SNAPSHOT = """struct<
 vias:array<struct<id:string,net:string,x:double,y:double,diameter:double,holeDiameter:double,viaType:string>>,
 lines:array<struct<id:string,net:string,layer:int,startX:double,startY:double,endX:double,endY:double,width:double>>,
 pads:array<struct<id:string,net:string,layer:int,x:double,y:double,holeDiameter:double,padNumber:string,refDes:string>>,
 pours:array<struct<id:string,net:string,layer:int,polygon:string>>,
 fills:array<struct<id:string,net:string,layer:int,polygon:string>>,
 poured:array<struct<pour_id:string,fills:array<struct<path:string,points:array<struct<x:double,y:double>>,lineWidth:double>>>>>"""
#: Fixed value: the paths of poured copper count in units of this many mil.
POURED_UNIT = 10.0


def _circle(x: float, y: float, r: float) -> list[tuple[float, float]]:
    n = 24 if r < 40 else 32 if r < 200 else 48
    return [(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]


def _arc(a: tuple[float, float], b: tuple[float, float], degrees: float) -> list[tuple[float, float]]:
    """Points behind a up to b on the arc that turns by ``degrees``, a point every 4 degrees, 8 to 48 of them."""
    turn = math.radians(degrees)
    chord = math.hypot(b[0] - a[0], b[1] - a[1])
    if abs(math.sin(turn / 2)) < 1e-9 or chord == 0:
        return [b]
    h = chord / 2 / math.tan(turn / 2)
    cx = (a[0] + b[0]) / 2 - h * (b[1] - a[1]) / chord
    cy = (a[1] + b[1]) / 2 + h * (b[0] - a[0]) / chord
    start, r = math.atan2(a[1] - cy, a[0] - cx), math.hypot(a[0] - cx, a[1] - cy)
    n = min(max(math.ceil(abs(degrees) / 4), 8), 48)
    return [(cx + r * math.cos(start + turn * i / n), cy + r * math.sin(start + turn * i / n)) for i in range(1, n)] + [b]


def path_rings(text: str | None) -> list[list[tuple[float, float]]]:
    """Rings of a token path: ``R x y w h`` rectangle, ``CIRCLE x y r``, else a start point followed by ``L`` and points,
    ``ARC`` or ``CARC`` with a turn in degrees and an end point (CARC the other way), ``C`` with the two control points
    and the end of a curve. Several paths may stand in one list. Rings of fewer than three points are dropped."""
    try:
        data = json.loads(text) if text else None
    except ValueError:
        return []
    if not isinstance(data, list):
        return []
    if data and all(isinstance(p, list) for p in data):
        return [r for p in data for r in path_rings(json.dumps(p))]
    ring: list[tuple[float, float]] = []
    at, mode = 0, "L"
    number = lambda k: float(data[at + k])
    rings = []
    try:
        while at < len(data):
            token = data[at]
            if isinstance(token, str) and not token.replace(".", "", 1).lstrip("-").isdigit():
                mode = token.upper()
                at += 1
                if mode == "R":
                    x, y, w, h = (number(k) for k in range(4))
                    rings.append([(x, y), (x + w, y), (x + w, y - h), (x, y - h)])
                    at, mode = at + 4, "L"
                elif mode == "CIRCLE":
                    rings.append(_circle(number(0), number(1), number(2)))
                    at, mode = at + 3, "L"
            elif mode in ("ARC", "CARC") and ring:
                end = (number(1), number(2))
                turn = number(0) if mode == "ARC" else -number(0)
                ring += _arc(ring[-1], end, turn)
                at += 3
            elif mode == "C" and ring:
                p = [ring[-1], *((number(k), number(k + 1)) for k in (0, 2, 4))]
                for i in range(1, 17):
                    t, u = i / 16, 1 - i / 16
                    w = (u**3, 3 * u * u * t, 3 * u * t * t, t**3)
                    ring.append((sum(a * q[0] for a, q in zip(w, p)), sum(a * q[1] for a, q in zip(w, p))))
                at += 6
            else:
                ring.append((number(0), number(1)))
                at += 2
    except (IndexError, ValueError, TypeError):
        pass
    if len(ring) >= 3:
        rings.append(ring)
    return rings


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))
def decoded_rings(paths: pd.Series) -> pd.Series:
    """``path_rings`` in millimetres, for a column."""
    return paths.map(lambda t: [[{"x": x * MIL, "y": y * MIL} for x, y in ring] for ring in path_rings(t)])


def fill_rings(path: str | None, points: list | None, width: float | None) -> list[list[tuple[float, float]]]:
    """Rings in mil of a piece of poured copper: its path in ``POURED_UNIT``, or else its points in mil, the first ring
    being the outline. Two points with a width are a rectangle."""
    if path:
        rings = path_rings(path)
        try:
            flat = json.loads(path)
        except ValueError:
            flat = []
        ends = [v for v in flat if isinstance(v, (int, float))] if isinstance(flat, list) else []
        pair = [tuple(ends[:2]), tuple(ends[2:])] if not rings and len(ends) == 4 else []
        unit = POURED_UNIT
    else:
        ring = [(q["x"], q["y"]) for q in (points if points is not None else []) if q and q["x"] is not None and q["y"] is not None]
        rings, pair, unit = ([ring] if len(ring) >= 3 else []), (ring if len(ring) == 2 else []), 1.0
    if pair and width and width > 0:
        (ax, ay), (bx, by) = pair
        length = math.hypot(bx - ax, by - ay)
        if length > 1e-10:
            u, v = -(by - ay) / length * width / 2, (bx - ax) / length * width / 2
            rings = [[(ax + u, ay + v), (bx + u, by + v), (bx - u, by - v), (ax - u, ay - v)]]
    return [[(x * unit, y * unit) for x, y in ring] for ring in rings]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))
def decoded_fills(paths: pd.Series, points: pd.Series, widths: pd.Series) -> pd.Series:
    """``fill_rings`` in millimetres, for columns."""
    return pd.Series([[[{"x": x * MIL, "y": y * MIL} for x, y in ring] for ring in fill_rings(a, b, c)] for a, b, c in zip(paths, points, widths)], dtype=object)


def poured_copper(snapshots: DataFrame) -> DataFrame:
    """``(board, id, net, layer, source, rings)``: copper of static fills (``fill``) and of pours as they were poured
    (``poured``), each piece on its own; a pour that was poured without any piece is its border (``border``). Pours that
    were never poured, and those without net, give no copper. Lengths become millimetres."""
    rows = lambda name: snapshots.select("board", F.explode(f"s.{name}").alias("m")).select("board", "m.*")
    named = lambda df: df.filter("trim(net) <> ''")
    whole = lambda df, source: df.select("board", "id", "net", "layer", F.lit(source).alias("source"), decoded_rings("polygon").alias("rings"))
    met = named(rows("pours")).join(rows("poured").withColumnRenamed("pour_id", "id"), ["board", "id"])
    pieces = met.select("board", "id", "net", "layer", F.explode("fills").alias("f"))
    pieces = pieces.select("board", "id", "net", "layer", F.lit("poured").alias("source"), decoded_fills("f.path", "f.points", "f.lineWidth").alias("rings"))
    every = whole(named(rows("fills")), "fill").unionByName(pieces).unionByName(whole(met.filter("size(fills) = 0"), "border"))
    return every.filter("size(rings) > 0 and size(rings[0]) >= 3")


def outer_layers(layers: DataFrame) -> DataFrame:
    """``layers (board, layer_id, ...)`` of copper with ``is_outer``: the least and the greatest number of each board."""
    copper = layers.filter(F.col("layer_id").isin(*COPPER_LAYERS))
    ends = copper.groupBy("board").agg(F.min("layer_id").alias("_first"), F.max("layer_id").alias("_last"))
    return copper.join(ends, "board").withColumn("is_outer", (F.col("layer_id") == F.col("_first")) | (F.col("layer_id") == F.col("_last"))).drop("_first", "_last")


def parse_snapshots(texts: DataFrame) -> DataFrame:
    """``(board, s)`` of ``(board, value)``; text that is no JSON gives no row."""
    return texts.select("board", F.from_json("value", SNAPSHOT).alias("s")).filter("s is not null")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """``parse_snapshots`` of JSON files; ``board`` is the file name."""
    return parse_snapshots(spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("board"), "value"))


def snapshot_tables(snapshots: DataFrame) -> dict[str, DataFrame]:
    """Vias, tracks, pads and pours in millimetres. Rows without position are dropped; the first of equal ones counts."""
    rows = lambda name: snapshots.select("board", F.posexplode(f"s.{name}").alias("no", "m")).select("board", "no", "m.*")
    mm = lambda c, default=None: (F.coalesce(c, F.lit(default)) if default is not None else F.col(c)) * MIL

    def first(df: DataFrame) -> DataFrame:
        key = [F.col("board"), F.coalesce("net", F.lit("")), F.round("x", 2), F.round("y", 2)]
        picked = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(key)]).agg(F.min(F.struct(*df.columns[1:2], *[c for c in df.columns if c != "no"])).alias("m"))
        return picked.select("m.*")

    vias = rows("vias").select("board", "no", "net", mm("x").alias("x"), mm("y").alias("y"), mm("diameter", DEFAULTS["diameter"]).alias("diameter"), mm("holeDiameter", DEFAULTS["hole"]).alias("hole_diameter"), F.col("viaType").alias("via_type"))
    pads = rows("pads").select("board", "no", "net", mm("x").alias("x"), mm("y").alias("y"), F.nullif("layer", F.lit(ALL_LAYERS)).alias("layer"), (F.coalesce("holeDiameter", F.lit(0.0)) * MIL).alias("hole_diameter"), F.col("padNumber").alias("pad_number"), F.col("refDes").alias("ref_des"))
    pads = pads.withColumn("is_tht", F.col("layer").isNull() | (F.col("hole_diameter") > 0))
    tracks = rows("lines").filter(F.col("layer").isin(*COPPER_LAYERS)).select("board", "no", "net", "layer", *[mm(a).alias(b) for a, b in (("startX", "x1"), ("startY", "y1"), ("endX", "x2"), ("endY", "y2"))], mm("width", DEFAULTS["width"]).alias("width")).dropna(subset=["x1", "y1", "x2", "y2"])
    pours = rows("pours").select("board", "no", "net", "layer", F.posexplode(decoded_rings("polygon")).alias("part", "vertices"))
    return {"vias": first(vias.dropna(subset=["x", "y"])), "pads": first(pads.dropna(subset=["x", "y"])), "tracks": tracks.drop("no"), "pours": pours.drop("no")}


def ground_net(tables: dict[str, DataFrame], rails: DataFrame) -> DataFrame:
    """``(board, ground)``: the ground name used most over vias, pads, tracks and pours, that is no rail."""
    every = None
    for name in ("vias", "pads", "tracks", "pours"):
        part = tables[name].select("board", "net")
        every = part if every is None else every.unionByName(part)
    counts = every.filter(is_ground(F.col("net"))).join(rails.select("board", "net"), ["board", "net"], "left_anti").groupBy("board", F.lower("net").alias("k")).agg(F.count("*").alias("n"), F.min("net").alias("net"))
    return counts.groupBy("board").agg(F.min(F.struct(-F.col("n"), "net")).alias("b")).select("board", F.col("b.net").alias("ground"))


def layer_table(layers: DataFrame) -> DataFrame:
    """Layers with their place in the stack (bottom, id 2, last) and sheet conductance from the copper thickness."""
    order = F.when(F.col("layer_id") == 2, 1_000_000).otherwise(F.col("layer_id"))
    return layers.filter(F.col("layer_id").isin(*COPPER_LAYERS)).withColumn("rank", order).withColumn("conductance", sheet_conductance(F.col("thickness"))).withColumn("thickness", F.coalesce("thickness", F.lit(COPPER)))


def via_layers(via_type: Column, names: Column) -> Column:
    """The layers a via joins, of the ``names`` from top to bottom: those between the two that the text of a blind or
    buried via tells (by a part of their names), or else all."""
    pattern = r"(?:Blind|Buried):\s*([^\s-]+)\s*-\s*([^\s-]+)"

    def place(group: int) -> Column:
        told = F.lower(F.regexp_extract(via_type, pattern, group))
        fits = lambda n: F.contains(F.lower(n), told) | F.contains(told, F.replace(F.lower(n), F.lit(" layer"), F.lit("")))
        at = F.filter(F.transform(names, lambda n, i: F.when(fits(n), i)), lambda i: i.isNotNull())
        return F.when(told != "", F.get(at, F.lit(0)))

    first, last = F.least(place(1), place(2)), F.greatest(place(1), place(2))
    return F.when(place(1).isNotNull() & place(2).isNotNull(), F.slice(names, first + 1, last - first + 1)).otherwise(names)


def run_config(tables: dict[str, DataFrame], layers: DataFrame, rails: DataFrame, ends: DataFrame | None = None, temp_rise: float = 10.0) -> DataFrame:
    """``(board, config)``: one JSON run configuration per board, as ``sources.config`` reads it.

    ``rails (board, net, voltage, current)``; a rail's current is the sum over its rows. ``ends (board, net, kind,
    is_ground, ref_des, layer, x, y)`` are the terminals of the ``source`` and ``load`` of each rail, those without layer
    going through the board; a rail without any of a kind has none. Vias and pads are those on the nets under analysis,
    the box is that of all. ``layers (board, layer_id, name, thickness)``.
    """
    ground = ground_net(tables, rails)
    nets = rails.select("board", "net").distinct().unionByName(ground.select("board", F.col("ground").alias("net")))
    on_nets = lambda name: tables[name].join(nets, ["board", "net"], "left_semi")
    gather = lambda df, name: df.groupBy("board").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "board"]))).alias(name))
    demand = rails.groupBy("board", "net").agg(F.max("voltage").alias("voltage"), F.sum("current").alias("current"))
    table = layer_table(layers)
    stack = table.select("board", F.col("rank").alias("position"), "name", "conductance", "layer_id", "thickness")
    names = stack.groupBy("board").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda s: s.getField("name")).alias("names"))
    by_id = table.select("board", F.col("layer_id").alias("layer"), F.col("name").alias("layer_name"))
    vias = on_nets("vias").join(names, "board", "left").select("board", "net", "x", "y", "hole_diameter", "diameter", "via_type", via_layers(F.col("via_type"), F.col("names")).alias("layer_names"))
    pads = on_nets("pads").join(by_id, ["board", "layer"], "left").select("board", "net", "x", "y", F.col("layer_name").alias("layer"), "is_tht", "hole_diameter", F.col("pad_number").alias("pin_name"))
    pours = tables["pours"].select("board", "net", "layer", "vertices")
    every = tables["pads"].select("board", "x", "y").unionByName(tables["vias"].select("board", "x", "y"))
    box = every.groupBy("board").agg(F.struct(F.min("x").alias("minX"), F.min("y").alias("minY"), F.max("x").alias("maxX"), F.max("y").alias("maxY")).alias("bounds"))
    copper = stack.groupBy("board").agg(F.map_from_entries(F.collect_list(F.struct("name", "thickness"))).alias("layer_cu_thickness"))

    parts = ground.join(box, "board", "left").join(copper, "board", "left")
    for df, name in ((vias, "vias"), (pads, "pads"), (stack.drop("thickness"), "layers"), (demand, "rails"), (tables["tracks"], "tracks"), (pours, "copper_pours")):
        parts = parts.join(gather(df, name), "board", "left")
    members = ["layers", "vias", "pads", "tracks", "copper_pours", "rails", "bounds", "layer_cu_thickness"]
    if ends is not None:
        pad = F.struct("ref_des", "x", "y", "layer", F.when(F.col("is_ground"), F.col("ground")).otherwise(F.col("net")).alias("net"), F.col("layer").isNull().alias("is_tht"))
        wired = ends.join(ground, "board").groupBy("board", "net", "kind", "ground").agg(F.sort_array(F.collect_list(F.when(~F.col("is_ground"), pad))).alias("pads"), F.sort_array(F.collect_list(F.when(F.col("is_ground"), pad))).alias("gnd_pads"))
        wired = wired.filter("size(pads) > 0").join(demand, ["board", "net"])
        for kind, value in (("source", "voltage"), ("load", "current")):
            one = wired.filter(F.col("kind") == kind).select("board", "net", value, F.col("ground").alias("gnd_net"), "pads", "gnd_pads")
            parts = parts.join(gather(one, f"{kind}s"), "board", "left")
            members.append(f"{kind}s")
    return parts.select("board", F.to_json(F.struct(F.col("ground").alias("gnd_net"), F.lit(float(temp_rise)).alias("temp_rise"), *members)).alias("config"))
