"""One query per relational operator of the analysis, over the board tables.

Rows of one id that were delivered twice count once. Numbers are rounded to what the tables carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import electrical as el
from ..functions import geometry as geo
from ..operators import linear as la
from ..operators.graph import propagated
from ..operators.spatial import near_or_inside
from ..tables import finite, known, layer_key, layer_keys, once_per_key, table
from .board_queries import MIL, located_pads, solution_tables

KEYS = {"vias": "via_id", "pads": "pad_id", "copper_pours": "pour_id", "layer_shapes": "shape_id", "sources": "source_id", "loads": "load_id", "nets": "net_id", "mesh_outputs": "mesh_id"}
MESH = ["solution_id", "layer_no", "role", "mesh_no"]


def once(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return once_per_key(table(spark, folder, name), KEYS[name], *columns)


def r(value: Column, digits: int = 4) -> Column:
    return F.round(value, digits)


# --- filters and sets ---------------------------------------------------------------------------------------------


def target_nets(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct nets an analysis asks for: those of sources and loads and their grounds. Unknown nets are none."""
    parts = [table(spark, folder, t).select("board_id", known(c).alias("net")) for t in ("sources", "loads") for c in ("net", "gnd_net")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).dropna().distinct()


def target_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes whose label is a target net of their board (semi join)."""
    shapes = once(spark, folder, "layer_shapes", "board_id", "net_label")
    return shapes.join(target_nets(spark, folder).toDF("board_id", "net_label"), ["board_id", "net_label"], "left_semi").select("shape_id", "board_id", "net_label")


def untargeted_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Layers of a board that no target shape lies on (anti join)."""
    shapes = once(spark, folder, "layer_shapes", "board_id", "layer_name", "net_label").withColumn("layer", layer_key("layer_name"))
    used = shapes.join(target_nets(spark, folder).toDF("board_id", "net_label"), ["board_id", "net_label"], "left_semi").select("board_id", "layer")
    return shapes.select("board_id", "layer").dropna().distinct().join(used, ["board_id", "layer"], "left_anti")


def layer_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Layer names by their normal form, with the number of spellings."""
    names = table(spark, folder, "vias").select(F.explode("layer_names").alias("name")).dropna()
    return names.groupBy(el.normal_name(F.col("name")).alias("normal")).agg(F.countDistinct("name").alias("spellings"), F.count("*").alias("uses"))


def valid_via_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Vias with those of their layers that exist; vias without any are dropped."""
    layers = table(spark, folder, "layer_map").select(layer_key("layer_name").alias("layer")).agg(F.collect_set("layer").alias("known_layers"))  # a fixed table
    vias = once(spark, folder, "vias", "layer_names").withColumn("layers", layer_keys("layer_names")).crossJoin(F.broadcast(layers))
    return vias.withColumn("layers", F.array_sort(F.array_intersect("layers", "known_layers"))).filter("size(layers) > 0").select("via_id", F.size("layers").alias("layer_count"), F.array_join("layers", ",").alias("layers"))


def shapes_of_size(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes per layer before and after tiny ones (under 0.01 square millimetres) are removed."""
    shapes = once(spark, folder, "layer_shapes", "layer_name", "area_mm2").withColumn("layer", layer_key("layer_name"))
    return shapes.groupBy("layer").agg(F.count("*").alias("shapes"), F.count_if(F.col("area_mm2") >= 0.01).alias("kept"))


def terminal_pads(spark: SparkSession, folder: str) -> DataFrame:
    """All pads of sources and loads, one row each."""
    parts = []
    for t, kind in (("sources", "source"), ("loads", "load")):
        rows = once(spark, folder, t, "board_id", "pads", "gnd_pads")
        for c, side in (("pads", "pos"), ("gnd_pads", "gnd")):
            parts.append(rows.select(F.lit(kind).alias("kind"), F.col(KEYS[t]).alias("owner_id"), "board_id", F.lit(side).alias("side"), F.posexplode(c).alias("pad_no", "pad")).select("kind", "owner_id", "board_id", "side", "pad_no", "pad.*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def smd_terminals(spark: SparkSession, folder: str) -> DataFrame:
    """The centres of terminal pads without hole, from all lists."""
    pads = terminal_pads(spark, folder).filter(~F.coalesce("is_tht", F.lit(False)) & finite("x") & finite("y"))
    return pads.select("board_id", "kind", "owner_id", "side", F.col("pad_no").cast("long").alias("pad_no"), r(F.col("x"), 6).alias("x"), r(F.col("y"), 6).alias("y"))


def distinct_terminals(spark: SparkSession, folder: str) -> DataFrame:
    """Terminals of an owner are equal if layer and position (to 6 digits) are."""
    pads = terminal_pads(spark, folder).select("kind", "owner_id", layer_key("layer").alias("layer"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    return pads.distinct().groupBy("kind", "owner_id").agg(F.count("*").alias("terminals"))


# --- joins --------------------------------------------------------------------------------------------------------


def named_pours(spark: SparkSession, folder: str) -> DataFrame:
    """Pours with the name of their layer, empty where the layer is unknown (dictionary lookup)."""
    layers = F.broadcast(table(spark, folder, "layer_map").select(F.col("layer_id").alias("layer"), "layer_name", "conductance"))  # a fixed table
    pours = once(spark, folder, "copper_pours", "board_id", "layer", "net").join(layers, "layer", "left")
    return pours.select("pour_id", F.coalesce("layer_name", F.lit("")).alias("layer_name"), el.default_conductance(F.col("conductance")).alias("conductance"))


def matched_rails(spark: SparkSession, folder: str) -> DataFrame:
    """Per board and net, whether sources meet loads, or either stands alone."""
    s = once(spark, folder, "sources", "board_id", "net").select("board_id", known("net").alias("net")).dropna().groupBy("board_id", "net").agg(F.count("*").alias("sources"))
    n = once(spark, folder, "loads", "board_id", "net").select("board_id", known("net").alias("net")).dropna().groupBy("board_id", "net").agg(F.count("*").alias("loads"))
    both = s.join(n, ["board_id", "net"], "full")
    status = F.when(F.col("loads").isNull(), "source only").when(F.col("sources").isNull(), "load only").otherwise("matched")
    return both.select("board_id", "net", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("loads", F.lit(0)).alias("loads"), status.alias("status"))


def _points(vias: DataFrame) -> DataFrame:
    return vias.select(F.col("board_id").alias("space"), F.col("via_id").alias("id"), "x", "y", F.array(F.lit("*")).alias("tags"))


def _sites(pads: DataFrame) -> DataFrame:
    return pads.select(F.col("board_id").alias("space"), F.col("pad_id").alias("id"), "x", "y", F.lit(None).cast("string").alias("tag"))


def _no_regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "space long, id long, tag string, rings array<array<struct<x:double,y:double>>>")


#: How far in millimetres a pad may snap to copper.
SNAP = 1.0


def nearest_pads(spark: SparkSession, folder: str) -> DataFrame:
    """For each via the nearest pad of its net within the snapping distance; ties go to the smaller id."""
    vias = once(spark, folder, "vias", "board_id", "x", "y", "net").filter(known("net").isNotNull() & finite("x") & finite("y"))
    pads = located_pads(spark, folder).select("pad_id", "board_id", "x", "y", "net").distinct()
    pads = pads.filter(known("net").isNotNull() & finite("x") & finite("y"))
    points = vias.select(F.col("board_id").alias("space"), F.col("via_id").alias("id"), "x", "y", F.array("net").alias("tags"))
    sites = pads.select(F.col("board_id").alias("space"), F.col("pad_id").alias("id"), "x", "y", F.col("net").alias("tag"))
    near = near_or_inside(points, sites, _no_regions(spark), SNAP)
    met = near.join(vias.select(F.col("via_id").alias("point_id"), F.col("x").alias("vx"), F.col("y").alias("vy")), "point_id").join(pads.select(F.col("pad_id").alias("other_id"), "x", "y"), "other_id")
    ranked = met.withColumn("d", F.round(F.hypot(F.col("vx") - F.col("x"), F.col("vy") - F.col("y")), 6))
    return ranked.groupBy(F.col("point_id").alias("via_id")).agg(F.min(F.struct("d", "other_id")).alias("best")).select("via_id", F.col("best.other_id").alias("pad_id"), F.col("best.d").alias("distance"))


def exempt_drills(spark: SparkSession, folder: str) -> DataFrame:
    """Vias without those at the centre (within 0.05) of a pad that has no hole (distance anti join)."""
    vias = once(spark, folder, "vias", "board_id", "x", "y", "hole_diameter").filter(finite("x") & finite("y"))
    pads = located_pads(spark, folder).filter(~F.coalesce("is_tht", F.lit(False)))
    met = near_or_inside(_points(vias), _sites(pads), _no_regions(spark), 0.05).select(F.col("point_id").alias("via_id"))
    return vias.join(met, "via_id", "left_anti").select("via_id", "board_id", "x", "y", "hole_diameter")


def pin_pads(spark: SparkSession, folder: str) -> DataFrame:
    """Pads and component pins by position in hundredths of a millimetre: the first pad of a position, with the designator of
    the pins there filled in (the lesser name where several), and positions that only pins have."""
    at = [F.floor(F.col(c) * 100 + 0.5).alias(f"k{c}") for c in "xy"]
    pads = located_pads(spark, folder).filter(finite("x") & finite("y")).select("board_id", *at, "pad_id", F.lit(None).cast("string").alias("ref_des"))
    names = once(spark, folder, "sources", "ref_des").select(F.lit("source").alias("kind"), F.col("source_id").alias("owner_id"), "ref_des")
    names = names.unionByName(once(spark, folder, "loads", "ref_des").select(F.lit("load").alias("kind"), F.col("load_id").alias("owner_id"), "ref_des"))
    pins = terminal_pads(spark, folder).filter(finite("x") & finite("y")).join(names, ["kind", "owner_id"]).select("board_id", *at, F.lit(None).cast("long").alias("pad_id"), "ref_des")
    return pads.unionByName(pins).groupBy("board_id", "kx", "ky").agg(F.min("pad_id").alias("pad_id"), F.min(F.nullif("ref_des", F.lit(""))).alias("ref_des"))


def pads_in_pours(spark: SparkSession, folder: str) -> DataFrame:
    """For each pad the first pour (least id) that contains it on its layer."""
    pads = located_pads(spark, folder).select(F.col("board_id").alias("space"), F.col("pad_id").alias("id"), "x", "y", F.array_compact(F.array(layer_key("layer"))).alias("tags"))
    layers = F.broadcast(table(spark, folder, "layer_map").select(F.col("layer_id").alias("layer"), layer_key("layer_name").alias("tag")))  # a fixed table
    pours = table(spark, folder, "copper_pours").join(layers, "layer").select(F.col("board_id").alias("space"), F.col("pour_id").alias("id"), "tag", F.concat(F.array("vertices"), F.coalesce("holes", F.array())).alias("rings"))
    none = spark.createDataFrame([], "space long, id long, x double, y double, tag string")
    found = near_or_inside(pads, none, pours, 0.0)
    return found.groupBy(F.col("point_id").alias("pad_id")).agg(F.min("other_id").alias("pour_id"), F.count("*").alias("pours"))


# --- aggregates ---------------------------------------------------------------------------------------------------


def pour_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """Area, perimeter, direction, bounds and vertex mean of each pour's outline, and its area without holes."""
    pours = once(spark, folder, "copper_pours", "vertices", "holes").filter("size(vertices) >= 3")
    area, box, mean = geo.ring_area("vertices"), geo.bounds("vertices"), geo.vertex_mean("vertices")
    rings = F.concat(F.array("vertices"), F.coalesce("holes", F.array()))
    return pours.select("pour_id", r(F.abs(area)).alias("area"), (area > 0).alias("counter_clockwise"), r(geo.perimeter("vertices")).alias("perimeter"), r(box.x0).alias("x0"), r(box.y1).alias("y1"), r(mean.x).alias("mean_x"), r(geo.polygon_area(rings), 3).alias("net_area"))


def board_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The box around all vias, pads and pours of a board."""
    parts = [table(spark, folder, "vias").select("board_id", "x", "y"), located_pads(spark, folder).select("board_id", "x", "y"), table(spark, folder, "copper_pours").select("board_id", F.inline("vertices"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(finite("x") & finite("y"))
    return every.groupBy("board_id").agg(*[r(f(c)).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def pour_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Pours and their area per board, net and layer."""
    pours = once(spark, folder, "copper_pours", "board_id", "net", "layer", "vertices")
    return pours.groupBy("board_id", known("net").alias("net"), "layer").agg(F.count("*").alias("pours"), r(F.sum(F.abs(geo.ring_area("vertices"))), 2).alias("area"))


def pads_by_net(spark: SparkSession, folder: str) -> DataFrame:
    """Pads per board and net, with how many have holes."""
    pads = once(spark, folder, "pads", "board_id", "net", "is_tht")
    return pads.groupBy("board_id", known("net").alias("net")).agg(F.count("*").alias("pads"), F.count_if("is_tht").alias("tht"))


def rail_currents(spark: SparkSession, folder: str) -> DataFrame:
    """Load current per board and net (positive loads), and the total of absolute currents."""
    loads = once(spark, folder, "loads", "board_id", "net", "load_current").filter(known("net").isNotNull() & finite("load_current"))
    return loads.groupBy("board_id", "net").agg(r(F.sum(F.when(F.col("load_current") > 0, F.col("load_current")).otherwise(0.0))).alias("current"), r(F.sum(F.abs("load_current"))).alias("total"))


def smallest_holes(spark: SparkSession, folder: str) -> DataFrame:
    """Least positive hole per board, net and layer."""
    vias = once(spark, folder, "vias", "board_id", "net", "hole_diameter", "layer_names").filter((F.col("hole_diameter") > 0) & known("net").isNotNull())
    return vias.select("board_id", "net", F.explode(layer_keys("layer_names")).alias("layer"), "hole_diameter").groupBy("board_id", "net", "layer").agg(F.min("hole_diameter").alias("hole"))


def median_extents(spark: SparkSession, folder: str) -> DataFrame:
    """Upper median of the larger side of a board's pours, in hundredths of a millimetre.

    Sides are counted per hundredth first, so the ordered part is bounded by the size of a board.
    """
    box = geo.bounds("vertices")
    sides = once(spark, folder, "copper_pours", "board_id", "vertices").filter("size(vertices) > 0").select("board_id", F.round(F.greatest(box.x1 - box.x0, box.y1 - box.y0) * 100).cast("long").alias("side")).dropna()
    counts = sides.groupBy("board_id", "side").agg(F.count("*").alias("n"))
    by = Window.partitionBy("board_id")
    ranked = counts.withColumn("upto", F.sum("n").over(by.orderBy("side").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    return ranked.filter("upto > total div 2").groupBy("board_id").agg(F.min("side").alias("side"))


def via_net_votes(spark: SparkSession, folder: str) -> DataFrame:
    """The net that most of a via's landings have; target nets win ties, then the lesser name, and only they count."""
    landings = once(spark, folder, "vias", "board_id", "landing_ids").select("via_id", "board_id", F.explode("landing_ids").alias("shape_id")).dropna()
    shapes = once(spark, folder, "layer_shapes", "net_label").select("shape_id", known("net_label").alias("net")).dropna()
    votes = landings.join(shapes, "shape_id").groupBy("via_id", "board_id", "net").agg(F.count("*").alias("votes"))
    votes = votes.join(target_nets(spark, folder).withColumn("target", F.lit(True)), ["board_id", "net"], "left")
    best = votes.groupBy("via_id").agg(F.min(F.struct(-F.col("votes"), F.col("target").isNull(), "net")).alias("b"))
    return best.filter("not b.col2").select("via_id", F.col("b.net").alias("net"), (-F.col("b.col1")).alias("votes"))


def ground_nets(spark: SparkSession, folder: str) -> DataFrame:
    """The ground name a board uses most (ignoring case) over pads, vias and pours; the lesser name wins ties."""
    parts = [once(spark, folder, t, "board_id", "net").select("board_id", "net") for t in ("pads", "vias", "copper_pours")]
    named = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(el.is_ground(F.col("net")))
    counts = named.groupBy("board_id", F.lower("net").alias("net")).agg(F.count("*").alias("n"))
    return counts.groupBy("board_id").agg(F.min(F.struct(-F.col("n"), "net")).alias("b")).select("board_id", F.col("b.net").alias("ground"), (-F.col("b.col1")).alias("uses"))


def voltage_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Meshes and range of potentials per run, board, layer and net; NaN and infinite values count as 0."""
    meshes = once(spark, folder, "mesh_outputs", "run_id", "board_id", "layer_name", "net", "potentials").filter(known("net").isNotNull())
    clean = F.transform(F.filter("potentials", lambda v: v.isNotNull()), el.sanitized)
    return meshes.groupBy("run_id", "board_id", layer_key("layer_name").alias("layer"), "net").agg(F.count("*").alias("meshes"), F.min(F.array_min(clean)).alias("low"), F.max(F.array_max(clean)).alias("high"))


def element_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lumped elements per board: voltage sources, current sources and via resistors."""
    vs = once(spark, folder, "sources", "board_id").groupBy("board_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("VS"))
    cs = once(spark, folder, "loads", "board_id").groupBy("board_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("CS"))
    res = once(spark, folder, "vias", "board_id", "layer_names").groupBy("board_id").agg(F.sum(F.greatest(F.coalesce(F.size(layer_keys("layer_names")), F.lit(0)) - 1, F.lit(0))).alias("n")).withColumn("kind", F.lit("R"))
    return vs.unionByName(cs).unionByName(res).filter("n > 0").select("board_id", "kind", "n")


# --- order --------------------------------------------------------------------------------------------------------


def layer_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Layers from top to bottom: by id, the bottom layer (id 2) last."""
    order = F.when(F.col("layer_id") == 2, 1_000_000).otherwise(F.col("layer_id"))
    return table(spark, folder, "layer_map").select("layer_id", layer_key("layer_name").alias("layer"), (F.row_number().over(Window.orderBy(order)) - 1).alias("position"))


def via_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Vias per type: the layers a blind or buried via's text names, matched in the stack by their beginning."""
    stack = layer_stack(spark, folder)
    kinds = once(spark, folder, "vias", "via_type").groupBy("via_type").agg(F.count("*").alias("vias"))
    pattern = "^(?:Blind|Buried): *([^-]+)-(.+)$"
    ends = kinds.select("via_type", "vias", el.normal_name(F.regexp_extract("via_type", pattern, 1)).alias("a"), el.normal_name(F.regexp_extract("via_type", pattern, 2)).alias("b")).filter("a <> '' and b <> ''")
    normal = el.normal_name(F.col("layer"))
    first = ends.join(F.broadcast(stack.select(normal.alias("l"), F.col("position").alias("p"))), F.expr("startswith(l, a)")).groupBy("via_type", "vias", "b").agg(F.min("p").alias("p"))
    last = first.join(F.broadcast(stack.select(normal.alias("l"), F.col("position").alias("q"))), F.expr("startswith(l, b)")).groupBy("via_type", "vias", "p").agg(F.min("q").alias("q"))
    return last.select("via_type", "vias", F.least("p", "q").alias("top"), F.greatest("p", "q").alias("bottom"), (F.abs(F.col("p") - F.col("q")) + 1).alias("layers"))


def via_resistors(spark: SparkSession, folder: str) -> DataFrame:
    """One resistor between each two neighbouring layers of a via; the length is the mean copper thickness."""
    stack = F.broadcast(layer_stack(spark, folder).join(table(spark, folder, "layer_map").select("layer_id", "conductance"), "layer_id").select("layer", "position", (F.col("conductance") / el.SIGMA).alias("thickness")))  # a fixed table
    vias = once(spark, folder, "vias", "layer_names", "hole_diameter").select("via_id", "hole_diameter", F.explode(layer_keys("layer_names")).alias("layer")).join(stack, "layer")
    by = Window.partitionBy("via_id").orderBy("position")
    pairs = vias.withColumn("to_layer", F.lead("layer").over(by)).withColumn("length", (F.col("thickness") + F.lead("thickness").over(by)) / 2).filter("to_layer is not null")
    return pairs.select("via_id", F.col("layer").alias("from_layer"), "to_layer", F.round(el.via_resistance(F.col("length"), F.col("hole_diameter")), 9).alias("ohms"))


def near_ground_pads(spark: SparkSession, folder: str) -> DataFrame:
    """At most 20 ground pads of a load: those nearest to the mean of its pads; all where it has no pads."""
    ends = terminal_pads(spark, folder).filter((F.col("kind") == "load") & finite("x") & finite("y"))
    centre = ends.filter("side = 'pos'").groupBy("owner_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    ground = ends.filter("side = 'gnd'").join(centre, "owner_id", "left")
    d = F.coalesce(F.round(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), 6), F.lit(0.0))
    ranked = ground.withColumn("place", F.row_number().over(Window.partitionBy("owner_id").orderBy(d, "pad_no")))
    return ranked.filter((F.col("place") <= 20) | F.col("cx").isNull()).select(F.col("owner_id").alias("load_id"), F.col("pad_no").cast("int").alias("pad_no"), "place")


def largest_pours(spark: SparkSession, folder: str) -> DataFrame:
    """The largest pour of each board and net; the lesser id wins ties."""
    pours = once(spark, folder, "copper_pours", "board_id", "net", "vertices").filter(known("net").isNotNull() & (F.size("vertices") >= 3))
    sized = pours.withColumn("area", r(F.abs(geo.ring_area("vertices"))))
    return sized.groupBy("board_id", "net").agg(F.min(F.struct(-F.col("area"), "pour_id")).alias("b")).select("board_id", "net", F.col("b.pour_id").alias("pour_id"), (-F.col("b.col1")).alias("area"))


def dense_net_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Nets of a board numbered from 0 without gaps, in the order of their first ids.

    Ids are numbered in blocks, and blocks are offset by the sizes of those before, so a large board is not one task.
    """
    nets = once(spark, folder, "nets", "board_id", "net_name").groupBy("board_id", "net_name").agg(F.min("net_id").alias("first_id")).withColumn("block", F.expr("first_id div 65536"))
    sizes = nets.groupBy("board_id", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("board_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("board_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("board_id", "block").orderBy("first_id")) - 1
    return nets.withColumn("within", within).join(offsets, ["board_id", "block"]).select("board_id", "net_name", (F.col("within") + F.col("before")).alias("number"))


# --- labels, capacity, output -------------------------------------------------------------------------------------


def propagated_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes with the label they have, or else the only one among all shapes that touch them directly or not."""
    shapes = once(spark, folder, "layer_shapes", "net_label").select(F.col("shape_id").alias("node"), known("net_label").alias("label"))
    links = table(spark, folder, "shape_links").select(F.col("shape_a").alias("a"), F.col("shape_b").alias("b")).distinct()
    known_ends = links.join(shapes.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(shapes.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    fits = known_ends.filter("coalesce(la = lb, true)").select("a", "b")
    return propagated(shapes, fits, "label").select(F.col("node").alias("shape_id"), F.col("label").alias("net_label"), "resolved")


def capacity_checks(spark: SparkSession, folder: str, rise: float = 10.0) -> DataFrame:
    """Current of each loaded net of a board against what its narrowest via land carries per layer; only more than 80 %
    is told."""
    currents = rail_currents(spark, folder).filter("current > 0").select("board_id", "net", "current")
    vias = once(spark, folder, "vias", "board_id", "net", "diameter", "layer_names").filter((F.col("diameter") > 0) & known("net").isNotNull())
    widths = vias.select("board_id", "net", F.explode(layer_keys("layer_names")).alias("layer"), "diameter").groupBy("board_id", "net", "layer").agg(F.min("diameter").alias("width"))
    layers = F.broadcast(table(spark, folder, "layer_map").select(layer_key("layer_name").alias("layer"), (F.col("conductance") / el.SIGMA).alias("thickness")))  # a fixed table
    limits = widths.join(layers, "layer").withColumn("limit", el.trace_capacity(F.col("width"), el.copper_ounces(F.col("thickness")), F.lit(rise), el.is_outer_layer(F.col("layer"))))
    checks = currents.join(limits, ["board_id", "net"]).withColumn("used", el.utilization(F.col("current"), F.col("limit"))).filter("used > 0.8")
    return checks.select("board_id", "net", "layer", r(F.col("current")).alias("current"), r(F.col("limit")).alias("capacity"), r(F.col("used"), 3).alias("utilization"), (F.col("used") > 1).alias("exceeded"))


def via_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Vias as they are drawn: the land is at least 0.4 wider than the hole and 0.5 wide."""
    vias = once(spark, folder, "vias", "x", "y", "hole_diameter").filter(finite("x") & finite("y"))
    hole = F.coalesce("hole_diameter", F.lit(0.0))
    drawn = F.when(hole <= 0, F.lit(0.3)).otherwise(hole)
    return vias.select("via_id", "x", "y", r(F.greatest(drawn + 0.4, F.lit(0.5))).alias("diameter"), r(drawn).alias("hole"))


def connection_points(spark: SparkSession, folder: str) -> DataFrame:
    """Terminals as they are drawn, per layer; those without layer or position are left out."""
    ends = terminal_pads(spark, folder).withColumn("layer", layer_key("layer")).filter(F.col("layer").isNotNull() & finite("x") & finite("y"))
    drawn = F.when(F.coalesce("is_tht", F.lit(False)) & (F.coalesce("hole_diameter", F.lit(0.0)) > 0), F.col("hole_diameter")).otherwise(F.lit(0.5))
    return ends.select("board_id", "layer", (F.col("kind") == "source").alias("is_source"), "owner_id", "side", F.col("pad_no").cast("long").alias("pad_no"), r(F.col("x"), 6).alias("x"), r(F.col("y"), 6).alias("y"), r(drawn, 6).alias("diameter"))


# --- meshes and matrices ------------------------------------------------------------------------------------------


def corners(spark: SparkSession, folder: str) -> DataFrame:
    """Triangles with their three corners and potentials (three equi joins on the mesh and the vertex number)."""
    found = solution_tables(spark, folder, {"triangle", "vertex"})
    out = found["triangle"].filter("role = 'meshes'")
    for i in range(3):
        v = found["vertex"].filter("role = 'meshes'").select(*MESH, F.col("vertex_no").alias(f"v{i}"), geo.point(F.col("x"), F.col("y")).alias(f"p{i}"), F.col("potential").alias(f"u{i}"))
        out = out.join(v, [*MESH, f"v{i}"])
    return out.select(*MESH, "triangle_no", "v0", "v1", "v2", "p0", "p1", "p2", "u0", "u1", "u2")


def triangle_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Area, power density and current density of each triangle from its corners, for the default sheet conductance."""
    s = el.SIGMA * el.COPPER
    c = corners(spark, folder).withColumn("g", geo.gradient(*(F.col(f"p{i}") for i in range(3)), *(F.col(f"u{i}") for i in range(3))))
    return c.select("solution_id", "layer_no", "mesh_no", "triangle_no", r(geo.triangle_area(F.col("p0"), F.col("p1"), F.col("p2"))).alias("area"), r(s * (F.col("g.x") ** 2 + F.col("g.y") ** 2), 3).alias("power"), r(-s * F.col("g.x"), 3).alias("jx"), r(-s * F.col("g.y"), 3).alias("jy"))


def mesh_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Per mesh: triangles, area, largest triangle, and triangles with an angle under 10 degrees or a side ratio over 5."""
    p = [F.col(f"p{i}") for i in range(3)]
    sides = [geo.distance(p[i].x, p[i].y, p[j].x, p[j].y) for i, j in ((0, 1), (1, 2), (2, 0))]
    angles = [geo.angle(p[i], p[(i + 1) % 3], p[(i + 2) % 3]) for i in range(3)]
    c = corners(spark, folder).select(*MESH, geo.triangle_area(*p).alias("a"), (F.greatest(*sides) / F.least(*sides)).alias("ratio"), F.least(*angles).alias("angle"))
    return c.groupBy("solution_id", "layer_no", "mesh_no").agg(F.count("*").alias("triangles"), r(F.sum("a"), 3).alias("area"), r(F.max("a")).alias("largest"), F.count_if(F.col("ratio") > 5).alias("thin"), F.count_if(F.col("angle") < 10).alias("sharp"))


def boundary_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that only one triangle of a mesh uses."""
    t = solution_tables(spark, folder, {"triangle"})["triangle"].filter("role = 'meshes' and v0 is not null and v1 is not null and v2 is not null")
    pairs = F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    uses = t.select("solution_id", "layer_no", "mesh_no", F.inline(pairs)).groupBy("solution_id", "layer_no", "mesh_no", "a", "b").agg(F.count("*").alias("n"))
    return uses.filter("n = 1").drop("n")


KEY = ["solution_id", "layer_no", "mesh_no"]


def conductances(spark: SparkSession, folder: str) -> DataFrame:
    """The conductance matrix of each mesh for the default sheet conductance, duplicates summed."""
    c = corners(spark, folder)
    c = c.select(*KEY, *[F.col(f"{a}{i}").alias(f"{b}{j}") for i, j in zip("012", "abc") for a, b in (("v", "n"), ("p", "p"))], F.lit(el.SIGMA * el.COPPER).alias("conductance"))
    return la.coo_sum(la.laplacian_stamps(c, KEY, KEY), KEY)


def potentials(spark: SparkSession, folder: str) -> DataFrame:
    """The potential of each vertex as a vector, 0 where it is null, NaN or infinite."""
    v = solution_tables(spark, folder, {"vertex"})["vertex"].filter("role = 'meshes'")
    return v.select(*KEY, F.col("vertex_no").alias("row"), F.coalesce(el.sanitized(F.col("potential")), F.lit(0.0)).alias("value"))


def laplacian(spark: SparkSession, folder: str) -> DataFrame:
    """The conductance matrix of each mesh in coordinates."""
    return conductances(spark, folder).withColumn("value", r(F.col("value"), 3))


def node_currents(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse matrix times vector: the currents out of the vertices, per mesh their number and norm."""
    product = la.spmv(conductances(spark, folder), potentials(spark, folder), KEY)
    return product.groupBy(*KEY).agg(F.count("*").alias("rows"), r(F.sqrt(F.sum(F.col("value") * F.col("value"))), 2).alias("norm"))


QUERIES = {
    f.__name__: f
    for f in (
        target_nets, target_shapes, untargeted_layers, layer_spellings, valid_via_layers, shapes_of_size, smd_terminals, distinct_terminals, named_pours, matched_rails,
        nearest_pads, exempt_drills, pin_pads, pads_in_pours, pour_geometry, board_bounds, pour_coverage, pads_by_net, rail_currents, smallest_holes, median_extents,
        via_net_votes, ground_nets, voltage_ranges, element_counts, layer_stack, via_spans, via_resistors, near_ground_pads, largest_pours, dense_net_numbers,
        propagated_labels, capacity_checks, via_positions, connection_points, triangle_fields, mesh_quality, boundary_edges, laplacian, node_currents,
    )
}
