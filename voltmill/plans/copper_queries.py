"""Queries on shapes and copper: scalar geometry over pours and pads, and what touches, joins and meets what.

Each query has its SQL, which computes the same by closed formulas or by comparing everything with everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import electrical as el
from ..functions import geometry as geo
from ..operators import copper, polygons
from ..operators.mesh import ear_clip, mesh_polygon
from ..tables import finite, known, layer_key, layer_keys, spread, table
from .board_queries import located_pads
from .inventory_queries import once, r, target_nets, terminal_pads
from .inventory_sql import _CTE, _FINITE
from .mesh_queries import ringed_pours

REACH = 0.05  # millimetres
#: Added before areas are rounded, so that those of few digits do not lie on the edge between two results.
EDGE = 3.1e-8


def _at(array: str, i: int):  # noqa: ANN202
    return F.get(array, F.lit(i))


# --- scalar geometry ----------------------------------------------------------------------------------------------


def fitted_transforms(spark: SparkSession, folder: str) -> DataFrame:
    """Per board the map of the vias' box onto that of the pads, its inverse on the corner, and the corner's mirror image."""
    box = lambda rows, name: rows.filter(finite("x") & finite("y")).groupBy("board_id").agg(F.struct(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).alias(name))
    both = box(table(spark, folder, "vias"), "v").join(box(located_pads(spark, folder), "p"), "board_id").withColumn("t", geo.fitted_transform(F.col("v"), F.col("p")))
    there = geo.affine(geo.point(F.col("v.x0"), F.col("v.y0")), F.col("t.scale"), F.col("t.dx"), F.col("t.dy"))
    mapped = both.withColumn("there", there).withColumn("back", geo.inverse_affine(F.col("there"), F.col("t.scale"), F.col("t.dx"), F.col("t.dy")))
    mirror = F.get(geo.mirrored(F.array("there"), (F.col("p.x0") + F.col("p.x1")) / 2), F.lit(0))
    columns = {"scale": "t.scale", "dx": "t.dx", "dy": "t.dy", "x": "there.x", "y": "there.y", "back_x": "back.x", "back_y": "back.y"}
    return mapped.select("board_id", *[r(F.col(c), 5).alias(n) for n, c in columns.items()], r(mirror.x, 5).alias("mirror_x"))


def pour_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The first and third edge of each pour: distance of the fourth point from the first edge, place along it, products,
    crossing and closeness, and the resistance of a track along the first edge."""
    p = once(spark, folder, "copper_pours", "vertices").filter("size(vertices) >= 5")
    a, b, c, d = (_at("vertices", i) for i in range(4))
    u, v = (b.x - a.x, b.y - a.y), (d.x - c.x, d.y - c.y)
    return p.select(
        "pour_id", r(geo.segment_distance(d.x, d.y, a.x, a.y, b.x, b.y)).alias("distance"), r(geo.along_segment(d.x, d.y, a.x, a.y, b.x, b.y)).alias("along"),
        r(geo.dot(*u, *v)).alias("dot"), r(geo.cross(*u, *v)).alias("cross"), geo.segments_intersect(a, b, c, d).alias("crosses"), geo.segments_close(a, b, c, d, 4.0).alias("close"),
        r(el.track_resistance(geo.distance(a.x, a.y, b.x, b.y), F.lit(0.2), F.lit(el.SIGMA * el.COPPER)), 6).alias("ohms"),
    )


def pour_centres(spark: SparkSession, folder: str) -> DataFrame:
    """Where the middle of a pour's box lies: inside the pour, inside any of its rings, how far from its edges."""
    p = ringed_pours(spark, folder).withColumn("box", geo.bounds(_at("rings", 0)))
    x, y = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    p = p.withColumn("x", x).withColumn("y", y)
    x, y = F.col("x"), F.col("y")
    return p.select("pour_id", geo.in_polygon(x, y, "rings").alias("inside"), geo.in_any_ring(x, y, "rings").alias("in_ring"), r(geo.polygon_distance(x, y, "rings")).alias("distance"),
                    r(geo.ring_distance(x, y, _at("rings", 0))).alias("from_outline"), geo.within(x, y, "rings", 0.5).alias("within"), geo.box_contains(F.col("box"), x, y).alias("in_box"))


def overlapping_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a board's pours on one layer, neighbours by id, and whether their boxes overlap."""
    p = ringed_pours(spark, folder).select("board_id", "layer", "pour_id", geo.bounds(_at("rings", 0)).alias("box"))
    by = Window.partitionBy("board_id", "layer").orderBy("pour_id")
    pairs = p.withColumn("other_id", F.lead("pour_id").over(by)).withColumn("other", F.lead("box").over(by)).filter("other_id is not null")
    return pairs.select("pour_id", "other_id", geo.boxes_overlap(F.col("box"), F.col("other")).alias("overlap"))


def oriented_pours(spark: SparkSession, folder: str) -> DataFrame:
    """Signed areas of outlines as given, as an outline, as a hole and mirrored."""
    p = once(spark, folder, "copper_pours", "vertices").filter("size(vertices) >= 3")
    area = lambda ring: r(geo.ring_area(ring) + EDGE)
    return p.select("pour_id", area("vertices").alias("given"), area(geo.oriented("vertices")).alias("outline"), area(geo.oriented("vertices", hole=True)).alias("hole"),
                    area(geo.mirrored("vertices", F.lit(40.0))).alias("mirrored"), area(geo.rotated("vertices", F.lit(3.0), F.lit(4.0), F.lit(37.0))).alias("turned"))


def pad_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Outlines of pads by symbol: points, area, and the width of the box of the rectangle when it is turned by 30 degrees."""
    p = once(spark, folder, "pads", "hole_diameter").withColumn("w", F.coalesce("hole_diameter", F.lit(0.5)) + 0.2).withColumn("h", F.col("w") * 1.5).withColumn("radius", F.col("w") / 8)
    zero = F.lit(0.0)
    ring = lambda kind, radius=zero, turn=zero: geo.symbol_ring(F.lit(kind), zero, zero, F.col("w"), F.col("h"), radius, turn)
    p = p.select("pad_id", ring("round").alias("circle"), ring("oval").alias("oval"), ring("rect").alias("rect"), ring("rect", F.col("radius")).alias("rounded"), ring("rect", zero, F.lit(30.0)).alias("turned"))
    box = geo.bounds("turned")
    return p.select("pad_id", *[r(geo.ring_area(n)).alias(f"{n}_area") for n in ("circle", "oval", "rect", "rounded")], *[F.size(n).cast("long").alias(f"{n}_points") for n in ("circle", "oval", "rounded")], r(box.x1 - box.x0).alias("turned_width"))


def pour_arcs(spark: SparkSession, folder: str) -> DataFrame:
    """Quarter and three-quarter arcs around the first point of a pour, a curve along its first points, a capsule between two."""
    p = once(spark, folder, "copper_pours", "vertices").filter("size(vertices) >= 5").withColumn("radius", F.pmod("pour_id", F.lit(7)) + 1.0)
    a, b, c, d = (_at("vertices", i) for i in range(4))
    one = lambda clockwise: geo.arc_between(a.x + F.col("radius"), a.y, a.x, a.y + F.col("radius"), a.x, a.y, F.lit(clockwise))
    p = p.select("pour_id", one(False).alias("quarter"), one(True).alias("rest"), geo.bezier(a, b, c, d).alias("curve"), geo.capsule(a.x, a.y, b.x, b.y, F.lit(0.3)).alias("track"))
    length = lambda path: F.aggregate(F.zip_with(path, F.slice(path, F.lit(2), F.size(path) - 1), lambda s, e: F.coalesce(F.hypot(s.x - e.x, s.y - e.y), F.lit(0.0))), F.lit(0.0), lambda t, v: t + v)
    middle = _at("curve", 8)
    return p.select("pour_id", F.size("quarter").cast("long").alias("quarter_points"), r(length(F.col("quarter"))).alias("quarter_length"), F.size("rest").cast("long").alias("rest_points"), r(length(F.col("rest"))).alias("rest_length"),
                    r(middle.x).alias("curve_x"), r(middle.y).alias("curve_y"), F.size("curve").cast("long").alias("curve_points"), r(geo.ring_area("track")).alias("track_area"))


def simplified_pours(spark: SparkSession, folder: str) -> DataFrame:
    """Outlines without the points that lie within 0.001 of the chord: they keep their area and their ends."""

    @F.pandas_udf("struct<points:long, area:double, ends:boolean>")
    def thinned(rings):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = []
        for ring in rings:
            path = [(q["x"], q["y"]) for q in ring]
            kept = polygons.simplified(path, 1e-3)
            rows.append((len(kept), polygons.area(np.array(kept)), tuple(kept[0]) == path[0] and tuple(kept[-1]) == path[-1]))
        return pd.DataFrame(rows, columns=["points", "area", "ends"])

    p = ringed_pours(spark, folder).select("pour_id", _at("rings", 0).alias("ring")).withColumn("thin", thinned("ring"))
    close = F.abs(F.col("thin.area") - geo.ring_area("ring")) <= 1e-3 * geo.perimeter("ring")
    return p.select("pour_id", (F.col("thin.points") <= F.size("ring")).alias("fewer"), close.alias("same_area"), F.col("thin.ends").alias("ends"))


def matching_nets(spark: SparkSession, folder: str) -> DataFrame:
    """Per load the pads of its board whose net suits it; an empty wanted name suits all."""
    loads = once(spark, folder, "loads", "board_id", "net").select("load_id", "board_id", F.coalesce("net", F.lit("")).alias("wanted"))
    counts = once(spark, folder, "pads", "board_id", "net").groupBy("board_id", F.coalesce("net", F.lit("")).alias("net")).agg(F.count("*").alias("n"))
    met = loads.join(counts, "board_id").filter(el.net_matches(F.col("wanted"), F.col("net")))
    return met.groupBy("load_id").agg(F.sum("n").alias("pads"))


def rail_vias(spark: SparkSession, folder: str) -> DataFrame:
    """Vias on the nets under analysis (semi join) with the layers they really have."""
    nets = target_nets(spark, folder).toDF("board_id", "net")
    vias = once(spark, folder, "vias", "board_id", "net", "hole_diameter", "layer_names").join(nets, ["board_id", "net"], "left_semi")
    return vias.select("via_id", "board_id", "net", F.size(layer_keys("layer_names")).cast("long").alias("layers"), (F.coalesce("hole_diameter", F.lit(0.0)) > 0).alias("drilled"))


def run_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of a result set: per board one of all its matched rails (run 0), and one for each rail; boards without a
    matched rail have a run 0 that is skipped."""
    rail = lambda t: once(spark, folder, t, "board_id", "net").select("board_id", known("net").alias("net")).dropna().distinct()
    sources, loads = rail("sources"), rail("loads")
    both = sources.join(loads, ["board_id", "net"])
    single = both.withColumn("run_no", F.row_number().over(Window.partitionBy("board_id").orderBy("net"))).select("board_id", "run_no", "net", F.lit(1).cast("long").alias("rails"), F.lit("ready").alias("status"))
    counts = both.groupBy("board_id").agg(F.count("*").alias("rails"))
    every = sources.select("board_id").unionByName(loads.select("board_id")).distinct().join(counts, "board_id", "left")
    whole = every.select("board_id", F.lit(0).alias("run_no"), F.lit(None).cast("string").alias("net"), F.coalesce("rails", F.lit(0)).alias("rails"), F.when(F.col("rails").isNull(), "skipped").otherwise("ready").alias("status"))
    return whole.unionByName(single)


# --- copper -------------------------------------------------------------------------------------------------------


def pour_copper(spark: SparkSession, folder: str) -> DataFrame:
    """Pours as ``(run, layer, poly, net, rings)``, layers by name."""
    layers = F.broadcast(table(spark, folder, "layer_map").select(F.col("layer_id").alias("layer"), layer_key("layer_name").alias("name")))  # a fixed table
    p = ringed_pours(spark, folder).join(layers, "layer")
    return p.select(F.col("board_id").alias("run"), F.col("name").alias("layer"), F.col("pour_id").alias("poly"), F.coalesce("net", F.lit("")).alias("net"), "rings")


def _pads(spark: SparkSession, folder: str) -> DataFrame:
    pads = located_pads(spark, folder).filter(finite("x") & finite("y")).select("pad_id", F.col("board_id").alias("run"), layer_key("layer").alias("layer"), known("net").alias("net"), "x", "y")
    return pads.dropDuplicates(["pad_id"]).filter("layer is not null")


def _vias(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "vias", "board_id", "x", "y", "net", "layer_names").filter(finite("x") & finite("y")).select("via_id", F.col("board_id").alias("run"), known("net").alias("net"), "x", "y", layer_keys("layer_names").alias("layers"))


def copper_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Pads with each pour of their layer that contains them or has an edge within reach."""
    return copper.polygon_hits(_pads(spark, folder), pour_copper(spark, folder), REACH, cell=5.0).select("pad_id", F.col("hit").alias("pour_id"))


def touching_pours(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of pours of a layer, of equal or unknown net, whose edges meet."""
    return copper.touching(pour_copper(spark, folder), cell=5.0).select("run", "layer", "a", "b")


def adjacent_pours(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of pours of a layer, of equal or unknown net, that conduct."""
    return copper.adjacent(pour_copper(spark, folder), cell=5.0).select("run", "layer", "a", "b")


def via_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pours that vias join across layers."""
    drills = _vias(spark, folder).select("run", F.col("via_id").alias("drill_id"), "x", "y")
    return copper.drill_links(drills, pour_copper(spark, folder))


def pour_nets(spark: SparkSession, folder: str) -> DataFrame:
    """Pours with their net, or else the only one of all copper they are joined to."""
    drills = _vias(spark, folder).select("run", F.col("via_id").alias("drill_id"), "x", "y")
    found = copper.propagated_nets(pour_copper(spark, folder), drills, cell=5.0)
    return found.select(F.col("poly").alias("pour_id"), F.nullif("net", F.lit("")).alias("net"), "resolved")


def relabelled_pours(spark: SparkSession, folder: str) -> DataFrame:
    """Pours of unknown net with that of the pour around their middle, of a pad or of a via inside them."""
    pours = pour_copper(spark, folder)
    vias = _vias(spark, folder).withColumn("layer", F.explode("layers"))
    return copper.relabelled(pours, pours, _pads(spark, folder), vias).select(F.col("poly").alias("pour_id"), "net")


def fed_pours(spark: SparkSession, folder: str) -> DataFrame:
    """Pours that conduct to a rail with a source, where the terminals of a board's sources and loads are its ends."""
    nets = once(spark, folder, "sources", "net").select(F.lit("source").alias("kind"), F.col("source_id").alias("owner_id"), "net").unionByName(once(spark, folder, "loads", "net").select(F.lit("load").alias("kind"), F.col("load_id").alias("owner_id"), "net"))
    ends = terminal_pads(spark, folder).filter((F.col("side") == "pos") & finite("x") & finite("y")).drop("net").join(nets, ["kind", "owner_id"])
    ends = ends.select(F.col("board_id").alias("run"), layer_key("layer").alias("layer"), F.col("net").alias("network"), (F.col("kind") == "source").alias("has_source"), "net", "x", "y").filter("layer is not null and net <> ''")
    return copper.connected_to_sources(pour_copper(spark, folder), ends, REACH, cell=5.0).select(F.col("poly").alias("pour_id"))


def nearest_copper(spark: SparkSession, folder: str) -> DataFrame:
    """The pour each pad is joined to: of its net around it or nearest, else the nearest of any net on its layer."""
    points = _pads(spark, folder).withColumnRenamed("pad_id", "point")
    found = copper.snapped(points, pour_copper(spark, folder))
    return found.select(F.col("point").alias("pad_id"), F.col("poly").alias("pour_id"), r(F.col("distance")).alias("distance"))


def snap_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Pads that no copper of their net could take, with the reason in words."""
    points = _pads(spark, folder).withColumnRenamed("pad_id", "point").filter("net is not null")
    pours = pour_copper(spark, folder)
    met = copper.snapped(points, pours, least_area=copper.LEAST_VIA_COPPER, strict=True).filter("poly_net = net")
    return copper.snap_failures(points.join(met.select("point"), "point", "left_anti"), pours).select(F.col("point").alias("pad_id"), "reason")


def _on_pairs(spark: SparkSession, folder: str) -> DataFrame:
    by = Window.partitionBy("board_id", "layer").orderBy("pour_id")
    pairs = ringed_pours(spark, folder).withColumn("other_id", F.lead("pour_id").over(by)).withColumn("others", F.lead("rings").over(by))
    return pairs.filter("other_id is not null").select("pour_id", "other_id", "rings", "others")


def pour_booleans(spark: SparkSession, folder: str) -> DataFrame:
    """Union, intersection and difference of neighbouring pours: their areas add up as they must."""

    def run(batches):  # noqa: ANN001, ANN202
        size = lambda ps: sum(abs(polygons.area(np.array(q[0]))) - sum(abs(polygons.area(np.array(h))) for h in q[1:]) for q in ps)
        for batch in batches:
            rows = []
            for a, b in zip(batch.column("rings").to_pylist(), batch.column("others").to_pylist()):
                a, b = polygons._plain(a), polygons._plain(b)
                one, two = size(polygons.boolean(a, [], "union")), size(polygons.boolean(b, [], "union"))
                union, common, less = (size(polygons.boolean(a, b, how)) for how in ("union", "intersection", "difference"))
                near = lambda u, v: abs(u - v) <= 1e-4 * (1 + one + two)  # noqa: E731, B023
                rows.append((near(one + two, union + common), near(one, less + common), common <= min(one, two) * (1 + 1e-6) and union <= (one + two) * (1 + 1e-6)))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("pour_id"), batch.column("other_id"), *(pa.array(c, pa.bool_()) for c in columns)], ["pour_id", "other_id", "sums", "parts", "bounds"])

    return spread(_on_pairs(spark, folder), "pour_id").mapInArrow(run, "pour_id long, other_id long, sums boolean, parts boolean, bounds boolean")


def pour_meshes(spark: SparkSession, folder: str) -> DataFrame:
    """Meshes and ear-clipped outlines of pours cover the area they must."""

    def run(batches):  # noqa: ANN001, ANN202
        twice = lambda p, t: ((p[t[:, 1], 0] - p[t[:, 0], 0]) * (p[t[:, 2], 1] - p[t[:, 0], 1]) - (p[t[:, 1], 1] - p[t[:, 0], 1]) * (p[t[:, 2], 0] - p[t[:, 0], 0])) if len(t) else np.zeros(0)
        for batch in batches:
            out = []
            for rings in batch.column("rings").to_pylist():
                whole = [q for polygon in polygons.boolean(polygons._plain(rings), [], "union") for q in [polygon]]
                covered = meshed = clipped = outline = 0.0
                for polygon in whole:
                    covered += polygons.area(np.array(polygon[0])) + sum(polygons.area(np.array(h)) for h in polygon[1:])
                    p, t = mesh_polygon(polygon, 2.0)
                    meshed += float(twice(p, t).sum() / 2)
                    outline += polygons.area(np.array(polygon[0]))
                    q = np.array(polygon[0])
                    clipped += float(np.abs(twice(q, ear_clip(polygon[0]))).sum() / 2)
                out.append((abs(meshed - covered) <= 0.1 * covered + 0.05, abs(clipped - outline) <= 1e-6 * (1 + outline)))
            columns = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([batch.column("pour_id"), *(pa.array(c, pa.bool_()) for c in columns)], ["pour_id", "meshed", "clipped"])

    return spread(ringed_pours(spark, folder).select("pour_id", "rings"), "pour_id").mapInArrow(run, "pour_id long, meshed boolean, clipped boolean")


def _areas(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("run", "layer").agg(F.sum(geo.polygon_area("rings")).alias(name))


def clipped_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Copper of a layer within the box of its board, which changes nothing, and within the left half of it, which takes
    some or is given up where it takes nearly all."""
    keys = ["run", "layer", "net"]
    p = pour_copper(spark, folder).select(*keys, "rings")
    ends = p.select("run", F.explode(F.flatten("rings")).alias("q")).groupBy("run").agg(*[f(f"q.{c}").alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))])
    corners = lambda x1: F.array(F.array(*[geo.point(x, y) for x, y in ((F.col("x0") - 1, F.col("y0") - 1), (x1, F.col("y0") - 1), (x1, F.col("y1") + 1), (F.col("x0") - 1, F.col("y1") + 1))])).alias("rings")
    half = (F.col("x0") + F.col("x1")) / 2
    cut = [polygons.clip_to_outline(p, ends.select("run", corners(x)), keys, "layer") for x in (F.col("x1") + 1, half)]
    met = _areas(polygons.combine_groups(p, keys), "before").join(_areas(cut[0], "same"), ["run", "layer"], "left").join(_areas(cut[1], "less"), ["run", "layer"], "left")
    near = 1e-3 + 1e-6 * F.col("before")
    return met.select("run", "layer", (F.abs(F.col("same") - F.col("before")) <= near).alias("kept"), ((F.col("less") <= F.col("before") + near) & (F.col("less") >= 0.1 * F.col("before") - near)).alias("cut"))


def orientation_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Per board 1 for each pour whose pads agree on a net, -2 for each where they differ."""
    return copper.orientation_score(pour_copper(spark, folder), _pads(spark, folder))


def boundary_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Pours as they are drawn: points of outline and holes, and the flat list of all."""
    p = pour_copper(spark, folder)
    flat = F.flatten(F.transform(F.flatten("rings"), lambda q: F.array(q.x, q.y)))
    return p.select(F.col("poly").alias("pour_id"), "layer", "net", F.size(_at("rings", 0)).cast("long").alias("outline_points"), (F.size("rings") - 1).cast("long").alias("holes"), (F.size(flat) / 2).cast("long").alias("points"))


def layer_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """All copper of a board's layer as one, whatever its net: no larger than the sum of its pours, no smaller than any."""
    p = pour_copper(spark, folder)
    one = polygons.layer_outlines(p, ["run", "layer"]).groupBy("run", "layer").agg(F.sum(geo.polygon_area("rings")).alias("whole"))
    parts = p.groupBy("run", "layer").agg(F.count("*").alias("pours"), F.sum(geo.polygon_area("rings")).alias("total"), F.max(geo.polygon_area("rings")).alias("most"))
    met = parts.join(one, ["run", "layer"], "left")
    return met.select("run", "layer", "pours", (F.col("whole") <= F.col("total") * 1.0001 + 0.01).alias("at_most"), (F.col("whole") >= F.col("most") * 0.9999 - 0.01).alias("at_least"))


QUERIES = {
    f.__name__: f
    for f in (
        fitted_transforms, pour_segments, pour_centres, overlapping_boxes, oriented_pours, pad_shapes, pour_arcs, simplified_pours, matching_nets, rail_vias, run_plan, copper_hits, touching_pours,
        adjacent_pours, via_links, pour_nets, relabelled_pours, fed_pours, nearest_copper, snap_reasons, pour_booleans, pour_meshes, boundary_polygons, layer_outlines, clipped_layers, orientation_scores,
    )
}


def _along(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    return f"greatest(0, least(1, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}), 0), 0)))"


def _far(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    t = _along(px, py, ax, ay, bx, by)
    return f"sqrt(({px} - ({ax} + {t} * ({bx} - {ax}))) ** 2 + ({py} - ({ay} + {t} * ({by} - {ay}))) ** 2)"


def _turn(p: str, q: str, s: str) -> str:
    return f"(({q}x - {p}x) * ({s}y - {p}y) - ({q}y - {p}y) * ({s}x - {p}x))"


_FOUR = _CTE + ", s as (select pour_id, vertices[1].x ax, vertices[1].y ay, vertices[2].x bx, vertices[2].y \"by\", vertices[3].x cx, vertices[3].y cy, vertices[4].x dx, vertices[4].y dy from c where len(vertices) >= 5)"
_E = '"by"'
_SEG = (_far("dx", "dy", "ax", "ay", "bx", _E), _along("dx", "dy", "ax", "ay", "bx", _E))
_CROSSES = f"({_turn('a', 'b', 'c')} * {_turn('a', 'b', 'd')} < 1e-9 and {_turn('c', 'd', 'a')} * {_turn('c', 'd', 'b')} < 1e-9)".replace("by ", '"by" ').replace("by)", '"by")')
_CLOSE = f"least({_far('ax', 'ay', 'cx', 'cy', 'dx', 'dy')}, {_far('bx', _E, 'cx', 'cy', 'dx', 'dy')}, {_far('cx', 'cy', 'ax', 'ay', 'bx', _E)}, {_far('dx', 'dy', 'ax', 'ay', 'bx', _E)}) <= 4"
#: Rings of pours as polygons: ring 0 is the outline; and their edges.
_RINGS = (
    _CTE
    + f""", cc as (select pour_id, c.board_id run, lm.ln layer, nullif(c.net, '') net, vertices, holes from c join lm on c.layer = lm.layer_id where len(vertices) >= 3),
rg as (select pour_id, run, layer, net, 0 ring, vertices v from cc union all select pour_id, run, layer, net, i, holes[i] from (select *, unnest(range(1, len(holes) + 1)) i from cc) where len(holes[i]) >= 3),
re as (select pour_id, run, layer, net, ring, i, v[i].x ax, v[i].y ay, v[i % len(v) + 1].x bx, v[i % len(v) + 1].y "by" from (select *, unnest(range(1, len(v) + 1)) i from rg)),
pz as (select pour_id, sum(case when ring = 0 then abs(a) else -abs(a) end) area, sum(abs(a)) gross from (select pour_id, ring, sum(ax * "by" - bx * ay) / 2 a from re group by 1, 2) group by 1),
pd as (select pad_id, board_id run, nullif(lower(trim(layer)), '') layer, nullif(net, '') net, px x, py y from p where {_FINITE} and nullif(lower(trim(layer)), '') is not null),
vi as (select via_id, board_id run, nullif(net, '') net, x, y, names from v where {_FINITE})
"""
)


def _hits(points: str, key: str, reach: float, layers: str = "q.layer = re.layer") -> str:
    """Points with the pours that contain them or are within reach."""
    near = f" or min({_far('q.x', 'q.y', 'ax', 'ay', 'bx', _E)}) <= {reach}" if reach else ""
    odd = 'sum(case when (ay > q.y) <> ("by" > q.y) and q.x < ax + (q.y - ay) * (bx - ax) / ("by" - ay) then 1 else 0 end)'
    return f"""select {key}, pour_id from (select q.{key}, pour_id, ring, {odd} % 2 = 1 odd, {f"min({_far('q.x', 'q.y', 'ax', 'ay', 'bx', _E)})" if reach else "null"} d
      from {points} q join re on q.run = re.run and {layers} group by all) group by {key}, pour_id having (bool_or(odd and ring = 0) and not bool_or(odd and ring > 0)){f" or min(d) <= {reach}" if reach else ""}"""


_BOXED = 'least(a.ax, a.bx) <= greatest(b.ax, b.bx) and least(b.ax, b.bx) <= greatest(a.ax, a.bx) and least(a.ay, a."by") <= greatest(b.ay, b."by") and least(b.ay, b."by") <= greatest(a.ay, a."by")'


def _turned(p: tuple[str, str], q: tuple[str, str], s: tuple[str, str]) -> str:
    return f"(({q[0]} - {p[0]}) * ({s[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({s[0]} - {p[0]}))"


_P = [("a.ax", "a.ay"), ("a.bx", 'a."by"'), ("b.ax", "b.ay"), ("b.bx", 'b."by"')]
_MEET = f"{_turned(_P[0], _P[1], _P[2])} * {_turned(_P[0], _P[1], _P[3])} < 1e-9 and {_turned(_P[2], _P[3], _P[0])} * {_turned(_P[2], _P[3], _P[1])} < 1e-9"
_TOUCH = f"touch as (select distinct a.run, a.layer, a.pour_id a, b.pour_id b from re a join re b on a.run = b.run and a.layer = b.layer and a.pour_id < b.pour_id and coalesce(a.net = b.net, true) and {_BOXED} and {_MEET})"
_CORNERS = "qv as (select distinct pour_id own, run, layer, net, ax x, ay y from re)"
_ADJACENT = f"""{_CORNERS}, vh as (select own, pour_id from (select q.own, q.x, q.y, pour_id, ring, sum(case when (ay > q.y) <> ("by" > q.y) and q.x < ax + (q.y - ay) * (bx - ax) / ("by" - ay) then 1 else 0 end) % 2 = 1 odd, min({_far('q.x', 'q.y', 'ax', 'ay', 'bx', _E)}) d
  from qv q join re on q.run = re.run and q.layer = re.layer and q.own <> re.pour_id and coalesce(q.net = re.net, true) group by all) group by own, x, y, pour_id having (bool_or(odd and ring = 0) and not bool_or(odd and ring > 0)) or min(d) <= {REACH}),
adj as (select distinct cc.run, cc.layer, least(own, vh.pour_id) a, greatest(own, vh.pour_id) b from vh join cc on cc.pour_id = own)"""
_DRILLED = f"dh as (select h.via_id, h.pour_id, cc.layer, cc.net from ({_hits('vi', 'via_id', 0, 'true')}) h join cc using (pour_id)), df as (select * from (select *, row_number() over (partition by via_id order by net is null, layer, pour_id) k from dh) where k = 1), dl as (select distinct df.pour_id a, dh.pour_id b from dh join df using (via_id) where dh.pour_id <> df.pour_id and coalesce(dh.net = df.net, true))"
_SNAP = f"""own as (select pad_id, arg_min(pour_id, (area, pour_id)) pour_id from ({_hits('pd', 'pad_id', 0)}) join pz using (pour_id) join pd using (pad_id) join cc using (pour_id) where pd.net is null or pd.net = cc.net group by 1),
bd as (select pad_id, pour_id, pd.net, cc.net pour_net, min({_far('x', 'y', 'ax', 'ay', 'bx', _E)}) d from pd join re on pd.run = re.run and pd.layer = re.layer join cc using (pour_id) where pad_id not in (select pad_id from own) group by all)"""

ORACLES = {
    "fitted_transforms": _CTE
    + f""", vb as (select board_id, min(x) x0, min(y) y0, -min(-x) x1, -min(-y) y1 from v where {_FINITE} group by 1), pb as (select board_id, min(px) x0, min(py) y0, -min(-px) x1, -min(-py) y1 from p where {_FINITE} group by 1),
      ft as (select vb.*, pb.x0 tx0, pb.x1 tx1, pb.y0 ty0, pb.y1 ty1, case when abs(((vb.x1 - vb.x0) / nullif(pb.x1 - pb.x0, 0) + (vb.y1 - vb.y0) / nullif(pb.y1 - pb.y0, 0)) / 2 - 25.4) < 5 then 1 / 25.4 else 1 end s from vb join pb using (board_id)),
      fd as (select *, (tx0 + tx1) / 2 - s * (x0 + x1) / 2 dx, (ty0 + ty1) / 2 - s * (y0 + y1) / 2 dy from ft)
      select board_id, round(s, 5) scale, round(dx, 5) dx, round(dy, 5) dy, round(x0 * s + dx, 5) x, round(y0 * s + dy, 5) y, round(x0, 5) back_x, round(y0, 5) back_y, round(tx0 + tx1 - (x0 * s + dx), 5) mirror_x from fd""",
    "pour_segments": _FOUR + f"""select pour_id, round({_SEG[0]}, 4) distance, round({_SEG[1]}, 4) along, round((bx - ax) * (dx - cx) + ("by" - ay) * (dy - cy), 4) + 0 dot, round((bx - ax) * (dy - cy) - ("by" - ay) * (dx - cx), 4) + 0 "cross",
      {_CROSSES} crosses, {_CLOSE} "close", round(sqrt((ax - bx) ** 2 + (ay - "by") ** 2) / (5.95e4::double * 0.035::double * 0.2), 6) ohms from s""",
    "pour_centres": _RINGS.replace("from c join lm on c.layer = lm.layer_id where", "from c left join lm on c.layer = lm.layer_id where") + f""", bx as (select pour_id, (min(ax) + max(ax)) / 2 x, (min(ay) + max(ay)) / 2 y from re where ring = 0 group by 1),
      ev as (select pour_id, ring, sum(case when (ay > y) <> ("by" > y) and x < ax + (y - ay) * (bx - ax) / ("by" - ay) then 1 else 0 end) % 2 = 1 odd, min({_far('x', 'y', 'ax', 'ay', 'bx', _E)}) d from re join bx using (pour_id) group by 1, 2),
      al as (select pour_id, bool_or(odd and ring = 0) and not bool_or(odd and ring > 0) inside, bool_or(odd) in_ring, min(d) d, min(case when ring = 0 then d end) o from ev group by 1)
      select pour_id, inside, in_ring, round(d, 4) distance, round(o, 4) from_outline, inside or d <= 0.5 "within", true in_box from al""".replace("(bx - ax) / ", "(re.bx - ax) / "),
    "overlapping_boxes": _RINGS + """, bb as (select pour_id, run, layer, min(ax) x0, max(ax) x1, min(ay) y0, max(ay) y1 from re where ring = 0 group by all),
      pr as (select *, lead(pour_id) over w other_id, lead(x0) over w u0, lead(x1) over w u1, lead(y0) over w v0, lead(y1) over w v1 from (select b.*, c.layer lid, c.board_id from bb b join c using (pour_id)) window w as (partition by board_id, lid order by pour_id))
      select pour_id, other_id, x0 <= u1 and u0 <= x1 and y0 <= v1 and v0 <= y1 overlap from pr where other_id is not null""",
    "oriented_pours": _CTE + f"select pour_id, round(a + {EDGE}, 4) given, round(abs(a) + {EDGE}, 4) outline, round({EDGE} - abs(a), 4) hole, round({EDGE} - a, 4) mirrored, round(a + {EDGE}, 4) turned from ga where n >= 3",
    "pad_shapes": _CTE + """, w as (select pad_id, coalesce(hole_diameter, 0.5) + 0.2 w from p), n as (select *, w * 1.5 h, greatest(4, least(32, ceil(least(w / 8, w / 2) * (pi() / 2) / 0.02)))::bigint k from w)
      select pad_id, round(12 * (w / 2) ** 2 * sin(2 * pi() / 24), 4) circle_area, round(10 * (w / 2) ** 2 * sin(pi() / 10) + (h - w) * w, 4) oval_area, round(w * h, 4) rect_area,
        round(w * h - (w / 8) ** 2 * (4 - 2 * k * sin(pi() / 2 / k)), 4) rounded_area, 24::bigint circle_points, 22::bigint oval_points, 4 * (k + 1) rounded_points, round(w * cos(radians(30)) + h * sin(radians(30)), 4) turned_width from n""",
    "pour_arcs": _FOUR + """, q as (select *, pour_id % 7 + 1.0::double r from s), k as (select *, greatest(8, least(256, ceil(pi() / 2 * r / 0.02)))::bigint n, greatest(8, least(256, ceil(3 * pi() / 2 * r / 0.02)))::bigint m, sqrt((ax - bx) ** 2 + (ay - "by") ** 2) len from q)
      select pour_id, n + 1 quarter_points, round(n * 2 * r * sin(pi() / 4 / n), 4) quarter_length, m + 1 rest_points, round(m * 2 * r * sin(3 * pi() / 4 / m), 4) rest_length, round((ax + 3 * bx + 3 * cx + dx) / 8, 4) curve_x, round((ay + 3 * "by" + 3 * cy + dy) / 8, 4) curve_y,
        17::bigint curve_points, round(case when len = 0 then 10 * 0.15 ** 2 * sin(2 * pi() / 20) else 10 * 0.15 ** 2 * sin(pi() / 10) + len * 0.3 end, 4) track_area from k""",
    "simplified_pours": _CTE + "select pour_id, true fewer, true same_area, true ends from c where len(vertices) >= 3",
    "matching_nets": _CTE + "select load_id, count(*) pads from lo join p on lo.board_id = p.board_id and (coalesce(lo.net, '') = '' or lo.net = coalesce(p.net, '')) group by 1",
    "rail_vias": _CTE + "select via_id, board_id, net, len(names) layers, coalesce(hole_diameter, 0) > 0 drilled from v where (board_id, net) in (select (board_id, net) from tn)",
    "run_plan": _CTE + """, s as (select distinct board_id, net from so where net <> '' and board_id is not null), l as (select distinct board_id, net from lo where net <> '' and board_id is not null), b as (select * from s join l using (board_id, net))
      select board_id, 0 run_no, null net, count(b.net) rails, case when count(b.net) = 0 then 'skipped' else 'ready' end status from (select board_id from s union select board_id from l) left join b using (board_id) group by 1
      union all select board_id, row_number() over (partition by board_id order by net), net, 1, 'ready' from b""",
    "copper_hits": _RINGS + _hits("pd", "pad_id", REACH),
    "touching_pours": _RINGS + f", {_TOUCH} select * from touch",
    "adjacent_pours": _RINGS + f", {_ADJACENT} select * from adj",
    "via_links": _RINGS + f", {_DRILLED} select * from dl",
    "pour_nets": _RINGS + f""", {_TOUCH}, {_DRILLED}, ed as (select a, b from touch union select b, a from touch union select a, b from dl union select b, a from dl),
      reach as (select pour_id node, pour_id seen from cc union select r.node, e.b from reach r join ed e on r.seen = e.a),
      votes as (select node, max(net) vote from reach join cc on pour_id = seen group by 1 having min(net) = max(net)) select pour_id, net, coalesce(net, vote) resolved from cc left join votes on node = pour_id""",
    "relabelled_pours": _RINGS + f""", mid as (select pour_id own, run, layer, avg(ax) x, avg(ay) y from re where ring = 0 group by all),
      ip as (select own pour_id, min(cc.net) net from ({_hits('mid', 'own', 0)}) join cc using (pour_id) group by 1),
      pn as (select h.pour_id, min(pd.net) net from ({_hits('pd', 'pad_id', 0)}) h join pd using (pad_id) group by 1),
      vn as (select h.pour_id, min(vi.net) net from ({_hits('vi', 'via_id', 0, 'list_contains(q.names, re.layer)')}) h join vi using (via_id) group by 1)
      select pour_id, coalesce(cc.net, ip.net, pn.net, vn.net, '') net from cc left join ip using (pour_id) left join pn using (pour_id) left join vn using (pour_id)""",
    "fed_pours": _RINGS + f""", te as (select row_number() over () id, e.board_id run, ln layer, x, y, kind, coalesce(so.net, lo.net) net from e left join so on kind = 'source' and source_id = owner_id left join lo on kind = 'load' and load_id = owner_id
        where side = 'pos' and {_FINITE} and ln is not null and coalesce(so.net, lo.net, '') <> ''),
      th as (select distinct te.run || '#' || te.net node, kind, h.pour_id from ({_hits('te', 'id', REACH)}) h join te using (id) join cc using (pour_id) where coalesce(cc.net = te.net, true)), {_ADJACENT},
      ed as (select a::varchar a, b::varchar b from adj union select b::varchar, a::varchar from adj union select node, pour_id::varchar from th union select pour_id::varchar, node from th),
      reach as (select distinct node seen from th where kind = 'source' union select e.b from reach r join ed e on r.seen = e.a) select pour_id from cc where pour_id::varchar in (select seen from reach)""",
    "nearest_copper": _RINGS + f""", {_SNAP}, oc as (select * from bd where net = pour_net), ok as (select oc.*, min(d) over (partition by pad_id) least from oc),
      o1 as (select pad_id, arg_min(pour_id, (area, pour_id)) pour_id, arg_min(d, (area, pour_id)) d from ok join pz using (pour_id) where d <= least + 1e-3 group by 1),
      f0 as (select *, min(d) over (partition by pad_id) least from bd where pad_id not in (select pad_id from o1)),
      f1 as (select pad_id, arg_min(pour_id, (area, pour_id)) pour_id, arg_min(d, (area, pour_id)) d from f0 join pz using (pour_id) where d <= least + 1e-3 group by 1)
      select pad_id, pour_id, 0.0::double distance from own union all select pad_id, pour_id, round(d, 4) from o1 union all select pad_id, pour_id, round(d, 4) from f1""",
    "snap_reasons": _RINGS + f""", {_SNAP}, got as (select pad_id from own union select pad_id from bd join pz using (pour_id) where net = pour_net and area >= 1),
      ly as (select run, layer, count(*) n from cc group by 1, 2), ln2 as (select run, layer, net, count(*) n, count(*) filter (where area >= 1) large, max(area) most from cc join pz using (pour_id) where net is not null group by 1, 2, 3)
      select pad_id, case when ln2.n is null then format('no copper of net {{}} among {{}} polygons of layer {{}}', pd.net, coalesce(ly.n, 0), pd.layer) else format('{{}} polygons of net {{}} on layer {{}}, {{}} of at least 1.00 mm2, the largest {{:.3f}} mm2', ln2.n, pd.net, pd.layer, large, most) end reason
      from pd left join ly using (run, layer) left join ln2 on ln2.run = pd.run and ln2.layer = pd.layer and ln2.net = pd.net where pd.net is not null and pad_id not in (select pad_id from got)""",
    "pour_booleans": _RINGS + "select pour_id, other_id, true sums, true parts, true bounds from (select pour_id, lead(pour_id) over (partition by board_id, layer order by pour_id) other_id from c where len(vertices) >= 3) where other_id is not null",
    "pour_meshes": _RINGS + "select pour_id, true meshed, true clipped from c where len(vertices) >= 3",
    "boundary_polygons": _RINGS + "select pour_id, layer, coalesce(net, '') net, max(case when ring = 0 then len(v) end) outline_points, count(*) - 1 holes, sum(len(v))::bigint points from rg group by all",
    "layer_outlines": _RINGS + "select run, layer, count(*) pours, true at_most, true at_least from cc group by 1, 2",
    "clipped_layers": _RINGS + "select distinct run, layer, true kept, true cut from cc",
    "orientation_scores": _RINGS + f"""select run, sum(s)::bigint score from (select cc.run, pour_id, case when min(pd.net) = max(pd.net) then 1 else -2 end s from ({_hits('pd', 'pad_id', 0)}) h join pd using (pad_id) join cc using (pour_id) where pd.net is not null group by 1, 2) group by 1""",
}
