"""From board archives and run configurations to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..sources import config, odb
from ..staging import staged
from .analyze import Settings, analyze, rail_runs, response

OUTLINE = "board_outline_layer"


def _stem(name: str) -> Column:
    return F.regexp_replace(F.col(name), r"\..*$", "")


def _box(points: DataFrame, name: str) -> DataFrame:
    ends = [f(c).alias(f"{c}{k}") for k, f in ((0, F.min), (1, F.max)) for c in "xy"]
    return points.groupBy("run").agg(F.struct(*ends).alias(name))


def file_tables(files: DataFrame, configs: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``analyze`` from ``files (board, path, content)`` of archives and ``configs (run, config, bounds)``.

    A run is matched with the archive whose file name, up to the first dot, is its own. Copper comes in the unit of the
    configuration, to whose box (that of the editor, or else of its pads, vias and terminals) the archive's is fitted.
    Layers compare without case; those the configuration does not list are left out, runs without an archive have no
    copper.
    """
    tables = config.config_tables(configs.withColumn("run", _stem("run")))
    layers = tables["layers"].select("run", F.col("name").alias("layer"), "position", "conductance", "layer_id").join(tables["thickness"].select("run", "layer", "thickness"), ["run", "layer"], "left")
    layers = staged(layers, "layers")
    board = lambda rows: rows.withColumn("run", _stem("board")).drop("board")
    found = staged(board(odb.board_polygons(files)), "archive")
    drills = staged(board(odb.drills(files)).withColumn("drill_id", F.monotonically_increasing_id()), "drills")

    # Where the editor's box lies in the archive, and the way back.
    ends = tables["terminals"].select("run", "x", "y").unionByName(tables["vias"].select("run", "x", "y")).unionByName(tables["pads"].select("run", "x", "y"))
    given = tables["runs"].filter("bounds is not null").select("run", F.struct(F.col("bounds.minX").alias("x0"), F.col("bounds.minY").alias("y0"), F.col("bounds.maxX").alias("x1"), F.col("bounds.maxY").alias("y1")).alias("given"))
    source = _box(ends.dropna(), "around").join(given, "run", "full").select("run", F.coalesce("given", "around").alias("source"))
    target = _box(found.select("run", F.explode(F.flatten("rings")).alias("p")).select("run", "p.x", "p.y"), "target")
    fit = staged(source.join(target, "run").select("run", geo.fitted_transform(F.col("source"), F.col("target")).alias("t")), "fit")
    back = lambda p: geo.inverse_affine(p, F.col("t.scale"), F.col("t.dx"), F.col("t.dy"))
    turned = found.join(fit, "run").withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, back)))
    drills = drills.join(fit, "run").withColumn("p", back(geo.point(F.col("x"), F.col("y")))).select("run", "drill_id", "p.x", "p.y", (F.col("diameter") / F.col("t.scale")).alias("diameter"), "is_via")

    low = F.lower("layer").alias("_low")
    names = layers.select("run", F.col("layer").alias("_layer"), low)
    by_id = lambda rows: rows.withColumnRenamed("layer", "layer_id").join(layers.select("run", "layer_id", "layer"), ["run", "layer_id"])
    vias = tables["vias"].withColumn("layer", F.explode("layer_names")).withColumn("_low", F.lower("layer")).join(names, ["run", "_low"])
    vias = vias.groupBy("run", F.col("via_no").cast("long").alias("via_id"), F.coalesce("net", F.lit("")).alias("net"), "x", "y", F.coalesce("hole_diameter", F.lit(0.0)).alias("hole_diameter")).agg(F.collect_set("_layer").alias("layers"))
    kinds = [tables[k].select("run", F.lit(k[:-1]).alias("kind"), F.col("element_no").cast("long").alias("element_id"), "net", "gnd_net", F.col(v).alias("value")) for k, v in (("sources", "voltage"), ("loads", "current"))]
    through = F.coalesce("is_tht", F.lit(False))
    terminals = tables["terminals"].filter("x is not null and y is not null").withColumn("_low", F.lower("layer")).join(names, ["run", "_low"], "left")
    return {
        "polygons": turned.withColumn("_low", F.lower("layer")).join(names, ["run", "_low"]).select("run", F.col("_layer").alias("layer"), "net", "rings"),
        "outlines": turned.filter(F.col("layer") == OUTLINE).select("run", "rings"),
        "drills": drills,
        "layers": layers.select("run", "layer", "position", "conductance", "thickness"),
        "vias": vias,
        "tracks": by_id(tables["tracks"]).select("run", F.col("track_no").cast("long").alias("track_id"), "net", "layer", "x1", "y1", "x2", "y2", "width"),
        "pours": by_id(tables["copper_pours"]).select("run", "layer", "net", F.concat(F.array("vertices"), F.coalesce("holes", F.array())).alias("rings")),
        "pads": tables["pads"].withColumn("_low", F.lower("layer")).join(names, ["run", "_low"]).select("run", F.col("_layer").alias("layer"), "net", "x", "y"),
        "elements": kinds[0].unionByName(kinds[1]),
        "terminals": terminals.select("run", "kind", F.col("element_no").cast("long").alias("element_id"), "is_ground", F.col("pad_no").cast("int").alias("pad_no"), F.when(~through, F.col("_layer")).alias("layer"), "x", "y"),
        "grounds": tables["runs"].select("run", F.col("gnd_net").alias("net")),
    }


def analyze_files(spark: SparkSession, archives: str, configs: str, settings: Settings = Settings(), bounds_member: str = "bounds", each_rail: bool = False) -> DataFrame:  # noqa: B008
    """``(run, response)``: the JSON answer of every run. With ``each_rail``, runs of several rails have one more answer
    for each of them (``run/net``), whether or not the others succeed."""
    tables = file_tables(odb.archive_files(spark, archives), config.read_configs(spark, configs, bounds_member))
    return response(analyze(rail_runs(tables) if each_rail else tables, settings))


def net_information(tables: dict[str, DataFrame]) -> DataFrame:
    """Per run and net of a source: voltage, load current and the positions of its terminals in millimetres."""
    rails = tables["elements"].groupBy("run", "net").agg(F.max(F.when(F.col("kind") == "source", F.col("value"))).alias("voltage"), F.sum(F.when(F.col("kind") == "load", F.col("value")).otherwise(0.0)).alias("current"))
    ends = tables["terminals"].filter("not is_ground").join(tables["elements"].select("run", "kind", "element_id", "net"), ["run", "kind", "element_id"])
    places = ends.groupBy("run", "net").agg(F.array_sort(F.collect_list(F.struct("kind", "layer", "x", "y"))).alias("terminals"))
    return rails.filter("net <> ''").join(places, ["run", "net"], "left")
