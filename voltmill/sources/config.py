"""Run configurations (one JSON document per run) as normalized tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAD = "struct<x:double,y:double,layer:string,net:string,is_tht:boolean,hole_diameter:double,pin_name:string>"
POINT = "struct<x:double,y:double>"
BOUNDS = "struct<minX:double,minY:double,maxX:double,maxY:double>"
#: The schema of a run configuration; lengths in millimetres.
SCHEMA = f"""struct<project_name:string, gnd_net:string, temp_rise:double,
 layers:array<struct<name:string,conductance:double,layer_id:int>>, layer_cu_thickness:map<string,double>,
 pads:array<{PAD}>,
 vias:array<struct<x:double,y:double,hole_diameter:double,diameter:double,layer_names:array<string>,net:string,via_type:string>>,
 tracks:array<struct<net:string,width:double,layer:int,x1:double,y1:double,x2:double,y2:double>>,
 sources:array<struct<net:string,voltage:double,gnd_net:string,ref_des:string,pads:array<{PAD}>,gnd_pads:array<{PAD}>>>,
 loads:array<struct<net:string,current:double,gnd_net:string,ref_des:string,pads:array<{PAD}>,gnd_pads:array<{PAD}>>>,
 copper_pours:array<struct<net:string,layer:int,vertices:array<{POINT}>,holes:array<array<{POINT}>>>>>"""


def parse_configs(texts: DataFrame, bounds_member: str = "bounds") -> DataFrame:
    """``(run, config, bounds)`` of ``(run, value)``, one JSON document each. Text that is no JSON has a null config;
    ``bounds`` is the box the editor gives in the member ``bounds_member``."""
    bounds = F.from_json("value", f"struct<`{bounds_member}`:{BOUNDS}>").getField(bounds_member)
    return texts.select("run", F.from_json("value", SCHEMA).alias("config"), bounds.alias("bounds"))


def read_configs(spark: SparkSession, path: str, bounds_member: str = "bounds") -> DataFrame:
    """``parse_configs`` of JSON files; ``run`` is the file name."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("run"), "value")
    return parse_configs(texts, bounds_member)


def config_tables(configs: DataFrame) -> dict[str, DataFrame]:
    """Normalized tables by member: layers, pads, vias, tracks, sources, loads, terminals, copper_pours and runs.

    Absent members have no rows; absent numbers are 0, absent temperature rise 10, absent conductance 1, absent names
    empty. ``position`` orders layers as listed.
    """
    c = configs.filter("config is not null").select("run", "config.*", "bounds")
    member = lambda name, no: c.select("run", F.posexplode(name).alias(no, "m")).select("run", no, "m.*")
    named = lambda *names: [F.coalesce(n, F.lit("")).alias(n) for n in names]
    number = lambda *names: [F.coalesce(n, F.lit(0.0)).alias(n) for n in names]
    out = {
        "runs": c.select("run", *named("project_name", "gnd_net"), F.coalesce("temp_rise", F.lit(10.0)).alias("temp_rise"), "bounds"),
        "layers": member("layers", "position").select("run", "position", *named("name"), F.coalesce(F.nullif("conductance", F.lit(0.0)), F.lit(1.0)).alias("conductance"), "layer_id"),
        "thickness": c.select("run", F.explode("layer_cu_thickness").alias("layer", "thickness")),
        "pads": member("pads", "pad_no"),
        "vias": member("vias", "via_no"),
        "tracks": member("tracks", "track_no"),
        "copper_pours": member("copper_pours", "pour_no"),
        "sources": member("sources", "element_no").select("run", "element_no", *named("net", "gnd_net", "ref_des"), *number("voltage"), "pads", "gnd_pads"),
        "loads": member("loads", "element_no").select("run", "element_no", *named("net", "gnd_net", "ref_des"), *number("current"), "pads", "gnd_pads"),
    }
    ends = None
    for kind in ("sources", "loads"):
        for side, net in (("pads", "net"), ("gnd_pads", "gnd_net")):
            part = out[kind].select("run", F.lit(kind[:-1]).alias("kind"), "element_no", F.lit(side == "gnd_pads").alias("is_ground"), F.col(net).alias("want_net"), F.posexplode(side).alias("pad_no", "p")).select("run", "kind", "element_no", "is_ground", "want_net", "pad_no", "p.x", "p.y", "p.layer", "p.is_tht", "p.hole_diameter")
            ends = part if ends is None else ends.unionByName(part)
    out["terminals"] = ends
    return out


def target_nets(tables: dict[str, DataFrame]) -> DataFrame:
    """``(run, net)``: the ground net and those of sources and loads and their grounds, without the empty name."""
    parts = [tables["runs"].select("run", F.col("gnd_net").alias("net"))]
    parts += [tables[k].select("run", F.col(n).alias("net")) for k in ("sources", "loads") for n in ("net", "gnd_net")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.filter("net <> ''").distinct()
