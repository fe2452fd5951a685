"""Queries of the core problems over the board tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import orphans
from ..operators.shred import ANALYSIS, cut_large, parse, shred
from ..operators.spatial import near_or_inside
from ..tables import known, layer_key, layer_keys, micros, once_per_key, table

#: Largest distance of a pad from a via in millimetres.
PAD_REACH = 0.25
MIL = 0.0254


HEADS, PARTS = {"analysis", "diagnostic", "layer"}, {"mesh", "tag", "vertex", "triangle"}


def solution_tables(spark: SparkSession, folder: str, want: set[str] | None = None) -> dict[str, DataFrame]:
    """The flat tables of the analysis responses. A failed analysis has its own row and no layers."""
    once = cut_large(once_per_key(table(spark, folder, "solutions"), "solution_id", "payload"), "solution_id", "payload", "result", "layer_solutions", ("meshes", "disconnected_meshes"), ("success",))
    parsed = once.select("solution_id", "kind", parse("payload", "result", "layer_solutions").alias("response"))
    failed = F.coalesce(~F.try_variant_get("response", "$.success", "boolean"), F.lit(False))
    # The heads of documents that were cut have the first tables, their parts the others.
    tables: dict[str, DataFrame] = {}
    for names, kind in ((HEADS, "head"), (PARTS, "part")):
        wanted = names if want is None else names & want
        own = parsed.filter(F.col("kind").isNull() | (F.col("kind") == kind))
        for group, kept in (({"analysis"}, own), (names - {"analysis"}, own.filter(~failed))):
            if wanted & group:
                tables |= shred(kept.drop("kind"), "solution_id", "response", ANALYSIS, "analysis", wanted & group)
    return tables


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per triangle of the solved meshes."""
    triangles = solution_tables(spark, folder, {"triangle"})["triangle"].filter("role = 'meshes'")
    return triangles.select("solution_id", F.col("layer_no"), "mesh_no", "triangle_no", "v0", "v1", "v2")


def p2_triangles(spark: SparkSession, folder: str) -> DataFrame:
    """All triangles with the values kept per triangle; ``role`` tells solved from disconnected meshes."""
    return solution_tables(spark, folder, {"triangle"})["triangle"]


def p2_vertices(spark: SparkSession, folder: str) -> DataFrame:
    """All vertices with their potentials."""
    return solution_tables(spark, folder, {"vertex"})["vertex"]


def p2_meshes(spark: SparkSession, folder: str) -> DataFrame:
    """All meshes with the inlined mesh quality."""
    return solution_tables(spark, folder, {"mesh"})["mesh"]


def p2_layers(spark: SparkSession, folder: str) -> DataFrame:
    """All layers of the solutions."""
    return solution_tables(spark, folder, {"layer"})["layer"]


def p2_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """One row per readable response with the inlined solver information."""
    return solution_tables(spark, folder, {"analysis"})["analysis"]


def located_pads(spark: SparkSession, folder: str) -> DataFrame:
    """Pads with coordinates in millimetres."""
    pads = table(spark, folder, "pads")
    scale = F.when(F.lower(F.trim("coord_unit")) == "mil", MIL).otherwise(1.0)
    return pads.withColumn("x", F.col("x") * scale).withColumn("y", F.col("y") * scale)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pads near each via on a common layer, and pours that contain it."""
    vias = table(spark, folder, "vias").select(F.col("board_id").alias("space"), F.col("via_id").alias("id"), "x", "y", layer_keys("layer_names").alias("tags"))
    # A blank layer name is no layer: it suits no via, unlike null.
    pads = located_pads(spark, folder).filter("layer is null or trim(layer) <> ''").select(F.col("board_id").alias("space"), F.col("pad_id").alias("id"), "x", "y", layer_key("layer").alias("tag"))
    layers = F.broadcast(table(spark, folder, "layer_map").select(F.col("layer_id").alias("layer"), layer_key("layer_name").alias("tag")).dropDuplicates(["layer"]))  # a fixed table
    pours = table(spark, folder, "copper_pours").join(layers, "layer")
    pours = pours.select(F.col("board_id").alias("space"), F.col("pour_id").alias("id"), "tag", F.concat(F.array("vertices"), F.coalesce("holes", F.array())).alias("rings"))
    found = near_or_inside(vias, pads, pours, PAD_REACH)
    kind = F.when(F.col("kind") == "site", "pad").otherwise("pour")
    return found.select(kind.alias("match_kind"), F.col("point_id").alias("via_id"), "other_id")


REFERENCES = (("sources", "source_id", "net"), ("loads", "load_id", "net"), ("vias", "via_id", "net"), ("layer_shapes", "shape_id", "net_label"))


def net_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the four referring tables whose known net was not alive on their board when they were recorded."""
    refs = None
    for name, key, net in REFERENCES:
        part = table(spark, folder, name).select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_id"), "board_id", known(net).alias("net_name"), micros("recorded_at").alias("at"))
        part = part.filter("net_name is not null")
        refs = part if refs is None else refs.unionByName(part)
    nets = table(spark, folder, "nets").select("board_id", "net_name", micros("created_at").alias("born"), micros("deleted_at").alias("gone"))
    lost = orphans(refs, nets, ["board_id", "net_name"], "at", "born", "gone")
    # A row that was delivered twice has equal content, so it is found twice or not at all.
    return lost.dropDuplicates().withColumn("ref_month", F.date_format(F.timestamp_micros("at"), "yyyy-MM"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references, one row each."""
    return net_orphans(spark, folder).select("ref_table", "ref_month", "ref_id")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references counted per table and month."""
    return net_orphans(spark, folder).groupBy("ref_table", "ref_month").agg(F.count("*").alias("orphans"), F.countDistinct("board_id", "net_name").alias("missing_nets"))


QUERIES = {"p2_found": p2_found, "p2_triangles": p2_triangles, "p2_vertices": p2_vertices, "p2_meshes": p2_meshes, "p2_layers": p2_layers, "p2_analyses": p2_analyses, "p4_found": p4_found, "p5_found": p5_found, "p5_report": p5_report}

# Opens JSON text and lone objects in the way the operator defines, level by level.
_J = "case when json_type({x}) = 'VARCHAR' then try_cast(json_extract_string({x}, '$') as json) else {x} end"
_L = "case json_type({x}) when 'ARRAY' then cast({x} as json[]) when 'OBJECT' then [{x}] else [] end"
_P2 = f"""
with recursive once as (select distinct on (solution_id) solution_id, try_cast(regexp_replace(payload, '^[^\\[{{"]+', '') as json) j from solutions),
opened as (select solution_id, {_J.format(x='j')} j from once),
taken as (select solution_id, case when json_type(j) = 'OBJECT' and json_type(j, '$.result') <> 'NULL' then json_extract(j, '$.result') else j end j from opened),
docs as (select solution_id, {_J.format(x='j')} j from taken),
good as (select solution_id, case json_type(j) when 'ARRAY' then j when 'OBJECT' then json_extract(j, '$.layer_solutions') end ls from docs
         where j is not null and not (json_type(j) = 'OBJECT' and coalesce(json_extract_string(j, '$.success') = 'false', false))),
ls as (select solution_id, {_J.format(x='ls')} ls from good),
l0 as (select solution_id, unnest({_L.format(x='ls')}) l, generate_subscripts({_L.format(x='ls')}, 1) - 1 layer_no from ls),
layers as (select solution_id, layer_no, {_J.format(x='l')} l from l0 where json_type(l) <> 'NULL'),
roles as (select 'meshes' as "role" union all select 'disconnected_meshes'),
m0 as (select solution_id, layer_no, "role", json_extract(l, '$.' || "role") m from layers, roles),
m1 as (select solution_id, layer_no, "role", {_J.format(x='m')} m from m0),
m2 as (select solution_id, layer_no, "role", unnest({_L.format(x='m')}) m, generate_subscripts({_L.format(x='m')}, 1) - 1 mesh_no from m1),
meshes as (select solution_id, layer_no, "role", mesh_no, {_J.format(x='m')} m from m2 where json_type(m) <> 'NULL'),
t0 as (select *, json_extract(m, '$.triangles') t, json_extract(m, '$.power_densities') pw, json_extract(m, '$.current_densities') cd from meshes),
t1 as (select solution_id, layer_no, "role", mesh_no, pw, cd, unnest({_L.format(x='t')}) t, generate_subscripts({_L.format(x='t')}, 1) - 1 triangle_no from t0),
tri as (select solution_id, layer_no, "role", mesh_no, triangle_no, case json_type(t) when 'OBJECT' then json_extract(t, '$.vertices') else t end v,
          json_extract(pw, '$[' || triangle_no || ']') p, json_extract(cd, '$[' || triangle_no || ']') c from t1 where json_type(t) <> 'NULL'),
triangles as (select solution_id, layer_no, "role", mesh_no, triangle_no, (v->>0)::bigint v0, (v->>1)::bigint v1, (v->>2)::bigint v2,
          (p->>'$')::double power_density, (c->>0)::double jx, (c->>1)::double jy from tri),
v0 as (select solution_id, layer_no, "role", mesh_no, json_extract(m, '$.potentials') pot, json_extract(m, '$.vertices') v from meshes),
v1 as (select solution_id, layer_no, "role", mesh_no, pot, unnest({_L.format(x='v')}) v, generate_subscripts({_L.format(x='v')}, 1) - 1 vertex_no from v0),
vertices as (select solution_id, layer_no, "role", mesh_no, vertex_no, coalesce(v->>'x', v->>0)::double x, coalesce(v->>'y', v->>1)::double y,
          (json_extract(pot, '$[' || vertex_no || ']')->>'$')::double potential from v1 where json_type(v) <> 'NULL')
"""
_P5 = """
with refs as (
  select 'sources' ref_table, source_id ref_id, board_id, net net_name, recorded_at from sources union
  select 'loads', load_id, board_id, net, recorded_at from loads union
  select 'vias', via_id, board_id, net, recorded_at from vias union
  select 'layer_shapes', shape_id, board_id, net_label, recorded_at from layer_shapes),
lost as (
  select * from refs r where net_name is not null and net_name <> '' and not exists (
    select 1 from nets n where n.board_id = r.board_id and n.net_name = r.net_name
      and n.created_at <= r.recorded_at and (n.deleted_at is null or n.deleted_at > r.recorded_at)))
"""

ORACLES = {
    "p2_found": _P2 + """select solution_id, layer_no, mesh_no, triangle_no, v0, v1, v2 from triangles where "role" = 'meshes'""",
    "p2_triangles": _P2 + "select * from triangles",
    "p2_vertices": _P2 + "select * from vertices",
    "p2_meshes": _P2 + """select solution_id, layer_no, "role", mesh_no, m->>'net' net, (m->>'$.mesh_quality.min_angle')::double mesh_quality_min_angle from meshes""",
    "p2_layers": _P2 + "select solution_id, layer_no, l->>'layer_name' layer_name from layers",
    "p2_analyses": _P2 + """select solution_id, case json_type(j) when 'OBJECT' then (j->>'success')::boolean end success, case json_type(j) when 'OBJECT' then j->>'message' end message,
      case json_type(j) when 'OBJECT' then (j->>'$.solver_info.ground_node_current')::double end solver_info_ground_node_current,
      case json_type(j) when 'OBJECT' then (j->>'$.solver_info.residual_norm')::double end solver_info_residual_norm from docs where j is not null and json_type(j) <> 'NULL'""",
    "p4_found": """
with v as (select distinct via_id, board_id, x, y, list_distinct(list_filter(list_transform(layer_names, lambda n: lower(trim(n))), lambda n: n is not null and n <> '')) names
           from vias where x is not null and y is not null and not isnan(x) and not isnan(y)),
p as (select distinct pad_id, board_id, x * case when coord_unit = 'mil' then 0.0254 else 1 end px, y * case when coord_unit = 'mil' then 0.0254 else 1 end py, lower(trim(layer)) ln
      from pads where x is not null and y is not null and not isnan(x) and not isnan(y)),
c as (select pour_id, board_id, lower(trim(m.layer_name)) ln, vertices, holes
      from (select distinct on (pour_id) * from copper_pours) c join layer_map m on c.layer = m.layer_id where len(vertices) >= 3),
rings as (select pour_id, board_id, ln, 0 ring, vertices r from c union all
          select pour_id, board_id, ln, i, holes[i] from (select *, unnest(range(1, len(holes) + 1)) i from c)),
edges as (select pour_id, board_id, ln, ring, r[i].x ax, r[i].y ay, r[i % len(r) + 1].x bx, r[i % len(r) + 1].y b_y
          from (select *, unnest(range(1, len(r) + 1)) i from rings where len(r) >= 3)),
crossing as (
  select v.via_id, e.pour_id, e.ring, count(*) n from v join edges e on v.board_id = e.board_id and list_contains(v.names, e.ln)
    and (e.ay > v.y) <> (e.b_y > v.y) and v.x < e.ax + (v.y - e.ay) * (e.bx - e.ax) / (e.b_y - e.ay)
  group by all having count(*) % 2 = 1)
select 'pad' match_kind, via_id, pad_id other_id from v join p on v.board_id = p.board_id and len(names) > 0 and (ln is null or ln <> '' and list_contains(names, ln))
  and (x - px) * (x - px) + (y - py) * (y - py) <= 0.0625
union all
select 'pour', via_id, pour_id from crossing group by via_id, pour_id having bool_or(ring = 0) and not bool_or(ring > 0)
""",
    "p5_found": _P5 + "select ref_table, strftime(recorded_at, '%Y-%m') ref_month, ref_id from lost",
    "p5_report": _P5 + "select ref_table, strftime(recorded_at, '%Y-%m') ref_month, count(*) orphans, count(distinct (board_id, net_name)) missing_nets from lost group by 1, 2",
}
