"""Queries of the llm problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from ..tables import known, once_per_key, table
from .components import component_ids, star_edges
from .encoding import count_tokens, encode_texts
from .mojibake import find_garbled
from .packing import pack
from .percentiles import BITS, percentiles, value_counts


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of layer shapes that are joined by touching or by vias."""
    # A written table, read on one side of three joins: a shape with very many links can be split.
    shapes = staged(table(spark, folder, "layer_shapes").select("shape_id", known("net_label").alias("label")).dropna(subset=["shape_id"]).dropDuplicates(["shape_id"]), "shapes")
    links = table(spark, folder, "shape_links").select("shape_a", "shape_b").dropna().filter("shape_a <> shape_b").distinct()
    links = links.join(shapes.toDF("shape_a", "label_a"), "shape_a").join(shapes.toDF("shape_b", "label_b"), "shape_b")
    touching = links.filter("coalesce(label_a = label_b, true)").select(F.col("shape_a").alias("a"), F.col("shape_b").alias("b"))

    vias = table(spark, folder, "vias").select("via_id", known("net").alias("net"), "landing_ids").filter("size(landing_ids) > 1")
    vias = vias.withColumn("landing_key", F.xxhash64("net", "landing_ids"))  # tells vias without id apart
    landings = vias.select("via_id", "landing_key", "net", F.explode("landing_ids").alias("shape_id")).dropna(subset=["shape_id"])
    landings = landings.join(shapes, "shape_id")
    joined = star_edges(landings, ["via_id", "landing_key"], "shape_id", "label", "net")

    return component_ids(touching.unionByName(joined), "a", "b").select(F.col("component").alias("group_id"), F.col("record").alias("shape_id"))


#: Reported percentiles in thousandths.
PERMILLE = {"p01": 10, "p05": 50, "p50": 500, "p95": 950, "p99": 990}


def mesh_value_counts(spark: SparkSession, folder: str, combined: bool = True) -> DataFrame:
    """The partial result of problem 3: counts of rounded values per net, day and measure. Unknown nets are no net."""
    meshes = once_per_key(table(spark, folder, "mesh_outputs"), "mesh_id", "net", "solved_at", "potentials", "power_densities")
    meshes = meshes.select(known("net").alias("net"), F.date_format("solved_at", "yyyy-MM-dd").alias("day"), "potentials", "power_densities").filter("net is not null")
    return value_counts(meshes, ["net", "day"], {"potential": "potentials", "power_density": "power_densities"}, combined=combined)


def p3_partials(spark: SparkSession, folder: str) -> DataFrame:
    """The counts that can be kept and combined, one row per net, day, measure and rounded value."""
    return mesh_value_counts(spark, folder)


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of potentials and power densities per net (period ``all``) and per net and day (period ``day``)."""
    counts = staged(mesh_value_counts(spark, folder, combined=False), "counts")
    found = percentiles(counts, ["net", "measure"], PERMILLE, roll_up=["day"])
    return found.select(F.when(F.col("level") == "each", "day").otherwise("all").alias("period"), "net", "day", "measure", "n", *PERMILLE)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, folder, "documents").select("doc_id", "text"), "text", "ids").select("doc_id", "ids")


#: Tokens a container holds.
CAPACITY = 2048


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of every piece of one that is longer than a container."""
    sizes = count_tokens(table(spark, folder, "documents").select("doc_id", "text"), "text", "n_tokens")
    return pack(sizes, "n_tokens", CAPACITY).select("container_id", "doc_id", "piece_no", "piece_start", "piece_size")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with wrongly decoded text, how it came about, and the original text where it can be had back."""
    return find_garbled(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "mappings", "restored")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with wrongly decoded text."""
    return p8_restored(spark, folder).select("doc_id")


QUERIES = {"p1_found": p1_found, "p3_percentiles": p3_percentiles, "p3_partials": p3_partials, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found, "p8_restored": p8_restored}

_ROUND = f"case when abs({{v}}) < 2.0::double ** 960 then {{v}} * {2 ** (53 - BITS) + 1}::double - ({{v}} * {2 ** (53 - BITS) + 1}::double - {{v}}) else {{v}} end"
_MESHES = """
with once as (select distinct on (mesh_id) * from mesh_outputs where net <> ''),
vals as (select net, strftime(solved_at, '%Y-%m-%d') as day, 'potential' measure, unnest(potentials) v from once union all
         select net, strftime(solved_at, '%Y-%m-%d'), 'power_density', unnest(power_densities) from once),
kept as (select * from vals where v is not null and not isnan(v))
"""

ORACLES = {
    "p1_found": """
with recursive shapes as (select distinct shape_id, nullif(net_label, '') label from layer_shapes),
land as (select distinct v.via_id, nullif(v.net, '') net, s.shape_id, s.label from (select via_id, net, unnest(landing_ids) shape_id from vias) v join shapes s using (shape_id)),
pairs as (
  select a.shape_id a, b.shape_id b from shape_links l join shapes a on a.shape_id = l.shape_a join shapes b on b.shape_id = l.shape_b
  where a.shape_id <> b.shape_id and coalesce(a.label = b.label, true)
  union
  select a.shape_id, b.shape_id from land a join land b on a.via_id = b.via_id and a.shape_id <> b.shape_id
  where coalesce(a.label = b.label, true) and coalesce(a.label = a.net, true) and coalesce(b.label = a.net, true)),
both_ways as (select a, b from pairs union select b, a from pairs),
reach as (select a node, a seen from both_ways union select r.node, w.b from reach r join both_ways w on r.seen = w.a)
select min(seen) group_id, node shape_id from reach group by node
""",
    "p3_percentiles": _MESHES
    + f""", scoped as (select 'day' period, net, day, measure, v from kept union all select 'all', net, null, measure, v from kept),
ranked as (select *, row_number() over (partition by period, net, day, measure order by v) r, count(*) over (partition by period, net, day, measure) n from scoped),
picked as (select period, net, day, measure, n,
  {", ".join(f"max(v) filter (where r = greatest(1, (n * {p} + 999) // 1000)) e_{name}" for name, p in PERMILLE.items())}
  from ranked group by period, net, day, measure, n)
select period, net, day, measure, n, {", ".join(_ROUND.format(v=f"e_{name}") + f" {name}" for name in PERMILLE)} from picked
""",
    "p3_partials": _MESHES + f"select net, day, measure, {_ROUND.format(v='v')} as \"value\", count(*) n from kept group by all",
}
