"""Queries on meshes and copper as a whole: coverage, loops, widths, merged pours and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators.mesh import trace_widths
from ..operators.polygons import combine_groups
from ..tables import known, once_per_key, table
from .inventory_queries import boundary_edges, corners
from .inventory_sql import CORNERS

#: Cells of the grid that samples a mesh, each way.
CELLS = 20
MESH = ["solution_id", "layer_no", "mesh_no"]


def mesh_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many points of a grid over the box of a mesh lie in at least one triangle (edges included), and their share.

    Each triangle only looks at the grid points of its own box, so the work follows the number of covered points.
    """
    t = corners(spark, folder).select(*MESH, "p0", "p1", "p2")
    xs, ys = F.array("p0.x", "p1.x", "p2.x"), F.array("p0.y", "p1.y", "p2.y")
    box = t.groupBy(*MESH).agg(F.min(F.array_min(xs)).alias("x0"), F.max(F.array_max(xs)).alias("x1"), F.min(F.array_min(ys)).alias("y0"), F.max(F.array_max(ys)).alias("y1")).filter("x1 > x0 and y1 > y0")
    step = lambda low, high: (F.col(high) - F.col(low)) / CELLS
    t = t.join(box, MESH)
    span = lambda values, low, high: F.sequence(F.greatest(F.lit(0), F.floor((F.array_min(values) - F.col(low)) / step(low, high)).cast("int")), F.least(F.lit(CELLS), F.ceil((F.array_max(values) - F.col(low)) / step(low, high)).cast("int")))
    points = t.withColumn("i", F.explode(span(xs, "x0", "x1"))).withColumn("j", F.explode(span(ys, "y0", "y1")))
    inside = geo.in_triangle(F.col("x0") + F.col("i") * step("x0", "x1"), F.col("y0") + F.col("j") * step("y0", "y1"), F.col("p0"), F.col("p1"), F.col("p2"))
    covered = points.filter(inside).groupBy(*MESH).agg(F.countDistinct("i", "j").alias("covered"))
    return covered.select(*MESH, "covered", F.round(F.col("covered") / (CELLS + 1) ** 2, 4).alias("share"))


def mesh_loops(spark: SparkSession, folder: str) -> DataFrame:
    """Boundary edges of a mesh, the vertices on them, and those where more than one loop passes."""
    edges = boundary_edges(spark, folder)
    ends = edges.select(*MESH, F.explode(F.array("a", "b")).alias("v")).groupBy(*MESH, "v").agg(F.count("*").alias("n"))
    return ends.groupBy(*MESH).agg((F.sum("n") / 2).cast("long").alias("edges"), F.count("*").alias("vertices"), F.count_if(F.col("n") > 2).alias("crossings"))


def ringed_pours(spark: SparkSession, folder: str) -> DataFrame:
    """Pours with their outline, counter-clockwise, and holes, clockwise, as ``rings``; those without outline are left
    out, as are holes of fewer than three points."""
    pours = once_per_key(table(spark, folder, "copper_pours"), "pour_id", "board_id", "net", "layer", "vertices", "holes").filter("size(vertices) >= 3")
    holes = F.transform(F.filter(F.coalesce("holes", F.array()), lambda h: F.size(h) >= 3), lambda h: geo.oriented(h, hole=True))
    return pours.select("pour_id", "board_id", known("net").alias("net"), "layer", F.concat(F.array(geo.oriented("vertices")), holes).alias("rings"))


def pour_widths(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated least width of the pours of a net on a layer of a board, over outlines and holes."""
    pours = ringed_pours(spark, folder).filter("net is not null")
    return trace_widths(pours, ["board_id", "net", "layer"], "rings").withColumn("width", F.round("width", 4))


def merged_pours(spark: SparkSession, folder: str) -> DataFrame:
    """Pours of a net on a layer of a board as disjoint polygons: their number, area and holes."""
    merged = combine_groups(ringed_pours(spark, folder), ["board_id", "net", "layer"])
    return merged.groupBy("board_id", "net", "layer").agg(F.count("*").alias("polygons"), F.round(F.sum(geo.polygon_area("rings")), 3).alias("area"), F.sum(F.size("rings") - 1).alias("holes"))


QUERIES = {f.__name__: f for f in (mesh_coverage, mesh_loops, pour_widths, merged_pours)}

_SIDE = "(({q}x - {p}x) * (y - {p}y) - ({q}y - {p}y) * (x - {p}x))"
_A, _B, _C = (_SIDE.format(p=p, q=q) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))

_EDGE = "sqrt((px - (ax + t * (bx - ax))) ** 2 + (py - (ay + t * (b_y - ay))) ** 2)"
_ALONG = "greatest(0, least(1, coalesce(((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / nullif((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay), 0), 0)))"
#: Twice the least distance from the edges among the points of a grid inside each ring.
WIDTHS = f"""
with c as (select distinct on (pour_id) * from copper_pours where len(vertices) >= 3 and net <> ''),
rg as (select pour_id, board_id, net, layer, 0 ring, vertices v from c union all select pour_id, board_id, net, layer, i, holes[i] from (select *, unnest(range(1, len(holes) + 1)) i from c) where len(holes[i]) >= 3),
ed as (select pour_id, ring, v[i].x ax, v[i].y ay, v[i % len(v) + 1].x bx, v[i % len(v) + 1].y b_y from (select *, unnest(range(1, len(v) + 1)) i from rg)),
bo as (select pour_id, ring, min(ax) x0, max(ax) x1, min(ay) y0, max(ay) y1 from ed group by 1, 2 having max(ax) > min(ax) and max(ay) > min(ay)),
gr as (select pour_id, ring, i, j, x0 + (x1 - x0) * i / {CELLS} px, y0 + (y1 - y0) * j / {CELLS} py from bo, range({CELLS + 1}) a(i), range({CELLS + 1}) b(j)),
al as (select g.pour_id, g.ring, g.i, g.j, px, py, ax, ay, bx, b_y, {_ALONG} t from gr g join ed using (pour_id, ring)),
fa as (select pour_id, ring, i, j, sum(case when (ay > py) <> (b_y > py) and px < ax + (py - ay) * (bx - ax) / (b_y - ay) then 1 else 0 end) % 2 = 1 inside, min({_EDGE}) d from al group by 1, 2, 3, 4),
le as (select pour_id, min(d) d from fa where inside and d > 1e-9 group by 1)
select board_id, net, layer, round(min(case when d is null then 0.2 else least(greatest(2 * d, 0.05), 10) end), 4) width from c left join le using (pour_id) group by 1, 2, 3
"""

ORACLES = {
    "mesh_coverage": CORNERS
    + f""", b as (select solution_id, layer_no, mesh_no, min(least(ax, bx, cx)) x0, max(greatest(ax, bx, cx)) x1, min(least(ay, b_y, cy)) y0, max(greatest(ay, b_y, cy)) y1 from t group by 1, 2, 3),
      g2 as (select b.*, i, j, x0 + i * ((x1 - x0) / {CELLS}) x, y0 + j * ((y1 - y0) / {CELLS}) y from b, range({CELLS + 1}) r(i), range({CELLS + 1}) s(j) where x1 > x0 and y1 > y0),
      hit as (select distinct g2.solution_id, g2.layer_no, g2.mesh_no, i, j from g2 join t on t.solution_id = g2.solution_id and t.layer_no = g2.layer_no and t.mesh_no = g2.mesh_no
        where ({_A} >= 0 and {_B} >= 0 and {_C} >= 0) or ({_A} <= 0 and {_B} <= 0 and {_C} <= 0))
      select solution_id, layer_no, mesh_no, count(*) covered, round(count(*) / {(CELLS + 1) ** 2}, 4) share from hit group by 1, 2, 3""".replace("by - ", "b_y - ").replace("(y - by)", "(y - b_y)").replace("- by)", "- b_y)").replace("(by ", "(b_y "),
    "mesh_loops": CORNERS
    + """, ed as (select solution_id, layer_no, mesh_no, least(v0, v1) a, greatest(v0, v1) b from triangles where "role" = 'meshes' union all
        select solution_id, layer_no, mesh_no, least(v1, v2), greatest(v1, v2) from triangles where "role" = 'meshes' union all select solution_id, layer_no, mesh_no, least(v2, v0), greatest(v2, v0) from triangles where "role" = 'meshes'),
      one as (select solution_id, layer_no, mesh_no, a, b from ed group by all having count(*) = 1),
      e2 as (select solution_id, layer_no, mesh_no, v, count(*) n from (select solution_id, layer_no, mesh_no, a v from one union all select solution_id, layer_no, mesh_no, b from one) group by all)
      select solution_id, layer_no, mesh_no, (sum(n) // 2)::bigint edges, count(*) vertices, count(*) filter (where n > 2) crossings from e2 group by 1, 2, 3""",
    "pour_widths": WIDTHS,
}
