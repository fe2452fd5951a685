"""Queries on networks and their matrices, through the operators of ``linear``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import electrical as el
from ..operators import linear as la
from ..staging import staged
from ..tables import finite, known
from .inventory_queries import KEY, conductances, corners, once, potentials, r, via_resistors
from .inventory_sql import _CTE, _FAR, _LAPLACE

#: What the far node of a mesh is held at, in volts.
VOLTS = 1.0


def resistor_systems(spark: SparkSession, folder: str) -> DataFrame:
    """The conductance matrix of each via's chain of resistors, layers being its nodes."""
    resistors = via_resistors(spark, folder).select("via_id", F.col("from_layer").alias("a"), F.col("to_layer").alias("b"), "ohms")
    return la.coo_sum(la.resistor_stamps(resistors, ["via_id"]), ["via_id"]).withColumn("value", r(F.col("value"), 1))


def load_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Currents that loads take from their net and give to their ground, summed per board and net."""
    loads = once(spark, folder, "loads", "board_id", "net", "gnd_net", "load_current").filter(known("net").isNotNull() & known("gnd_net").isNotNull() & finite("load_current"))
    return la.current_stamps(loads.select("board_id", F.col("net").alias("a"), F.col("gnd_net").alias("b"), F.col("load_current").alias("amperes")), ["board_id"]).withColumn("value", r(F.col("value"), 6))


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    s = once(spark, folder, "sources", "board_id", "net", "gnd_net", "voltage").filter(known("net").isNotNull() & known("gnd_net").isNotNull() & finite("voltage"))
    return s.select("board_id", F.col("source_id").alias("no"), F.col("net").alias("p"), F.col("gnd_net").alias("n"), F.col("voltage").alias("value"))


def ground_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The net that is ground on each board: the return of the source with the highest voltage."""
    return la.ground_nodes(_sources(spark, folder), ["board_id"])


def held_nets(spark: SparkSession, folder: str) -> DataFrame:
    """The voltages at which sources hold the nets of a board, stacked sources included."""
    return la.held_voltages(_sources(spark, folder), ["board_id"]).withColumn("value", r(F.col("value"), 6))


def _held(matrix: DataFrame) -> DataFrame:
    """The first node of each mesh at 0, the last at ``VOLTS``; meshes of one node are left out."""
    ends = matrix.groupBy(*KEY).agg(F.min("row").alias("low"), F.max("row").alias("high")).filter("low < high")
    return ends.select(*KEY, F.inline(F.array(F.struct(F.col("low").alias("row"), F.lit(0.0).alias("value")), F.struct(F.col("high").alias("row"), F.lit(VOLTS).alias("value")))))


def vector_algebra(spark: SparkSession, folder: str) -> DataFrame:
    """Per mesh: entries and trace of its matrix, also with 1 added to the diagonal, the potentials' square, and that of
    three times the potentials less themselves."""
    a, u = staged(conductances(spark, folder), "matrix"), staged(potentials(spark, folder), "vector")
    trace = lambda m, name: la.diagonal(m, KEY).groupBy(*KEY).agg(r(F.sum("value"), 2).alias(name))
    ones = la.diagonal(a, KEY).withColumn("value", F.lit(1.0))
    twice = la.axpy(3.0, u, u.withColumn("value", -F.col("value")), KEY)
    out = la.entry_counts(a, KEY).join(trace(a, "trace"), KEY).join(trace(la.with_diagonal(a, ones, KEY), "raised"), KEY)
    for name, v in (("square", u), ("twice", twice)):
        out = out.join(la.dot(v, v, KEY).select(*KEY, r(F.col("dot"), 2).alias(name)), KEY)
    return out


def held_systems(spark: SparkSession, folder: str) -> DataFrame:
    """Systems with two nodes held: entries and sum of the matrix and of the right-hand side, and of the reduced one."""
    a = staged(conductances(spark, folder), "matrix")
    fixed = staged(_held(a), "held")
    none = fixed.filter("false")
    total = lambda m, name: m.groupBy(*KEY).agg(F.count("*").alias(name), r(F.sum("value"), 2).alias(f"{name}_sum"))
    whole, right = la.dirichlet(a.join(fixed.select(*KEY).distinct(), KEY, "left_semi"), none, fixed, KEY)
    small, _ = la.reduced(a.join(fixed.select(*KEY).distinct(), KEY, "left_semi"), none, fixed, KEY)
    return total(whole, "matrix").join(total(right, "right"), KEY).join(total(small, "reduced"), KEY, "left")


def scaled_systems(spark: SparkSession, folder: str) -> DataFrame:
    """Matrices scaled to a diagonal of ones, where it is positive: the largest entry beside it and the diagonal's mean."""
    s = la.scaled(staged(conductances(spark, folder), "matrix"), KEY)
    return s.groupBy(*KEY).agg(r(F.max(F.when(F.col("row") != F.col("col"), F.abs("value"))), 3).alias("largest"), r(F.avg(F.when(F.col("row") == F.col("col"), F.sign("value") * F.least(F.abs("value"), F.lit(1.0)))), 3).alias("diagonal"))


def solved_meshes(spark: SparkSession, folder: str) -> DataFrame:
    """Each mesh solved with its ends held, by sizes of cotangents: unknowns, whether the residual is small, whether what
    enters at one end leaves at the other, and whether potentials stay between the ends."""
    c = corners(spark, folder)
    c = c.select(*KEY, *[F.col(f"{a}{i}").alias(f"{b}{j}") for i, j in zip("012", "abc") for a, b in (("v", "n"), ("p", "p"))], F.lit(el.SIGMA * el.COPPER).alias("conductance"))
    one = F.concat_ws("/", *KEY).alias("system")
    a = staged(la.coo_sum(la.laplacian_stamps(c, KEY, KEY, signed=False), KEY), "matrix")
    fixed = staged(_held(a).select(one, "row", "value"), "held")
    a = a.select(one, "row", "col", "value")
    a = a.join(fixed.select("system").distinct(), "system", "left_semi")
    matrix, right = la.dirichlet(a, fixed.filter("false"), fixed, ["system"])
    solved = staged(la.solve(matrix, right, "system"), "solved")
    x = solved.select("system", "row", "value")
    flow = la.spmv(a, x, ["system"]).join(fixed.select("system", "row", F.col("value").alias("held")), ["system", "row"], "left")
    sums = flow.groupBy("system").agg(F.max(F.when(F.col("held").isNull(), F.abs("value")).otherwise(0.0)).alias("off"), F.sum(F.when(F.col("held").isNotNull(), F.col("value"))).alias("net"), F.sum(F.abs("value")).alias("size"))
    inside = x.groupBy("system").agg(F.count("*").alias("unknowns"), ((F.min("value") >= -1e-2) & (F.max("value") <= VOLTS + 1e-2)).alias("bounded"))
    return inside.join(sums, "system").select("system", "unknowns", (F.col("off") < 1e-3 + 1e-4 * F.col("size")).alias("settled"), (F.abs("net") < 1e-2 + 1e-4 * F.col("size")).alias("balanced"), "bounded")


QUERIES = {f.__name__: f for f in (resistor_systems, load_vectors, ground_choice, held_nets, vector_algebra, held_systems, scaled_systems, solved_meshes)}

_SOURCES = f"ss as (select board_id, source_id no, net p, gnd_net n, voltage v from so where net <> '' and gnd_net <> '' and {_FAR.format('voltage')})"
_K = "solution_id, layer_no, mesh_no"
_HELD = f"""en as (select {_K}, min("row") low, max("row") high from lap group by all having min("row") < max("row")),
fi as (select {_K}, low "row", 0.0::double held from en union all select {_K}, high, {VOLTS}::double from en),
lm2 as (select l.*, a.held ha, b.held hb, a."row" is not null fa, b."row" is not null fb from lap l join en using ({_K}) left join fi a on a.solution_id = l.solution_id and a.layer_no = l.layer_no and a.mesh_no = l.mesh_no and a."row" = l."row"
  left join fi b on b.solution_id = l.solution_id and b.layer_no = l.layer_no and b.mesh_no = l.mesh_no and b."row" = l.col)"""

ORACLES = {
    "resistor_systems": _CTE + """, pr as (select via_id, hole_diameter, st.layer f, lead(st.layer) over w t, (conductance / 5.95e4 + lead(conductance / 5.95e4) over w) / 2 as len
        from (select via_id, hole_diameter, unnest(names) layer from v) x join st on st.layer = x.layer window w as (partition by via_id order by position)),
      re as (select via_id, f, t, 1 / round(case when hole_diameter / 2 <= 0 then 1e-3 else len / (5.95e4 * pi() * ((hole_diameter / 2 + 0.025) * (hole_diameter / 2 + 0.025) - hole_diameter / 2 * hole_diameter / 2)) end, 9) g from pr where t is not null),
      sm as (select via_id, f "row", f col, g "value" from re union all select via_id, t, t, g from re union all select via_id, f, t, -g from re union all select via_id, t, f, -g from re)
      select via_id, "row", col, round(sum("value"), 1) "value" from sm where "value" is not null and not isinf("value") group by all""",
    "load_vectors": _CTE + f""", l as (select * from lo where net <> '' and gnd_net <> '' and {_FAR.format('load_current')}) select board_id, "row", round(sum(i), 6) "value" from (select board_id, net "row", -load_current i from l union all select board_id, gnd_net, load_current from l) group by all""",
    "ground_choice": _CTE + f", {_SOURCES} select board_id, n ground from (select *, row_number() over (partition by board_id order by v desc, no) k from ss) where k = 1",
    "held_nets": _CTE + f""", {_SOURCES}, nx as (select s.*, (select max(q.no) from ss q where q.board_id is not distinct from s.board_id and q.no < s.no and q.p = s.n) before from ss s),
      ch as (select board_id, no, p, n, v total from nx where before is null union all select nx.board_id, nx.no, nx.p, nx.n, ch.total + nx.v from nx join ch on nx.board_id is not distinct from ch.board_id and nx.before = ch.no),
      al as (select board_id, p "row", total "value", no from ch union all select board_id, n, 0, -1 from ss) select board_id, "row", round(arg_max("value", no), 6) "value" from al group by 1, 2""",
    "vector_algebra": _LAPLACE + f""", tr as (select {_K}, count(*) filter (where "value" <> 0) entries, sum(case when "row" = col then "value" else 0 end) t, count(*) filter (where "row" = col) n from lap group by all),
      sq as (select {_K}, sum(coalesce(case when isnan(potential) or abs(potential) = 'inf'::double then 0 else potential end, 0) ** 2) s from vv group by all)
      select {_K}, entries, round(t, 2) trace, round(t + n, 2) raised, round(s, 2) square, round(4 * s, 2) twice from tr join sq using ({_K})""",
    "held_systems": _LAPLACE + f""", {_HELD}, ma as (select {_K}, "value" from lm2 where not fa and not fb union all select {_K}, 1.0 from fi), ri as (select {_K}, "row", sum(-"value" * hb) "value" from lm2 where not fa and fb group by all union all select {_K}, "row", held from fi)
      select {_K}, m.matrix, m.matrix_sum, q."right", q.right_sum, z.reduced, z.reduced_sum from (select {_K}, count(*) matrix, round(sum("value"), 2) matrix_sum from ma group by all) m join (select {_K}, count(*) "right", round(sum("value"), 2) right_sum from ri group by all) q using ({_K})
      left join (select {_K}, count(*) reduced, round(sum("value"), 2) reduced_sum from lm2 where not fa and not fb group by all) z using ({_K})""",
    "scaled_systems": _LAPLACE + f""", di as (select {_K}, "row", case when "value" > 0 then sqrt("value") else 1 end s from lap where "row" = col),
      sc as (select {_K}, l."row", l.col, l."value" / coalesce(a.s, 1) / coalesce(b.s, 1) "value" from lap l left join di a using ({_K}, "row") left join (select {_K}, "row" col, s from di) b using ({_K}, col))
      select {_K}, round(max(case when "row" <> col then abs("value") end), 3) largest, round(avg(case when "row" = col then sign("value") * least(abs("value"), 1) end), 3) diagonal from sc group by all""",
    "solved_meshes": _LAPLACE + f""", {_HELD}, un as (select {_K}, count(distinct "row") unknowns from lm2 group by {_K}) select concat_ws('/', solution_id, layer_no, mesh_no) "system", unknowns, true settled, true balanced, true bounded from un""",
}
