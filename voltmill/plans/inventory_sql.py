"""SQL of the inventory queries, for comparison on the same tables."""

from __future__ import annotations

from .board_queries import ORACLES as _BOARD

_CTE = """
with recursive v as (select distinct on (via_id) *, list_distinct(list_filter(list_transform(layer_names, lambda n: lower(trim(n))), lambda n: n is not null and n <> '')) names from vias),
p as (select distinct on (pad_id) *, x * case when coord_unit = 'mil' then 0.0254 else 1 end px, y * case when coord_unit = 'mil' then 0.0254 else 1 end py from pads),
c as (select distinct on (pour_id) * from copper_pours),
sh as (select distinct on (shape_id) *, nullif(net_label, '') label from layer_shapes),
so as (select distinct on (source_id) * from sources),
lo as (select distinct on (load_id) * from loads),
lm as (select *, lower(trim(layer_name)) ln from layer_map),
nt as (select distinct on (net_id) * from nets),
tn as (select board_id, net from (select board_id, net from so union select board_id, gnd_net from so union select board_id, net from lo union select board_id, gnd_net from lo) where net <> '' and board_id is not null),
ends as (
  select kind, owner_id, board_id, side, i - 1 pad_no, unnest(l[i]) from (
    select *, unnest(range(1, len(l) + 1)) i from (
      select 'source' kind, source_id owner_id, board_id, 'pos' side, pads l from so union all select 'source', source_id, board_id, 'gnd', gnd_pads from so union all
      select 'load', load_id, board_id, 'pos', pads from lo union all select 'load', load_id, board_id, 'gnd', gnd_pads from lo))),
e as (select *, nullif(lower(trim(layer)), '') ln from ends),
vx as (select pour_id, board_id, net, layer, len(vertices) n, i, vertices[i].x ax, vertices[i].y ay, vertices[i % len(vertices) + 1].x bx, vertices[i % len(vertices) + 1].y b_y
       from (select *, unnest(range(1, len(vertices) + 1)) i from c)),
ga as (select pour_id, board_id, net, layer, sum(ax * b_y - bx * ay) / 2 a, sum(sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y))) len, min(ax) x0, max(ay) y1, avg(ax) mx, max(ax) x1, min(ay) y0, any_value(n) n from vx group by all),
st as (select layer_id, ln layer, conductance, row_number() over (order by case when layer_id = 2 then 1000000 else layer_id end) - 1 as position from lm)
"""

# As text, since statistics of the files, which leave NaN out, would fold a comparison of numbers.
_FAR = "{0}::varchar not in ('nan', 'inf', '-inf')"
_FINITE = f"{_FAR.format('x')} and {_FAR.format('y')}"
_MESH = _BOARD["p2_triangles"].removesuffix("select * from triangles")
CORNERS = (
    _MESH
    + """, vv as (select * from vertices where "role" = 'meshes'),
t as (select t.solution_id, t.layer_no, t.mesh_no, t.triangle_no, t.v0, t.v1, t.v2, a.x ax, a.y ay, b.x bx, b.y b_y, c.x cx, c.y cy, a.potential ua, b.potential ub, c.potential uc
      from triangles t join vv a on a.solution_id = t.solution_id and a.layer_no = t.layer_no and a.mesh_no = t.mesh_no and a.vertex_no = t.v0
      join vv b on b.solution_id = t.solution_id and b.layer_no = t.layer_no and b.mesh_no = t.mesh_no and b.vertex_no = t.v1
      join vv c on c.solution_id = t.solution_id and c.layer_no = t.layer_no and c.mesh_no = t.mesh_no and c.vertex_no = t.v2 where t."role" = 'meshes'),
d as (select *, (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) as det, sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) ab, sqrt((cx - bx) * (cx - bx) + (cy - b_y) * (cy - b_y)) bc, sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) ca from t),
s as (select *, case when abs(det) < 1e-15 then 1e-15 else det end dd from d),
g as (select *, (ua * (b_y - cy) + ub * (cy - ay) + uc * (ay - b_y)) / dd gx, (ua * (cx - bx) + ub * (ax - cx) + uc * (bx - ax)) / dd gy from s)
"""
)
_ANGLE = "degrees(acos(greatest(-1, least(1, ({u} * {u} + {v} * {v} - {w} * {w}) / nullif(2 * {u} * {v}, 0)))))"
_LAPLACE = (
    CORNERS
    + """, h as (
  select solution_id, layer_no, mesh_no, triangle_no, v1 a, v2 b, ((bx - ax) * (cx - ax) + (b_y - ay) * (cy - ay)) / abs(det) / 2 w from d where abs(det) >= 1e-15 union all
  select solution_id, layer_no, mesh_no, triangle_no, v2, v0, ((cx - bx) * (ax - bx) + (cy - b_y) * (ay - b_y)) / abs(det) / 2 from d where abs(det) >= 1e-15 union all
  select solution_id, layer_no, mesh_no, triangle_no, v0, v1, ((ax - cx) * (bx - cx) + (ay - cy) * (b_y - cy)) / abs(det) / 2 from d where abs(det) >= 1e-15),
k as (select *, row_number() over (partition by solution_id, layer_no, mesh_no order by abs(w)) r, count(*) over (partition by solution_id, layer_no, mesh_no) n from h where w <> 0),
m as (select *, max(case when r = n // 2 + 1 then abs(w) end) over (partition by solution_id, layer_no, mesh_no) m from k),
cl as (select solution_id, layer_no, mesh_no, a, b, sign(w) * greatest(m / 1e4, least(m * 1e4, abs(w))) * (5.95e4::double * 0.035::double) w from m),
coo as (select solution_id, layer_no, mesh_no, a "row", a col, w "value" from cl union all select solution_id, layer_no, mesh_no, b, b, w from cl union all
        select solution_id, layer_no, mesh_no, a, b, -w from cl union all select solution_id, layer_no, mesh_no, b, a, -w from cl),
lap as (select solution_id, layer_no, mesh_no, "row", col, sum("value") "value" from coo group by all)
"""
)

ORACLES = {
    "target_nets": _CTE + "select board_id, net from tn",
    "target_shapes": _CTE + "select shape_id, board_id, net_label from sh where (board_id, net_label) in (select (board_id, net) from tn)",
    "untargeted_layers": _CTE + """select board_id, layer from (select distinct board_id, nullif(lower(trim(layer_name)), '') layer from sh) where layer is not null and board_id is not null
      and (board_id, layer) not in (select (board_id, lower(trim(layer_name))) from sh where (board_id, net_label) in (select (board_id, net) from tn) and layer_name is not null and board_id is not null)""",
    "layer_spellings": "select regexp_replace(lower(name), '[^a-z0-9]', '', 'g') normal, count(distinct name) spellings, count(*) uses from (select unnest(layer_names) as name from vias) where name is not null group by 1",
    "valid_via_layers": _CTE + """select via_id, len(l) layer_count, array_to_string(l, ',') layers from (select via_id, list_sort(list_intersect(names, ln)) l from v, (select list(ln) ln from lm)) where len(l) > 0""",
    "shapes_of_size": _CTE + "select nullif(lower(trim(layer_name)), '') layer, count(*) shapes, count(*) filter (where area_mm2 >= 0.01) kept from sh group by 1",
    "smd_terminals": _CTE + f"select board_id, kind, owner_id, side, pad_no, round(x, 6) x, round(y, 6) y from e where not coalesce(is_tht, false) and {_FINITE}",
    "distinct_terminals": _CTE + "select kind, owner_id, count(*) terminals from (select distinct kind, owner_id, ln, round(x, 6) x, round(y, 6) y from e) group by all",
    "named_pours": _CTE + "select pour_id, coalesce(layer_name, '') layer_name, coalesce(nullif(conductance, 0), 1) conductance from c left join lm on c.layer = lm.layer_id",
    "matched_rails": _CTE + """select board_id, net, coalesce(s, 0) sources, coalesce(l, 0) loads, case when l is null then 'source only' when s is null then 'load only' else 'matched' end status
      from (select board_id, net, count(*) s from so where net <> '' and board_id is not null group by all) full join (select board_id, net, count(*) l from lo where net <> '' and board_id is not null group by all) using (board_id, net)""",
    "nearest_pads": _CTE + f"""select via_id, pad_id, d distance from (
      select v.via_id, p.pad_id, round(sqrt((v.x - px) * (v.x - px) + (v.y - py) * (v.y - py)), 6) d, row_number() over (partition by v.via_id order by round(sqrt((v.x - px) * (v.x - px) + (v.y - py) * (v.y - py)), 6), p.pad_id) k
      from v join p on v.board_id = p.board_id and v.net = p.net and v.net <> '' where {_FAR.format('v.x')} and {_FAR.format('v.y')} and {_FAR.format('px')} and {_FAR.format('py')}
        and sqrt((v.x - px) * (v.x - px) + (v.y - py) * (v.y - py)) <= 1) where k = 1""",
    "exempt_drills": _CTE + f"""select via_id, board_id, x, y, hole_diameter from v where {_FINITE} and not exists (select 1 from p where p.board_id = v.board_id and not coalesce(is_tht, false)
      and sqrt((v.x - px) * (v.x - px) + (v.y - py) * (v.y - py)) <= 0.05)""",
    "pin_pads": _CTE + f"""select board_id, kx, ky, min(pad_id) pad_id, min(ref_des) ref_des from (
      select board_id, floor(px * 100 + 0.5)::bigint kx, floor(py * 100 + 0.5)::bigint ky, pad_id, null ref_des from p where {_FINITE} union all
      select e.board_id, floor(x * 100 + 0.5)::bigint, floor(y * 100 + 0.5)::bigint, null, nullif(coalesce(so.ref_des, lo.ref_des), '') from e left join so on kind = 'source' and source_id = owner_id left join lo on kind = 'load' and load_id = owner_id where {_FINITE}) group by 1, 2, 3""",
    "pads_in_pours": _CTE + f""", rings as (select pour_id, board_id, ln, 0 ring, vertices r from c join lm on c.layer = lm.layer_id where len(vertices) >= 3 union all
        select pour_id, board_id, ln, i, holes[i] from (select *, unnest(range(1, len(holes) + 1)) i from c join lm on c.layer = lm.layer_id)),
      ed as (select pour_id, board_id, ln, ring, r[i].x ax, r[i].y ay, r[i % len(r) + 1].x bx, r[i % len(r) + 1].y b_y from (select *, unnest(range(1, len(r) + 1)) i from rings where len(r) >= 3)),
      cr as (select p.pad_id, pour_id, ring from p join ed on p.board_id = ed.board_id and lower(trim(p.layer)) = ln and {_FAR.format('px')} and {_FAR.format('py')}
        and (ay > py) <> (b_y > py) and px < ax + (py - ay) * (bx - ax) / (b_y - ay) group by all having count(*) % 2 = 1)
      select pad_id, min(pour_id) pour_id, count(*) pours from (select pad_id, pour_id from cr group by all having bool_or(ring = 0) and not bool_or(ring > 0)) group by 1""",
    "pour_geometry": _CTE + """, ho as (select pour_id, h, unnest(range(1, len(h) + 1)) i from (select pour_id, unnest(holes) h from c) where len(h) >= 3),
      hz as (select pour_id, sum(a) holes from (select pour_id, h, abs(sum(h[i].x * h[i % len(h) + 1].y - h[i % len(h) + 1].x * h[i].y)) / 2 a from ho group by all) group by 1)
      select pour_id, round(abs(a), 4) area, a > 0 counter_clockwise, round(len, 4) perimeter, round(x0, 4) x0, round(y1, 4) y1, round(mx, 4) mean_x, round(abs(a) - coalesce(holes, 0), 3) net_area
      from ga left join hz using (pour_id) where n >= 3""",
    "board_bounds": _CTE + f"""select board_id, round(min(x), 4) min_x, round(-min(-x), 4) max_x, round(min(y), 4) min_y, round(-min(-y), 4) max_y
      from (select board_id, x, y from v where {_FINITE} union all select board_id, px, py from (select distinct board_id, x, y, px, py from p where {_FINITE}) union all select board_id, ax, ay from vx where {_FAR.format('ax')} and {_FAR.format('ay')}) group by 1""",
    "pour_coverage": _CTE + "select c.board_id, nullif(c.net, '') net, c.layer, count(*) pours, round(sum(case when len(vertices) >= 3 then abs(a) when vertices is not null then 0 end), 2) area from c left join ga using (pour_id) group by 1, 2, 3",
    "pads_by_net": _CTE + "select board_id, nullif(net, '') net, count(*) pads, count(*) filter (where is_tht) tht from p group by 1, 2",
    "rail_currents": _CTE + f"select board_id, net, round(sum(case when load_current > 0 then load_current else 0 end), 4) as \"current\", round(sum(abs(load_current)), 4) total from lo where net <> '' and {_FAR.format('load_current')} group by 1, 2",
    "smallest_holes": _CTE + "select board_id, net, layer, min(hole_diameter) hole from (select board_id, net, hole_diameter, unnest(names) layer from v where hole_diameter > 0 and net <> '') group by all",
    "median_extents": _CTE + """select board_id, side from (select board_id, side, row_number() over (partition by board_id order by side) k, count(*) over (partition by board_id) n
      from (select board_id, round(greatest(x1 - x0, y1 - y0) * 100)::bigint side from ga)) where k = n // 2 + 1""",
    "via_net_votes": _CTE + """, vo as (select via_id, v.board_id, label net, count(*) n from (select via_id, board_id, unnest(landing_ids) shape_id from v) v join sh using (shape_id) where label is not null group by all)
      select via_id, net, n votes from (select vo.*, tn.net is not null target, row_number() over (partition by via_id order by n desc, tn.net is null, vo.net) k from vo left join tn on tn.board_id = vo.board_id and tn.net = vo.net) where k = 1 and target""",
    "ground_nets": _CTE + """select board_id, net ground, n uses from (select board_id, lower(net) net, count(*) n, row_number() over (partition by board_id order by count(*) desc, lower(net)) k
      from (select board_id, net from p union all select board_id, net from v union all select board_id, net from c)
      where lower(trim(net)) in ('gnd', 'ground', '0', 'earth', 'vss', 'vee', 'agnd', 'dgnd', 'sgnd', 'pgnd') or regexp_matches(lower(trim(net)), 'gnd|ground|vss') group by 1, 2) where k = 1""",
    "voltage_ranges": _CTE + """, mo as (select distinct on (mesh_id) * from mesh_outputs where net <> ''),
      mv as (select run_id, board_id, mesh_id, nullif(lower(trim(layer_name)), '') layer, net, list_filter(list_transform(potentials, lambda x: case when isnan(x) or abs(x) = 'inf'::double then 0 else x end), lambda x: x is not null) q from mo)
      select run_id, board_id, layer, net, count(*) meshes, min(list_min(q)) low, max(list_max(q)) high from mv group by 1, 2, 3, 4""",
    "element_counts": _CTE + """select board_id, kind, n from (select board_id, 'VS' kind, count(*) n from so group by 1 union all select board_id, 'CS', count(*) from lo group by 1 union all
      select board_id, 'R', sum(greatest(coalesce(len(names), 0) - 1, 0))::bigint from v group by 1) where n > 0""",
    "layer_stack": _CTE + "select layer_id, layer, position from st",
    "via_spans": _CTE + """, kinds as (select via_type, count(*) vias, regexp_replace(lower(regexp_extract(via_type, '^(?:Blind|Buried): *([^-]+)-(.+)$', 1)), '[^a-z0-9]', '', 'g') a,
        regexp_replace(lower(regexp_extract(via_type, '^(?:Blind|Buried): *([^-]+)-(.+)$', 2)), '[^a-z0-9]', '', 'g') b from v group by via_type),
      found as (select via_type, vias, (select min(position) from st where starts_with(regexp_replace(layer, '[^a-z0-9]', '', 'g'), a)) p, (select min(position) from st where starts_with(regexp_replace(layer, '[^a-z0-9]', '', 'g'), b)) q from kinds where a <> '' and b <> '')
      select via_type, vias, least(p, q) top, greatest(p, q) bottom, abs(p - q) + 1 layers from found where p is not null and q is not null""",
    "via_resistors": _CTE + """, pr as (select via_id, hole_diameter, st.layer from_layer, lead(st.layer) over w to_layer, (conductance / 5.95e4 + lead(conductance / 5.95e4) over w) / 2 as len
        from (select via_id, hole_diameter, unnest(names) layer from v) x join st on st.layer = x.layer window w as (partition by via_id order by position))
      select via_id, from_layer, to_layer, round(case when hole_diameter / 2 <= 0 then 1e-3 else len / (5.95e4 * pi() * ((hole_diameter / 2 + 0.025) * (hole_diameter / 2 + 0.025) - hole_diameter / 2 * hole_diameter / 2)) end, 9) ohms from pr where to_layer is not null""",
    "near_ground_pads": _CTE + f""", f as (select * from e where kind = 'load' and {_FINITE}), ce as (select owner_id, avg(x) cx, avg(y) cy from f where side = 'pos' group by 1)
      select owner_id load_id, pad_no, place from (select f.owner_id, pad_no, cx, row_number() over (partition by f.owner_id order by coalesce(round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 6), 0), pad_no) place
      from f left join ce using (owner_id) where side = 'gnd') where place <= 20 or cx is null""",
    "largest_pours": _CTE + """select board_id, net, pour_id, round(abs(a), 4) area from (select *, row_number() over (partition by board_id, net order by round(abs(a), 4) desc, pour_id) k from ga where n >= 3 and net <> '') where k = 1""",
    "dense_net_numbers": _CTE + "select board_id, net_name, row_number() over (partition by board_id order by min(net_id)) - 1 as number from nt group by 1, 2",
    "propagated_labels": _CTE + """, ok as (select a.shape_id a, b.shape_id b from shape_links l join sh a on a.shape_id = shape_a join sh b on b.shape_id = shape_b where a.shape_id <> b.shape_id and coalesce(a.label = b.label, true)),
      two as (select a, b from ok union select b, a from ok), reach as (select a node, b seen from two union select r.node, w.b from reach r join two w on r.seen = w.a),
      votes as (select node, max(label) vote from (select node, seen from reach union select node, node from reach) join sh on sh.shape_id = seen group by node having min(label) = max(label))
      select shape_id, label net_label, coalesce(label, vote) resolved from sh left join votes on node = shape_id""",
    "capacity_checks": _CTE + f""", cu as (select board_id, net, round(sum(case when load_current > 0 then load_current else 0 end), 4) i from lo where net <> '' and {_FAR.format('load_current')} group by 1, 2),
      wi as (select board_id, net, layer, min(diameter) w from (select board_id, net, diameter, unnest(names) layer from v where diameter > 0 and net <> '') group by all),
      li as (select board_id, net, layer, i, case when regexp_matches(layer, 'top|bottom') then 0.048 else 0.024 end * pow(10, 0.44) * pow(w / 0.0254 * (conductance / 5.95e4 / (1.378 * 0.0254)) * 1.378, 0.725) lim from cu join wi using (board_id, net) join st using (layer) where i > 0)
      select board_id, net, layer, round(i, 4) as "current", round(lim, 4) capacity, round(i / lim, 3) utilization, i / lim > 1 exceeded from li where i / lim > 0.8""",
    "via_positions": _CTE + f"select via_id, x, y, round(greatest(case when coalesce(hole_diameter, 0) <= 0 then 0.3 else hole_diameter end + 0.4, 0.5), 4) diameter, round(case when coalesce(hole_diameter, 0) <= 0 then 0.3 else hole_diameter end, 4) hole from v where {_FINITE}",
    "connection_points": _CTE + f"""select board_id, ln layer, kind = 'source' is_source, owner_id, side, pad_no, round(x, 6) x, round(y, 6) y,
      round(case when coalesce(is_tht, false) and coalesce(hole_diameter, 0) > 0 then hole_diameter else 0.5 end, 6) diameter from e where ln is not null and {_FINITE}""",
    "triangle_fields": CORNERS + "select solution_id, layer_no, mesh_no, triangle_no, round(abs(det) / 2, 4) area, round(5.95e4::double * 0.035::double * (gx * gx + gy * gy), 3) as power, round(-5.95e4::double * 0.035::double * gx, 3) jx, round(-5.95e4::double * 0.035::double * gy, 3) jy from g",
    "mesh_quality": CORNERS + f"""select solution_id, layer_no, mesh_no, count(*) triangles, round(sum(abs(det) / 2), 3) area, round(max(abs(det) / 2), 4) largest, count(*) filter (where greatest(ab, bc, ca) / least(ab, bc, ca) > 5) thin,
      count(*) filter (where least({_ANGLE.format(u='ab', v='ca', w='bc')}, {_ANGLE.format(u='ab', v='bc', w='ca')}, {_ANGLE.format(u='bc', v='ca', w='ab')}) < 10) sharp from d group by 1, 2, 3""",
    "boundary_edges": _MESH + """, ed as (select solution_id, layer_no, mesh_no, least(v0, v1) a, greatest(v0, v1) b from triangles where "role" = 'meshes' union all
      select solution_id, layer_no, mesh_no, least(v1, v2), greatest(v1, v2) from triangles where "role" = 'meshes' union all select solution_id, layer_no, mesh_no, least(v2, v0), greatest(v2, v0) from triangles where "role" = 'meshes')
      select solution_id, layer_no, mesh_no, a, b from ed group by all having count(*) = 1""",
    "laplacian": _LAPLACE + """select solution_id, layer_no, mesh_no, "row", col, round("value", 3) "value" from lap""",
    "node_currents": _LAPLACE + """, y as (select l.solution_id, l.layer_no, l.mesh_no, "row", sum("value" * coalesce(potential, 0)) y from lap l join vv on vv.solution_id = l.solution_id and vv.layer_no = l.layer_no and vv.mesh_no = l.mesh_no and vv.vertex_no = l.col group by all)
      select solution_id, layer_no, mesh_no, count(*) as "rows", round(sqrt(sum(y * y)), 2) norm from y group by 1, 2, 3""",
}
