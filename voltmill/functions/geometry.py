"""Planar geometry as column expressions.

A point is ``struct<x: double, y: double>``, a ring an array of points whether closed or not, a polygon an array of
rings of which the first is the outline. Null rings give null; rings without points give 0 or null as stated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x: Column | float, y: Column | float) -> Column:
    x, y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


# --- points, boxes, segments --------------------------------------------------------------------------------------


def affine(p: Column, scale: Column, dx: Column, dy: Column) -> Column:
    """``p * scale + (dx, dy)``; null parameters are the identity."""
    s = F.coalesce(scale, F.lit(1.0))
    return point(p.x * s + F.coalesce(dx, F.lit(0.0)), p.y * s + F.coalesce(dy, F.lit(0.0)))


def inverse_affine(p: Column, scale: Column, dx: Column, dy: Column) -> Column:
    s = F.coalesce(scale, F.lit(1.0))
    return point((p.x - F.coalesce(dx, F.lit(0.0))) / s, (p.y - F.coalesce(dy, F.lit(0.0))) / s)


def fitted_scale(from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """1/25.4 where the mean ratio of two extents tells inches from millimetres, else 1."""
    ratio = (from_w / F.nullif(to_w, F.lit(0.0)) + from_h / F.nullif(to_h, F.lit(0.0))) / 2
    return F.when(F.abs(ratio - 25.4) < 5, F.lit(1 / 25.4)).otherwise(1.0)


def fitted_transform(source: Column, target: Column) -> Column:
    """``struct<scale, dx, dy>`` that maps the middle of one box to that of another, in the unit the sizes tell."""
    scale = fitted_scale(source.x1 - source.x0, source.y1 - source.y0, target.x1 - target.x0, target.y1 - target.y0)
    dx = (target.x0 + target.x1) / 2 - scale * (source.x0 + source.x1) / 2
    dy = (target.y0 + target.y1) / 2 - scale * (source.y0 + source.y1) / 2
    return F.struct(scale.alias("scale"), dx.alias("dx"), dy.alias("dy"))


def mirrored(ring: Column | str, cx: Column) -> Column:
    """Mirrored left to right at ``cx``."""
    return F.transform(col(ring), lambda p: point(2 * cx - p.x, p.y))


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def along_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on a segment, from 0 to 1, the nearest point to p lies; 0 on a segment without length."""
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(length, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = along_segment(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def segments_intersect(a: Column, b: Column, c: Column, d: Column, eps: float = 1e-9) -> Column:
    """Orientation test with tolerance on the products, which also counts short segments that nearly touch."""

    def turn(p: Column, q: Column, r: Column) -> Column:
        return cross(q.x - p.x, q.y - p.y, r.x - p.x, r.y - p.y)

    return (turn(a, b, c) * turn(a, b, d) < eps) & (turn(c, d, a) * turn(c, d, b) < eps)


def segments_close(a: Column, b: Column, c: Column, d: Column, tolerance: float) -> Column:
    """Any end of one segment within ``tolerance`` of the other."""
    return F.least(
        segment_distance(a.x, a.y, c.x, c.y, d.x, d.y), segment_distance(b.x, b.y, c.x, c.y, d.x, d.y),
        segment_distance(c.x, c.y, a.x, a.y, b.x, b.y), segment_distance(d.x, d.y, a.x, a.y, b.x, b.y),
    ) <= tolerance


def boxes_overlap(a: Column, b: Column) -> Column:
    """Inclusive; boxes are structs of x0, y0, x1, y1."""
    return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)


def box_contains(box: Column, x: Column, y: Column) -> Column:
    return (box.x0 <= x) & (x <= box.x1) & (box.y0 <= y) & (y <= box.y1)


# --- rings --------------------------------------------------------------------------------------------------------


def successors(ring: Column | str) -> Column:
    """The ring turned by one place: each point's successor."""
    r = col(ring)
    return F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))


def edges(ring: Column | str) -> Column:
    """Array of ``struct<a, b>``, one per point, the last leading back to the first."""
    r = col(ring)
    return F.zip_with(r, successors(r), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def ring_area(ring: Column | str) -> Column:
    """Signed area, positive counter-clockwise; 0 for fewer than three points."""
    r = col(ring)
    twice = _total(F.zip_with(r, successors(r), lambda a, b: a.x * b.y - b.x * a.y))
    return F.when(F.size(r) >= 3, twice / 2).when(r.isNotNull(), F.lit(0.0))


def perimeter(ring: Column | str) -> Column:
    r = col(ring)
    return _total(F.zip_with(r, successors(r), lambda a, b: F.hypot(a.x - b.x, a.y - b.y)))


def polygon_area(rings: Column | str) -> Column:
    """Area of the outline less those of the holes."""
    r = col(rings)
    return F.abs(ring_area(F.get(r, F.lit(0)))) - _total(F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda h: F.abs(F.coalesce(ring_area(h), F.lit(0.0)))))


def bounds(ring: Column | str) -> Column:
    """``struct<x0, y0, x1, y1>``; nulls for a ring without points."""
    r = col(ring)
    return F.struct(F.array_min(r.x).alias("x0"), F.array_min(r.y).alias("y0"), F.array_max(r.x).alias("x1"), F.array_max(r.y).alias("y1"))


def vertex_mean(ring: Column | str) -> Column:
    """Mean of the points, unweighted; null for a ring without points."""
    r = col(ring)
    n = F.nullif(F.size(r), F.lit(0))
    return point(_total(F.transform(r, lambda p: p.x)) / n, _total(F.transform(r, lambda p: p.y)) / n)


def oriented(ring: Column | str, hole: bool = False) -> Column:
    """Counter-clockwise, or clockwise for a hole."""
    r = col(ring)
    wrong = ring_area(r) > 0 if hole else ring_area(r) < 0
    return F.when(wrong, F.reverse(r)).otherwise(r)


def in_ring(x: Column, y: Column, ring: Column | str) -> Column:
    """Even-odd test, half-open in y; false for fewer than three points."""
    r = col(ring)
    crossed = F.zip_with(r, successors(r), lambda a, b: (((a.y > y) != (b.y > y)) & (x < a.x + (y - a.y) * (b.x - a.x) / F.nullif(b.y - a.y, F.lit(0.0)))))
    return (F.size(r) >= 3) & (F.size(F.filter(crossed, lambda c: c)) % 2 == 1)


def in_polygon(x: Column, y: Column, rings: Column | str) -> Column:
    """Inside the outline and no hole."""
    r = col(rings)
    holes = F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))
    return in_ring(x, y, F.get(r, F.lit(0))) & ~F.exists(holes, lambda h: F.coalesce(in_ring(x, y, h), F.lit(False)))


def in_any_ring(x: Column, y: Column, rings: Column | str) -> Column:
    return F.exists(col(rings), lambda r: F.coalesce(in_ring(x, y, r), F.lit(False)))


def ring_distance(x: Column, y: Column, ring: Column | str) -> Column:
    """Distance of a point from the edges; null for a ring without points."""
    r = col(ring)
    return F.array_min(F.zip_with(r, successors(r), lambda a, b: segment_distance(x, y, a.x, a.y, b.x, b.y)))


def polygon_distance(x: Column, y: Column, rings: Column | str) -> Column:
    return F.array_min(F.transform(col(rings), lambda r: ring_distance(x, y, r)))


def within(x: Column, y: Column, rings: Column | str, tolerance: float) -> Column:
    """Inside, or at most ``tolerance`` from an edge."""
    return in_polygon(x, y, rings) | F.coalesce(polygon_distance(x, y, rings) <= tolerance, F.lit(False))


# --- constructed shapes -------------------------------------------------------------------------------------------


def arc_points(cx: Column, cy: Column, radius: Column, start: Column, sweep: Column, segments: Column) -> Column:
    """``segments + 1`` points on an arc."""
    n = segments.cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: point(cx + radius * F.cos(start + sweep * i / n), cy + radius * F.sin(start + sweep * i / n)))


def circle(cx: Column, cy: Column, radius: Column, sides: int = 24) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda i: point(cx + radius * F.cos(i * (2 * math.pi / sides)), cy + radius * F.sin(i * (2 * math.pi / sides))))


def capsule(ax: Column, ay: Column, bx: Column, by: Column, width: Column, steps: int = 10) -> Column:
    """A segment with round caps; a 20-gon where the segment has no length."""
    r, turn = width / 2, F.atan2(by - ay, bx - ax)
    half = lambda x, y, start: arc_points(x, y, r, start, F.lit(math.pi), F.lit(steps))
    body = F.concat(half(bx, by, turn - math.pi / 2), half(ax, ay, turn + math.pi / 2))
    return F.when((ax == bx) & (ay == by), circle(ax, ay, r, 20)).otherwise(body)


def rectangle(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.array(point(cx - w / 2, cy - h / 2), point(cx + w / 2, cy - h / 2), point(cx + w / 2, cy + h / 2), point(cx - w / 2, cy + h / 2))


def corner_segments(radius: Column) -> Column:
    """Segments of a quarter turn so that each is about 0.02 long, from 4 to 32."""
    return F.greatest(F.lit(4), F.least(F.lit(32), F.ceil(radius * (math.pi / 2) / 0.02))).cast("int")


def rounded_rectangle(cx: Column, cy: Column, w: Column, h: Column, radius: Column) -> Column:
    """The radius is clamped to half the shorter side; none gives the plain rectangle."""
    r = F.least(radius, w / 2, h / 2)
    n, quarter = corner_segments(r), F.lit(math.pi / 2)
    corner = lambda sx, sy, start: arc_points(cx + sx * (w / 2 - r), cy + sy * (h / 2 - r), r, F.lit(start), quarter, n)
    body = F.concat(corner(1, -1, -math.pi / 2), corner(1, 1, 0.0), corner(-1, 1, math.pi / 2), corner(-1, -1, math.pi))
    return F.when(r <= 0, rectangle(cx, cy, w, h)).otherwise(body)


def rotated(ring: Column | str, cx: Column, cy: Column, degrees: Column) -> Column:
    s, c = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    return F.transform(col(ring), lambda p: point(cx + (p.x - cx) * c - (p.y - cy) * s, cy + (p.x - cx) * s + (p.y - cy) * c))


def arc_between(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, clockwise: Column) -> Column:
    """Points of the arc from a to b around c, with exact ends and 8 to 256 segments of about 0.02."""
    start, radius = F.atan2(ay - cy, ax - cx), F.hypot(ax - cx, ay - cy)
    raw = F.atan2(by - cy, bx - cx) - start
    full = F.lit(2 * math.pi)
    sweep = F.when(clockwise, F.when(raw >= 0, raw - full).otherwise(raw)).otherwise(F.when(raw <= 0, raw + full).otherwise(raw))
    n = F.greatest(F.lit(8), F.least(F.lit(256), F.ceil(F.abs(sweep) * radius / 0.02))).cast("int")
    inner = F.transform(F.sequence(F.lit(1), n - 1), lambda i: point(cx + radius * F.cos(start + sweep * i / n), cy + radius * F.sin(start + sweep * i / n)))
    return F.concat(F.array(point(ax, ay)), inner, F.array(point(bx, by)))


def bezier(p0: Column, p1: Column, p2: Column, p3: Column, segments: int = 16) -> Column:
    """A cubic curve as ``segments + 1`` points."""

    def at(i: Column) -> Column:
        t = i / segments
        u = 1 - t
        w = (u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t)
        return point(w[0] * p0.x + w[1] * p1.x + w[2] * p2.x + w[3] * p3.x, w[0] * p0.y + w[1] * p1.y + w[2] * p2.y + w[3] * p3.y)

    return F.transform(F.sequence(F.lit(0), F.lit(segments)), at)


def symbol_ring(kind: Column, cx: Column, cy: Column, w: Column, h: Column, r: Column, degrees: Column) -> Column:
    """The outline of a pad symbol: ``round`` (24-gon), ``rect`` with or without corner radius, ``oval`` (capsule)."""
    wide = w >= h
    half = F.abs(w - h) / 2
    zero = F.lit(0.0)
    oval = capsule(cx - F.when(wide, half).otherwise(zero), cy - F.when(wide, zero).otherwise(half), cx + F.when(wide, half).otherwise(zero), cy + F.when(wide, zero).otherwise(half), F.least(w, h))
    ring = F.when(kind == "round", circle(cx, cy, w / 2)).when(kind == "rect", rounded_rectangle(cx, cy, w, h, r)).when(kind == "oval", oval)
    return F.when(F.coalesce(degrees, zero) == 0, ring).otherwise(rotated(ring, cx, cy, degrees))


# --- triangles ----------------------------------------------------------------------------------------------------


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return F.abs(cross(b.x - a.x, b.y - a.y, c.x - a.x, c.y - a.y)) / 2


def in_triangle(x: Column, y: Column, a: Column, b: Column, c: Column) -> Column:
    """Boundary included, either direction."""
    side = lambda p, q: cross(q.x - p.x, q.y - p.y, x - p.x, y - p.y)
    s = [side(a, b), side(b, c), side(c, a)]
    return ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))


def angle(at: Column, p: Column, q: Column) -> Column:
    """Degrees at a corner by the law of cosines; null if a side has no length."""
    u, v, w = distance(at.x, at.y, p.x, p.y), distance(at.x, at.y, q.x, q.y), distance(p.x, p.y, q.x, q.y)
    c = (u * u + v * v - w * w) / F.nullif(2 * u * v, F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def half_cotangent(at: Column, p: Column, q: Column, signed: bool = True) -> Column:
    """Half the cotangent at a corner, the weight of the opposite edge; 0 for a degenerate corner."""
    ux, uy, vx, vy = p.x - at.x, p.y - at.y, q.x - at.x, q.y - at.y
    c = cross(ux, uy, vx, vy)
    c = F.abs(c)
    value = F.when(c < 1e-15, F.lit(0.0)).otherwise(dot(ux, uy, vx, vy) / c / 2)
    return value if signed else F.abs(value)


def gradient(a: Column, b: Column, c: Column, va: Column, vb: Column, vc: Column) -> Column:
    """Gradient of the plane through three values, as a point."""
    d = cross(b.x - a.x, b.y - a.y, c.x - a.x, c.y - a.y)
    d = F.when(F.abs(d) < 1e-15, F.lit(1e-15)).otherwise(d)
    gx = (va * (b.y - c.y) + vb * (c.y - a.y) + vc * (a.y - b.y)) / d
    gy = (va * (c.x - b.x) + vb * (a.x - c.x) + vc * (b.x - a.x)) / d
    return point(gx, gy)
