import math

import pytest
from pyspark.sql import functions as F

from voltmill.functions import electrical as el
from voltmill.functions import geometry as geo

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
RINGS = "array<array<struct<x:double,y:double>>>"


def one(spark, *rings):
    rows = [([[{"x": x, "y": y} for x, y in r] for r in rings],)]
    return spark.createDataFrame(rows, f"rings {RINGS}").withColumn("ring", F.col("rings")[0])


def value(df, column):
    return df.select(column.alias("v")).first().v


def test_ring_measures(spark):
    d = one(spark, SQUARE, [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)])
    assert value(d, geo.ring_area("ring")) == 16 and value(d, geo.polygon_area("rings")) == 15
    assert value(d, geo.perimeter("ring")) == 16
    assert tuple(value(d, geo.bounds("ring"))) == (0, 0, 4, 4) and tuple(value(d, geo.vertex_mean("ring"))) == (2, 2)
    assert value(d, geo.ring_area(geo.oriented("ring", hole=True))) == -16
    p = lambda f, x, y: value(d, f(F.lit(x), F.lit(y), "rings"))
    assert p(geo.in_polygon, 3.0, 3.0) and not p(geo.in_polygon, 1.5, 1.5) and p(geo.in_any_ring, 1.5, 1.5) and not p(geo.in_polygon, 9.0, 1.0)
    assert p(geo.polygon_distance, 1.5, 1.5) == 0.5
    assert value(d, geo.within(F.lit(4.04), F.lit(1.0), "rings", 0.05))


def test_empty_and_null_rings(spark):
    d = one(spark, [], [(0.0, 0.0), (1.0, 1.0)])
    assert value(d, geo.ring_area("ring")) == 0 and value(d, geo.ring_area(F.col("rings")[1])) == 0
    assert value(d, geo.vertex_mean("ring")).x is None and value(d, geo.bounds("ring")).x0 is None
    assert value(d, geo.in_ring(F.lit(0.0), F.lit(0.0), "ring")) is False
    assert value(d, geo.ring_area(F.lit(None).cast("array<struct<x:double,y:double>>"))) is None


def test_shapes(spark):
    d = one(spark, SQUARE)
    n = lambda *v: [F.lit(float(x)) for x in v]
    area = lambda r: value(d, geo.ring_area(r))
    assert area(geo.circle(*n(0, 0, 1), 24)) == pytest.approx(math.pi, rel=0.02)
    assert area(geo.capsule(*n(0, 0, 10, 0, 2))) == pytest.approx(20 + math.pi, rel=0.02)
    assert value(d, F.size(geo.capsule(*n(1, 1, 1, 1, 2)))) == 20
    r = geo.rounded_rectangle(*n(0, 0, 4, 4, 1))
    assert area(r) == pytest.approx(16 - 4 + math.pi, rel=0.01) and value(d, F.size(r)) >= 20 and tuple(value(d, geo.bounds(r))) == pytest.approx((-2, -2, 2, 2))
    turned = geo.bounds(geo.rotated(geo.rectangle(*n(0, 0, 4, 2)), *n(0, 0, 90)))
    assert tuple(value(d, turned)) == pytest.approx((-1, -2, 1, 2))
    arc = value(d, geo.arc_between(*n(1, 0, 0, 1, 0, 0), F.lit(False)))
    assert (arc[0].x, arc[-1].y) == (1, 1) and all(math.hypot(*p) == pytest.approx(1) for p in arc)
    assert len(value(d, geo.arc_between(*n(1, 0, 1, 0, 0, 0), F.lit(True)))) == 257
    curve = value(d, geo.bezier(*[geo.point(x, y) for x, y in ((0, 0), (0, 1), (1, 1), (1, 0))]))
    assert len(curve) == 17 and tuple(curve[8]) == pytest.approx((0.5, 0.75))


def test_segments_and_triangles(spark):
    d = one(spark, SQUARE)
    p = geo.point
    assert value(d, geo.segments_intersect(p(0, 0), p(2, 2), p(0, 2), p(2, 0)))
    assert not value(d, geo.segments_intersect(p(0, 0), p(1, 0), p(5, 5), p(6, 5)))
    assert value(d, geo.segments_close(p(0, 0), p(1, 0), p(0, 0.05), p(1, 0.05), 0.06))
    a, b, c = p(0, 0), p(3, 0), p(0, 4)
    assert value(d, geo.triangle_area(a, b, c)) == 6 and value(d, geo.angle(a, b, c)) == pytest.approx(90)
    assert value(d, geo.half_cotangent(b, a, c)) == pytest.approx(3 / 4 / 2)
    assert tuple(value(d, geo.gradient(a, b, c, F.lit(1.0), F.lit(7.0), F.lit(5.0)))) == pytest.approx((2, 1))
    assert value(d, geo.in_triangle(F.lit(0.0), F.lit(4.0), a, b, c)) and not value(d, geo.in_triangle(F.lit(3.0), F.lit(4.0), a, b, c))
    q = geo.inverse_affine(geo.affine(p(3, 4), F.lit(2.0), F.lit(1.0), F.lit(None).cast("double")), F.lit(2.0), F.lit(1.0), F.lit(None).cast("double"))
    assert tuple(value(d, q)) == (3, 4)
    assert value(d, geo.fitted_scale(F.lit(254.0), F.lit(127.0), F.lit(10.0), F.lit(5.0))) == pytest.approx(1 / 25.4)


def test_electrical(spark):
    d = spark.createDataFrame([("rect200x100xr20", 1), ("rect10x20", 2), ("oval300x100", 3), ("r50", 4), ("s60", 5), ("weird", 6)], "s string, i int")
    got = {r.i: tuple(r.v) for r in d.select("i", el.symbol_fields(F.col("s")).alias("v")).collect()}
    assert got[1] == ("rect", 0.2, 0.1, 0.02) and got[2] == ("rect", 0.01, 0.02, 0.0) and got[3][0] == "oval" and got[4] == ("round", 0.05, 0.05, 0.0) and got[5] == ("rect", 0.06, 0.06, 0.0) and got[6][0] is None
    assert value(d, el.sanitized(F.lit(float("nan")))) == 0 and value(d, el.sanitized(F.lit(float("-inf")))) == 0
    assert value(d, el.normal_name(F.lit("Top-Layer 1"))) == "toplayer1"
    assert value(d, el.is_ground(F.lit("MY_VSS"))) and not value(d, el.is_ground(F.lit("3V3")))
    assert value(d, el.via_resistance(F.lit(1.6), F.lit(0.3))) == pytest.approx(1.6 / (5.95e4 * math.pi * (0.175**2 - 0.15**2)))
    assert value(d, el.via_resistance(F.lit(1.6), F.lit(0.0))) == 1e-3
    assert value(d, el.trace_capacity(F.lit(0.254), F.lit(1.0), F.lit(10.0), F.lit(True))) == pytest.approx(0.048 * 10**0.44 * 13.78**0.725)
    assert el.coarsened(2.0, 20.0, 15354, 15000)[0] == pytest.approx(2 * 1.5 * math.sqrt(15354 / 15000)) and el.coarsened(2.0, 20.0, 15354, 15000)[1] == 17
    assert el.mesh_size(100) == (2.0, 20.0)
