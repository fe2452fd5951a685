import random

import numpy as np

from voltmill.operators import spatial
from voltmill.operators.spatial import RTree, build_quadtree, near_or_inside, number_leaves, tiles_of_boxes

P = "space long, id long, x double, y double, tags array<string>, kind string"
S = "space long, id long, x double, y double, tag string, tile string"
R = "space long, id long, tag string, rings array<array<struct<x:double,y:double>>>"
NAN = float("nan")


def inside(x, y, ring):
    ring = [p for p in ring or [] if p is not None and None not in p and p[0] == p[0] and p[1] == p[1]]
    hit = False
    if len(ring) < 3:
        return False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            hit = not hit
    return hit


def brute(points, sites, regions, d):
    out = set()
    ok = lambda *v: all(x is not None and x == x for x in v)
    for s, i, x, y, tags, _ in points:
        if not ok(s, i, x, y) or not tags:
            continue
        for s2, j, u, v, tag, _ in sites:
            if s2 == s and ok(j, u, v) and np.hypot(x - u, y - v) <= d and (tag is None or tag in tags):
                out.add(("site", i, j))
        for s2, j, tag, rings in regions:
            if s2 == s and j is not None and rings and tag is not None and tag in tags and inside(x, y, rings[0]) and not any(inside(x, y, h) for h in rings[1:]):
                out.add(("region", i, j))
    return out


def data(seed, n=250):
    rnd = random.Random(seed)
    c = lambda: rnd.choice([None, NAN, 3.0]) if rnd.random() < 0.03 else rnd.random() * rnd.choice([1, 10])
    space = lambda: rnd.choice([1, 1, 1, 2, None])
    points = [(space(), i, c(), c(), rnd.choice([None, [], ["a"], ["a", "b"], ["b", None]]), "k") for i in range(n)]
    sites = [(space(), 1000 + i, c(), c(), rnd.choice([None, "a", "b", "z"]), "t") for i in range(n)]
    ring = lambda x, y, r: [(x + r * np.cos(t) * k, y + r * np.sin(t) * k) for t, k in zip(np.linspace(0, 6.28, 9), [1, 0.4] * 5)]
    regions = []
    for i in range(40):
        x, y, r = rnd.random() * 10, rnd.random() * 10, rnd.random() * 4
        outline = [tuple(map(float, p)) for p in ring(x, y, r)]
        hole = [tuple(map(float, p)) for p in ring(x, y, r / 3)][::-1]
        regions.append((space(), 2000 + i, rnd.choice(["a", "b", None]), rnd.choice([[outline], [outline, hole], [outline + outline[:1], hole, None, []], [outline[:2]], [], None, [None], [[None, (NAN, 1.0), *outline]]])))
    return points, sites, regions


def check(spark, points, sites, regions, d=0.3):
    frames = spark.createDataFrame(points, P), spark.createDataFrame(sites, S), spark.createDataFrame(regions, R)
    got = [tuple(r) for r in near_or_inside(*frames, d).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(points, sites, regions, d)


def test_one_tile(spark):
    points, sites, regions = data(1)
    check(spark, points + points[:30], sites + sites[:30], regions + regions[:5])


def test_quadtree_tiles_and_salts(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE_ROWS", 30)
    monkeypatch.setattr(spatial, "BUNDLE_ROWS", 50)
    points, sites, regions = data(2)
    points += [(1, 5000 + i, 2.0, 2.0, ["a"], "k") for i in range(120)]  # one position, which no cut can split
    sites += [(1, 6000 + i, 2.1, 2.0, "a", "t") for i in range(90)]
    check(spark, points + points[-40:], sites + sites[-30:], regions)


def test_tiles_keep_their_size_when_the_sample_is_small(spark, monkeypatch):
    """With a sample far too small for the rows, leaves and boxes of spaces are cut into cells."""
    monkeypatch.setattr(spatial, "TILE_ROWS", 30)
    monkeypatch.setattr(spatial, "BUNDLE_ROWS", 50)
    points, sites, regions = data(7)
    check(spark, points, sites, regions)
    most = []
    real = spatial._salted

    def watched(lines):
        most.append(lines.groupBy("space", "tile").count().agg({"count": "max"}).first()[0])
        return real(lines)

    monkeypatch.setattr(spatial, "_salted", watched)
    for sample in (1, 60, 50_000):
        monkeypatch.setattr(spatial, "SAMPLE_ROWS", sample)
        check(spark, points, sites, regions)
    assert max(most) <= 200 and len(points) + len(sites) > 450


def test_empty(spark):
    points, sites, regions = data(3, 20)
    check(spark, [], sites, regions)
    check(spark, points, [], [])


def test_tiles_cover_the_plane():
    rng = np.random.default_rng(4)
    x, y = rng.random(500), rng.random(500)
    for rows_a_sample in (1, 10_000):
        tree = number_leaves(build_quadtree(x, y, 20), rows_a_sample)
        far = np.array([[-9.0, 5.0, -9.0, 5.0], [0.5, 0.5, 0.5, 0.5]])
        rows, _ = tiles_of_boxes(tree, far)
        assert sorted(rows) == [0, 1]
        box = np.array([[0.2, 0.3, 0.7, 0.9]])
        inside = np.array([[u, v, u, v] for u, v in rng.random((300, 2)) * [0.5, 0.6] + [0.2, 0.3]])
        assert set(tiles_of_boxes(tree, inside)[1]) <= set(tiles_of_boxes(tree, box)[1])


def test_rtree_probe():
    rng = np.random.default_rng(5)
    tile = rng.integers(0, 3, 700)
    low = rng.random((700, 2)) * 10
    box = np.hstack([low, low + rng.random((700, 2))])
    pt, px, py = rng.integers(0, 4, 300), rng.random(300) * 11, rng.random(300) * 11
    got = {(a, b) for p, k in RTree(tile, box).probe(pt, px, py, 64) for a, b in zip(p, k)}
    want = {(i, j) for i in range(300) for j in np.flatnonzero((tile == pt[i]) & (box[:, 0] <= px[i]) & (px[i] <= box[:, 2]) & (box[:, 1] <= py[i]) & (py[i] <= box[:, 3]))}
    assert got == want
