"""Points near other points, and regions that contain points.

1. Rows are counted per space (a board). A bounded sample of all positions (at most ``2 * SAMPLE_ROWS``) gives a
   quadtree for every space that has more than one tile's worth of rows and enough of the sample. The tree covers the
   whole plane, so every row finds its tile whatever the sample missed. As the sample is bounded, so are the trees; a
   leaf that stands for more rows than a tile should hold is cut into equal cells, as many as its rows ask for, and so
   is the box of a large space with too small a part of the sample. Tiles therefore keep their size at any scale.
2. Rows are counted per tile. A tile that still holds too many (equal positions, which no cut separates) is salted:
   its points are spread over rows and its boxes over columns of a table of salts, and each is copied to the others'
   places, so that every point meets every box once.
3. A point goes to the one tile that holds it. The box of a region (or of a point, grown by the distance) is
   replicated to all tiles it touches.
4. Tiles are bundled by hash, and tasks hold an equal share of bundles, their number following that of the rows. Each
   bundle bulk-loads a sort-tile-recursive R-tree over its boxes, probes it with its points level by level, and refines
   candidates exactly.
5. The point of a pair is its reference point: as it lies in one tile only, each pair is found once although boxes
   are replicated, and no pass over the result is needed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Stage

#: Rows fetched to shape the quadtree, on average; at most twice as many.
SAMPLE_ROWS = 50_000
#: Rows one tile, one bundle of tiles and one task should hold, and the most tasks.
TILE_ROWS = 10_000
BUNDLE_ROWS = 20_000
TASK_ROWS = 60_000
MOST_TASKS = 100_000
MAX_DEPTH = 16
FANOUT = 16
_MIN_SAMPLE = 24


# --- quadtree -----------------------------------------------------------------------------------------------------


def build_quadtree(x: np.ndarray, y: np.ndarray, most: float, depth: int = 0) -> dict:
    """A node ``{"cut": (cx, cy), "kids": [sw, se, nw, ne]}`` or a leaf ``{"n": rows, "box": (x, y, width, height)}``
    over sampled positions."""
    if not len(x):
        return {"n": 0, "box": (0.0, 0.0, 0.0, 0.0)}
    box = (float(x.min()), float(y.min()), float(np.ptp(x)), float(np.ptp(y)))
    if len(x) <= most or depth >= MAX_DEPTH or not (box[2] or box[3]):
        return {"n": len(x), "box": box}
    cx, cy = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
    where = (x >= cx).astype(int) + 2 * (y >= cy)
    return {"cut": (cx, cy), "kids": [build_quadtree(x[where == q], y[where == q], most, depth + 1) for q in range(4)]}


def cells_a_side(rows: float) -> int:
    """Cells along each side of a box with that many rows, a power of two."""
    return 1 if rows <= 2 * TILE_ROWS else 1 << math.ceil(math.log(rows / TILE_ROWS, 4))


def number_leaves(tree: dict, rows_a_sample: float) -> dict:
    """Give every leaf its number of cells a side and the number of its first tile."""
    state = [0]

    def walk(node: dict) -> None:
        if "cut" in node:
            for kid in node["kids"]:
                walk(kid)
        else:
            node["tile"], node["cells"] = state[0], cells_a_side(node["n"] * rows_a_sample)
            state[0] += node["cells"] ** 2

    walk(tree)
    return tree


def _cell_numbers(values: np.ndarray, start: float, width: float, cells: int) -> np.ndarray:
    """The cells of a side that hold ``values``; what is beyond either end belongs to the outermost cell."""
    if not width:
        return np.zeros(len(values), np.int64)
    return np.clip(np.floor((values - start) / (width / cells)), 0, cells - 1).astype(np.int64)


def tiles_of_boxes(tree: dict, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, tile) of all tiles the boxes ``[xmin, ymin, xmax, ymax]`` touch."""
    rows, tiles = [], []

    def walk(node: dict, at: np.ndarray) -> None:
        if not len(at):
            return
        if "cut" not in node:
            x, y, w, h = node["box"]
            n = node["cells"]
            i0, i1 = (_cell_numbers(box[at, k], x, w, n) for k in (0, 2))
            j0, j1 = (_cell_numbers(box[at, k], y, h, n) for k in (1, 3))
            wide = i1 - i0 + 1
            count = wide * (j1 - j0 + 1)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(np.arange(len(at)), count)
            rows.append(at[row])
            tiles.append(node["tile"] + (j0[row] + place // wide[row]) * n + i0[row] + place % wide[row])
            return
        cx, cy = node["cut"]
        west, east = box[at, 0] < cx, box[at, 2] >= cx
        south, north = box[at, 1] < cy, box[at, 3] >= cy
        for q, hit in enumerate((west & south, east & south, west & north, east & north)):
            walk(node["kids"][q], at[hit])

    walk(tree, np.arange(len(box)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(tiles)


# --- R-tree -------------------------------------------------------------------------------------------------------


class RTree:
    """A packed R-tree over boxes that carry a tile number; boxes of other tiles are never touched by a probe."""

    def __init__(self, tile: np.ndarray, box: np.ndarray):
        n = len(tile)
        self.order = self._pack(tile, box)
        self.levels: list[np.ndarray] = []
        low = np.column_stack([tile, box[:, 0], box[:, 1]])[self.order] if n else np.zeros((0, 3))
        high = np.column_stack([tile, box[:, 2], box[:, 3]])[self.order] if n else np.zeros((0, 3))
        self.levels.append(np.hstack([low, high]))
        while len(self.levels[-1]) > FANOUT:
            below = self.levels[-1]
            cuts = np.arange(0, len(below), FANOUT)
            self.levels.append(np.hstack([np.minimum.reduceat(below[:, :3], cuts), np.maximum.reduceat(below[:, 3:], cuts)]))

    @staticmethod
    def _pack(tile: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Sort-tile-recursive order: by tile, then vertical strips, then upwards within a strip."""
        n = len(tile)
        if not n:
            return np.zeros(0, np.int64)
        cx, cy = box[:, 0] + box[:, 2], box[:, 1] + box[:, 3]
        by_x = np.lexsort((cx, tile))
        sorted_tile = tile[by_x]
        first = np.r_[True, sorted_tile[1:] != sorted_tile[:-1]]
        start = np.flatnonzero(first)
        size = np.diff(np.r_[start, n])
        strip_rows = np.ceil(np.sqrt(np.ceil(size / FANOUT))).astype(np.int64) * FANOUT
        strip = (np.arange(n) - np.repeat(start, size)) // np.repeat(strip_rows, size)
        return by_x[np.lexsort((cy[by_x], strip, sorted_tile))]

    def probe(self, tile: np.ndarray, x: np.ndarray, y: np.ndarray, step: int = 20_000):
        """Yield pairs (point, box) whose box holds the point, edges included."""
        for s in range(0, len(tile), step):
            point = np.arange(s, min(s + step, len(tile)))
            at = np.column_stack([tile[point], x[point], y[point]]).astype(float)
            top = self.levels[-1]
            p, k = np.repeat(np.arange(len(point)), len(top)), np.tile(np.arange(len(top)), len(point))
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                hit = np.ones(len(p), bool)
                for axis in range(3):
                    hit &= (level[k, axis] <= at[p, axis]) & (at[p, axis] <= level[k, axis + 3])
                p, k = p[hit], k[hit]
                if depth:
                    first = k * FANOUT
                    count = np.minimum(first + FANOUT, len(self.levels[depth - 1])) - first
                    p = np.repeat(p, count)
                    k = np.repeat(first, count) + (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count))
            yield point[p], self.order[k]


# --- exact tests --------------------------------------------------------------------------------------------------


def rings_contain(px: np.ndarray, py: np.ndarray, ring: np.ndarray, start: np.ndarray, vx: np.ndarray, vy: np.ndarray, most: int = 2_000_000) -> np.ndarray:
    """Even-odd test of point ``i`` against ring ``ring[i]``; ring ``r`` has the vertices ``start[r]:start[r + 1]``.

    Rings are closed if they are not. Those of fewer than three points contain nothing.
    """
    out = np.zeros(len(px), bool)
    size = (start[1:] - start[:-1])[ring]
    size = np.where(size < 3, 0, size)
    done = np.cumsum(size)
    begin = 0
    while begin < len(px):
        base = done[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(done, base + most, side="right")))
        n = size[begin:end]
        pair = np.repeat(np.arange(begin, end), n)
        if len(pair):
            offset = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            a = start[ring[pair]] + offset
            b = np.where(offset + 1 == size[pair], start[ring[pair]], a + 1)
            ay, by = vy[a], vy[b]
            over = (ay > py[pair]) != (by > py[pair])
            a, b, pair = a[over], b[over], pair[over]
            cross = vx[a] + (py[pair] - vy[a]) * (vx[b] - vx[a]) / (vy[b] - vy[a])
            hits = np.bincount(pair[px[pair] < cross] - begin, minlength=end - begin)
            out[begin:end] = hits % 2 == 1
        begin = end
    return out


# --- the join -----------------------------------------------------------------------------------------------------


def _sample_trees(positions: DataFrame, rows: int) -> dict[int, dict]:
    """Quadtrees of the spaces that need more than one tile, from a bounded sample of (space, x, y)."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    taken = positions if share >= 1 else positions.sample(share, seed=7)
    pdf = taken.limit(2 * SAMPLE_ROWS).toPandas()
    most = max(_MIN_SAMPLE, TILE_ROWS * share)
    trees = {}
    for space, part in pdf.groupby("space"):
        if len(part) > most:
            trees[int(space)] = number_leaves(build_quadtree(part["x"].to_numpy(), part["y"].to_numpy(), most), 1 / share)
    return trees


def _grids(spaces: DataFrame) -> DataFrame:
    """``(space, gx, gy, gw, gh, cells)``: spaces with more rows than a tile should hold, and the size of their cells."""
    large = spaces.filter(F.col("n") > 2 * TILE_ROWS).withColumn("cells", F.expr(f"shiftleft(1L, cast(ceil(log2(n / {TILE_ROWS}) / 2) as int))"))
    width = lambda a: F.nullif((F.col(f"{a}1") - F.col(f"{a}0")) / F.col("cells"), F.lit(0.0))
    return Stage(large.select("space", F.col("x0").alias("gx"), F.col("y0").alias("gy"), width("x").alias("gw"), width("y").alias("gh"), "cells"), "grids").df


def _with_tiles(df: DataFrame, trees: dict[int, dict], grids: DataFrame) -> DataFrame:
    """Add ``tile``; a row appears once for each tile its box touches."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("array<bigint>")
    def tiles(space, x0, y0, x1, y1):  # noqa: ANN001
        import pandas as pd

        out = np.empty(len(space), object)
        box = np.column_stack([x0, y0, x1, y1])
        spaces, codes = np.unique(space.to_numpy(), return_inverse=True)
        for code, s in enumerate(spaces):
            at = np.flatnonzero(codes == code)
            r, t = tiles_of_boxes(shared.value[int(s)], box[at])
            order = np.argsort(r, kind="stable")
            r, t = r[order], t[order]
            for row, part in zip(at, np.split(t, np.searchsorted(r, np.arange(1, len(at))))):
                out[row] = part
        return pd.Series(out)

    def cell(value: str, start: str, size: str) -> Column:
        number = F.floor((F.col(value) - F.col(start)) / F.col(size)).cast("double")
        return F.coalesce(F.greatest(F.lit(0.0), F.least(number, F.col("cells") - 1.0)), F.lit(0.0)).cast("long")

    cells = lambda a: F.explode(F.sequence(cell(f"{a}0", f"g{a}", "gw" if a == "x" else "gh"), cell(f"{a}1", f"g{a}", "gw" if a == "x" else "gh")))
    # At most SAMPLE_ROWS / 12 spaces have a tree.
    heavy = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in trees], "space long"))
    rest = df.join(heavy, "space", "left_anti").join(grids, "space", "left").withColumn("_i", cells("x")).withColumn("_j", cells("y"))
    rest = rest.withColumn("tile", F.col("_j") * F.coalesce("cells", F.lit(1)) + F.col("_i")).select(*df.columns, "tile")
    if not trees:
        return rest
    return rest.unionByName(df.join(heavy, "space", "left_semi").withColumn("tile", F.explode(tiles("space", "x0", "y0", "x1", "y1"))))


def _salted(lines: DataFrame) -> DataFrame:
    """Add ``salt``; points and boxes of tiles that hold too many are copied to the places where they meet."""
    of = lambda is_point: F.count_if((F.col("kind") == 0) == F.lit(is_point))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / TILE_ROWS)).cast("long").alias(f"_{n}")
    counts = lines.groupBy("space", "tile").agg(of(True).alias("points"), of(False).alias("boxes"))
    hot = Stage(counts.filter(F.greatest("points", "boxes") > 2 * TILE_ROWS).select("space", "tile", parts("points"), parts("boxes")), "hot").df
    many = lines.join(hot, ["space", "tile"], "left")
    rows, columns = F.coalesce("_points", F.lit(1)), F.coalesce("_boxes", F.lit(1))
    own = lambda n: F.pmod(F.xxhash64("id"), n)
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    salts = F.when(F.col("kind") == 0, F.transform(all_of(columns), lambda c: own(rows) * columns + c)).otherwise(F.transform(all_of(rows), lambda r: r * columns + own(columns)))
    return many.withColumn("salt", F.explode(salts)).drop("_points", "_boxes")


def near_or_inside(points: DataFrame, sites: DataFrame, regions: DataFrame, distance: float) -> DataFrame:
    """Match points with sites at most ``distance`` away and with regions that contain them.

    ``points``: space long, id long, x, y double, tags array<string>.
    ``sites``: space long, id long, x, y double, tag string (null suits every point that has a tag).
    ``regions``: space long, id long, tag string, rings array<array<struct<x, y>>>, the first ring being the outline.
    A match needs the same space and a tag of the point. Result: kind (``site`` or ``region``), point_id, other_id,
    each pair once; repeated rows of one id count once. Null or NaN coordinates, null ids and null spaces match nothing.
    """
    points = points.filter(_usable("space", "id", "x", "y") & (F.size("tags") > 0))
    sites = sites.filter(_usable("space", "id", "x", "y"))
    d = F.lit(distance * (1 + 1e-9))
    real = F.filter(F.transform("rings", lambda r: F.filter(r, lambda v: v.isNotNull() & v.x.isNotNull() & v.y.isNotNull() & ~F.isnan(v.x) & ~F.isnan(v.y))), lambda r: r.isNotNull())
    regions = regions.filter("space is not null and id is not null and tag is not null and size(rings) > 0 and rings[0] is not null").withColumn("rings", real)
    regions = regions.filter(F.size(F.element_at("rings", 1)) >= 3)
    outline = F.element_at("rings", 1)
    regions = regions.select(
        "space", "id", "tag",
        F.array_min(outline.x).alias("x0"), F.array_min(outline.y).alias("y0"), F.array_max(outline.x).alias("x1"), F.array_max(outline.y).alias("y1"),
        F.flatten(F.transform("rings", lambda r: r.x)).alias("vx"), F.flatten(F.transform("rings", lambda r: r.y)).alias("vy"),
        F.transform("rings", F.size).alias("sizes"),
    )

    everywhere = points.select("space", "x", "y").unionByName(sites.select("space", "x", "y"))
    everywhere = everywhere.unionByName(regions.select("space", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")))
    box = [f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))]
    spaces = Stage(everywhere.groupBy("space").agg(F.count("*").alias("n"), *box), "spaces", {"rows": F.sum("n"), "most": F.max("n")})
    rows = spaces.seen["rows"] or 0
    one_tile = (spaces.seen["most"] or 0) <= TILE_ROWS  # then each space is a tile, and none can be too full
    trees, grids = ({}, None) if one_tile else (_sample_trees(everywhere, rows), _grids(spaces.df))
    spaces.drop()
    bundles = max(1, math.ceil(rows / BUNDLE_ROWS))
    tasks = max(1, min(math.ceil(rows / TASK_ROWS), MOST_TASKS))

    p = points.select("space", "id", *[F.col(c).alias(a) for c, a in (("x", "x0"), ("y", "y0"), ("x", "x1"), ("y", "y1"))], F.lit(0).alias("kind"), "tags")
    s = sites.select("space", "id", (F.col("x") - d).alias("x0"), (F.col("y") - d).alias("y0"), (F.col("x") + d).alias("x1"), (F.col("y") + d).alias("y1"), F.lit(1).alias("kind"), F.array("tag").alias("tags"), F.array("x").alias("vx"), F.array("y").alias("vy"))
    r = regions.withColumn("kind", F.lit(2)).withColumn("tags", F.array("tag")).drop("tag")
    tiled = (lambda df: df.withColumn("tile", F.lit(0).cast("long"))) if one_tile else (lambda df: _with_tiles(df, trees, grids))
    lines = tiled(p).unionByName(tiled(s), allowMissingColumns=True).unionByName(tiled(r), allowMissingColumns=True)
    lines = lines.withColumn("salt", F.lit(0).cast("long")) if one_tile else _salted(lines)
    lines = lines.withColumn("bundle", F.pmod(F.xxhash64("space", "tile", "salt"), F.lit(bundles)).cast("int"))

    def match(batch: pa.Table) -> pa.Table:
        return match_bundle(batch, distance)

    return lines.repartition(tasks, "bundle").groupBy("bundle").applyInArrow(match, "kind string, point_id long, other_id long")


def _usable(*names: str):  # noqa: ANN202
    test = F.lit(True)
    for n in names:
        test = test & F.col(n).isNotNull()
        if n in "xy":
            test = test & ~F.isnan(n) & (F.abs(n) != F.lit(float("inf")))
    return test


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list column; null lists are empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.nan_to_num(pc.list_value_length(arr).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    return arr.flatten(), np.r_[0, np.cumsum(size)]


def match_bundle(batch: pa.Table, distance: float) -> pa.Table:
    """All matches within one bundle of tiles."""
    def column(name: str) -> np.ndarray:
        return batch.column(name).to_numpy()

    kind, ids = column("kind"), column("id")
    _, tile = np.unique(np.rec.fromarrays([column("space"), column("tile"), column("salt")]), return_inverse=True)
    box = np.column_stack([column(c) for c in ("x0", "y0", "x1", "y1")]).astype(float)
    # Repeated rows of an id: the first one in the bundle's tile counts.
    _, first = np.unique(np.rec.fromarrays([kind, ids, tile]), return_index=True)
    point, other = first[kind[first] == 0], first[kind[first] > 0]
    tag_values, tag_start = _lists(batch.column("tags"))
    codes = pc.dictionary_encode(tag_values)
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    code = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    tags = max(1, len(codes.dictionary))
    owner = np.repeat(np.arange(len(kind)), np.diff(tag_start))
    named = (kind[owner] == 0) & (code >= 0)
    of_point = np.unique(owner[named] * tags + code[named])
    own_tag = np.full(len(kind), -1)
    own_tag[other] = code[tag_start[other]]
    vx, vstart = _lists(batch.column("vx"))
    vx, vy = vx.to_numpy(zero_copy_only=False), _lists(batch.column("vy"))[0].to_numpy(zero_copy_only=False)
    sizes, sstart = _lists(batch.column("sizes"))
    ring_size = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
    ring_count = np.diff(sstart)
    # Sites carry one vertex and no ring; all vertices lie in row order.
    ring_owner = np.repeat(np.arange(len(kind)), ring_count)
    within = np.cumsum(ring_size) - ring_size
    lead = np.r_[0, np.cumsum(ring_size)][sstart[:-1]]
    ring_start = vstart[ring_owner] + within - lead[ring_owner] if len(ring_size) else np.zeros(0, np.int64)

    tree = RTree(tile[other], box[other])
    kinds, lefts, rights = [], [], []
    for p, o in tree.probe(tile[point], box[point, 0], box[point, 1]):
        p, o = point[p], other[o]
        fits = own_tag[o] < 0
        named = p * tags + own_tag[o]
        at = np.minimum(np.searchsorted(of_point, named), len(of_point) - 1)
        fits |= of_point[at] == named if len(of_point) else False
        p, o = p[fits], o[fits]
        px, py = box[p, 0], box[p, 1]
        site = kind[o] == 1
        ok = np.zeros(len(p), bool)
        at = vstart[o[site]]
        ok[site] = np.hypot(px[site] - vx[at], py[site] - vy[at]) <= distance
        region = np.flatnonzero(~site)
        if len(region):
            ro = o[region]
            starts = np.r_[ring_start, 0]
            ends = np.r_[ring_start + ring_size, 0]
            inside = _in_rings(px[region], py[region], sstart[ro], starts, ends, vx, vy)
            region, ro = region[inside], ro[inside]
            holes = ring_count[ro] - 1
            pair = np.repeat(np.arange(len(region)), holes)
            ring = np.repeat(sstart[ro] + 1, holes) + np.arange(len(pair)) - np.repeat(np.cumsum(holes) - holes, holes)
            hit = _in_rings(px[region][pair], py[region][pair], ring, starts, ends, vx, vy)
            out = np.bincount(pair[hit], minlength=len(region)) > 0
            ok[region[~out]] = True
        kinds.append(kind[o[ok]])
        lefts.append(ids[p[ok]])
        rights.append(ids[o[ok]])
    k = np.concatenate(kinds) if kinds else np.zeros(0, np.int64)
    names = np.where(k == 1, "site", "region").astype(object)
    return pa.table({"kind": pa.array(names, pa.string()), "point_id": pa.array(np.concatenate(lefts) if lefts else [], pa.int64()), "other_id": pa.array(np.concatenate(rights) if rights else [], pa.int64())})


def _in_rings(px, py, ring, starts, ends, vx, vy):  # noqa: ANN001, ANN202
    """``rings_contain`` for rings given by separate starts and ends."""
    used, index = np.unique(ring, return_inverse=True)
    size = ends[used] - starts[used]
    flat = np.r_[0, np.cumsum(size)]
    at = np.repeat(starts[used], size) + np.arange(flat[-1]) - np.repeat(flat[:-1], size)
    return rings_contain(px, py, index, flat, vx[at], vy[at])
