"""Board archives (gzip tar of text records) as tables.

``archive_files`` unpacks archives, one row per file. Everything after that is line work in the JVM: a window carries
the last layer list, net, tool or symbol down the lines of one file, and running counts number the records. Only
surfaces, whose grammar nests, and strokes are built by a grouped function, one small group per surface record.

Coordinates stay in the archive's unit. Rules that matter: a feature's number counts S, L, A and P records only and
advances for those that give no polygon; lines, arcs and pads need polarity P; a ring needs three points.
"""

from __future__ import annotations

import io
import math
import posixpath
import tarfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import electrical as el
from ..functions import geometry as geo

#: How far a pad may be from the component pin whose rotation it takes, in the archive's unit.
PIN_REACH = 0.01
FILES = "board string, path string, content string"
RINGS = "array<array<struct<x:double,y:double>>>"


def archive_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``(board, path, content)`` of the regular files of archives; ``board`` is the archive's file name.

    Unreadable archives give no rows; bytes that are no UTF-8 are replaced. Paths are cleaned of leading ``./``.
    """

    def unpack(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    with tarfile.open(fileobj=io.BytesIO(body), mode="r:*") as archive:
                        for member in archive:
                            if member.isfile():
                                text = archive.extractfile(member).read().decode("utf-8", "replace")
                                yield pa.RecordBatch.from_pydict({"board": [posixpath.basename(name)], "path": [posixpath.normpath(member.name)], "content": [text]})
                except (tarfile.TarError, EOFError, OSError):
                    continue

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(unpack, FILES)


def find_files(files: DataFrame, part: str, suffix: str) -> DataFrame:
    """Per board the first path, by name, that contains ``part`` and ends with ``suffix``, ignoring case."""
    hits = files.filter(F.lower("path").contains(part.lower()) & F.lower("path").endswith(suffix.lower()))
    return hits.groupBy("board").agg(F.min(F.struct("path", "content")).alias("f")).select("board", "f.path", "f.content")


def lines(files: DataFrame) -> DataFrame:
    """``(board, path, line_no, line)`` without surrounding blanks, empty lines and comments."""
    split = files.select("board", "path", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    return split.filter("line <> '' and not startswith(line, '#')")


def _carried(value: Column, by: list[str]) -> Column:
    """The last value so far that is not null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))


def net_references(files: DataFrame) -> DataFrame:
    """``(board, layer, feature_no, net)`` of the copper features each net names in ``eda/data``.

    ``LYR`` lines list the layers, ``NET`` begins a net (attributes behind ``;`` are cut), ``FID C l f`` refers to
    feature f of layer l; of several nets the last one counts. A layer number without a layer is skipped.
    """
    rows = lines(find_files(files, "/eda/", "/data")).withColumn("word", F.split("line", r"\s+"))
    rows = rows.withColumn("net", _carried(F.when(F.col("word")[0] == "NET", F.trim(F.split(F.expr("substring(line, 5)"), ";")[0])), ["board"]))
    layers = rows.filter("word[0] = 'LYR'").select("board", "line_no", F.posexplode(F.slice("word", F.lit(2), F.size("word") - 1)).alias("at", "layer"))
    layers = layers.withColumn("layer_no", F.row_number().over(Window.partitionBy("board").orderBy("line_no", "at")) - 1).select("board", "layer_no", "layer")
    refs = rows.filter("word[0] = 'FID' and get(word, 1) = 'C' and net is not null")
    refs = refs.select("board", "line_no", "net", F.get("word", F.lit(2)).try_cast("int").alias("layer_no"), F.get("word", F.lit(3)).try_cast("int").alias("feature_no")).dropna()
    return refs.join(layers, ["board", "layer_no"]).groupBy("board", "layer", "feature_no").agg(F.max_by("net", "line_no").alias("net"))


def component_rotations(files: DataFrame) -> DataFrame:
    """``(board, x, y, degrees)`` of the pins of component files; of several at one place the last one counts."""
    rows = lines(files.filter("lower(path) like '%/components'")).withColumn("word", F.split("line", r"\s+")).filter("word[0] = 'TOP'")
    number = lambda i: F.get("word", F.lit(i)).try_cast("double")
    pins = rows.select("board", F.struct("path", "line_no").alias("at"), number(2).alias("x"), number(3).alias("y"), number(4).alias("degrees")).dropna()
    return pins.groupBy("board", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).agg(F.max_by("degrees", "at").alias("degrees"))


def tools(files: DataFrame) -> DataFrame:
    """``(board, folder, tool_no, type)`` of drill tool files: ``NUM=`` then ``TYPE=``."""
    rows = lines(files.filter("lower(path) like '%drill%/tools'"))
    number = F.when(F.upper("line").startswith("NUM="), F.expr("try_cast(substring(line, 5) as int)"))
    rows = rows.withColumn("tool_no", _carried(number, ["board", "path"])).filter("startswith(upper(line), 'TYPE=') and tool_no is not null")
    return rows.select("board", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "tool_no", F.trim(F.expr("substring(line, 6)")).alias("type"))


def features(files: DataFrame) -> DataFrame:
    """``(board, path, layer, feature_no, kind, fields, body, symbol)`` of feature files and profiles.

    ``kind`` is S, L, A or P; ``body`` holds the lines of a surface in order, ``symbol`` the decoded symbol of a line,
    arc or pad (struct kind, w, h, r). Files are those named ``features`` or ``profile``.
    """
    rows = lines(files.filter("lower(path) like '%/features' or lower(path) like '%/profile'")).withColumn("word", F.split("line", r"\s+"))
    is_symbol = F.col("line").startswith("$")
    symbols = rows.filter(is_symbol).select("board", "path", F.expr("try_cast(substring(word[0], 2) as int)").alias("symbol_no"), el.symbol_fields(F.lower(F.get("word", F.lit(1)))).alias("symbol"))
    kind = F.col("word")[0]
    starts = kind.isin("S", "L", "A", "P")
    order = Window.partitionBy("board", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.filter(~is_symbol).withColumn("starts", starts.cast("int")).withColumn("feature_no", F.sum("starts").over(order) - 1).filter("feature_no >= 0")
    of_surface = F.first(kind).over(Window.partitionBy("board", "path", "feature_no").orderBy("line_no"))
    marked = marked.withColumn("kind", of_surface)
    head = marked.filter("starts = 1").select("board", "path", "feature_no", "kind", F.col("word").alias("fields"))
    body = marked.filter("kind = 'S' and starts = 0").groupBy("board", "path", "feature_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s.line).alias("body"))
    numbered = head.withColumn("symbol_no", F.expr("case when kind = 'P' then try_cast(get(fields, 3) as int) when kind = 'L' then try_cast(get(fields, 5) as int) when kind = 'A' then try_cast(get(fields, 7) as int) end"))
    joined = numbered.join(symbols, ["board", "path", "symbol_no"], "left").join(body, ["board", "path", "feature_no"], "left")
    layer = F.when(F.lower("path").endswith("/profile"), "board_outline_layer").otherwise(F.regexp_extract("path", "/([^/]+)/features$", 1))
    return joined.select("board", "path", layer.alias("layer"), "feature_no", "kind", "fields", "body", "symbol")


def surface_rings(body: list[str] | None) -> list[list[list[tuple[float, float]]]]:
    """Polygons of a surface record: ``OB x y I|H`` begins a ring (a hole for H), ``OS x y`` is a line, ``OC x y cx cy
    Y|N`` an arc (Y clockwise), ``OE`` ends the ring. Rings of fewer than three points are dropped."""
    polygons: list[list[list[tuple[float, float]]]] = []
    ring: list[tuple[float, float]] = []
    hole = False
    for line in body or []:
        word = line.split()
        try:
            if word[0] == "OB":
                ring, hole = [(float(word[1]), float(word[2]))], len(word) > 3 and word[3].upper() == "H"
            elif word[0] == "OS" and ring:
                ring.append((float(word[1]), float(word[2])))
            elif word[0] == "OC" and ring:
                ring += arc(ring[-1], (float(word[1]), float(word[2])), (float(word[3]), float(word[4])), len(word) > 5 and word[5].upper() == "Y")[1:]
            elif word[0] == "OE":
                if len(ring) >= 3:
                    if hole and polygons:
                        polygons[-1].append(ring)
                    elif not hole:
                        polygons.append([ring])
                ring = []
        except (ValueError, IndexError):
            continue
    return polygons


def arc(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float], clockwise: bool) -> list[tuple[float, float]]:
    """Points from a to b around c with exact ends, in 8 to 256 pieces of about 0.02."""
    radius, start = math.hypot(a[0] - c[0], a[1] - c[1]), math.atan2(a[1] - c[1], a[0] - c[0])
    sweep = math.atan2(b[1] - c[1], b[0] - c[0]) - start
    if clockwise and sweep >= 0:
        sweep -= 2 * math.pi
    elif not clockwise and sweep <= 0:
        sweep += 2 * math.pi
    n = min(max(math.ceil(abs(sweep) * radius / 0.02), 8), 256)
    return [a, *((c[0] + radius * math.cos(start + sweep * i / n), c[1] + radius * math.sin(start + sweep * i / n)) for i in range(1, n)), b]


def stroke(points: list[tuple[float, float]], width: float) -> list[tuple[float, float]]:
    """A polyline with width as a ring: offset to the left along averaged normals, and back on the right."""
    p = np.asarray(points, float)
    d = np.diff(p, axis=0)
    length = np.hypot(d[:, 0], d[:, 1])
    normal = np.column_stack([-d[:, 1], d[:, 0]]) / np.where(length == 0, 1, length)[:, None]
    mean = np.vstack([normal[:1], normal[:-1] + normal[1:], normal[-1:]])
    size = np.hypot(mean[:, 0], mean[:, 1])
    mean = mean / np.where(size == 0, 1, size)[:, None] * (width / 2)
    return [tuple(map(float, q)) for q in np.vstack([p + mean, (p - mean)[::-1]])]


def polygons(found: DataFrame, rotations: DataFrame | None = None) -> DataFrame:
    """``(board, layer, feature_no, part_no, rings)`` of features that give copper.

    With ``rotations``, pads take that of the nearest component pin within ``PIN_REACH``, else none; without, their own.
    """
    number = lambda i: F.get("fields", F.lit(i)).try_cast("double")
    drawn = found.filter("kind <> 'S' and symbol.kind is not null")
    key = ["board", "layer", "feature_no"]

    strokes = drawn.filter("kind = 'L' and get(fields, 6) = 'P'").select(*key, *[number(i + 1).alias(c) for i, c in enumerate(("ax", "ay", "bx", "by"))], F.col("symbol.w").alias("w")).dropna().filter("w > 0")
    strokes = strokes.select(*key, F.array(geo.capsule(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("w"))).alias("rings"))

    pads = drawn.filter("kind = 'P' and get(fields, 4) = 'P'").select(*key, number(1).alias("px"), number(2).alias("py"), F.coalesce(number(5), F.lit(0.0)).alias("own"), "symbol").dropna(subset=["px", "py"])
    if rotations is not None:
        pads = pads.withColumn("_id", F.struct(*key))
        cell = lambda c: F.floor(F.col(c) / PIN_REACH)
        around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
        pins = rotations.select(F.col("board").alias("rb"), F.col("x").alias("rx"), F.col("y").alias("ry"), "degrees", cell("x").alias("cx"), cell("y").alias("cy"))
        near = pads.select("_id", "board", "px", "py").withColumn("cx", around("px")).withColumn("cy", around("py")).join(pins.withColumnRenamed("rb", "board"), ["board", "cx", "cy"])
        near = near.withColumn("d", F.round(F.hypot(F.col("px") - F.col("rx"), F.col("py") - F.col("ry")), 9)).filter(F.col("d") < PIN_REACH)
        pads = pads.join(near.groupBy("_id").agg(F.min(F.struct("d", "degrees")).alias("n")).select("_id", "n.degrees"), "_id", "left").drop("_id")
    else:
        pads = pads.withColumn("degrees", F.col("own"))
    pads = pads.select(*key, F.array(geo.symbol_ring(F.col("symbol.kind"), F.col("px"), F.col("py"), F.col("symbol.w"), F.col("symbol.h"), F.col("symbol.r"), F.col("degrees"))).alias("rings"))

    # Surfaces and arcs, whose points depend on the point before, one record at a time.
    nested = found.filter("kind = 'S' or (kind = 'A' and get(fields, 8) = 'P' and symbol.w > 0)").select(*key, "kind", "fields", "body", F.col("symbol.w").alias("w"))

    def build(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out: dict[str, list] = {"board": [], "layer": [], "feature_no": [], "part_no": [], "rings": []}
            for row in batch.to_pylist():
                parts = surface_rings(row["body"])
                if row["kind"] == "A":
                    try:
                        v = [float(x) for x in row["fields"][1:7]]
                        parts = [[stroke(arc((v[0], v[1]), (v[2], v[3]), (v[4], v[5]), len(row["fields"]) > 10 and row["fields"][10].upper() == "Y"), row["w"])]]
                    except (ValueError, IndexError):
                        parts = []
                for no, part in enumerate(parts):
                    for name in ("board", "layer", "feature_no"):
                        out[name].append(row[name])
                    out["part_no"].append(no)
                    out["rings"].append([[{"x": x, "y": y} for x, y in ring] for ring in part])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("board", pa.string()), ("layer", pa.string()), ("feature_no", pa.int64()), ("part_no", pa.int32()), ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))]))

    built = nested.withColumn("feature_no", F.col("feature_no").cast("long")).mapInArrow(build, f"board string, layer string, feature_no long, part_no int, rings {RINGS}")
    flat = strokes.unionByName(pads).select("board", "layer", F.col("feature_no").cast("long").alias("feature_no"), F.lit(0).alias("part_no"), "rings")
    return flat.unionByName(built)


def drills(files: DataFrame) -> DataFrame:
    """``(board, x, y, diameter, is_via)`` of the pads of drill layers; the tool's type tells vias."""
    holes = features(files.filter("lower(path) like '%drill%'")).filter("kind = 'P' and symbol.w is not null")
    number = lambda i: F.get("fields", F.lit(i)).try_cast("double")
    holes = holes.select("board", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), number(1).alias("x"), number(2).alias("y"), F.col("symbol.w").alias("diameter"), F.expr("try_cast(get(fields, 5) as int)").alias("tool_no"))
    return holes.join(tools(files), ["board", "folder", "tool_no"], "left").select("board", "x", "y", "diameter", (F.upper(F.coalesce("type", F.lit(""))) == "VIA").alias("is_via"))


def board_polygons(files: DataFrame) -> DataFrame:
    """All copper and outline polygons of boards with their net, empty where no net names the feature."""
    copper = files.filter("lower(path) not like '%drill%'")
    found = polygons(features(copper), component_rotations(files))
    nets = net_references(files).select("board", F.lower("layer").alias("key"), F.col("feature_no").cast("long").alias("feature_no"), "net")
    return found.withColumn("key", F.lower("layer")).join(nets, ["board", "key", "feature_no"], "left").select("board", "layer", "feature_no", "part_no", F.coalesce("net", F.lit("")).alias("net"), "rings")
