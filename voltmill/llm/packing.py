"""Filling containers of fixed capacity with items of whole-number sizes.

Only the histogram of sizes decides which sizes share a container, and it has at most ``capacity`` entries whatever
the number of items. So the plan is made on the driver from the histogram, and items are matched to it by their size
and their rank among the items of that size.

Plan. Of the items above a third of the capacity at most two fit one container: from the largest down, each is paired
with the largest remaining one that still fits. Smaller items go, from the largest down, to the containers with the
least sufficient gap (best fit), each taking as many of one size as fit, and to new containers when no gap suffices.
Containers that are alike are planned as one interval of numbers. A size splits at most two intervals, and filling an
interval at least halves its gap, so the plan has fewer than ``12 * 4 * capacity`` entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import staged


#: Columns of the result.
RESULT = ("piece_no", "piece_start", "piece_size", "container_id")


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Entries ``(size, first rank, items, first container, items per container)`` and the number of containers."""
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must be between 1 and the capacity")
    entries: list[tuple[int, int, int, int, int]] = []
    placed = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    used = 0

    def put(size: int, count: int, first: int, each: int) -> None:
        entries.append((size, placed[size], count, first, each))
        placed[size] += count

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((s for s in large if s <= capacity - a and left[s] > (s == a)), 0)
            if not b:
                n = left[a]
                put(a, n, used, 1)
                rest = capacity - a
            elif b == a:
                n = left[a] // 2
                put(a, 2 * n, used, 2)
                rest = capacity - 2 * a
            else:
                n = min(left[a], left[b])
                put(a, n, used, 1)
                put(b, n, used, 1)
                left[b] -= n
                rest = capacity - a - b
            left[a] -= 2 * n if b == a else n
            gaps.setdefault(rest, []).append((used, n))
            used += n

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        need = left[size]
        for gap in sorted(g for g in gaps if g >= size):
            fit = gap // size
            intervals = gaps.pop(gap)
            while intervals and need:
                first, n = intervals.pop()
                full = min(n, need // fit)
                if full:
                    put(size, full * fit, first, fit)
                    gaps.setdefault(gap - fit * size, []).append((first, full))
                    need -= full * fit
                if full < n and need:
                    part = min(need, fit)  # fewer than fit are left
                    put(size, part, first + full, part)
                    gaps.setdefault(gap - part * size, []).append((first + full, 1))
                    need -= part
                    full += 1
                if full < n:
                    intervals.append((first + full, n - full))
            if intervals:
                gaps.setdefault(gap, []).extend(intervals)
            if not need:
                break
        if need:
            fit = capacity // size
            full, part = divmod(need, fit)
            if full:
                put(size, full * fit, used, fit)
                gaps.setdefault(capacity - fit * size, []).append((used, full))
            if part:
                put(size, part, used + full, part)
                gaps.setdefault(capacity - part * size, []).append((used + full, 1))
            used += full + bool(part)
    return entries, used


def pack(items: DataFrame, size: str, capacity: int) -> DataFrame:
    """Assign items to containers: ``items`` with ``piece_no``, ``piece_start``, ``piece_size`` and ``container_id``.

    An item longer than the capacity is split into full pieces and a rest; no other item is split. Containers are
    numbered from 0 without gaps. An item of size 0 or of null or negative size takes no room: one row, with a null
    container. Repeated rows are items of their own, all other columns are kept; columns that bear the name of a result
    column are replaced.

    Ranks among equal sizes come from the items' partitions and offsets between these, so a size that a third of all
    items have is never brought into one task. Which of several items of equal size goes where follows the layout of the
    files and their partitions; container sizes and their number do not.
    """
    names = [c for c in items.columns if c not in RESULT]
    items = items.select(*names, F.col(size).alias("_size"))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.expr(f"(coalesce(_size, 0) - 1) div {capacity}")).cast("long"))
    cut = items.withColumn("piece_no", F.explode(pieces)).withColumn("piece_start", F.col("piece_no") * capacity)
    cut = cut.withColumn("piece_size", F.greatest(F.lit(0), F.least(F.lit(capacity), F.coalesce("_size", F.lit(0)) - F.col("piece_start"))).cast("int"))
    cut = staged(cut.withColumn("_part", F.spark_partition_id()).withColumn("_order", F.monotonically_increasing_id()), "items")

    per_part = cut.filter("piece_size > 0").groupBy("piece_size", "_part").agg(F.count("*").alias("_n"))
    histogram = {r["piece_size"]: r["n"] for r in per_part.groupBy("piece_size").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    entries, used = plan_containers(histogram, capacity)
    plan = np.array(sorted(entries), np.int64).reshape(-1, 5)
    shared = items.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity alone

    earlier = Window.partitionBy("piece_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("piece_size", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    in_part = F.row_number().over(Window.partitionBy("piece_size", "_part").orderBy("_order")) - 1
    ranked = cut.filter("piece_size > 0").withColumn("_rank", in_part).join(offsets, ["piece_size", "_part"])
    ranked = ranked.select(*names, "piece_no", "piece_start", "piece_size", (F.col("_rank") + F.col("_offset")).cast("long").alias("_rank"))
    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("container_id", T.LongType())])

    def look_up(batches):  # noqa: ANN001, ANN202
        table = shared.value
        # Sizes and ranks in one ascending number; ranks stay far below 2**50.
        keys = table[:, 0] * 2**50 + table[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, batch.column("piece_size").to_numpy().astype(np.int64) * 2**50 + rank, side="right") - 1
            container = table[at, 3] + (rank - table[at, 1]) // table[at, 4] if len(rank) else rank
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(container, pa.int64())], [*batch.schema.names[:-1], "container_id"])

    placed = ranked.mapInArrow(look_up, schema)
    empty = cut.filter("piece_size = 0").select(*names, "piece_no", "piece_start", "piece_size", F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(empty)
