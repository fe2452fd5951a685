"""Percentiles of very large numeric columns from cumulative frequencies.

Values are reduced to counts of (group, value), where a value is first rounded to ``bits`` significant binary digits.
Rounding is monotone, so the p-th value of the rounded numbers is the rounded p-th value: each reported percentile
differs from the exact one by a relative error of at most ``2 ** -bits`` (0.1 % at 10 bits). Rounding uses one product
and two differences, so every engine gives the same bits.

Counts are the partial result: tables of several partitions or days are combined by ``combine`` and can be kept.
Percentiles are read off the counts in one range sort: the counts of a group are partitioned into ranges of values with
fixed borders, each range sums its own counts in order, the sums of the ranges before it are its offset, and the first
value whose cumulative count reaches the rank is the answer. Fixed borders need no sampling pass, and a range of one
group is bounded by the rounding, so no task holds a whole group, hot or not. Sums and offsets of the ranges are known
first; only ranges that hold a rank are sorted. A bit sketch of fixed size tells them before anything is shuffled, and
what it lets through beside them is dropped later, so it never changes a result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import Stage
from ..tables import bit_sketch, sketch_bit, with_bit

BITS = 10
#: List entries a row of a batch may have.
CHUNK = 1024


def _rounded_array(values: np.ndarray, bits: int) -> np.ndarray:
    """To ``bits`` significant binary digits; infinities stay, as do values beyond 2**960."""
    with np.errstate(over="ignore", invalid="ignore"):
        spread = values * float(2 ** (53 - bits) + 1)
        return np.where(np.abs(values) < 2.0**960, spread - (spread - values), values) + 0.0


def _keyed(rows: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """Adds what partitions and orders counts: 96 bits of hash that tell the groups of ``keys`` apart, and the range of
    the value."""
    return rows.select(F.xxhash64(*keys).alias("_h"), F.hash(*keys).alias("_i"), *keys, *more, value_range(F.col("value")).alias("_range"), "value", "n")


def value_counts(rows: DataFrame, keys: list[str], lists: dict[str, str], measure: str = "measure", bits: int = BITS, combined: bool = True) -> DataFrame:
    """The partial result ``(keys, measure, value, n)`` of list columns; ``lists``: measure -> column.

    Null and NaN are left out, infinities count as the outermost values, null and empty lists count nothing. Each
    batch of rows is reduced to counts before it is shuffled, so a value or group that a third of all rows have arrives
    as one row per batch. Lists longer than ``CHUNK`` are cut, so a batch is bounded whatever the lengths are. Without
    ``combined``, a value has a row for each batch that holds it, which ``combine`` and ``percentiles`` take as well.
    """
    if {"value", "n", "level", measure} & set(keys):
        raise ValueError("keys must not be called value, n, level or as the measure")
    chunks = F.greatest(F.lit(0), *[F.expr(f"(coalesce(size(`{c}`), 0) - 1) div {CHUNK}") for c in lists.values()])
    cut = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks.cast("long"))))
    cut = cut.select(*keys, *[F.slice(F.col(c), F.expr(f"cast(_chunk * {CHUNK} + 1 as int)"), CHUNK).alias(f"_l{i}") for i, c in enumerate(lists.values())])
    schema = T.StructType([*cut.select(*keys).schema.fields, T.StructField(measure, T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType())])
    names = list(lists)

    def reduce_batches(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            codes = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                part = pc.dictionary_encode(batch.column(k), null_encoding="encode")
                codes = codes * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False)
            _, first, group = np.unique(codes, return_index=True, return_inverse=True)
            for i, name in enumerate(names):
                column = batch.column(f"_l{i}")
                size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                values = column.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(group, size)
                real = ~np.isnan(values)
                values, owner = _rounded_array(values[real], bits), owner[real]
                order = np.lexsort((values, owner))
                values, owner = values[order], owner[order]
                new = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])][: len(values)])
                taken = pa.array(first[owner[new]])
                columns = [batch.column(k).take(taken) for k in keys]
                n = np.diff(np.r_[new, len(values)])
                yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(new), pa.string()), pa.array(values[new], pa.float64()), pa.array(n, pa.int64())], [*keys, measure, "value", "n"])

    counts = cut.mapInArrow(reduce_batches, schema)
    return combine([counts], [*keys, measure]) if combined else counts


def combine(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One partial result from several; ``keys`` may be fewer than the parts have."""
    every = reduce(lambda a, b: a.unionByName(b), [p.select(*keys, "value", "n") for p in parts])
    return every.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def value_range(value: Column) -> Column:
    """The number of the range that holds ``value``. Ranges are ordered as their values are; each spans a factor of 2,
    so it holds about ``2 ** (bits - 1)`` distinct rounded values."""
    octave = F.floor(F.least(F.log2(F.abs(value)), F.lit(1100.0))) + 1200  # at least 126
    number = F.when(value == 0, 0).when(value > 0, octave).otherwise(-octave).cast("int")
    return F.coalesce(number, F.lit(0))  # never null, for the sake of the planner


def percentiles(counts: DataFrame, keys: list[str], permille: dict[str, int], roll_up: list[str] = ()) -> DataFrame:
    """``(keys, roll_up, level, n, one column per entry of permille)`` from a partial result.

    The p-th percentile of n values is the value of rank ``ceil(p * n)``, at least 1. A null key is a group like any
    other. No counts give no rows. With ``roll_up``, each group of ``keys`` has a row for all its values (``level`` is
    ``all``, the columns of ``roll_up`` null) beside those for each combination of ``roll_up`` (``level`` is ``each``);
    without, ``level`` is ``all``. Both levels are read off one partitioning by ``keys`` and range. ``counts`` are read
    twice, so they should be a table or cheap.
    """
    roll_up = list(roll_up)
    place = ["_h", "_i", "_range"]
    placed = _keyed(counts, keys, roll_up)
    group = ["_h", "_i", "level", *roll_up]
    blank = [F.lit(None).cast(t).alias(k) for k, t in placed.select(*roll_up).dtypes]

    # Sums of the ranges, what lies before each, and those in which a rank lies.
    each = placed.groupBy("_h", "_i", *roll_up, "_range", *keys).agg(F.sum("n").alias("_in_range"))
    sums = each.groupBy("_h", "_i", "_range", *keys).agg(F.sum("_in_range").alias("_in_range")).select(F.lit("all").alias("level"), *blank, *place, *keys, "_in_range")
    if roll_up:
        sums = sums.unionByName(each.withColumn("level", F.lit("each")))
    whole = Window.partitionBy(*group)
    before = F.sum("_in_range").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranks = {name: F.greatest(F.lit(1), F.expr(f"(_total * {p} + 999) div 1000")) for name, p in permille.items()}
    offsets = sums.select(*group, "_range", *keys, "_in_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_in_range").over(whole).alias("_total"))
    hit = F.lit(False)
    for rank in ranks.values():
        hit = hit | ((F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_in_range")))
    offsets = Stage(offsets.filter(hit).drop("_in_range"), "offsets").df

    # Counts of those ranges and their offsets come to one place, counts without their keys. Without value, the offset
    # of a range sorts first. Equal values need no sum: the first of them to reach a rank is that value.
    sketch = bit_sketch(offsets.select(sketch_bit(*place, "level", *roll_up).alias("_bit")), "_bit")
    lines = with_bit(placed.select(*place, *roll_up, "value", "n"), sketch, sketch_bit(*place, F.lit("all"), *blank), "_all")
    lines = with_bit(lines, sketch, sketch_bit(*place, F.lit("each"), *roll_up), "_each") if roll_up else lines.withColumn("_each", F.lit(False))
    none = lambda name: F.lit(None).cast("long").alias(name)
    lines = lines.filter("_all or _each").select(*place, "_all", "_each", *roll_up, "value", "n", none("_before"), none("_total"))
    is_all = (F.col("level") == "all").alias("_all")
    lines = lines.unionByName(offsets.select(*place, is_all, (~is_all).alias("_each"), *roll_up, F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("n"), "_before", "_total"))
    lines = lines.repartition(*place)
    levels = [F.when(F.col("_all"), F.struct(F.lit("all").alias("level"), *blank)), F.when(F.col("_each"), F.struct(F.lit("each").alias("level"), *[F.col(k).alias(k) for k in roll_up]))]
    lines = lines.select(*place, "value", "n", "_before", "_total", F.inline(F.array_compact(F.array(*levels))))
    so_far = Window.partitionBy(*place, "level", *roll_up).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = lines.select(*group, "value", *[f("n" if c == "_running" else c).over(so_far).alias(c) for c, f in (("_running", F.sum), ("_before", F.max), ("_total", F.max))])
    ranked = ranked.filter("value is not null and _total is not null")
    reached = F.col("_running") + F.col("_before")
    firsts = [F.min(F.when(reached >= rank, F.col("value"))).alias(name) for name, rank in ranks.items()]
    picked = ranked.groupBy(*group).agg(F.max("_total").alias("n"), *firsts)
    names = offsets.select("_h", "_i", *keys).distinct()
    return picked.join(names, ["_h", "_i"]).select(*keys, *roll_up, "level", "n", *permille)
