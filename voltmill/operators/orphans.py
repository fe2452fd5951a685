"""References to records that do not exist at the time of the reference.

Parents live for intervals ``[start, end)`` of an integer axis (microseconds, or plain keys). They are sorted and
compressed into contiguous runs; every reference is matched as-of to the runs that start at or before it and is
reported when it lies beyond the end of all of them.

Scale. The axis is cut into slices, and all sorting happens per (key, slice), so a key that holds a third of all rows
is spread over its slices. What earlier slices leave open is carried as one number per (key, slice). A (key, slice)
that still holds more than ``hot_rows`` references is salted: its references are spread over salts, its few runs are
copied to each. The list of salted groups is a written table: joins with it are broadcasts while it is below Spark's
threshold and shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Stage

#: Ninety days in microseconds.
SLICE = 90 * 86_400_000_000
_FOREVER = 2**63 - 1


def contiguous_runs(parents: DataFrame, keys: list[str], start: str, end: str, within: list[str] = ()) -> DataFrame:
    """Merge overlapping or touching intervals per key (and ``within``) into runs ``(keys, within, run_start, run_end)``.

    A null ``end`` never ends. A null ``start`` and an interval that ends before or when it starts are nothing.
    """
    by = [*keys, *within]
    rows = parents.select(*by, F.col(start).alias("_s"), F.coalesce(F.col(end), F.lit(_FOREVER)).alias("_e")).filter("_e > _s")
    order = Window.partitionBy(*by).orderBy("_s", "_e")
    before = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.when(F.col("_s") <= before, 0).otherwise(1))
    numbered = opened.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_run").agg(F.min("_s").alias("run_start"), F.max("_e").alias("run_end")).drop("_run")


def orphans(refs: DataFrame, parents: DataFrame, keys: list[str], at: str, start: str, end: str, slice_width: int = SLICE, hot_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``refs`` for which no parent with equal ``keys`` is alive at ``at``; all columns of ``refs`` are kept.

    ``at``, ``start`` and ``end`` are long columns. A parent is alive from ``start`` (included) to ``end`` (excluded,
    null = for ever). A null key or a null ``at`` in a reference finds no parent, so the reference is reported.
    Plain integer keys are the case ``[k, k + 1)`` with ``keys=[]``. Repeated rows stay repeated. Columns of ``parents`` other than the named ones are ignored, and columns of ``refs``
    may bear any name that does not start with two underscores.
    """
    names = refs.columns
    sliced = refs.withColumn("__slice", F.expr(f"floor(`{at}` / {slice_width})").cast("long"))
    complete = F.lit(True)
    for column in [*keys, at]:
        complete = complete & F.col(column).isNotNull()
    loose = sliced.filter(~complete).select(*names)
    tied = sliced.filter(complete)

    born = parents.select(*[F.col(k) for k in keys], F.col(start).alias("__s"), F.col(end).alias("__e")).dropna(subset=[*keys, "__s"])
    born = born.withColumn("__slice", F.expr(f"floor(__s / {slice_width})").cast("long"))
    runs = contiguous_runs(born, keys, "__s", "__e", ["__slice"])

    # What each slice inherits from the slices before it, and how many references it has.
    by = [*keys, "__slice"]
    parts = runs.groupBy(*by).agg(F.max("run_end").alias("__end"), F.lit(0).cast("long").alias("__n"))
    parts = parts.unionByName(tied.groupBy(*by).agg(F.lit(None).cast("long").alias("__end"), F.count("*").alias("__n")))
    parts = Stage(parts.groupBy(*by).agg(F.max("__end").alias("__end"), F.sum("__n").alias("__n")), "slices").df
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*by, F.max("__end").over(earlier).alias("__end"))

    hot = Stage(parts.filter(F.col("__n") > hot_rows).select(*by, F.expr(f"cast(ceil(__n / {hot_rows}) as int)").alias("__salts")), "hot").df

    facts = runs.select(*by, F.col("run_start").alias("__t"), F.col("run_end").alias("__end"))
    facts = facts.unionByName(carried.filter("__end is not null").withColumn("__t", F.lit(-(2**63)).cast("long")))
    facts = facts.join(hot, by, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    facts = facts.withColumn("__ref", F.lit(0))

    digest = F.xxhash64(*[F.col(f"`{n}`").cast("string") for n in names])
    spread = F.when(F.col("__salts").isNotNull(), F.pmod(digest, F.col("__salts"))).otherwise(0).cast("int")
    asked = tied.join(hot, by, "left").withColumn("__salt", spread).drop("__salts")
    asked = asked.withColumn("__t", F.col(at)).withColumn("__ref", F.lit(1)).withColumn("__end", F.lit(None).cast("long"))
    lined = asked.unionByName(facts, allowMissingColumns=True)
    so_far = Window.partitionBy(*by, "__salt").orderBy("__t", "__ref").rowsBetween(Window.unboundedPreceding, 0)
    matched = lined.withColumn("__until", F.max("__end").over(so_far)).filter("__ref = 1")
    gone = matched.filter(F.col("__until").isNull() | (F.col("__until") <= F.col("__t")))
    return gone.select(*names).unionByName(loose)
