"""Access to the tables of a data folder and the cleaning rules they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; timestamps without zone stay as they are."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def known(name: Column | str) -> Column:
    """A net name, or null where it is null or empty and so refers to nothing."""
    return F.nullif(F.col(name) if isinstance(name, str) else name, F.lit(""))


def layer_key(name: Column | str) -> Column:
    """A layer name in the form in which layers compare: lower case without surrounding blanks; blank becomes null."""
    column = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.lower(F.trim(column)), F.lit(""))


def layer_keys(names: Column | str) -> Column:
    """The distinct layer keys of an array of names; null and blank entries are left out."""
    column = F.col(names) if isinstance(names, str) else names
    return F.array_distinct(F.filter(F.transform(column, layer_key), lambda n: n.isNotNull()))


def finite(x: Column | str) -> Column:
    """True where a number is neither null nor NaN nor infinite."""
    column = F.col(x) if isinstance(x, str) else x
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))


def micros(ts: Column | str) -> Column:
    """A timestamp as microseconds, for timestamps with and without zone (session zone UTC)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` partitioned by ``keys`` into as many partitions as the session shuffles to. For grouped functions that
    work long on few bytes: adaptive execution, which only sees the bytes, would put them all into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Bits of the sketch of repeated keys, 2**26: a broadcast of 8 MB at most.
SKETCH_BITS = 1 << 26


def sketch_bit(*columns: str) -> Column:
    """The bit, from 1, that stands for some values in a sketch."""
    return F.pmod(F.xxhash64(*columns), F.lit(SKETCH_BITS)) + 1


def bit_sketch(bits: DataFrame, bit: str) -> DataFrame:
    """The set bits of a column ``bit`` as ``(bucket, bits)``, at most SKETCH_BITS / 8 bytes: for a broadcast."""
    words = bits.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    return words.coalesce(1)


def with_bit(rows: DataFrame, sketch: DataFrame, bit: Column, name: str) -> DataFrame:
    """Adds the boolean ``name``: whether ``bit`` is set in a sketch. False where the bit is null."""
    placed = rows.withColumn("__bucket", F.bitmap_bucket_number(bit)).withColumn("__at", F.bitmap_bit_position(bit))
    met = placed.join(F.broadcast(sketch.toDF("__bucket", "__bits")), "__bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.select(*rows.columns, F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0, F.lit(False)).alias(name))


def once_per_key(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per ``key`` of a table read from files, with ``columns``: the first one in the files. Rows of a null key
    all stay.

    Keys are shuffled once to find those that occur repeatedly, and the place of their first row. A bit sketch of fixed
    size holds the repeated keys: a row whose bit is not set is the only one of its key and stays where it is, however
    wide. Only the others, the repeated ones and a few that share a bit, are joined with the places by key.
    """
    from .staging import Stage

    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    plain = [key, *[c for c in columns if c != key]]
    named = rows.select(*plain, place.alias("__place"))
    places = named.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    repeated = Stage(places.filter("__n > 1").select(F.col(key).alias("__key"), "__first"), "repeated").df
    tested = with_bit(named, bit_sketch(repeated.select(sketch_bit("__key").alias("__bit")), "__bit"), F.when(F.col(key).isNotNull(), sketch_bit(key)), "__doubtful")
    met = tested.filter("__doubtful").select(*plain, "__place").join(repeated, F.col(key) == F.col("__key"), "left")
    first = met.filter("__first is null or __first = __place").select(*plain)
    return tested.filter("not __doubtful").select(*plain).unionByName(first)
