"""Continuous ingestion of deliveries.

The tables receive most ids once and some again later. ``append_once`` keeps each id once however late it or a repeat
arrives, by looking at the keys written so far; ``first_deliveries`` keeps state for a limited time only. ``shred_stream``
turns arriving responses into flat tables. Both writers have one folder per micro-batch, so a batch that is run again
after a failure replaces its own files and nothing is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.shred import ANALYSIS, parse, shred


def arrivals(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """Rows of parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_deliveries(rows: DataFrame, key: str, arrived: str, lateness: str = "60 days") -> DataFrame:
    """Each ``key`` once; repeats are recognised as long as they arrive within ``lateness``. The state holds keys only.

    A row that is older than the watermark when it comes first is lost: where files are not in order of ``arrived``, as
    in a backfill, use ``append_once``.
    """
    timed = rows.withColumn("_arrived", F.col(arrived).cast("timestamp")).withWatermark("_arrived", lateness)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_arrived")


def arrivals_per_day(rows: DataFrame, arrived: str, lateness: str = "60 days") -> DataFrame:
    """Rows per day of arrival; a day is final once the watermark has passed it."""
    timed = rows.withColumn("_arrived", F.col(arrived).cast("timestamp")).withWatermark("_arrived", lateness)
    return timed.groupBy(F.window("_arrived", "1 day").alias("day")).agg(F.count("*").alias("rows")).select(F.col("day.start").alias("day"), "rows")


def shred_stream(rows: DataFrame, key: str, payload: str, target: str, checkpoint: str, tables: tuple[str, ...] = ("layer", "mesh", "vertex", "triangle")) -> StreamingQuery:
    """Write the flat tables of arriving responses below ``target``, one folder per table and batch."""

    def write(batch: DataFrame, number: int) -> None:
        documents = batch.select(key, parse(payload, "result", "layer_solutions").alias("_response"))
        for name, table in shred(documents, key, "_response", ANALYSIS, "analysis", set(tables)).items():
            table.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(rows: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append to the parquet table ``target`` each ``key`` once, the first that comes; rows of a null key all stay.

    Each batch is compared with the keys written by the other batches, an anti join on the key column alone.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        place = spark._jvm.org.apache.hadoop.fs.Path(target)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        others = [s.getPath().toString() for s in files.listStatus(place)] if files.exists(place) else []
        others = [p for p in others if "/batch=" in p and not p.endswith(f"/batch={number}")]
        if others:
            once = once.join(spark.read.schema(batch.schema).parquet(*others).select(key), key, "left_anti").select(*batch.columns)
        once.unionByName(batch.filter(F.col(key).isNull())).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
