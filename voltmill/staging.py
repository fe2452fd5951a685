"""Intermediate tables in the folder all executors share.

Iterative operators cut their lineage by writing a parquet table and reading it back. The folder comes from the
session's ``spark.checkpoint.dir``; only where that is unset and the master is local (as in a test) a temporary one is
used, on a cluster its absence is an error. A written table survives the loss of any executor. A superseded one can be
deleted at once, all others are deleted when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        base = spark.sparkContext.getCheckpointDir() or ""
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="voltmill-"))
    return base.rstrip("/")


class Stage:
    """One intermediate table: written on construction, read through ``df``.

    ``watched`` are aggregates by name; their values over all rows are in ``seen``, taken while the table is written.
    As the size of the files is known, a join with ``df`` is planned as a broadcast below Spark's threshold only.
    """

    def __init__(self, df: DataFrame, name: str = "stage", watched: dict[str, Column] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/voltmill/{name}-{uuid.uuid4().hex}"
        self.seen: dict[str, object] = {}
        if watched:
            observation = Observation()
            df.observe(observation, *[c.alias(n) for n, c in watched.items()]).write.parquet(self.path)
            self.seen = observation.get
        else:
            df.write.parquet(self.path)
        self._files().deleteOnExit(self._place())  # of what exists only
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def _place(self):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path)

    def _files(self):  # noqa: ANN202
        return self._place().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self) -> None:
        """Delete the files; the caller knows that nothing reads them any more."""
        self._files().delete(self._place(), True)
        self._files().cancelDeleteOnExit(self._place())


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Stage(df, name).df


def counted(df: DataFrame, name: str = "stage") -> DataFrame:
    """``staged``, where rows may be far larger than the files that hold them, as equal values are written once: if the
    rows themselves are beyond Spark's threshold for broadcasts, joins with the table are sort-merge joins."""
    stage = Stage(df, name, {"rows": F.count(F.lit(1))})
    return guarded(stage, stage.seen["rows"] or 0)


def guarded(stage: Stage, rows: int) -> DataFrame:
    """What a stage of so many rows has, as ``counted`` gives it."""
    threshold = stage.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return stage.df.hint("merge") if rows * stage.df._jdf.schema().defaultSize() > threshold else stage.df
