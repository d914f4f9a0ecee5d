"""Cutting a plan's lineage, where it would otherwise repeat whole subplans many times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors can read and write.

    Where it is unset, a temporary one serves a session in one process; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder of spark.checkpoint.dir and read from there.

    With spark.cleaner.referenceTracking.cleanCheckpoints Spark removes it once nothing refers to it any more.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a few columns that any executor can hold: about a hundred bytes each.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """df, written once, and broadcast where it is joined if it has at most FEW rows; else the join is Spark's choice."""
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(FEW + 1).count() <= FEW else kept
