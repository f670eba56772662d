"""Cutting lineage with reliable checkpoints in the folder that all machines share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leaves the session's ``spark.checkpoint.dir`` alone; sets a folder in the warehouse only where Spark runs on one machine."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    spark.sparkContext.setCheckpointDir(os.path.join(warehouse, "_checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows, observed on the way to the folder and not counted by a job of its own."""
    seen = Observation()
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return kept, seen.get["n"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, where all machines see it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/{name}-{uuid.uuid4().hex}"
