"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; only a local session may lack it."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "/tmp/geostrata-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """df from files of the shared folder: lost executors only repeat reads."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, share: int, *by: str) -> DataFrame:
    """df dealt evenly over tasks of about ``share`` rows, by the columns where there are any; as many tasks as a shuffle has, at most. It counts df: cheap for files and what is cut."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(most, max(1, -(-df.count() // share))), *by)
