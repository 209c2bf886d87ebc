"""The folder that driver and executors share, and tables that are cut off from their lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint folder exists, a temporary one is set
    in local mode (tests); on a cluster, whose executors couldn't see it, that is an error.
    """
    context = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return context.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing will read again, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file through Hadoop's file systems, wherever the path lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
