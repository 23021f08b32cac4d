"""Cutting the lineage of loops so that it survives the loss of executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; a local one is set only where none is, as in tests."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            import tempfile

            where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(where)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
