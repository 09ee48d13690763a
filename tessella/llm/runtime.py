"""Session helpers: where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared checkpoint folder: it survives the loss of executors.

    The folder is the session's spark.checkpoint.dir; only where that is unset (local tests) one is made here.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark))
    return df.checkpoint(eager=True)


def local_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tessella-")
