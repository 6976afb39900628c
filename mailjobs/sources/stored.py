"""Intermediate rows in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may leave that unset and gets a temporary
    one; a cluster has to name it, since a machine-local folder goes with its executor."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mailjobs-"))
    return sc._jsc.sc().getCheckpointDir().get()


def computed_once(df: DataFrame) -> DataFrame:
    """The rows, computed now and kept by a reliable checkpoint: what reads them twice finds the same."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
