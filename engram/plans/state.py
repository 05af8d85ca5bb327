"""Cutting of lineage between rounds, in the folder that the cluster shares."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only where the session names none and all runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/{uuid.uuid4().hex}-{label}"


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()
