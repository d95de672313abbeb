"""Tables that a job writes on its way, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine if the session runs on it alone."""
    if named := spark.conf.get("spark.checkpoint.dir", ""):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="siftline-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: what is used several times is computed once, and a lost executor costs its own tasks."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
