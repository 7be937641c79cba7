"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A path not used before, under spark.checkpoint.dir; under a new local folder where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not known.isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: worked out once however often it is read, and safe from lost executors. by: columns
    whose values have a folder each."""
    path = new_folder(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
