"""Cut points in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or for a local master without one a temporary folder."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"cut-{spark.sparkContext.applicationId}")
    os.makedirs(made, exist_ok=True)
    return f"file://{made}"


def cut(df: DataFrame, *by: str) -> DataFrame:
    """df, written to the shared folder and read back, so that its lineage ends there; by: columns whose values get folders
    of their own, so that a filter on them reads no others."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
