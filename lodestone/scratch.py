"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` where the cluster names one.
    Where it is unset, a local temporary folder in local mode (one machine, one process), else an
    error: executors of a cluster do not see the driver's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/lodestone-scratch"
    return f"{base.rstrip('/')}/lodestone/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` (with options of the writer) as Parquet in the shared folder and read it again. Lineage ends there, so a
    lost executor costs a re-read, not a recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
