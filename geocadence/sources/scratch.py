"""Scratch tables of iterative operators, in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder; executors need one that all of them and the driver share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="scratch-"))
    return _own[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{spark.sparkContext.applicationId}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
