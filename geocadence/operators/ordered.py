"""Global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geocadence.sources.scratch import checkpointed


def in_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in ranges of ``order`` (ascending, nulls first), each with its block's number ``_b``; written, so the ranges
    are the same for every later reader."""
    return checkpointed(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add the row's place in the order, from 0, and the number of rows ``_m``; the ranges' sizes, one row a range, are
    all that meets in one task. The column ``_b`` of ``in_blocks`` stays."""
    blocked = in_blocks(df, order)
    sizes = blocked.groupBy("_b").agg(F.count("*").alias("_n"))
    bases = sizes.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_base"), F.sum("_n").over(W.partitionBy()).alias("_m"))
    place = F.row_number().over(W.partitionBy("_b").orderBy(*order)) - 1 + F.col("_base")
    return blocked.join(F.broadcast(bases), "_b").withColumn(out, place).drop("_base")
