"""Reading and writing observations, maps, patterns and tables of results.

Observations are Parquet in folders by tile and year, so a filter on either reads only its folders; missing
values are null and keep their rows. Paths may be in any store that Spark reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_observations(df: DataFrame, path: str, *, tile: str | None = None, ts: str = "ts", mode: str = "errorifexists") -> None:
    """Write observations in folders by ``tile`` (if given) and year; one task per folder and range of dates writes."""
    by = [*([tile] if tile else []), "year"]
    df.withColumn("year", F.year(ts)).repartition(*by, F.month(ts)).write.mode(mode).partitionBy(*by).parquet(path)


def read_observations(spark: SparkSession, path: str, *, start: str | None = None, end: str | None = None, tiles: list[str] | None = None, tile: str = "tile", ts: str = "ts", nodata: float | None = None, value: str = "value") -> DataFrame:
    """Observations between two dates (both included) and of some tiles; only their folders are read. NaN, infinite and
    ``nodata`` values become null."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col("year") >= int(start[:4])) & (F.col(ts) >= F.lit(start).cast("date")))
    if end is not None:
        df = df.where((F.col("year") <= int(end[:4])) & (F.col(ts) <= F.lit(end).cast("date")))
    if tiles is not None:
        df = df.where(F.col(tile).isin(tiles))
    v = F.col(value)
    gone = F.isnan(v.cast("double")) | (F.abs(v) == float("inf"))
    if nodata is not None:
        gone = gone | (v == nodata)
    return df.withColumn(value, F.when(~gone, v)).drop("year")


def read_maps(spark: SparkSession, paths: str | list[str], *, pattern: str = r"(\d{4}-?\d{2}-?\d{2})", fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """One-date maps (rows of y, x, value), the date ``ts`` taken from each file's name by the first group of ``pattern``;
    files whose name has no date have a null one."""
    reader = spark.read.format(fmt).option("header", True)
    df = (reader.schema(schema) if schema else reader).load(paths)
    digits = F.regexp_replace(F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), pattern, 1), r"\D", "")
    return df.withColumn("ts", F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd")).cast("date"))


def read_patterns(spark: SparkSession, path: str, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Patterns of a CSV with the columns pattern, date and one or more of values."""
    columns = ", ".join(["pattern string", "date date", *[f"`{v}` double" for v in values]])
    return spark.read.schema(columns).csv(path, header=True).withColumnRenamed("date", "ts")


def to_csv(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Each table as a CSV folder below ``folder``; names are made safe for paths. Returns the paths."""
    out = []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{re.sub(r'[^A-Za-z0-9_.-]+', '_', name)}"
        df.write.mode("overwrite").csv(path, header=True)
        out.append(path)
    return out
