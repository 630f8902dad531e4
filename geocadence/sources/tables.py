"""Relations that stand for cubes: observations, wide bands, annual series, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel_id, ts (date), at (timestamp), seq, band, value (null = missing), qa."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("pixel_id"), F.to_date("ts").alias("ts"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("band"),
        F.when((F.col("event_type") != "error") & ~F.isnan("value"), F.col("value")).alias("value"), F.get_json_object("props", "$.k").cast("int").alias("qa"),
    )


OBS_SQL = """obs AS (SELECT user_id AS pixel_id, CAST(ts AS DATE) AS ts, ts AS at, event_id AS seq, event_type AS band,
  CASE WHEN event_type <> 'error' THEN value END AS value, CAST(json_extract(props, '$.k') AS INTEGER) AS qa FROM events)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel_id, seq, ts and six bands in reflectance."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_suppkey").alias("pixel_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.to_date("l_shipdate").alias("ts"),
        (F.col("l_tax") + 0.02).alias("blue"), (F.col("l_discount") + 0.03).alias("green"), (F.col("l_quantity") / 250).alias("red"),
        (F.col("l_extendedprice") / 100000).alias("nir"), (F.col("l_quantity") / 100).alias("swir1"), (F.col("l_discount") * 2 + 0.05).alias("swir2"),
    )


WIDE_SQL = """wide AS (SELECT l_suppkey AS pixel_id, l_orderkey * 10 + l_linenumber AS seq, CAST(l_shipdate AS DATE) AS ts,
  l_tax + 0.02 AS blue, l_discount + 0.03 AS green, l_quantity / 250 AS red,
  l_extendedprice / 100000 AS nir, l_quantity / 100 AS swir1, l_discount * 2 + 0.05 AS swir2 FROM lineitem)"""


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel_id, year, value: root of the mean price of a supplier and year; a few are missing."""
    x = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pixel_id"), F.year("l_shipdate").alias("year"))
    # a square root keeps sums and halves off the rounding points of a comparison
    value = F.sqrt(F.round(F.sum("l_extendedprice"), 2) / F.count("l_extendedprice"))
    return x.agg(value.alias("v")).select("pixel_id", "year", F.when((F.col("pixel_id") * 7 + F.col("year")) % 23 != 0, F.col("v")).alias("value"))


ANNUAL_SQL = """annual AS (SELECT pixel_id, year, CASE WHEN (pixel_id * 7 + year) % 23 <> 0 THEN v END AS value FROM (
  SELECT l_suppkey AS pixel_id, CAST(year(l_shipdate) AS INTEGER) AS year, sqrt(round(sum(l_extendedprice), 2) / count(l_extendedprice)) AS v FROM lineitem GROUP BY ALL))"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel_id, month (first day), value: root of the mean price of a supplier and month."""
    x = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pixel_id"), F.trunc("l_shipdate", "MM").alias("month"))
    return x.agg(F.sqrt(F.round(F.sum("l_extendedprice"), 2) / F.count("l_extendedprice")).alias("value"))


MONTHLY_SQL = """monthly AS (SELECT l_suppkey AS pixel_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
  sqrt(round(sum(l_extendedprice), 2) / count(l_extendedprice)) AS value FROM lineitem GROUP BY ALL)"""


def grid(spark: SparkSession, sf_dir: str, width: int = 50) -> DataFrame:
    """y, x, value, class, zone of a map made from parts."""
    p = read(spark, sf_dir, "part")
    y, x = F.floor(F.col("p_partkey") / width).cast("int"), (F.col("p_partkey") % width).cast("int")
    return p.select(y.alias("y"), x.alias("x"), F.col("p_retailprice").alias("value"), (F.col("p_size") % 5).cast("int").alias("class"), (F.col("p_partkey") % 7).cast("int").alias("zone"), F.col("p_size").alias("size"))


GRID_SQL = """grid AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS y, CAST(p_partkey % 50 AS INTEGER) AS x, p_retailprice AS value,
  CAST(p_size % 5 AS INTEGER) AS class, CAST(p_partkey % 7 AS INTEGER) AS zone, p_size AS size FROM part)"""


def sql(*parts: str, select: str) -> str:
    """A statement from common table expressions and a final SELECT."""
    return "WITH " + ",\n".join(parts) + "\n" + select
