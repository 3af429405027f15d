"""The driver's tables in the roles that the queries give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: the type is the group, the value the width, the header's k the star count."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("frame_id"), F.col("event_type").alias("grp"), "user_id", F.col("ts").cast("timestamp").alias("ts"), k.alias("nbstars"), F.col("value").alias("fwhm"),
        F.when(F.col("event_id") % 17 != 0, F.col("value") * 1.25).alias("wfwhm"), (1 - F.col("value") / 1000).alias("roundness"), (F.col("event_id") % 11 != 0).alias("registered"),
    )


FRAMES_SQL = """frames AS (
  SELECT event_id AS frame_id, event_type AS grp, user_id, ts, CAST(json_extract_string(props, '$.k') AS INT) AS nbstars, value AS fwhm,
         CASE WHEN event_id % 17 <> 0 THEN value * 1.25 END AS wfwhm, 1 - value / 1000 AS roundness, event_id % 11 <> 0 AS registered
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixel samples: the order is the pixel, the part and line the frame."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("px"), F.col("l_linenumber").alias("frame"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"), F.col("l_suppkey").alias("ch"), "l_discount", "l_tax", "l_partkey", "l_returnflag")


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as colours in 0 to 1."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 110000).alias("r"), (F.col("l_quantity") / 50).alias("g"), (F.col("l_discount") * 10).alias("b"))


RGB_SQL = "rgb AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 110000 AS r, l_quantity / 50 AS g, l_discount * 10 AS b FROM lineitem)"
