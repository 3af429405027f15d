"""Picture statistics against references: conditional levels, scores with one-sided limits, a soft minimum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_terms(stats: DataFrame, looks: DataFrame, on: list[str], tolerance: Column, weight: Column, logarithmic: Column) -> DataFrame:
    """Long statistics (on..., stat, v) against long references (ref, stat, r): (on..., ref, score), the weighted squared deviations."""
    both = stats.join(looks, "stat")
    gap = F.when(logarithmic, F.ln(F.col("v") / F.col("r"))).otherwise(F.col("v") - F.col("r")) / tolerance
    return both.groupBy(*on, "ref").agg(F.sum(weight * gap * gap).alias("score"))


def soft_min(scores: DataFrame, keys: list[str], value: str, temperature: float = 2.0) -> DataFrame:
    """(keys, soft): min - T ln mean exp(-(v - min) / T), the value that many good references share."""
    least = scores.groupBy(*keys).agg(F.min(value).alias("__m"))
    mean = F.avg(F.exp(-(F.col(value) - F.col("__m")) / temperature))
    out = scores.join(least, keys).groupBy(*keys, "__m").agg(mean.alias("__e"))
    return out.select(*keys, (F.col("__m") - temperature * F.ln("__e")).alias("soft"))


def typical(stats: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, typical, spread): median over references and its MAD."""
    centred = stats.join(stats.groupBy(*keys).agg(F.median(value).alias("typical")), keys)
    return centred.groupBy(*keys, "typical").agg(F.median(F.abs(F.col(value) - F.col("typical"))).alias("spread"))


def sector_means(pixels: DataFrame, keys: list[str], hue: Column, weight: Column, sectors: int = 6) -> DataFrame:
    """(keys, sector, weight, hue): circular mean of hue in each sector."""
    df = pixels.withColumn("sector", F.floor(F.pmod(hue, F.lit(360.0)) / (360 / sectors)).cast("int")).withColumn("__h", F.radians(hue)).withColumn("__w", weight)
    out = df.groupBy(*keys, "sector").agg(F.sum("__w").alias("weight"), F.sum(F.col("__w") * F.cos("__h")).alias("__c"), F.sum(F.col("__w") * F.sin("__h")).alias("__s"))
    return out.select(*keys, "sector", "weight", F.pmod(F.degrees(F.atan2("__s", "__c")), F.lit(360.0)).alias("hue"))
