"""Measurement, limit, verdict: gates over pixel tables as one long table of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits by gate (fixed values): least and greatest allowed.
LIMITS = {
    "sky_median": (0.08, 0.12), "clipped": (None, 0.0005), "white": (None, 0.0005), "sky_chroma": (None, 2.0), "quadrants": (None, 1.5), "band_structure": (None, 0.008),
    "pixel_noise": (None, 0.008), "stars_lost": (None, 0.20), "stars_round": (None, 0.25), "stars_coloured": (0.10, None), "stars_physical": (None, 0.10),
}
#: Gates that pass where they could not be measured.
PASS_ON_NULL = ("stars_physical",)


def with_verdicts(values: DataFrame, limits: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Long values (..., gate, value) with `passed` and `distance`, how far outside the limit, relative to it."""
    limits = LIMITS if limits is None else limits
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for gate, (a, b) in limits.items():
        low = F.when(F.col("gate") == gate, F.lit(a).cast("double")).otherwise(low)
        high = F.when(F.col("gate") == gate, F.lit(b).cast("double")).otherwise(high)
    out = values.withColumn("low", low).withColumn("high", high)
    under, over = (F.col("low") - F.col("value")) / F.abs("low"), (F.col("value") - F.col("high")) / F.abs("high")
    distance = F.greatest(F.lit(0.0), F.coalesce(under, F.lit(0.0)), F.coalesce(over, F.lit(0.0)))
    missing = F.col("value").isNull() | F.isnan("value")
    out = out.withColumn("distance", F.when(missing, F.when(F.col("gate").isin(*PASS_ON_NULL), 0.0).otherwise(1.0)).otherwise(distance))
    return out.withColumn("passed", F.col("distance") <= 0)


def summary(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, passed, failed, distance): all gates passed, the names of those that did not, and the sum of distances."""
    return verdicts.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",").alias("failed"), F.sum("distance").alias("distance"))


def measure(pixels: DataFrame, keys: list[str], sky_share: float = 0.45) -> DataFrame:
    """Long gate values of pixels (keys, y, x, lum, top, a, b): the sky is the darkest share of the luminance.

    Quadrants are taken about the middle of each picture. Pictures whose sky has 100 pixels or fewer have no sky values.
    """
    edge = pixels.groupBy(*keys).agg(F.percentile("lum", F.lit(sky_share)).alias("__edge"), (F.max("y") / 2).alias("__my"), (F.max("x") / 2).alias("__mx"))
    df = pixels.join(edge, keys).withColumn("__sky", F.col("lum") <= F.col("__edge"))
    sky = lambda c: F.when(F.col("__sky"), F.col(c))
    whole = df.groupBy(*keys).agg(
        F.count(sky("lum")).alias("__n"), F.median(sky("lum")).alias("sky_median"), F.avg((F.col("top") >= 0.995).cast("int")).alias("clipped"), F.avg((F.col("lum") >= 0.97).cast("int")).alias("white"),
        F.greatest(F.abs(F.median(sky("a"))), F.abs(F.median(sky("b")))).alias("sky_chroma"),
    )
    quarter = df.filter("__sky").groupBy(*keys, (F.col("y") >= F.col("__my")).alias("__qy"), (F.col("x") >= F.col("__mx")).alias("__qx")).agg(F.count(F.lit(1)).alias("__n"), F.median("a").alias("__a"), F.median("b").alias("__b"))
    quarter = quarter.filter("__n > 100").groupBy(*keys).agg(F.greatest(F.max("__a") - F.min("__a"), F.max("__b") - F.min("__b")).alias("quadrants"))
    whole = whole.join(quarter, keys, "left")
    enough = F.col("__n") > 100
    gates = {"sky_median": F.when(enough, F.col("sky_median")), "clipped": F.col("clipped"), "white": F.col("white"), "sky_chroma": F.when(enough, F.col("sky_chroma")), "quadrants": F.when(enough, F.col("quadrants"))}
    rows = F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), v.alias("value")) for g, v in gates.items())))
    return whole.select(*keys, rows.alias("__g")).select(*keys, "__g.gate", "__g.value")
