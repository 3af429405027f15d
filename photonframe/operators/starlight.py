"""Conservation of star light: pixel values changed as little as possible, in proportion, so that every star has the light it should have.

Footprints overlap, so stars and pixels are a sparse system: a star's light is the sum of its shares of pixels. Iterative proportional fitting
multiplies every pixel by its stars' ratios of wanted to present light, each to the power of the star's share, until all ratios are 1. A round
is one join of the sparse entries with the stars' factors, one aggregation by pixel and one by star; neither a star's pixels nor an
image's stars meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonframe.sources import shared


def footprints(stars: DataFrame, keys: list[str], reach: int, sigma: float) -> DataFrame:
    """(keys, star_id, y, x, share): the pixels within `reach` of stars (keys, star_id, y, x; whole pixels), each shared among the stars that cover it
    by Gaussian weights of the distance; a pixel's shares sum to 1."""
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if dy * dy + dx * dx <= reach * reach))
    each = stars.select(*keys, "star_id", "y", "x", F.explode(offsets).alias("o"))
    weight = F.exp(-(F.col("o.dy") * F.col("o.dy") + F.col("o.dx") * F.col("o.dx")) / (2.0 * sigma * sigma))
    each = each.select(*keys, "star_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), weight.alias("__w"))
    total = each.groupBy(*keys, "y", "x").agg(F.sum("__w").alias("__s"))
    return each.join(total, [*keys, "y", "x"]).select(*keys, "star_id", "y", "x", (F.col("__w") / F.col("__s")).alias("share"))


def conserved(pixels: DataFrame, prints: DataFrame, wanted: DataFrame, keys: list[str], tolerance: float = 1e-7, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """Pixels (keys, y, x, v: light above the sky) with the fitted `v`, and (keys, star_id, wanted, light, pixels, rounds) of every star: `light` is within
    `tolerance` of `wanted` (keys, star_id, wanted), relatively, unless the demands contradict each other or `rounds` are over. Stars without
    light in the pixels, or without a positive demand, keep what they have; pixels without a star, or not positive, stay."""
    lit = pixels.filter("v > 0").select(*keys, "y", "x", "v")
    entries = shared.kept(prints.join(lit, [*keys, "y", "x"]).join(wanted.filter("wanted > 0").select(*keys, "star_id"), [*keys, "star_id"], "left_semi"), "entries")
    names = [*keys, "star_id"]
    factors = shared.kept(entries.groupBy(*names).agg(F.sum(F.col("share") * F.col("v")).alias("light"), F.count(F.lit(1)).alias("pixels"), F.lit(0.0).alias("log")).join(wanted.select(*names, "wanted"), names).filter("light > 0"), "factors")
    worst, done = None, 0
    for done in range(1, rounds + 1):
        # The log of a star's factor grows by that of its ratio; a pixel's factor is the product of its stars'.
        factors = factors.withColumn("log", F.col("log") + F.log(F.col("wanted") / F.col("light"))).drop("light")
        light = _light(entries, factors, keys).groupBy(*names).agg(F.sum(F.col("share") * F.col("v")).alias("light"))
        factors = shared.kept(factors.join(light, names), "factors")
        worst = factors.agg(F.max(F.abs(F.col("light") / F.col("wanted") - 1))).first()[0]
        if worst is None or worst <= tolerance:
            break
    fitted = _light(entries, factors, keys).groupBy(*keys, "y", "x").agg(F.max("v").alias("__v"))
    out = pixels.join(fitted, [*keys, "y", "x"], "left").withColumn("v", F.coalesce("__v", "v")).drop("__v")
    return out, factors.select(*names, "wanted", "light", "pixels", F.lit(done).alias("rounds"))


def _light(entries: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """Entries (keys, y, x, star_id, share) with the pixel's value after all its stars' factors. A pixel's stars are few, so they are one row."""
    met = entries.join(factors.select(*keys, "star_id", "log"), [*keys, "star_id"], "left").withColumn("log", F.coalesce("log", F.lit(0.0)))
    by_pixel = met.groupBy(*keys, "y", "x", "v").agg(F.sum(F.col("share") * F.col("log")).alias("__l"), F.collect_list(F.struct("star_id", "share")).alias("__e"))
    return by_pixel.select(*keys, "y", "x", (F.col("v") * F.exp("__l")).alias("v"), F.explode("__e").alias("__e")).select(*keys, "y", "x", "v", "__e.star_id", "__e.share")
