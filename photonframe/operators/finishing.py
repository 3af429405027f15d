"""What the finishing of a picture is decided by: black point, highlights, star colour, signal of the object, independent part stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonframe.operators import ranks, robust
from photonframe.sources import shared

# Sigmas below the sky that become black, the share of clipped or white pixels from which highlights are protected,
# the colour that stars should reach and the boosts that may take them there.
SHADOWS, CLIP_LIMIT, STAR_COLOUR, STAR_BOOSTS = 2.8, 0.0005, 0.10, (1.0, 1.5, 2.0)


def black_point(df: DataFrame, keys: list[str], value: str, shadows: float = SHADOWS) -> DataFrame:
    """(keys, med, sigma, black): the level that becomes black, `shadows` sigmas below the median and not below 0."""
    levels = robust.mad_sigma(df, keys, value)
    return levels.select(*keys, "med", "sigma", F.greatest(F.lit(0.0), F.col("med") - shadows * F.col("sigma")).alias("black"))


def star_boost(colour: Column) -> Column:
    """The smallest boost that takes the stars' colour to its aim, else the largest; null for null."""
    out = F.when(colour.isNotNull(), F.lit(STAR_BOOSTS[-1]))
    for boost in reversed(STAR_BOOSTS[:-1]):
        out = F.when(colour * boost >= STAR_COLOUR, F.lit(boost)).otherwise(out)
    return out


def decisions(df: DataFrame, keys: list[str], low: Column, high: Column, colour: Column, limit: float = CLIP_LIMIT) -> DataFrame:
    """(keys, clipped, white, hdr, boost) of pictures whose pixels have a lowest and a highest channel: shares at 0 and at 1, whether
    highlights need protection, and the boost of the stars' mean colour. One aggregation, partial before the shuffle."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    out = df.groupBy(*keys).agg(share(low <= 0).alias("clipped"), share(high >= 1).alias("white"), F.avg(colour).alias("__c"))
    return out.select(*keys, "clipped", "white", ((F.col("clipped") > limit) | (F.col("white") > limit)).alias("hdr"), star_boost(F.col("__c")).alias("boost"))


def object_snr(df: DataFrame, keys: list[str], smooth: str, residual: str, detail: str, star: str, least: int = 500) -> DataFrame:
    """(keys, snr, pixels): the ninetieth percentile of the object's signal over the noise of a pixel.

    `smooth` is the blurred luminance, `residual` that less a wider blur, `detail` the luminance less its blur, `star` marks stars.
    The sky is the median of the lowest 40 %; the object is what stands 3 sigmas of `residual` above it and is no star.
    0 where fewer than `least` pixels do, or where there is no noise. Quantiles are exact and gather no group.
    """
    plain = ranks.small(df, keys)
    noise = robust.mad_sigma(df, keys, detail, plain).select(*keys, F.col("sigma").alias("__noise"))
    spread = ranks.quantiles(df, keys, F.abs(F.col(residual)), {"__spread": 0.5}, plain=plain).drop("n")
    dark = ranks.with_quantile(df, keys, smooth, 0.4, "__p40", plain).filter(F.col(smooth) <= F.col("__p40"))
    sky = ranks.quantiles(dark, keys, smooth, {"__sky": 0.5}, plain=plain).drop("n")
    # One row a group, read by every pass of the last quantile: a table, so that the passes before it run once.
    levels = shared.kept(ranks.by_group(ranks.by_group(sky, spread, keys), noise, keys), "levels")
    over = ranks.by_group(df, levels, keys).filter((F.col(smooth) > F.col("__sky") + 3 * 1.4826 * F.col("__spread")) & ~F.col(star))
    top = ranks.quantiles(over, keys, (F.col(smooth) - F.col("__sky")) / F.nullif(F.col("__noise"), F.lit(0.0)), {"__snr": 0.9}, plain=plain)
    out = ranks.by_group(levels, top, keys, "left").withColumn("pixels", F.coalesce("n", F.lit(0)))
    return out.select(*keys, F.when((F.col("pixels") >= least) & (F.col("__noise") > 0), F.col("__snr")).otherwise(0.0).alias("snr"), "pixels")


def part_stacks(df: DataFrame, keys: list[str], frame: str, value: str, weight: str, parts: int = 2) -> DataFrame:
    """(keys, n0, mean0, n1, mean1, ...): weighted means of the frames whose number leaves each remainder, on one pixel grid, so that
    their noise is independent; a mean is null where its part has no frame. One aggregation for all parts."""
    out = []
    for part in range(parts):
        mine = F.pmod(F.col(frame), F.lit(parts)) == part
        w = F.when(mine & F.col(value).isNotNull(), F.col(weight))
        out += [F.count(w).alias(f"n{part}"), (F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0.0))).alias(f"mean{part}")]
    return df.groupBy(*keys).agg(*out)


def assembled_parameters(parameters: Column) -> Column:
    """The parameters (a map of text) that hold once panels are assembled: those of the assembly go, and a restoration from the frames of
    one stack becomes the automatic one."""
    # The parameters of the assembly, those that name a restoration, and its name.
    gone, methods, by_frames = ("mosaic", "roi_crop_percent", "hypertune"), ("deconv_method", "deconv_stars_method"), "imagemm"
    left = F.map_filter(parameters, lambda k, v: ~k.isin(*gone))
    return F.transform_values(left, lambda k, v: F.when(k.isin(*methods) & (v == by_frames), F.lit("auto")).otherwise(v))
