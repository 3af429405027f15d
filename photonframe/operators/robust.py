"""Robust statistics per group: a few aggregations joined on the group keys. Groups that may hold a large share of all rows (a channel, a session)
take exact quantiles and ranks from `ranks`, which gathers no group; statistics of one pixel's or one user's samples take them in a window of that group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonframe.operators import ranks

#: MAD to standard deviation, and the standard error of a median (fixed values).
MAD_SCALE, MEDIAN_ERROR = 1.4826, 1.2533


def with_median(df: DataFrame, keys: list[str], value: str, name: str = "med") -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.median(value).alias(name)), keys)


def mad_sigma(df: DataFrame, keys: list[str], value: str, plain: bool | None = None) -> DataFrame:
    """(keys, med, sigma): 1.4826 times the median absolute deviation."""
    plain = ranks.small(df, keys) if plain is None else plain
    centred = ranks.with_quantile(df.select(*keys, value), keys, value, 0.5, "med", plain)
    spread = ranks.quantiles(centred, [*keys, "med"], F.abs(F.col(value) - F.col("med")), {"sigma": 0.5}, plain=plain)
    return spread.select(*keys, "med", (MAD_SCALE * F.col("sigma")).alias("sigma"))


def lower_half_sigma(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, med, sigma) from the values at or below the median; groups with fewer than 16 of them use all values."""
    centred = with_median(df, keys, value).withColumn("__low", F.when(F.col(value) <= F.col("med"), F.col(value)))
    low = centred.groupBy(*keys, "med").agg(F.count("__low").alias("__n"), F.median("__low").alias("__lm"))
    again = centred.join(low.drop("med"), keys)
    deep = F.when(F.col("__n") >= 16, F.when(F.col("__low").isNotNull(), F.abs(F.col(value) - F.col("__lm")))).otherwise(F.abs(F.col(value) - F.col("med")))
    return again.groupBy(*keys, "med").agg((MAD_SCALE * F.median(deep)).alias("sigma"))


def sigma_clip(df: DataFrame, keys: list[str], value: str, low: float = 4.0, high: float = 3.0, passes: int = 3, weight: Column | None = None) -> DataFrame:
    """(keys, n, kept, mean): weighted mean of what stays within median - low sigma and median + high sigma over `passes` rounds.

    Each round aggregates by the keys on the same partitioning, so the frames of a pixel are shuffled once.
    """
    part = Window.partitionBy(*keys)
    df = df.withColumn("__w", F.lit(1.0) if weight is None else weight).withColumn("__in", F.lit(True))
    for _ in range(passes):
        inside = F.when(F.col("__in"), F.col(value))
        df = df.withColumn("__m", F.median(inside).over(part)).withColumn("__s", F.stddev_pop(inside).over(part))
        keep = (F.col(value) >= F.col("__m") - low * F.col("__s")) & (F.col(value) <= F.col("__m") + high * F.col("__s"))
        df = df.withColumn("__in", F.col("__in") & keep)
    inside = F.when(F.col("__in"), F.col("__w"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(inside).alias("kept"), (F.sum(inside * F.col(value)) / F.sum(inside)).alias("mean"))


def winsorized(df: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """(keys, n, mean): values pulled to median +- k sigma before averaging."""
    part = Window.partitionBy(*keys)
    df = df.withColumn("__m", F.median(value).over(part)).withColumn("__s", F.stddev_pop(value).over(part))
    pulled = F.greatest(F.col("__m") - k * F.col("__s"), F.least(F.col("__m") + k * F.col("__s"), F.col(value)))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(pulled).alias("mean"))


def mad_reject(df: DataFrame, keys: list[str], value: str, k: float = 3.0) -> DataFrame:
    """(keys, n, kept, mean) of the values within k MAD sigma of the median (all, where that is 0)."""
    part = Window.partitionBy(*keys)
    df = df.withColumn("__m", F.median(value).over(part))
    df = df.withColumn("__d", F.abs(F.col(value) - F.col("__m"))).withColumn("__s", MAD_SCALE * F.median("__d").over(part))
    inside = F.when((F.col("__s") <= 0) | (F.col("__d") <= k * F.col("__s")), F.col(value))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(inside).alias("kept"), F.avg(inside).alias("mean"))


def weighted_coadd(df: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    """(keys, coadd, variance, covered) by inverse-variance weights; 0, 1 and false where nothing weighs."""
    df = df.withColumn("__v", value).withColumn("__w", F.coalesce(weight, F.lit(0.0)))
    total = F.sum("__w")
    out = df.groupBy(*keys).agg(F.sum(F.col("__w") * F.coalesce("__v", F.lit(0.0))).alias("__wy"), total.alias("__sw"))
    some = F.col("__sw") > 0
    return out.select(*keys, F.when(some, F.col("__wy") / F.col("__sw")).otherwise(0.0).alias("coadd"), F.when(some, 1 / F.col("__sw")).otherwise(1.0).alias("variance"), some.alias("covered"))


def noise_model(df: DataFrame, keys: list[str], level: str, residual: str, bins: int = 24, least: int = 20) -> DataFrame:
    """(keys, a, b, bins): variance = a + b level, fitted over level bins weighted by their counts."""
    plain = ranks.small(df, keys)
    binned = ranks.ranked(df.select(*keys, level, residual), keys, level, residual, name="__rank", total="__all", plain=plain)
    own = [*keys, "__bin"]
    binned = binned.withColumn("__bin", ranks.ntile(F.col("__rank"), F.col("__all"), bins)).drop("__rank", "__all")
    if plain:
        # A bin lies in its group's window, so its medians are windows on the same exchange.
        cells = binned.withColumn("__mr", F.median(residual).over(Window.partitionBy(*own)))
        cells = cells.groupBy(*own).agg(F.count(level).alias("__n"), F.median(level).alias("__x"), F.pow(MAD_SCALE * F.median(F.abs(F.col(residual) - F.col("__mr"))), 2).alias("__y"))
        cells = cells.filter((F.col("__n") >= least) & F.col("__x").isNotNull() & F.col("__y").isNotNull())
    else:
        centred = ranks.with_quantile(binned, own, residual, 0.5, "__mr", plain)
        levels = ranks.quantiles(binned, own, level, {"__x": 0.5}, plain=plain).withColumnRenamed("n", "__n")
        spread = ranks.quantiles(centred, own, F.abs(F.col(residual) - F.col("__mr")), {"__d": 0.5}, plain=plain).select(*own, F.pow(MAD_SCALE * F.col("__d"), 2).alias("__y"))
        cells = ranks.by_group(levels, spread, own).filter(F.col("__n") >= least)
    w = F.col("__n").cast("double")
    sums = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("bins"), F.sum(w).alias("sw"), F.sum(w * F.col("__x")).alias("sx"), F.sum(w * F.col("__y")).alias("sy"), F.sum(w * F.col("__x") * F.col("__x")).alias("sxx"), F.sum(w * F.col("__x") * F.col("__y")).alias("sxy"))
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    b = F.greatest(F.lit(0.0), F.coalesce(slope, F.lit(0.0)))
    return sums.select(*keys, F.greatest(F.lit(1e-12), (F.col("sy") - b * F.col("sx")) / F.col("sw")).alias("a"), b.alias("b"), "bins")


def plateau(df: DataFrame, keys: list[str], value: str, least: int = 20, times: float = 6.0, bins: int = 200) -> DataFrame:
    """(keys, plateau): median around the highest histogram spike of the upper values; null where there is none.

    The spike has at least `least` values and `times` the continuum (median count of the lower half of the bins).
    """
    top = df.filter(F.col(value) > 0).groupBy(*keys).agg(F.max(value).alias("__top"))
    inside = df.join(top, keys).filter((F.col(value) > 0.4 * F.col("__top")) & (F.col(value) <= 1.001 * F.col("__top")))
    inside = inside.withColumn("__bin", F.floor((F.col(value) - 0.4 * F.col("__top")) / (F.col("__top") / bins)).cast("int"))
    counts = inside.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__c"))
    half = int(0.601 * bins) // 2
    filled = counts.filter(F.col("__bin") < half).groupBy(*keys).agg(F.array_sort(F.collect_list("__c")).alias("__l"))
    # Empty bins count as 0, so the median is that of `half` counts.
    at = lambda k: F.when(F.size("__l") >= half - k, F.get("__l", F.lit(k) - (half - F.size("__l")))).otherwise(0)
    continuum = filled.select(*keys, F.greatest(F.lit(1.0), (at((half - 1) // 2) + at(half // 2)) / 2).alias("__k"))
    part = Window.partitionBy(*keys).orderBy("__bin")
    spikes = counts.join(continuum, keys, "left").withColumn("__k", F.coalesce("__k", F.lit(1.0)))
    peak = (F.col("__c") >= least) & (F.col("__c") >= times * F.col("__k"))
    spikes = spikes.withColumn("__up", F.when(F.lead("__bin").over(part) == F.col("__bin") + 1, F.lead("__c").over(part)).otherwise(0)).withColumn("__down", F.when(F.lag("__bin").over(part) == F.col("__bin") - 1, F.lag("__c").over(part)).otherwise(0))
    best = spikes.filter(peak & (F.col("__c") >= F.col("__up")) & (F.col("__c") >= F.col("__down"))).groupBy(*keys).agg(F.max("__bin").alias("__at"))
    near = inside.join(best, keys).filter(F.abs(F.col("__bin") - F.col("__at")) <= 1)
    return df.select(*keys).distinct().join(ranks.quantiles(near, keys, value, {"plateau": 0.5}, plain=ranks.small(df, keys)).drop("n"), keys, "left")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, *order: str) -> DataFrame:
    """(keys, wmedian): the first value at which the running weight reaches half of all."""
    part = Window.partitionBy(*keys)
    run = F.sum(weight).over(part.orderBy(value, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("__run", run).withColumn("__all", F.sum(weight).over(part))
    return df.filter(F.col("__run") >= F.col("__all") / 2).groupBy(*keys).agg(F.min(value).alias("wmedian"))


def moving_average(df: DataFrame, keys: list[str], value: str, half: int, *order: str) -> DataFrame:
    """Rows with `smooth`, the mean of up to `half` rows on both sides; the first of `order` is a number or a time. Windows run over cells of
    consecutive ranks with the neighbours' edges, so no group is sorted as a whole."""
    cells = ranks.neighbours(ranks.ranked(df.withColumn("__at", ranks.number(df, order[0])), keys, "__at", *order[1:], name="__rank", total="__all"), keys, "__rank", half)
    window = Window.partitionBy(*keys, "__cell").orderBy("__rank").rowsBetween(-half, half)
    return cells.withColumn("smooth", F.avg(value).over(window)).filter("__own").drop("__at", "__rank", "__all", "__cell", "__own")


def moving_median(df: DataFrame, keys: list[str], value: str, position: str, half: int) -> DataFrame:
    """(keys, position, value, smooth): median over positions within `half`. Positions are bucketed, so the join is an equi-join."""
    width = 2 * half + 1
    near = df.select(*keys, F.col(position).alias("__p"), F.col(value).alias("__v"), F.explode(F.array(*(F.floor(F.col(position) / width) + d for d in (-1, 0, 1)))).alias("__cell"))
    own = df.select(*keys, position, value).withColumn("__cell", F.floor(F.col(position) / width))
    pairs = own.join(near, [*keys, "__cell"]).filter(F.abs(F.col("__p") - F.col(position)) <= half)
    return pairs.groupBy(*keys, position, value).agg(F.median("__v").alias("smooth"))


def banding(rows: DataFrame, keys: list[str], position: str, profile: str, sigma: str, width: int) -> DataFrame:
    """(keys, ratio, banded): spread of row medians about their 15-row running median over that of white noise."""
    smooth = moving_median(rows, keys, profile, position, 7).join(rows.select(*keys, position, sigma), [*keys, position])
    out = smooth.groupBy(*keys).agg(F.stddev_pop(F.col(profile) - F.col("smooth")).alias("__sd"), F.avg(sigma).alias("__s"), F.count(F.lit(1)).alias("__n"))
    ratio = F.col("__sd") / (MEDIAN_ERROR * F.col("__s") / F.sqrt(F.lit(float(width))))
    return out.select(*keys, ratio.alias("ratio"), (ratio > 1 + 5 / F.sqrt(2.0 * F.col("__n"))).alias("banded"))


def paired_gain(df: DataFrame, keys: list[str], base: Column, trial: Column) -> DataFrame:
    """(keys, tiles, gain, error): half the mean log ratio of paired tiles and its standard error; null below four tiles."""
    d = 0.5 * F.ln(base / trial)
    out = df.groupBy(*keys).agg(F.count(d).alias("tiles"), F.avg(d).alias("__g"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("__e"))
    enough = F.col("tiles") >= 4
    return out.select(*keys, "tiles", F.when(enough, F.col("__g")).alias("gain"), F.when(enough, F.col("__e")).alias("error"))


def shared_ratio(a: DataFrame, b: DataFrame, on: list[str], keys: list[str], value: str) -> DataFrame:
    """(keys, n, median_ratio, slope): ratio of the same sources in two tables, by median and by least squares."""
    both = a.select(*on, F.col(value).alias("__a")).join(b.select(*on, F.col(value).alias("__b")), on)
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(F.col("__b") / F.col("__a")).alias("median_ratio"), (F.sum(F.col("__a") * F.col("__b")) / F.sum(F.col("__a") * F.col("__a"))).alias("slope"))
