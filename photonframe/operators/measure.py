"""Measurements over pixels and sources: stamps, ring profiles, radii, truth comparisons, defects, trails, fitted parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonframe.operators import ranks
from photonframe.operators.robust import MAD_SCALE


def frame_groups(frames: DataFrame, scope: list[str], ratio: float = 2.0, least: int = 3) -> DataFrame:
    """Groups of frames (object, filter, exptime, gain, width, height, binning, bayer) per scope with their role: main (most exposure, then
    frames), hdr (same object, filter, size and bayer, exposure at least `ratio` apart, enough frames) or other, with the reason."""
    key = ["object", "filter", "exposure", "gain1", "w", "h", "bayer"]
    df = frames.select(*scope, F.coalesce("object", F.lit("")).alias("object"), F.coalesce("filter", F.lit("")).alias("filter"), F.round("exptime", 2).alias("exposure"), F.round("gain", 1).alias("gain1"), (F.col("width") * F.col("binning")).alias("w"), (F.col("height") * F.col("binning")).alias("h"), F.coalesce("bayer", F.lit("")).alias("bayer"), "exptime")
    groups = df.groupBy(*scope, *key).agg(F.sum("exptime").alias("total"), F.count(F.lit(1)).alias("frames"))
    part = Window.partitionBy(*scope).orderBy(F.desc("total"), F.desc("frames"), *key)
    same = ["object", "filter", "w", "h", "bayer"]
    groups = groups.withColumn("__r", F.row_number().over(part)).withColumn("__m", F.first(F.struct(*same, "exposure")).over(part))
    alike = F.lit(True)
    for c in same:
        alike = alike & (F.col(c) == F.col(f"__m.{c}"))
    apart = F.greatest("exposure", F.col("__m.exposure")) / F.least("exposure", F.col("__m.exposure")) >= ratio
    role = F.when(F.col("__r") == 1, "main").when(alike & apart & (F.col("frames") >= least), "hdr").otherwise("other")
    reason = F.when((role == "other") & alike & apart, "too few frames")
    return groups.withColumn("role", role).withColumn("reason", reason).drop("__r", "__m")


def stamps(stars: DataFrame, pixels: DataFrame, half: int, cell: int, keep: tuple[str, ...] = ("star_id",), values: tuple[str, ...] = ("v",)) -> DataFrame:
    """(keep, dy, dx, values): pixels (y, x, values) within `half` of stars (keep, y, x). An equi-join on cells of at least `half` pixels; a star
    is repeated for the cells that its box touches."""
    low = lambda c: F.floor((F.col(c) - half) / cell).cast("long")
    high = lambda c: F.floor((F.col(c) + half) / cell).cast("long")
    s = stars.select(*keep, F.col("y").alias("sy"), F.col("x").alias("sx"), F.explode(F.sequence(low("y"), high("y"))).alias("cy"), F.sequence(low("x"), high("x")).alias("__cx"))
    s = s.select(*keep, "sy", "sx", "cy", F.explode("__cx").alias("cx"))
    p = pixels.withColumn("cy", F.floor(F.col("y") / cell).cast("long")).withColumn("cx", F.floor(F.col("x") / cell).cast("long"))
    box = (F.abs(F.col("y") - F.col("sy")) <= half) & (F.abs(F.col("x") - F.col("sx")) <= half)
    return s.join(p, ["cy", "cx"]).filter(box).select(*keep, (F.col("y") - F.col("sy")).alias("dy"), (F.col("x") - F.col("sx")).alias("dx"), *values)


#: What tells the sites of `sites` apart, each of which may be null.
SITE = ("__y", "__x", "__id")


def sites(stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(SITE, y, x, times) and (star_id, SITE): stars of one place see the same pixels, so they are one site, which is measured once. A star
    with several places is a site of its own; a place counts as often as the star has it. Stars without a place have no site."""
    placed = stars.filter("y is not null and x is not null").select("star_id", "y", "x")
    known = placed.groupBy("star_id").agg(F.count(F.lit(1)).alias("__n"), F.min("y").alias("y"), F.min("x").alias("x"))
    one, none = F.col("__n") == 1, F.lit(None)
    of = known.select("star_id", F.when(one, F.col("y")).alias("__y"), F.when(one, F.col("x")).alias("__x"), F.when(~one, F.col("star_id")).alias("__id"))
    single = known.filter(one).select("y", "x").distinct()
    kind = stars.schema["star_id"].dataType
    single = single.select(F.col("y").alias("__y"), F.col("x").alias("__x"), none.cast(kind).alias("__id"), "y", "x", F.lit(1).cast("long").alias("times"))
    several = ranks.by_group(placed, known.filter(~one).select("star_id"), ["star_id"]).groupBy("star_id", "y", "x").agg(F.count(F.lit(1)).alias("times"))
    several = several.select(*(none.cast(stars.schema[c].dataType).alias(f"__{c}") for c in "yx"), F.col("star_id").alias("__id"), "y", "x", "times")
    return single.unionByName(several), of


def counted(pixels: DataFrame, *values: str) -> DataFrame:
    """(y, x, values, n): how often each value occurs at a place."""
    return pixels.filter("y is not null and x is not null").groupBy("y", "x", *values).agg(F.count(F.lit(1)).alias("n"))


def aperture_flux(stars: DataFrame, pixels: DataFrame, half: int, cell: int, radius: float, inner: float, outer: float) -> DataFrame:
    """(star_id, flux, sky) of stars (star_id, y, x) with pixels (y, x, v) within `half`: light within a radius above the median of a ring.

    The work grows with the distinct places of stars times the distinct values near them, not with stars times pixels."""
    at, of = sites(stars)
    r2 = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    cut = stamps(at, counted(pixels, "v"), half, cell, (*SITE, "times"), ("v", "n"))
    cut = cut.groupBy(*SITE, "v", (r2 <= radius**2).alias("__core"), ((r2 >= inner**2) & (r2 <= outer**2)).alias("__ring")).agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    lit = F.col("__core") & F.col("v").isNotNull()
    sky = F.percentile(F.when(F.col("__ring"), F.col("v")), F.lit(0.5), F.col("n"))
    out = cut.groupBy(*SITE).agg(F.sum(F.when(lit, F.col("v") * F.col("n"))).alias("__s"), F.sum(F.when(lit, F.col("n")).otherwise(0)).alias("__n"), sky.alias("sky"))
    out = out.select(*SITE, (F.col("__s") - F.col("__n") * F.coalesce("sky", F.lit(0.0))).alias("flux"), "sky")
    return ranks.by_group(of, out, list(SITE)).select("star_id", "flux", "sky")


def centroid_offsets(cut: DataFrame, sigma: float = 3.0, saturation: float | None = None) -> DataFrame:
    """(star_id, n, dy, dx): how far stars lie in an image from where they lie in the reference. The stamps' v is a struct (a: reference, b: image);
    centroids are weighted by a Gaussian, above the stamp's median. Stars without light in either, or saturated in either, are left out."""
    once = F.lit(1).cast("long")
    light, values = cut.groupBy("star_id", "dy", "dx").agg(*_light()), _values(cut, "star_id").withColumn("n", once)
    return _offsets(light.withColumn("times", once), values.withColumn("times", once), ["star_id"], sigma, saturation)


def field_offsets(stars: DataFrame, pixels: DataFrame, half: int, cell: int, sigma: float = 3.0, saturation: float | None = None) -> DataFrame:
    """`centroid_offsets` of stars (star_id, y, x) with pixels (y, x, v) within `half`. A site's pixels are summed by place and its medians taken of
    counted values, so that stars at one place, and pixels at one place, cost no pairs."""
    at, of = sites(stars)
    pixels = pixels.filter("y is not null and x is not null")
    light = stamps(at, pixels.groupBy("y", "x").agg(*_light()), half, cell, (*SITE, "times"), _SUMS)
    values = stamps(at, counted(_values(pixels, "y", "x"), "plane", "value"), half, cell, (*SITE, "times"), ("plane", "value", "n"))
    return ranks.by_group(of, _offsets(light, values, list(SITE), sigma, saturation), list(SITE)).select("star_id", "n", "dy", "dx")


_SUMS = ("__n", "__na", "__nb", "__sa", "__sb", "__top")


def _light() -> list[Column]:
    """Of the pixels at one place: their number, the numbers and sums of both planes' values, and the greatest value."""
    each = [f(f"v.{c}").alias(f"__{n}{c}") for n, f in (("n", F.count), ("s", F.sum)) for c in "ab"]
    return [F.count(F.lit(1)).alias("__n"), *each, F.max(F.greatest("v.a", "v.b")).alias("__top")]


def _values(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, plane, value): the values of both planes, one below the other."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(c).alias("plane"), F.col(f"v.{c}").cast("double").alias("value")) for c in "ab"))).alias("__v")).select(*keep, "__v.plane", "__v.value")


def _offsets(light: DataFrame, values: DataFrame, keys: list[str], sigma: float, saturation: float | None) -> DataFrame:
    """(keys, n, dy, dx) of what each place of a stamp holds (keys, dy, dx, times and the sums of it) and of its values (keys, plane, value, n, times)."""
    found = values.groupBy(*keys, "plane", "value").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    medians = found.groupBy(*keys).agg(*(F.percentile(F.when(F.col("plane") == c, F.col("value")), F.lit(0.5), F.col("n")).alias(f"__m{c}") for c in "ab"))
    w = F.exp(-(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) / (2 * sigma**2)) * F.col("times")
    above = {c: (F.col(f"__s{c}") - F.col(f"__m{c}") * F.col(f"__n{c}")) * w for c in "ab"}
    sums = [F.sum(above[c] * (F.lit(1.0) if d is None else F.col(d))).alias(f"__{c}{d or ''}") for c in "ab" for d in (None, "dy", "dx")]
    out = ranks.by_group(light, medians, keys).groupBy(*keys).agg(F.sum(F.col("__n") * F.col("times")).alias("n"), F.max("__top").alias("__top"), *sums).filter("__a > 0 and __b > 0")
    if saturation is not None:
        out = out.filter(F.col("__top") < 0.8 * saturation)
    return out.select(*keys, "n", *((F.col(f"__b{d}") / F.col("__b") - F.col(f"__a{d}") / F.col("__a")).alias(d) for d in ("dy", "dx")))


def ring_profile(stars: DataFrame, pixels: DataFrame, half: int, cell: int, keys: list[str], width: float = 1.0) -> DataFrame:
    """(keys, ring, level, error, n) of the pixels (y, x, v) within `half` of stars (keys, y, x): medians of rings and their standard errors.

    How often a place lies in a ring of the stars of a group is counted first; its values are then counted as often. No pairs of stars and pixels are made."""
    ring = F.floor(F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) / width).cast("int")
    values = counted(pixels, "v")
    at = stars.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("times"))
    places = values.select("y", "x").distinct().withColumns({"__py": F.col("y"), "__px": F.col("x")})
    seen = stamps(at, places, half, cell, (*keys, "times"), ("__py", "__px")).groupBy(*keys, ring.alias("ring"), F.col("__py").alias("y"), F.col("__px").alias("x")).agg(F.sum("times").alias("times"))
    group = [*keys, "ring"]
    points = seen.join(values, ["y", "x"]).groupBy(*group, "v").agg(F.sum(F.col("times") * F.col("n")).alias("n"))
    levels = ranks.by_group(points.groupBy(*group).agg(F.sum("n").alias("__n")), ranks.counted_medians(points, group, "v", "n", "level"), group, "left")
    apart = ranks.by_group(points, levels.drop("__n"), group).withColumn("__d", F.abs(F.col("v") - F.col("level")))
    out = ranks.by_group(levels, ranks.counted_medians(apart, group, "__d", "n", "__m"), group, "left")
    return out.select(*group, "level", (1.2533 * MAD_SCALE * F.col("__m") / F.sqrt("__n")).alias("error"), F.col("__n").alias("n"))


def detected_radius(profile: DataFrame, keys: list[str], k: float = 3.0, run: int = 3) -> DataFrame:
    """(keys, radius): the first of `run` consecutive rings below k errors; the last ring where there is none."""
    part = Window.partitionBy(*keys).orderBy("ring")
    low = F.coalesce(F.col("level") < k * F.col("error"), F.lit(True)).cast("int")
    df = profile.withColumn("__l", F.sum(low).over(part.rowsBetween(0, run - 1)))
    return df.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("__l") == run, F.col("ring"))), F.max("ring")).alias("radius"))


def off_locus(stars: DataFrame, keys: list[str], tolerance: float = 0.1, least_snr: float = 60.0, least: int = 20) -> DataFrame:
    """(keys, share, stars): bright stars (r, g, b, snr) whose green lies outside the range of red and blue; null below `least` stars."""
    low, high = F.least("r", "b") * (1 - tolerance), F.greatest("r", "b") * (1 + tolerance)
    out = stars.filter(F.col("snr") >= least_snr).groupBy(*keys).agg(F.avg(((F.col("g") < low) | (F.col("g") > high)).cast("int")).alias("__s"), F.count(F.lit(1)).alias("stars"))
    return out.select(*keys, F.when(F.col("stars") >= least, F.col("__s")).alias("share"), "stars")


def truth_metrics(both: DataFrame, keys: list[str], estimate: str, truth: str) -> DataFrame:
    """(keys, gain, nrmse, psnr): the estimate is scaled to the truth by least squares first."""
    fit = both.groupBy(*keys).agg((F.covar_pop(estimate, truth) / F.var_pop(estimate)).alias("gain"), F.avg(estimate).alias("__e"), F.avg(truth).alias("__t"), (F.max(truth) - F.min(truth)).alias("__range"), F.stddev_pop(truth).alias("__sd"))
    gap = F.col("gain") * (F.col(estimate) - F.col("__e")) + F.col("__t") - F.col(truth)
    out = both.join(fit, keys).groupBy(*keys, "gain", "__range", "__sd").agg(F.sqrt(F.avg(gap * gap)).alias("__rms"))
    return out.select(*keys, "gain", (F.col("__rms") / F.col("__sd")).alias("nrmse"), (20 * F.log10(F.col("__range") / F.col("__rms"))).alias("psnr"))


def defect_map(frames: DataFrame, position: list[str], value: str, group: list[str], k: float = 7.0) -> DataFrame:
    """Positions whose median over frames stands out from their group's by k MAD sigma."""
    medians = frames.groupBy(*group, *position).agg(F.median(value).alias("level"))
    part = Window.partitionBy(*group)
    df = medians.withColumn("__m", F.median("level").over(part))
    df = df.withColumn("__d", F.abs(F.col("level") - F.col("__m"))).withColumn("__s", MAD_SCALE * F.median("__d").over(part))
    return df.filter((F.col("__s") > 0) & (F.col("__d") > k * F.col("__s"))).select(*group, *position, "level")


def trail_bins(pixels: DataFrame, keys: list[str], angles: int = 36, step: float = 2.0, least: int = 20) -> DataFrame:
    """(keys, angle, rho, n): lines on which many bright pixels (y, x) lie, as counts of a Hough accumulator."""
    angle = F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("angle")
    df = pixels.select(*keys, "y", "x", angle)
    t = F.col("angle") * (3.141592653589793 / angles)
    df = df.withColumn("rho", F.floor((F.col("x") * F.cos(t) + F.col("y") * F.sin(t)) / step).cast("int"))
    return df.groupBy(*keys, "angle", "rho").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def best_overlap(cells: DataFrame, keys: list[str], choice: str, a: str, b: str) -> DataFrame:
    """(keys, choice, iou): the choice whose two masks overlap best; ties to the smaller one."""
    both, either = F.sum((F.col(a) & F.col(b)).cast("int")), F.sum((F.col(a) | F.col(b)).cast("int"))
    ious = cells.groupBy(*keys, choice).agg((both / F.nullif(either, F.lit(0))).alias("iou"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("iou"), choice))
    return ious.withColumn("__r", rank).filter(F.col("__r") == 1).drop("__r")


def fill_nearest(rows: DataFrame, keys: list[str], order: str, value: str, plain: bool | None = None) -> DataFrame:
    """Rows with `filled`: missing values take that of the nearest row in order (a number), the earlier one on ties."""
    known = F.when(F.col(value).isNotNull() & F.col(order).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    df = ranks.around(rows, keys, order, known, "__before", "__after", plain=plain)
    nearer = F.col("__before").isNotNull() & (F.col("__after").isNull() | (F.col(order) - F.col("__before.o") <= F.col("__after.o") - F.col(order)))
    return df.withColumn("filled", F.when(nearer, F.col("__before.v")).otherwise(F.col("__after.v"))).drop("__before", "__after")


def largest_passing(low: Column | float, high: Column | float, passes: Callable[[Column], Column], steps: int = 5) -> Column:
    """The largest value in [low, high] that passes, by bisection in one expression (a step is a fold, not a job); null if low fails."""
    low, high = (c if isinstance(c, Column) else F.lit(float(c)) for c in (low, high))
    start = F.struct(low.alias("a"), high.alias("b"))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["a"] + state["b"]) / 2
        return F.when(passes(middle), F.struct(middle.alias("a"), state["b"].alias("b"))).otherwise(F.struct(state["a"].alias("a"), middle.alias("b")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["a"])
    return F.when(passes(high), high).when(passes(low), found)


def first_passing(ladder: list[float], passes: Callable[[Column], Column]) -> Column:
    """The first value of a ladder that passes, else null."""
    return F.get(F.filter(F.array(*(F.lit(float(v)) for v in ladder)), passes), F.lit(0))


def smoothed(profile: DataFrame, keys: list[str], order: str, value: str, error: str, strength: float) -> DataFrame:
    """Profiles (keys, order, value, error) with `smooth`, minimising weighted squares and `strength` times squared second differences.

    A profile is a few hundred rings and is solved in one small group.
    """

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        v, w = frame[value].to_numpy(float), 1 / np.maximum(frame[error].to_numpy(float), 1e-9) ** 2
        w = np.where(np.isfinite(v), w, 0.0)
        d = np.diff(np.eye(len(v)), 2, axis=0) if len(v) > 2 else np.zeros((0, len(v)))
        return frame.assign(smooth=np.linalg.solve(np.diag(w) + strength * d.T @ d + 1e-12 * np.eye(len(v)), w * np.nan_to_num(v)))

    df = profile.select(*keys, order, value, error)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", smooth double"
    return df.groupBy(*keys).applyInPandas(solve, schema)


def weighted_slope(rows: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """(keys, slope): weighted least squares through the origin."""
    w = F.col(weight)
    return rows.groupBy(*keys).agg((F.sum(w * F.col(x) * F.col(y)) / F.sum(w * F.col(x) * F.col(x))).alias("slope"))


def strips(pixels: DataFrame, keys: list[str], n: int, x: str, value: str) -> DataFrame:
    """(keys, lump): the greatest deviation of vertical strips' lower quartiles from their median."""
    extent = pixels.groupBy(*keys).agg((F.max(x) + 1).alias("__w"))
    df = pixels.join(extent, keys).withColumn("__s", F.floor(F.col(x) * n / F.col("__w")).cast("int"))
    q = df.groupBy(*keys, "__s").agg(F.percentile(value, F.lit(0.25)).alias("__q"))
    q = q.join(q.groupBy(*keys).agg(F.median("__q").alias("__m")), keys)
    return q.groupBy(*keys).agg(F.max(F.abs(F.col("__q") - F.col("__m"))).alias("lump"))
