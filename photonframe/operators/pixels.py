"""Pixel algebra over long tables (one row a pixel, frame and channel): calibration, super-pixels, HDR blending, histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonframe.operators import matching, ranks, tiles
from photonframe.sources import shared


def calibrated(raw: Column, bias: Column, dark: Column, flat: Column, k: Column | float = 1.0) -> Column:
    """(raw - bias - k dark) / flat; a missing master does nothing."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    zero, one = F.lit(0.0), F.lit(1.0)
    return (raw - F.coalesce(bias, zero) - k * F.coalesce(dark, zero)) / F.coalesce(F.nullif(flat, zero), one)


#: Colour of a sensor site by pattern, in the order (even row, even column), (even, odd), (odd, even), (odd, odd).
PATTERNS = {"RGGB": "RGGB", "GRBG": "GRBG", "GBRG": "GBRG", "BGGR": "BGGR"}


def cfa_channel(y: Column, x: Column, pattern: str) -> Column:
    p = PATTERNS[pattern]
    return F.element_at(F.array(*(F.lit(c) for c in p)), (F.pmod(y, F.lit(2)) * 2 + F.pmod(x, F.lit(2)) + 1).cast("int"))


def superpixels(pixels: DataFrame, keys: list[str], y: str, x: str, value: str, pattern: str) -> DataFrame:
    """(keys, sy, sx, r, g, b): 2 by 2 cells as one pixel, the greens averaged."""
    df = pixels.withColumn("__c", cfa_channel(F.col(y), F.col(x), pattern))
    mean = lambda c: F.avg(F.when(F.col("__c") == c, F.col(value))).alias(c.lower())
    return df.groupBy(*keys, F.floor(F.col(y) / 2).alias("sy"), F.floor(F.col(x) / 2).alias("sx")).agg(mean("R"), mean("G"), mean("B"))


def block_medians(pixels: DataFrame, keys: list[str], y: str, x: str, value: str, size: int) -> DataFrame:
    return pixels.groupBy(*keys, F.floor(F.col(y) / size).alias("by"), F.floor(F.col(x) / size).alias("bx")).agg(F.median(value).alias("med"), F.count(F.lit(1)).alias("n"))


def hdr_blend(pixels: DataFrame, pixel: list[str], exposure: str, value: str, valid: Column, variance: Column, saturation: float) -> DataFrame:
    """(pixel, blended): radiances weighted by inverse variance and a cosine taper towards saturation.

    The taper looks at the greater of the own radiance and those of all shorter exposures, so that a clipped long exposure cannot
    pass for a faint one. Pixels without weight take the shortest valid exposure.
    """
    radiance = F.when(valid, F.col(value) / F.col(exposure))
    df = pixels.withColumn("__r", radiance).withColumn("__v", variance / (F.col(exposure) * F.col(exposure)))
    shorter = Window.partitionBy(*pixel).orderBy(exposure, value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max("__r").over(shorter)
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (seen * F.col(exposure) - 0.85 * saturation) / (0.12 * saturation)))
    taper = 0.5 * (1 + F.cos(F.lit(3.141592653589793) * u))
    df = df.withColumn("__w", F.when(F.col("__r").isNotNull(), taper / F.greatest(F.col("__v"), F.lit(1e-18))).otherwise(0.0))
    out = df.groupBy(*pixel).agg(F.sum("__w").alias("__sw"), F.sum(F.col("__w") * F.coalesce("__r", F.lit(0.0))).alias("__swr"), F.min_by(F.when(F.col("__r").isNotNull(), F.col("__r")), F.when(F.col("__r").isNotNull(), F.struct(exposure, value))).alias("__short"))
    return out.select(*pixel, F.when(F.col("__sw") > 1e-12, F.col("__swr") / F.col("__sw")).otherwise(F.col("__short")).alias("blended"))


def hue_degrees(a: Column, b: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def hue_histogram(pixels: DataFrame, keys: list[str], a: Column, b: Column, bins: int = 18) -> DataFrame:
    """(keys, bin, share): chroma-weighted shares of hue."""
    df = pixels.withColumn("bin", F.floor(hue_degrees(a, b) / (360 / bins)).cast("int")).withColumn("__w", F.sqrt(a * a + b * b))
    cells = df.groupBy(*keys, "bin").agg(F.sum("__w").alias("__w"))
    total = F.sum("__w").over(Window.partitionBy(*keys))
    return cells.select(*keys, "bin", (F.col("__w") / total).alias("share"))


def hue_distance(first: DataFrame, second: DataFrame, keys: list[str], bins: int = 18) -> DataFrame:
    """(keys, distance): circular earth mover's distance of hue histograms (keys, bin, share), in half turns."""
    every = first.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    both = every.join(first.withColumnRenamed("share", "__a"), [*keys, "bin"], "left").join(second.withColumnRenamed("share", "__b"), [*keys, "bin"], "left")
    gap = F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0))
    run = both.withColumn("__c", F.sum(gap).over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    middle = run.groupBy(*keys).agg(F.median("__c").alias("__m"))
    return run.join(middle, keys).groupBy(*keys).agg((F.sum(F.abs(F.col("__c") - F.col("__m"))) / (bins / 2)).alias("distance"))


def histogram_mode(pixels: DataFrame, keys: list[str], value: Column, bins: int, half: int = 4) -> DataFrame:
    """(keys, mode, sky_sigma_bin): bin centre of the smoothed histogram's peak, and the nearest bin below it at half height."""
    cells = pixels.groupBy(*keys, F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("__n"))
    full = cells.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(cells, [*keys, "bin"], "left")
    part = Window.partitionBy(*keys).orderBy("bin")
    full = full.withColumn("__s", F.sum(F.coalesce("__n", F.lit(0))).over(part.rowsBetween(-half, half)))
    peak = full.groupBy(*keys).agg(F.max(F.struct("__s", (-F.col("bin")).alias("b"))).alias("p")).select(*keys, F.col("p.__s").alias("__top"), (-F.col("p.b")).alias("__at"))
    left = full.join(peak, keys).filter((F.col("bin") <= F.col("__at")) & (F.col("__s") * 2 <= F.col("__top"))).groupBy(*keys).agg(F.max("bin").alias("__half"))
    return peak.join(left, keys, "left").select(*keys, ((F.col("__at") + 0.5) / bins).alias("mode"), ((F.col("__half") + 0.5) / bins).alias("left_half"))


def integer_shift(reference: DataFrame, image: DataFrame, keys: list[str], reach: int, size: int = 256) -> DataFrame:
    """(keys, dy, dx, corr): the whole-pixel shift of greatest correlation, at most `reach` each way, ties to the smaller one. Tables hold (keys, y, x, v).

    Both images lie in one table of tiles (`reach` at most their `size`). Each tile correlates its part of the reference with the image and its halo by
    Fourier transforms, for all shifts at once, and gives the sums that a correlation needs; they are added over tiles. Pixels missing on either side
    have no say, of repeated ones the greatest value counts; a shift under which a side does not vary, or fewer than two pixels meet, has no correlation."""
    both = reference.select(*keys, "y", "x", "v").unionByName(image.select(*keys, "y", "x", F.lit(None).cast("double").alias("v"), F.col("v").alias("__w")), allowMissingColumns=True)
    both = both.groupBy(*keys, "y", "x").agg(F.max("v").cast("double").alias("v"), F.max("__w").cast("double").alias("__w"))
    # Sums keep their digits around the images' means.
    level = both.groupBy(*keys).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("__mv"), F.coalesce(F.avg("__w"), F.lit(0.0)).alias("__mw"))
    pairs = ranks.by_group(both, level, keys).select(*keys, "y", "x", (F.col("v") - F.col("__mv")).alias("v"), (F.col("__w") - F.col("__mw")).alias("__w"))
    side = 2 * reach + 1

    def sums(padded: np.ndarray, at: dict) -> list[tuple]:
        a, b = padded.real.copy(), padded.imag
        inside = np.zeros(a.shape, bool)
        inside[reach : reach + at["h"], reach : reach + at["w"]] = True
        ma, mb = inside & ~np.isnan(a), ~np.isnan(b)
        a, b = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
        shape = [n + 2 * reach for n in a.shape]
        left = [np.conj(np.fft.rfft2(p, shape)) for p in (ma.astype(float), a, a * a)]
        right = [np.fft.rfft2(p, shape) for p in (mb.astype(float), b, b * b)]
        shifts = np.arange(-reach, reach + 1)
        of = lambda i, j: np.fft.irfft2(left[i] * right[j], shape)[np.ix_(shifts, shifts)]
        got = [np.rint(of(0, 0)), of(1, 0), of(0, 1), of(2, 0), of(0, 2), of(1, 1)]
        return [(int(shifts[i]), int(shifts[j]), *(float(g[i, j]) for g in got)) for i in range(side) for j in range(side) if got[0][i, j] > 0]

    schema = "dy int, dx int, n double, a double, b double, aa double, bb double, ab double"
    part = tiles.map_tiles(tiles.from_pixels(pairs, keys, size, second="__w"), keys, reach, sums, schema, rows=True, border="missing", dtype=np.complex64)
    total = part.groupBy(*keys, "dy", "dx").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")))
    va, vb = (F.col(c * 2) - F.col(c) * F.col(c) / F.col("n") for c in ("a", "b"))
    # What the transforms leave of an even image is rounding.
    varies = (F.col("n") >= 2) & (va > 1e-9 * F.col("aa")) & (vb > 1e-9 * F.col("bb"))
    found = total.filter(varies).withColumn("corr", (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(va * vb))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("corr", 9).desc(), "dy", "dx"))
    return found.withColumn("__r", rank).filter(F.col("__r") == 1).select(*keys, "dy", "dx", "corr")


def gain_offset(both: DataFrame, keys: list[str], reference: str, value: str) -> DataFrame:
    """(keys, gain, offset): least squares of value on reference; 1 and 0 outside 0.5 to 2 or for fewer than ten pixels."""
    out = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.covar_pop(reference, value) / F.var_pop(reference)).alias("__g"), F.avg(reference).alias("__r"), F.avg(value).alias("__v"))
    good = (F.col("n") >= 10) & (F.col("__g") > 0.5) & (F.col("__g") < 2)
    return out.select(*keys, F.coalesce(F.when(good, F.col("__g")), F.lit(1.0)).alias("gain"), F.coalesce(F.when(good, F.col("__v") - F.col("__g") * F.col("__r")), F.lit(0.0)).alias("offset"))


def covered_area(samples: DataFrame, panels: DataFrame, panel_id: str) -> DataFrame:
    """Samples (sid, x, y) with `covered` and `nearest_panel` of uncovered ones, by the centre, ties to the smaller id; panels are (x0, x1, y0, y1, cx, cy).

    A sample meets only the panels in its grid cell, cells being as large as the largest panel. Those left without one look for centres in
    cells that double in every round: a centre within a cell's width is in one of nine cells, so what is found that near is the nearest.
    Rounds end when all have one, at the latest when a cell is as wide as everything; no sample meets every panel before."""
    box = panels.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("size"), *(f(c).alias(f"{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in ("cx", "cy"))).first()
    if box["size"] is None:
        return samples.select("sid", F.lit(False).alias("covered"), F.lit(None).cast(panels.schema[panel_id].dataType).alias("nearest_panel")).distinct()
    size = max(float(box["size"]), 1e-9)
    points = samples.select("sid", "x", "y")
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long"))
    spread = panels.select("x0", "x1", "y0", "y1", F.explode(cells("x0", "x1")).alias("gx"), "cx").select("*", F.explode(cells("y0", "y1")).alias("gy"))
    placed = points.withColumn("gx", F.floor(F.col("x") / size).cast("long")).withColumn("gy", F.floor(F.col("y") / size).cast("long"))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    covered = placed.join(spread, ["gx", "gy"]).filter(inside).select("sid").distinct().withColumn("covered", F.lit(True))
    marked = shared.kept(points.join(covered, "sid", "left").withColumn("covered", F.coalesce("covered", F.lit(False))), "samples")
    reach = marked.agg(*(f(c).alias(f"{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in ("x", "y"))).first()
    left, out = marked.filter("not covered and x is not null and y is not null").select("sid", "x", "y"), marked.filter("covered or x is null or y is null").select("sid", "covered", F.lit(None).cast(panels.schema[panel_id].dataType).alias("nearest_panel"))
    if reach["lx"] is None:
        return out
    widest = 2 * max(max(box["hcx"], reach["hx"]) - min(box["lcx"], reach["lx"]), max(box["hcy"], reach["hy"]) - min(box["lcy"], reach["ly"])) + size
    while not left.isEmpty():
        around = matching.with_cells(panels.select(F.col(panel_id).alias("__p"), F.col("cx").alias("__x"), F.col("cy").alias("__y")), "__x", "__y", size, True)
        d = F.pow(F.col("x") - F.col("__x"), 2) + F.pow(F.col("y") - F.col("__y"), 2)
        met = matching.with_cells(left, "x", "y", size).join(around, ["cx", "cy"]).withColumn("__d", d).filter(F.col("__d") <= size * size)
        near = shared.kept(met.groupBy("sid").agg(F.min(F.struct("__d", "__p")).alias("n")).select("sid", F.lit(False).alias("covered"), F.col("n.__p").alias("nearest_panel")), "nearest")
        out = out.unionByName(near)
        if size > widest:
            break
        left = shared.kept(left.join(near.select("sid"), "sid", "left_anti"), "samples")
        size *= 2
    return out
