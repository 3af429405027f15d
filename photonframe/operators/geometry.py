"""Transforms, footprints and resampling as expressions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def affine_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, a, b, c, d, e, f) of x2 = a x + b y + c and y2 = d x + e y + f by least squares over pairs (x, y, x2, y2).

    Normal equations are sums, so any number of pairs reduces to one row a key; null where the points lie on a line.
    """
    s = {n: F.sum(e) for n, e in {"x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}.items()}
    s |= {f"{t}{m}": F.sum(F.col(t) * v) for t in ("x2", "y2") for m, v in (("", F.lit(1.0)), ("x", F.col("x")), ("y", F.col("y")))}
    m = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(v.alias(f"s_{k}") for k, v in s.items()))
    c = lambda k: F.col(f"s_{k}")
    n = F.col("n").cast("double")
    # Centred second moments.
    xx, xy, yy = c("xx") - c("x") * c("x") / n, c("xy") - c("x") * c("y") / n, c("yy") - c("y") * c("y") / n
    det = xx * yy - xy * xy
    m = m.withColumn("__det", det)
    out = []
    for t, (p, q, r) in (("x2", "abc"), ("y2", "def")):
        tx, ty = c(f"{t}x") - c(t) * c("x") / n, c(f"{t}y") - c(t) * c("y") / n
        a = F.when(F.abs("__det") > 1e-12, (tx * yy - ty * xy) / F.col("__det"))
        b = F.when(F.abs("__det") > 1e-12, (ty * xx - tx * xy) / F.col("__det"))
        out += [a.alias(p), b.alias(q), (c(t) / n - a * c("x") / n - b * c("y") / n).alias(r)]
    return m.select(*keys, "n", *out)


def residual_clip(pairs: DataFrame, fits: DataFrame, keys: list[str], k: float = 3.0) -> DataFrame:
    """Pairs within k MAD sigma of their fit."""
    df = pairs.join(fits, keys).withColumn("__r", F.hypot(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") - F.col("x2"), F.col("d") * F.col("x") + F.col("e") * F.col("y") + F.col("f") - F.col("y2")))
    med = df.groupBy(*keys).agg((1.4826 * F.median("__r")).alias("__s"))
    return df.join(med, keys).filter(F.col("__r") <= k * F.greatest(F.col("__s"), F.lit(1e-9))).select(*pairs.columns)


def homography(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a row-major 3 by 3 matrix."""
    g = lambda i: F.element_at(h, i)
    w = g(7) * x + g(8) * y + g(9)
    return (g(1) * x + g(2) * y + g(3)) / w, (g(4) * x + g(5) * y + g(6)) / w


def is_identity(h: Column, tolerance: float = 1e-9) -> Column:
    unit = F.array(*(F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)))
    return F.forall(F.zip_with(h, unit, lambda a, b: F.abs(a - b)), lambda d: d <= tolerance)


def footprints(frames: DataFrame, frame_id: str, h: str, width: float, height: float) -> DataFrame:
    """(frame_id, xs, ys): corners of each frame on the canvas, in order."""
    corners = [homography(F.col(h), F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (width, 0), (width, height), (0, height))]
    return frames.select(frame_id, F.array(*(c[0] for c in corners)).alias("xs"), F.array(*(c[1] for c in corners)).alias("ys"))


def inside(xs: str, ys: str, x: Column, y: Column) -> Column:
    """Whether a point lies in a convex quadrilateral."""
    side = lambda i: (F.col(xs)[(i + 1) % 4] - F.col(xs)[i]) * (y - F.col(ys)[i]) - (F.col(ys)[(i + 1) % 4] - F.col(ys)[i]) * (x - F.col(xs)[i])
    low, high = F.least(*(side(i) for i in range(4))), F.greatest(*(side(i) for i in range(4)))
    return (low >= 0) | (high <= 0)


def coverage(feet: DataFrame, cell: float) -> DataFrame:
    """(cy, cx, frames): frames over the centre of each cell of the canvas. Each footprint makes the cells of its own bounding box."""
    at = lambda c: F.floor(c / cell).cast("int")
    df = feet.withColumn("cy", F.explode(F.sequence(at(F.array_min("ys")), at(F.array_max("ys"))))).withColumn("cx", F.explode(F.sequence(at(F.array_min("xs")), at(F.array_max("xs")))))
    return df.filter(inside("xs", "ys", (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell)).groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("frames"))


def drizzle(pixels: DataFrame, keys: list[str], scale: float, pixfrac: float, dx: Column, dy: Column, weight: Column | None = None) -> DataFrame:
    """(keys, oy, ox, v, weight): pixels (y, x, v) shrunk by pixfrac, shifted by (dy, dx), dropped on a grid `scale` times finer.

    A drop makes the output cells that it overlaps (few, as the drop is small), weighted by the shared area; then one aggregation.
    """
    w = F.lit(1.0) if weight is None else weight
    half = pixfrac * scale / 2
    df = pixels.withColumn("__cx", (F.col("x") + 0.5 + dx) * scale).withColumn("__cy", (F.col("y") + 0.5 + dy) * scale).withColumn("__w", w)
    lo, hi = (lambda c: F.floor(F.col(c) - half + 1e-9).cast("int")), (lambda c: F.ceil(F.col(c) + half - 1e-9).cast("int") - 1)
    df = df.withColumn("oy", F.explode(F.sequence(lo("__cy"), hi("__cy")))).withColumn("ox", F.explode(F.sequence(lo("__cx"), hi("__cx"))))
    shared = lambda c, o: F.least(F.col(c) + half, F.col(o) + 1.0) - F.greatest(F.col(c) - half, F.col(o).cast("double"))
    df = df.withColumn("__a", F.greatest(F.lit(0.0), shared("__cy", "oy")) * F.greatest(F.lit(0.0), shared("__cx", "ox")) * F.col("__w")).filter("__a > 0")
    return df.groupBy(*keys, "oy", "ox").agg((F.sum(F.col("__a") * F.col("v")) / F.sum("__a")).alias("v"), F.sum("__a").alias("weight"))


def plane_fit(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, q, r) of v = p x + q y + r over block values (x, y, v)."""
    both = blocks.select(*keys, "x", "y", F.col("v").alias("x2"), F.lit(0.0).alias("y2"))
    return affine_fit(both, keys).select(*keys, F.col("a").alias("p"), F.col("b").alias("q"), F.col("c").alias("r"))


def resampling(scale: Column, cfa: Column, pixfrac: Column, demosaic: Column) -> Column:
    """struct(method, scale, pixfrac): drizzle for finer grids, else Lanczos; pixfrac between 0.1 and 1, by default 1 / scale."""
    plain = demosaic | ~cfa | (scale <= 1)
    lanczos = demosaic | ~cfa
    frac = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(pixfrac, F.when(plain, F.lit(1.0)).otherwise(F.round(1 / scale, 3)))))
    return F.struct(F.when(lanczos, "lanczos4").otherwise("drizzle").alias("method"), F.when(lanczos, F.lit(1.0)).otherwise(scale).alias("scale"), F.when(~lanczos, frac).alias("pixfrac"))


def rejection(choice: Column, resampled: Column, scale: Column, sigma_low: Column, sigma_high: Column) -> Column:
    """struct(method, low, high) of a rejection: unless chosen, MAD on finer drizzle grids, else winsorized; 0 or null limits mean 4 and 3."""
    given = lambda c, d: F.when(c.isNull() | (c == 0), F.lit(float(d))).otherwise(c)
    auto = F.when((resampled == "drizzle") & (scale > 1), "mad").otherwise("winsorized")
    return F.struct(F.coalesce(choice, auto).alias("method"), given(sigma_low, 4).alias("low"), given(sigma_high, 3).alias("high"))
