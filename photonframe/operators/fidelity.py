"""Structural fidelity of a finished image to its linear data, over a pyramid of scales.

Both images lie in one table of tiles. One exchange of halos serves all scales: each tile builds its part of the pyramid and measures the
local deviations of both images and their covariance in a Gaussian window. What depends on the whole image (its range, its noise at each scale)
is an aggregation of a few numbers a tile; a second pass over the saved measures compares them with it. No image is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonframe.operators import ranks, tiles
from photonframe.sources import shared

# Weights of the five scales, the window and its deviation, the range of the linear image and of the finished one, the constants of the
# two ratios, and the frequency (cycles a degree) of the first scale, which halves with each.
WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)
WINDOW, SIGMA = 11, 1.5
SOURCE_TOP, FINISHED_TOP = 2.0**32 - 1, 255.0
C1, C2 = 0.01, 10.0
FREQUENCY = 16.0
MODES = ("hits", "tmqi", "youden")

_SUMS = ("n", "both", "significant", "hit", "plain", "alarm")


def window() -> np.ndarray:
    at = np.arange(WINDOW) - WINDOW // 2
    w = np.exp(-(at**2) / (2 * SIGMA**2))
    return w / w.sum()


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """The normal distribution function to about 1e-12, by the series of positive terms of the error function; 0 and 1 from 6 deviations on (1e-9)."""
    far, x = np.abs(x) >= 6, np.clip(x, -6, 6)
    term = np.abs(x)
    total = term.copy()
    for k in range(1, 100):
        term = term * x * x / (2 * k + 1)
        total += term
    return np.where(far, x > 0, 0.5 + np.sign(x) * total * np.exp(-x * x / 2) / np.sqrt(2 * np.pi))


def visibility(scale: int) -> float:
    """Deviation at which half of the variations of a finished image (0 to 255) are seen, from the eye's contrast sensitivity at the scale's frequency."""
    f = 0.114 * FREQUENCY / 2**scale
    return 128.0 / (1.4 * 260.0 * (0.0192 + f) * np.exp(-(f**1.1)))


def _windowed(a: np.ndarray) -> np.ndarray:
    """Weighted means in windows that lie whole inside `a`."""
    w = window()
    rows = sum(w[k] * a[k : a.shape[0] - WINDOW + 1 + k] for k in range(WINDOW))
    return sum(w[k] * rows[:, k : a.shape[1] - WINDOW + 1 + k] for k in range(WINDOW))


def _halved(a: np.ndarray, first_y: int | None, first_x: int | None) -> np.ndarray:
    """Means of pixels 2i - 1 and 2i each way, of those that are not missing; the image's first row and column stand for the one before, `first_*`
    being where they lie in `a`."""
    if first_y:
        a[first_y - 1] = a[first_y]
    if first_x:
        a[:, first_x - 1] = a[:, first_x]
    there = ~np.isnan(a)
    out = np.full(((a.shape[0] + 1) // 2, (a.shape[1] + 1) // 2), np.nan + 1j * np.nan)
    y, x = slice(2, None, 2), slice(2, None, 2)
    before_y, before_x = slice(1, a.shape[0] - 1, 2), slice(1, a.shape[1] - 1, 2)
    ny, nx = len(range(*y.indices(a.shape[0]))), len(range(*x.indices(a.shape[1])))
    four = lambda a: a[y, x] + a[before_y, x][:ny] + a[y, before_x][:, :nx] + a[before_y, before_x][:ny, :nx]
    n, total = four(there.astype(int)), four(np.where(there, a, 0))
    out[1 : 1 + ny, 1 : 1 + nx][n > 0] = total[n > 0] / n[n > 0]
    return out


def _last(data: pd.Series, y0: pd.Series, x0: pd.Series, h: pd.Series, w: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """The last row and column that a tile's pixels reach one level below those whose last ones are given; -1 without any."""
    out = []
    for d, top, left, rows, columns, end in zip(data, y0, x0, h, w, ends):
        y, x = np.nonzero(~np.isnan(np.frombuffer(d, np.complex64).reshape(rows, columns)))
        y, x, end = y + top, x + left, [int(e) for e in end.split()]
        for my, mx in zip(end[::2], end[1::2]):
            y, x = (y + 1) // 2, (x + 1) // 2
            inside = (2 * y <= my) & (2 * x <= mx)
            y, x = y[inside], x[inside]
        out.append((y.max(), x.max()) if len(y) else (-1, -1))
    return pd.DataFrame(out, columns=["y", "x"])


def extents(pairs: DataFrame, keys: list[str], scales: int) -> DataFrame:
    """(keys, ends): the last row and column of all levels but the last, as text. A level's pixel stands for up to four of the level before, the last
    of which may be missing but must not lie beyond that level's last row and column; with gaps these move."""
    out = pairs.groupBy(*keys).agg(F.concat_ws(" ", F.max(F.col("y0") + F.col("h")) - 1, F.max(F.col("x0") + F.col("w")) - 1).alias("ends"))
    last = F.pandas_udf(_last, "y int, x int")
    for _ in range(1, scales - 1):
        at = ranks.by_group(pairs, out, keys).select(*keys, "ends", last("data", "y0", "x0", "h", "w", "ends").alias("__at"))
        out = at.groupBy(*keys, "ends").agg(F.max("__at.y").alias("__y"), F.max("__at.x").alias("__x")).select(*keys, F.concat_ws(" ", "ends", "__y", "__x").alias("ends"))
    return out


def measures(pairs: DataFrame, keys: list[str], scales: int = len(WEIGHTS)) -> DataFrame:
    """(keys, scale, noise_sum, noise_n, low, high, n, sd_source, sd_finished, cov) of each tile and scale of complex tiles (`tiles.from_pixels` with
    `second`): sums of the absolute second differences of the source, the tile's range of it, and the packed local measures of the n windows that hold
    no missing pixel; one of a coarser scale is the mean of its pixels that are not. Tile sides must be multiples of 2 ** (scales - 1), and, where an image has several tiles, at least 6 times that."""
    if not 1 <= scales <= len(WEIGHTS):
        raise ValueError(f"one to {len(WEIGHTS)} scales")
    unit = 2 ** (scales - 1)
    halo, reach = (WINDOW // 2 + 1) * unit, WINDOW // 2

    def run(padded: np.ndarray, at: dict) -> list[tuple]:
        if at["y0"] % unit or at["x0"] % unit:
            raise ValueError(f"sides of tiles must be multiples of {unit}")
        numbers = [int(e) for e in at["ends"].split()]
        ends = list(zip(numbers[::2], numbers[1::2]))
        own = padded[halo : halo + at["h"], halo : halo + at["w"]].real
        low, high = (float(f(own[~np.isnan(own)])) if not np.isnan(own).all() else None for f in (np.min, np.max))
        middle = np.nan_to_num(np.nanmean(padded.real)) + 1j * np.nan_to_num(np.nanmean(padded.imag)) if not np.isnan(padded).all() else 0j
        a, rows = padded - middle, []
        a[np.isnan(a)] = np.nan + 1j * np.nan
        for scale in range(scales):
            if scale:
                h = halo >> (scale - 1)
                a = _halved(a, h if at["y0"] == 0 else None, h if at["x0"] == 0 else None)
                # Beyond the last row and column of the level before, there is none.
                my, mx = ends[scale - 1]
                a[max(0, my // 2 + 1 - (at["y0"] >> scale) + (halo >> scale)) :] = np.nan + 1j * np.nan
                a[:, max(0, mx // 2 + 1 - (at["x0"] >> scale) + (halo >> scale)) :] = np.nan + 1j * np.nan
            edge = halo >> scale
            ny, nx = ((at[c] - 1 >> scale) + 1 for c in ("h", "w"))
            part = a[edge - reach : edge + ny + reach, edge - reach : edge + nx + reach]
            s, f = part.real, part.imag
            ms, mf = _windowed(s), _windowed(f)
            local = np.stack([np.sqrt(np.maximum(_windowed(s * s) - ms * ms, 0)), np.sqrt(np.maximum(_windowed(f * f) - mf * mf, 0)), _windowed(s * f) - ms * mf])
            good = ~np.isnan(local).any(axis=0)
            c = s[reach - 1 : reach + ny + 1, reach - 1 : reach + nx + 1]
            rows2 = c[:-2] - 2 * c[1:-1] + c[2:]
            second = np.abs(rows2[:, :-2] - 2 * rows2[:, 1:-1] + rows2[:, 2:])
            found = second[~np.isnan(second)]
            rows.append((scale, float(found.sum()), len(found), low, high, int(good.sum()), *(m[good].tobytes() for m in local)))
        return rows

    schema = "scale int, noise_sum double, noise_n long, low double, high double, n long, sd_source binary, sd_finished binary, cov binary"
    pairs = shared.kept(pairs, "pairs")
    placed = ranks.by_group(pairs, extents(pairs, keys, scales), keys)
    return tiles.map_tiles(placed, [*keys, "ends"], halo, run, schema, rows=True, border="missing", dtype=np.complex64).drop("ends")


def noise(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scale, sigma): the source's noise at each scale, from its second differences; null without a whole neighbourhood."""
    sums = measured.groupBy(*keys, "scale").agg(F.sum("noise_sum").alias("__s"), F.sum("noise_n").alias("__n"))
    return sums.select(*keys, "scale", F.when(F.col("__n") > 0, float(np.sqrt(np.pi / 2) / 6) * F.col("__s") / F.col("__n")).alias("sigma"))


def fidelity(pairs: DataFrame, keys: list[str], scales: int = len(WEIGHTS), noise_from: DataFrame | None = None) -> DataFrame:
    """(keys, scale, hits, tmqi, youden) of complex tiles: the source (any linear unit) as the real part, the finished image (0 to 1) as the other.

    A variation of the source is significant by its deviation against the noise at that scale, one of the finished image visible by the eye's
    threshold, both through a normal ogive. `hits`: the share of significant structure that is visible and keeps its shape; `youden`: less the share
    of insignificant variation made visible; `tmqi`: likeness of the two. A scale without a whole window has nulls. An image of one value
    only has deviations at its limit of zero, so that hits is the ogive's foot where the finished image is flat too. `noise_from` (keys, scale, sigma) gives the noise of other data, as `noise` returns it, in the source's unit."""
    measured = shared.kept(measures(pairs, keys, scales), "fidelity")
    span = measured.filter("scale = 0").groupBy(*keys).agg(F.min("low").alias("__low"), F.max("high").alias("__high"))
    level = ranks.by_group(noise(measured, keys) if noise_from is None else noise_from.select(*keys, "scale", "sigma"), span, keys, "left")
    spread = 1 + 3 / np.sqrt(2 / float((np.outer(window(), window()) ** 2).sum()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                sums = [0.0] * len(_SUMS)
                if r.n and not pd.isna(r.sigma):
                    unit = SOURCE_TOP / max(r.high - r.low, 1e-30)
                    s, f = np.frombuffer(r.sd_source) * unit, np.frombuffer(r.sd_finished) * FINISHED_TOP
                    like = (np.frombuffer(r.cov) * unit * FINISHED_TOP + C2) / (s * f + C2)
                    limit, seen = r.sigma * unit * spread, visibility(r.scale)
                    p, q = (normal_cdf((d - u) / max(u / 3, 1e-12)) for d, u in ((s, limit), (f, seen)))
                    both = (2 * p * q + C1) / (p * p + q * q + C1) * like
                    sums = [float(r.n), both.sum(), p.sum(), (p * q * np.clip(like, 0, 1)).sum(), (1 - p).sum(), ((1 - p) * q).sum()]
                out.append([*(getattr(r, f"k{i}") for i in range(len(keys))), r.scale, *sums])
            yield pd.DataFrame(out, columns=[*keys, "scale", *_SUMS])

    met = ranks.by_group(measured.drop("low", "high"), level.withColumnsRenamed({"__low": "low", "__high": "high"}), [*keys, "scale"])
    named = met.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), "scale", "n", "sigma", "low", "high", "sd_source", "sd_finished", "cov")
    schema = ", ".join([*(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys), "scale int", *(f"{c} double" for c in _SUMS)])
    total = named.mapInPandas(run, schema).groupBy(*keys, "scale").agg(*(F.sum(c).alias(c) for c in _SUMS))
    hits = F.col("hit") / F.greatest(F.col("significant"), F.lit(1e-9))
    alarms = F.col("alarm") / F.greatest(F.col("plain"), F.lit(1e-9))
    known = lambda c: F.when(F.col("n") > 0, c)
    return total.select(*keys, "scale", known(hits).alias("hits"), known(F.col("both") / F.col("n")).alias("tmqi"), known(hits - alarms).alias("youden"))


def score(levels: DataFrame, keys: list[str], mode: str = "hits") -> DataFrame:
    """(keys, score) of `fidelity`: the weighted sum over scales, or for "tmqi" the weighted product. Where scales are null, the weights of the others
    are raised alike; null where all are."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), F.col("scale") + 1)
    value = F.ln(F.greatest(F.col(mode), F.lit(1e-9))) if mode == "tmqi" else F.col(mode)
    sums = levels.filter(F.col(mode).isNotNull()).groupBy(*keys).agg((F.sum(weight * value) / F.sum(weight) * float(sum(WEIGHTS))).alias("__s"))
    return ranks.by_group(levels.select(*keys).distinct(), sums, keys, "left").select(*keys, (F.exp("__s") if mode == "tmqi" else F.col("__s")).alias("score"))
