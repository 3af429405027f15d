"""Neighbourhood operators over tile rows: each tile gets the borders of its eight neighbours by one shuffle of borders only.

A tile row is (key..., ty, tx, y0, x0, h, w, data float32). Image borders reflect. No image is gathered: a task holds one tile and its halo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonframe.operators import kernels

COLUMNS = ("ty", "tx", "y0", "x0", "h", "w", "data")


def from_pixels(pixels: DataFrame, keys: list[str], size: int, extent_of: list[str] | None = None, second: str | None = None) -> DataFrame:
    """Tiles of a long table (keys, y, x, v); missing pixels are not-a-number. An image reaches as far as its pixels do, or, with `extent_of`, as
    far as those of all images that agree in these keys. With `second`, a column of another image of the same place, tiles hold complex64: `v`
    as the real part, `second` as the imaginary one; `map_tiles` takes them with dtype complex64."""
    shared = keys if extent_of is None else extent_of
    df = pixels.withColumn("ty", F.floor(F.col("y") / size).cast("int")).withColumn("tx", F.floor(F.col("x") / size).cast("int"))
    extent = df.groupBy(*shared).agg(F.max("y").alias("__my"), F.max("x").alias("__mx"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key[-2:]
        y0, x0 = ty * size, tx * size
        h, w = min(size, int(rows["__my"].iloc[0]) + 1 - y0), min(size, int(rows["__mx"].iloc[0]) + 1 - x0)
        a = np.full((h, w), np.nan, np.float32) if second is None else np.full((h, w), complex(np.nan, np.nan), np.complex64)
        place = rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0
        a.real[place] = rows["v"]
        if second is not None:
            a.imag[place] = rows[second]
        return pd.DataFrame([[*key, y0, x0, h, w, a.tobytes()]], columns=[*keys, *COLUMNS])

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "ty int, tx int, y0 int, x0 int, h int, w int, data binary"])
    return df.join(extent, shared).select(*keys, "ty", "tx", "y", "x", "v", *([second] if second else []), "__my", "__mx").groupBy(*keys, "ty", "tx").applyInPandas(build, schema)


def to_pixels(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """The long table (keys, y, x, v) of tiles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                y, x = np.mgrid[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]
                yield pd.DataFrame({**{k: [getattr(r, k)] * y.size for k in keys}, "y": y.ravel(), "x": x.ravel(), "v": np.frombuffer(r.data, np.float32).astype(float)})

    schema = ", ".join([*(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys), "y int, x int, v double"])
    return tiles.select(*keys, *COLUMNS).mapInPandas(run, schema)


def _pieces(keys: list[str], halo: int, dtype: type = np.float32):
    """Each tile itself, and for its neighbours the strips that they need."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                a = np.frombuffer(r.data, dtype).reshape(r.h, r.w)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        ys = slice(0, r.h) if dy == 0 else slice(0, min(halo, r.h)) if dy < 0 else slice(max(0, r.h - halo), r.h)
                        xs = slice(0, r.w) if dx == 0 else slice(0, min(halo, r.w)) if dx < 0 else slice(max(0, r.w - halo), r.w)
                        part = np.ascontiguousarray(a[ys, xs])
                        out.append([*(getattr(r, k) for k in keys), r.ty + dy, r.tx + dx, r.y0 + ys.start, r.x0 + xs.start, *part.shape, part.tobytes(), dy == dx == 0])
            yield pd.DataFrame(out, columns=[*keys, *COLUMNS, "own"])

    return run


def map_tiles(tiles: DataFrame, keys: list[str], halo: int, fn: Callable[[np.ndarray, dict], object], schema: str, rows: bool = False, border: str = "reflect", dtype: type = np.float32) -> DataFrame:
    """fn(padded tile, its row) over all tiles: by default an array of the tile's own size, which becomes its data; with `rows`
    a list of tuples, which become rows (keys, schema). Beyond the image pixels reflect, or, with border "missing", are not-a-number.
    Only the eight neighbours send borders, so a halo is at most a tile wide."""
    types = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys)
    strips = tiles.select(*keys, *COLUMNS).mapInPandas(_pieces(keys, halo, dtype), f"{types}, ty int, tx int, y0 int, x0 int, h int, w int, data binary, own boolean")
    names = [x.split()[0] for x in schema.split(", ")] if schema else []

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["own"]]
        if not len(own):
            return pd.DataFrame([], columns=[*keys, *(names if rows else COLUMNS)])
        r = own.iloc[0]
        if len(group) > 1 and halo > max(group["h"].max(), group["w"].max()):
            raise ValueError(f"a halo of {halo} pixels needs larger tiles")
        a = np.full((r.h + 2 * halo, r.w + 2 * halo), complex(np.nan, np.nan) if dtype is np.complex64 else np.nan)
        known = np.zeros(a.shape, bool)
        for s in group.itertuples(index=False):
            y, x = s.y0 - r.y0 + halo, s.x0 - r.x0 + halo
            part = np.frombuffer(s.data, dtype).reshape(s.h, s.w)
            ya, xa = max(0, y), max(0, x)
            yb, xb = min(a.shape[0], y + s.h), min(a.shape[1], x + s.w)
            if yb > ya and xb > xa:
                a[ya:yb, xa:xb] = part[ya - y : yb - y, xa - x : xb - x]
                known[ya:yb, xa:xb] = True
        have_y, have_x = np.flatnonzero(known.any(axis=1)), np.flatnonzero(known.any(axis=0))
        top, left = have_y[0], have_x[0]
        inner = a[top : have_y[-1] + 1, left : have_x[-1] + 1]
        pad = ((top, a.shape[0] - 1 - have_y[-1]), (left, a.shape[1] - 1 - have_x[-1]))
        # A side without a neighbour is an image border.
        padded = a if border == "missing" else np.pad(inner, pad, mode="reflect" if min(inner.shape) > max(max(p) for p in pad) else "symmetric") if any(map(any, pad)) else inner
        info = {k: v for k, v in zip([*keys, "ty", "tx"], key)} | {c: int(r[c]) for c in ("y0", "x0", "h", "w")}
        got = fn(padded, info)
        if rows:
            return pd.DataFrame([[*key[: len(keys)], *x] for x in got], columns=[*keys, *names])
        return pd.DataFrame([[*key, r.y0, r.x0, r.h, r.w, np.ascontiguousarray(got, dtype).tobytes()]], columns=[*keys, *COLUMNS])

    out = f"{types}, {schema}" if rows else f"{types}, ty int, tx int, y0 int, x0 int, h int, w int, data binary"
    return strips.groupBy(*keys, "ty", "tx").applyInPandas(build, out)


def blur(tiles: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    return map_tiles(tiles, keys, kernels.gaussian_reach(sigma), lambda a, _: kernels.gaussian(a, sigma), "")


def median_filter(tiles: DataFrame, keys: list[str], r: int) -> DataFrame:
    return map_tiles(tiles, keys, r, lambda a, _: kernels.median(a, r), "")


def dilate(tiles: DataFrame, keys: list[str], r: int) -> DataFrame:
    return map_tiles(tiles, keys, r, lambda a, _: kernels.maximum(a, r), "")


def erode(tiles: DataFrame, keys: list[str], r: int) -> DataFrame:
    return map_tiles(tiles, keys, r, lambda a, _: kernels.minimum(a, r), "")


def repair_defects(tiles: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    return map_tiles(tiles, keys, 2, lambda a, _: kernels.same_colour_repair(a, threshold), "")


def demosaic(tiles: DataFrame, keys: list[str], pattern: str, channel: str) -> DataFrame:
    """One colour channel of a mosaic at every site."""
    p = np.array([[ord(pattern[0]), ord(pattern[1])], [ord(pattern[2]), ord(pattern[3])]])

    def fn(a: np.ndarray, r: dict) -> np.ndarray:
        y, x = np.mgrid[r["y0"] - 1 : r["y0"] + r["h"] + 1, r["x0"] - 1 : r["x0"] + r["w"] + 1]
        return kernels.bilinear_demosaic(a, p[y % 2, x % 2], ord(channel))

    return map_tiles(tiles, keys, 1, fn, "")


def deconvolve(tiles: DataFrame, keys: list[str], psf: np.ndarray, rounds: int = 10) -> DataFrame:
    halo = 2 * max(psf.shape)
    return map_tiles(tiles, keys, halo, lambda a, _: kernels.richardson_lucy(a, psf, rounds)[halo:-halo, halo:-halo], "")


def detect_stars(tiles: DataFrame, keys: list[str], r: int = 3, threshold: float = 8.0) -> DataFrame:
    """(keys, y, x, flux, fwhm, ellipticity) of stars, with windowed centroids."""
    fn = lambda a, t: [(t["y0"] + cy, t["x0"] + cx, flux, fwhm, e) for _, _, cy, cx, flux, fwhm, e in kernels.stars(a, r, threshold)]
    return map_tiles(tiles, keys, r, fn, "y double, x double, flux double, fwhm double, ellipticity double", rows=True)


def restore(exposures: DataFrame, keys: list[str], frame: str, kernel: str, variance: float, rounds: int = 40) -> DataFrame:
    """Tiles restored from all exposures of the same place: rows (keys, frame, tile..., kernel: array<double> of k squared values).

    A group is one tile of every exposure; its size is the number of exposures times that of a tile.
    """

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(frame)
        r = group.iloc[0]
        y = np.stack([np.frombuffer(d, np.float32).reshape(r.h, r.w) for d in group["data"]]).astype(float)
        k = int(round(len(r[kernel]) ** 0.5))
        x, _ = kernels.mm_restore(np.nan_to_num(y), np.full(y.shape, variance), np.isfinite(y), np.stack([np.reshape(v, (k, k)) for v in group[kernel]]), rounds)
        return pd.DataFrame([[*key, r.y0, r.x0, r.h, r.w, x.astype(np.float32).tobytes()]], columns=[*keys, *COLUMNS])

    types = ", ".join(f"{k} {exposures.schema[k].dataType.simpleString()}" for k in keys)
    return exposures.groupBy(*keys, "ty", "tx").applyInPandas(build, f"{types}, ty int, tx int, y0 int, x0 int, h int, w int, data binary")
