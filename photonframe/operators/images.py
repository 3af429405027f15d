"""Operators on images as pixel tables (keys, y, x, v) or tiles: local contrast, wavelet planes, local planes, distances, connected regions.

No image is gathered: histograms are aggregations, neighbourhoods are tiles with halos, distances are one pass over columns and one over
rows, and regions are labelled inside tiles and joined along tile borders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonframe.operators import kernels, ranks, tiles
from photonframe.sources import shared

#: The median absolute value of a normal deviate (a fixed value).
MAD_NORMAL = 0.6745


def complete(pixels: DataFrame, keys: list[str], fill: float | None = None) -> DataFrame:
    """Pixels with a row for every place up to the image's last row and column; missing or null values are `fill`."""
    extent = pixels.groupBy(*keys).agg(F.max("y").alias("__y"), F.max("x").alias("__x"))
    lines = extent.select(*keys, "__x", F.explode(F.sequence(F.lit(0), F.col("__y").cast("int"))).alias("y"))
    grid = lines.select(*keys, "y", F.explode(F.sequence(F.lit(0), F.col("__x").cast("int"))).alias("x"))
    given = pixels.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("y").cast("int").alias("__y"), F.col("x").cast("int").alias("__x"), *(c for c in pixels.columns if c not in (*keys, "y", "x")))
    on = (F.col("y") == F.col("__y")) & (F.col("x") == F.col("__x"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = grid.join(given, on, "left").drop("__y", "__x", *(f"__k{i}" for i in range(len(keys))))
    return out if fill is None else out.withColumn("v", F.coalesce("v", F.lit(float(fill))))


def local_contrast(pixels: DataFrame, keys: list[str], size: int, clip: float = 1.5, bins: int = 64, amount: float = 1.0) -> DataFrame:
    """Pixels (values 0 to 1) with `out`: contrast-limited equalisation against the histograms of tiles of `size` pixels, each pixel mixed from
    those of the four tiles whose centres surround it, then blended with the pixel by `amount`.

    A tile's histogram is an aggregation with partial sums, its counts are cut at `clip` times their mean, the excess is spread evenly, and
    the sums up to each bin are its table. A pixel joins one row: the tables of its four tiles. Tiles without pixels have no say."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("v") * bins))).cast("int")
    df = pixels.withColumn("__b", b)
    t = lambda c: F.floor(F.col(c) / size).cast("int")
    counts = df.filter("v is not null").groupBy(*keys, t("y").alias("__ty"), t("x").alias("__tx"), "__b").agg(F.count(F.lit(1)).alias("__c"))
    hist = counts.groupBy(*keys, "__ty", "__tx").agg(F.map_from_entries(F.collect_list(F.struct("__b", "__c"))).alias("__h"), F.sum("__c").alias("__n"))
    limit = F.greatest(F.lit(1.0), clip * F.col("__n") / bins)
    # map lookups of bins without pixels give null.
    full = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("__h", i), F.lit(0)).cast("double"))
    hist = hist.withColumn("__full", full).withColumn("__limit", limit)
    excess = F.aggregate("__full", F.lit(0.0), lambda a, c: a + F.greatest(F.lit(0.0), c - F.col("__limit")))
    cut = F.transform("__full", lambda c: F.least(c, F.col("__limit")) + F.col("__more") / bins)
    sums = F.aggregate("__cut", F.array().cast("array<double>"), lambda a, c: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + c / F.col("__n"))))
    tables = hist.withColumn("__more", excess).withColumn("__cut", cut).select(*keys, "__ty", "__tx", sums.alias("__table"))
    # Each tile is a corner of the four cells between tile centres that touch it.
    corners = tables.withColumn("__dy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__dx", F.explode(F.array(F.lit(0), F.lit(1))))
    corners = corners.withColumn("__cy", F.col("__ty") - F.col("__dy")).withColumn("__cx", F.col("__tx") - F.col("__dx"))
    of = lambda dy, dx: F.max(F.when((F.col("__dy") == dy) & (F.col("__dx") == dx), F.col("__table"))).alias(f"__t{dy}{dx}")
    cells = corners.groupBy(*keys, "__cy", "__cx").agg(*(of(dy, dx) for dy in (0, 1) for dx in (0, 1)))
    at = lambda c: (F.col(c) + 0.5) / size - 0.5
    df = df.withColumn("__cy", F.floor(at("y")).cast("int")).withColumn("__cx", F.floor(at("x")).cast("int"))
    df = df.withColumn("__wy", at("y") - F.col("__cy")).withColumn("__wx", at("x") - F.col("__cx"))
    met = ranks.by_group(df, cells, [*keys, "__cy", "__cx"])
    top, weight = F.lit(0.0), F.lit(0.0)
    for dy in (0, 1):
        for dx in (0, 1):
            w = (F.col("__wy") if dy else 1 - F.col("__wy")) * (F.col("__wx") if dx else 1 - F.col("__wx"))
            value = F.get(F.col(f"__t{dy}{dx}"), F.col("__b"))
            top, weight = top + F.coalesce(w * value, F.lit(0.0)), weight + F.when(value.isNotNull(), w).otherwise(0.0)
    return met.withColumn("out", (1 - amount) * F.col("v") + amount * top / weight).select(*pixels.columns, "out")


def _planes(cut: DataFrame, keys: list[str], halo: int, fn: Callable[[np.ndarray], list[np.ndarray]], border: str = "reflect") -> DataFrame:
    """(keys, scale, y, x, v) of the arrays that fn makes of every padded tile, in double precision."""

    def made(a: np.ndarray, t: dict) -> list[tuple]:
        return [(j, t["y0"], t["x0"], t["h"], t["w"], np.ascontiguousarray(w).tobytes()) for j, w in enumerate(fn(a))]

    rows = tiles.map_tiles(cut, keys, halo, made, "scale int, y0 int, x0 int, h int, w int, data binary", rows=True, border=border)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                y, x = np.mgrid[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]
                yield pd.DataFrame({**{k: [getattr(r, k)] * y.size for k in keys}, "scale": r.scale, "y": y.ravel(), "x": x.ravel(), "v": np.frombuffer(r.data)})

    types = ", ".join(f"{k} {cut.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(run, f"{types}, scale int, y int, x int, v double")


def local_linear(cut: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """(keys, y, x, v) of local linear regression with Gaussian weights on tiles. Beyond the image and where pixels are missing nothing weighs,
    so that edges keep their slope; places with nothing near have no row."""
    out = _planes(cut, keys, kernels.gaussian_reach(sigma), lambda a: [kernels.local_linear(a, sigma)], "missing")
    return out.filter("v is not null and not isnan(v)").drop("scale")


def starlet(cut: DataFrame, keys: list[str], scales: int) -> DataFrame:
    """(keys, scale, y, x, v) of the wavelet planes of tiles, the smooth rest as scale `scales`; all scales from one exchange of halos, which grow
    with the scale: a tile must be `kernels.starlet_reach` wide, where the image has more than one."""
    return _planes(cut, keys, kernels.starlet_reach(scales), lambda a: kernels.starlet(a, scales))


def scale_noise(planes: DataFrame, keys: list[str], scales: int) -> DataFrame:
    """(keys, scale, sigma): the noise of each plane but the rest, from the median absolute coefficient."""
    fine = planes.filter(F.col("scale") < scales)
    return ranks.quantiles(fine, [*keys, "scale"], F.abs(F.col("v")), {"sigma": 0.5}).select(*keys, "scale", (F.col("sigma") / MAD_NORMAL).alias("sigma"))


def denoised(planes: DataFrame, keys: list[str], scales: int, thresholds: list[float]) -> DataFrame:
    """(keys, y, x, v): planes shrunk towards 0 by a multiple of their noise, scale by scale, and summed."""
    planes = shared.kept(planes, "planes")
    noise = scale_noise(planes, keys, scales)
    limit = F.element_at(F.array(*(F.lit(float(t)) for t in thresholds), F.lit(0.0)), F.least(F.col("scale"), F.lit(len(thresholds))) + 1) * F.coalesce("sigma", F.lit(0.0))
    met = ranks.by_group(planes, noise, [*keys, "scale"], "left")
    shrunk = F.signum("v") * F.greatest(F.lit(0.0), F.abs(F.col("v")) - limit)
    return met.groupBy(*keys, "y", "x").agg(F.sum(shrunk).alias("v"))


def nearest_seed(pixels: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """Every place of the image with its nearest seed (`sy`, `sx`; of equally near ones the first column, then row) and the squared distance `d2`; null
    in images without a seed. Exact: a window over each column finds the seeds above and below, then each row takes the lower envelope of
    the columns' parabolas. Only a column or a row meets in a task."""
    grid = complete(pixels.select(*keys, "y", "x", F.col(seed).alias("__s")), keys)
    column = Window.partitionBy(*keys, "x").orderBy("y")
    own = F.when(F.coalesce("__s", F.lit(False)), F.col("y"))
    above = F.last(own, True).over(column)
    below = F.first(own, True).over(column.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = F.when(above.isNull() | (below - F.col("y") < F.col("y") - above), below).otherwise(above)
    lines = grid.withColumn("sy", near).select(*keys, "y", "x", "sy")

    def envelope(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        sy = rows["sy"].to_numpy(float)
        at = kernels.nearest_in_row(np.abs(sy - key[-1]))
        none = at < 0
        sx, sy = at.astype(float), sy[at]
        d2 = (rows["x"].to_numpy() - sx) ** 2 + (key[-1] - sy) ** 2
        cut = lambda a: pd.array(np.where(none, 0, np.nan_to_num(a)), dtype="Int64").copy()
        out = {c: cut(a) for c, a in (("sy", sy), ("sx", sx), ("d2", d2))}
        for a in out.values():
            a[none] = pd.NA
        return pd.DataFrame({**{k: [v] * len(rows) for k, v in zip([*keys, "y"], key)}, "x": rows["x"].to_numpy(), **out})

    types = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    return lines.groupBy(*keys, "y").applyInPandas(envelope, f"{types}, y int, x int, sy int, sx int, d2 long")


def filled(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Every place of the image with `v`, where that is missing that of the nearest pixel that has one, and `d2`."""
    near = nearest_seed(pixels.withColumn("__has", F.col("v").isNotNull()), keys, "__has")
    source = pixels.filter("v is not null").select(*keys, F.col("y").cast("int").alias("sy"), F.col("x").cast("int").alias("sx"), "v")
    return near.join(source, [*keys, "sy", "sx"], "left").select(*keys, "y", "x", "v", "d2")


def regions(pixels: DataFrame, keys: list[str], mask: str, size: int = 256) -> DataFrame:
    """The pixels of a mask with `region`, the first pixel (y * 2^31 + x) of the connected region (pixels that share a side). A tile labels
    its own pixels; labels that meet across a tile border are joined. No task holds more than a tile, whatever a region's size."""
    inside = pixels.filter(mask).select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    tiled = inside.withColumn("__ty", F.floor(F.col("y") / size).cast("int")).withColumn("__tx", F.floor(F.col("x") / size).cast("int"))

    def label(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = key[-2] * size, key[-1] * size
        y, x = rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0
        m = np.zeros((size, size), bool)
        m[y, x] = True
        at = kernels.regions(m)[y, x]
        first = (y0 + at // size).astype(np.int64) * (1 << 31) + x0 + at % size
        return pd.DataFrame({**{k: [v] * len(rows) for k, v in zip(keys, key)}, "y": rows["y"], "x": rows["x"], "region": first})

    types = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    labelled = shared.kept(tiled.groupBy(*keys, "__ty", "__tx").applyInPandas(label, f"{types}, y int, x int, region long"), "regions")
    border = lambda c: F.pmod(F.col(c), F.lit(size))
    rim = labelled.filter((border("y") == 0) | (border("x") == 0)).select(*keys, "y", "x", F.col("region").alias("b"))
    # Each border pixel looks for the one before it in the tile above or to the left.
    looks = rim.filter(border("y") == 0).withColumn("y", F.col("y") - 1).unionByName(rim.filter(border("x") == 0).withColumn("x", F.col("x") - 1))
    edges = looks.join(labelled.withColumnRenamed("region", "a"), [*keys, "y", "x"]).select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    names = joined(edges, keys)
    return labelled.join(names, [*keys, "region"], "left").select(*keys, "y", "x", F.coalesce("name", "region").alias("region"))


def joined(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, region, name) of the labels in edges (keys, a, b): the least label that each is connected with. Each round every label takes the
    least of its neighbours, chains of these are followed to their ends by doubling, and edges between different ends remain: at most
    half of the labels. Every round is a table in the shared folder."""
    edges = shared.kept(edges.filter("a <> b"), "edges")
    names: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        jump = shared.kept(both.groupBy(*keys, "a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "jumps")
        while True:
            ends = jump.select(*keys, F.col("a").alias("to"), F.col("to").alias("end"))
            further = shared.kept(jump.join(ends, [*keys, "to"], "left").select(*keys, "a", F.coalesce("end", "to").alias("to"), (F.col("end") < F.col("to")).alias("moved")), "jumps")
            jump, moved = further.drop("moved"), further.filter("moved").isEmpty()
            if moved:
                break
        roots = jump.select(*keys, F.col("a").alias("region"), F.col("to").alias("root"))
        if names is None:
            names = roots.withColumnRenamed("root", "name")
        else:
            again = names.join(roots.withColumnRenamed("region", "name"), [*keys, "name"], "left")
            names = again.select(*keys, "region", F.coalesce("root", "name").alias("name"))
        names = shared.kept(names, "names")
        for side in ("a", "b"):
            edges = edges.join(roots.withColumnRenamed("region", side).withColumnRenamed("root", "__r"), [*keys, side]).drop(side).withColumnRenamed("__r", side)
        edges = shared.kept(edges.filter("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if names is None:
        return edges.select(*keys, F.col("a").alias("region"), F.col("b").alias("name"))
    return names
