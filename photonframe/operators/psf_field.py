"""Point-spread functions that vary over the field: fitted from star stamps, held at a grid of nodes, mixed bilinearly between them.

The fit of every kernel pixel is a weighted regression on the star's position whose normal equations are sums over stars: one aggregation with
partial sums, after which a kernel pixel is one small system. No task gathers a star's stamp or a frame's stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonframe.operators import ranks, tiles

#: Values of a field's kernels that travel with the tasks at most (64 MB).
FIELD_VALUES = 8_000_000


def nodes(height: int, width: int, spacing: float) -> tuple[list[float], list[float]]:
    """Rows and columns of the nodes: evenly from edge to edge, at most `spacing` apart, two at least."""
    grid = lambda n: np.linspace(0, n - 1, max(2, int(np.ceil((n - 1) / spacing)) + 1)).tolist()
    return grid(height), grid(width)


def powers(degree: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]


def _terms(y, x, height: int, width: int, degree: int) -> list:
    """The polynomial's terms at a position, scaled to -1 to 1; columns or numbers."""
    u, v = 2.0 * x / max(width - 1, 1) - 1, 2.0 * y / max(height - 1, 1) - 1
    out = []
    for i, j in powers(degree):
        t = u**0 if isinstance(u, float) else F.lit(1.0)
        for _ in range(i):
            t = t * u
        for _ in range(j):
            t = t * v
        out.append(t)
    return out


def neighbours_subtracted(stamps: DataFrame, stars: DataFrame, kernel: DataFrame, keys: list[str], half: int) -> DataFrame:
    """Stamps (keys, star_id, dy, dx, v) less what the other stars (keys, star_id, y, x, flux; whole pixels) put there, by a mean kernel (keys, dy, dx, v).
    Stars meet by grid cells as wide as a stamp, in nine of which a neighbour can be."""
    cell = 2 * half + 1
    at = lambda c: F.floor(F.col(c) / cell)
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    near = stars.select(*keys, F.col("star_id").alias("n_id"), F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("flux").alias("n_flux"))
    near = near.withColumn("__a", F.explode(steps)).withColumn("__b", F.explode(steps)).withColumn("__cy", at("ny") + F.col("__a")).withColumn("__cx", at("nx") + F.col("__b")).drop("__a", "__b")
    own = stars.select(*keys, "star_id", "y", "x").withColumn("__cy", at("y")).withColumn("__cx", at("x"))
    pairs = own.join(near, [*keys, "__cy", "__cx"]).filter(F.col("star_id") != F.col("n_id"))
    pairs = pairs.filter((F.abs(F.col("ny") - F.col("y")) <= 2 * half) & (F.abs(F.col("nx") - F.col("x")) <= 2 * half))
    pairs = pairs.select(*keys, "star_id", (F.col("ny") - F.col("y")).alias("oy"), (F.col("nx") - F.col("x")).alias("ox"), "n_flux")
    # The neighbour's kernel, moved onto the star's stamp.
    light = pairs.join(kernel.select(*keys, F.col("dy").alias("ky"), F.col("dx").alias("kx"), F.col("v").alias("kv")), keys) if keys else pairs.crossJoin(F.broadcast(kernel.select(F.col("dy").alias("ky"), F.col("dx").alias("kx"), F.col("v").alias("kv"))))
    light = light.withColumn("dy", F.col("ky") + F.col("oy")).withColumn("dx", F.col("kx") + F.col("ox")).filter((F.abs("dy") <= half) & (F.abs("dx") <= half))
    light = light.groupBy(*keys, "star_id", "dy", "dx").agg(F.sum(F.col("n_flux") * F.col("kv")).alias("__light"))
    return stamps.join(light, [*keys, "star_id", "dy", "dx"], "left").withColumn("v", F.col("v") - F.coalesce("__light", F.lit(0.0))).drop("__light")


def fit(stamps: DataFrame, keys: list[str], height: int, width: int, degree: int = 2, weight: Column | None = None, clip: float | None = 3.0, rounds: int = 2) -> DataFrame:
    """(keys, dy, dx, coefs, scatter, stars): each kernel pixel as a polynomial of the star's position, from stamps (keys, star_id, y, x, dy, dx, v) of unit
    light. With `clip`, values further from the model than so many times its scatter leave, `rounds` times."""
    count = len(powers(degree))
    rows = stamps.withColumn("__w", F.lit(1.0) if weight is None else weight).withColumn("__t", F.array(*_terms(F.col("y"), F.col("x"), height, width, degree)))
    for k in range(1 + (rounds if clip is not None else 0)):
        t = [F.col("__t")[i] for i in range(count)]
        # All values weigh as much as the first round's clipping leaves; a value that left weighs nothing.
        sums = [F.sum(F.col("__w") * t[i] * t[j]) for i in range(count) for j in range(i, count)] + [F.sum(F.col("__w") * t[i] * F.col("v")) for i in range(count)]
        total = rows.groupBy(*keys, "dy", "dx").agg(F.array(*sums).alias("__sums"), F.sum(F.col("__w") * F.col("v") * F.col("v")).alias("__vv"), F.sum("__w").alias("__sw"), F.count(F.when(F.col("__w") > 0, 1)).alias("stars"))
        coefs = total.mapInPandas(_solver(count), ", ".join([*(f"{k} {stamps.schema[k].dataType.simpleString()}" for k in keys), f"dy {stamps.schema['dy'].dataType.simpleString()}", f"dx {stamps.schema['dx'].dataType.simpleString()}", "coefs array<double>, scatter double, stars long"]))
        if clip is None or k == rounds:
            return coefs
        met = ranks.by_group(rows, coefs.select(*keys, "dy", "dx", "coefs", "scatter"), [*keys, "dy", "dx"])
        model = sum((F.col("coefs")[i] * F.col("__t")[i] for i in range(1, count)), F.col("coefs")[0] * F.col("__t")[0])
        rows = met.withColumn("__w", F.when(F.abs(F.col("v") - model) <= clip * F.col("scatter") + 1e-12, F.col("__w")).otherwise(0.0)).drop("coefs", "scatter")


def _solver(count: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = [(i, j) for i in range(count) for j in range(i, count)]
        for frame in frames:
            out = []
            for s, vv, sw in zip(frame["__sums"], frame["__vv"], frame["__sw"]):
                a, b = np.zeros((count, count)), np.asarray(s[len(upper) :], float)
                for (i, j), v in zip(upper, s):
                    a[i, j] = a[j, i] = v
                # A ridge on all but the mean keeps pixels that few stars have solvable.
                a[np.arange(1, count), np.arange(1, count)] += 1e-6 * max(a[0, 0], 1e-30)
                c = np.linalg.solve(a, b) if a[0, 0] > 0 else np.zeros(count)
                left = vv - 2 * c @ b + c @ a @ c if a[0, 0] > 0 else 0.0
                out.append((c.tolist(), float(np.sqrt(max(left, 0) / sw)) if sw > 0 else 0.0))
            yield frame.drop(columns=["__sums", "__vv", "__sw"]).assign(coefs=[c for c, _ in out], scatter=[s for _, s in out])[[*frame.columns[: frame.columns.get_loc("dx") + 1], "coefs", "scatter", "stars"]]

    return run


def node_kernels(coefs: DataFrame, keys: list[str], height: int, width: int, spacing: float, degree: int = 2, support: float | None = None) -> DataFrame:
    """(keys, iy, ix, dy, dx, v): the kernel at every node, nothing beyond `support` pixels or below 0, of unit sum."""
    ys, xs = nodes(height, width, spacing)
    grid = F.array(*(F.struct(F.lit(i).alias("iy"), F.lit(j).alias("ix"), F.array(*(F.lit(float(t)) for t in _terms(float(y), float(x), height, width, degree))).alias("t")) for i, y in enumerate(ys) for j, x in enumerate(xs)))
    each = coefs.select(*keys, "dy", "dx", "coefs", F.explode(grid).alias("n"))
    value = sum((F.col("coefs")[i] * F.col("n.t")[i] for i in range(1, len(powers(degree)))), F.col("coefs")[0] * F.col("n.t")[0])
    if support is not None:
        value = F.when(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= support * support, value).otherwise(0.0)
    each = each.select(*keys, F.col("n.iy").alias("iy"), F.col("n.ix").alias("ix"), "dy", "dx", F.greatest(F.lit(0.0), value).alias("v"))
    total = each.groupBy(*keys, "iy", "ix").agg(F.sum("v").alias("__s"))
    return ranks.by_group(each, total, [*keys, "iy", "ix"]).select(*keys, "iy", "ix", "dy", "dx", (F.col("v") / F.col("__s")).alias("v"))


def collected(kernels: DataFrame, half: int) -> np.ndarray:
    """The kernels of one field (iy, ix, dy, dx, v) as an array over nodes and offsets; an error beyond FIELD_VALUES."""
    size = kernels.agg(F.max("iy").alias("y"), F.max("ix").alias("x")).first()
    if (size.y + 1) * (size.x + 1) * (2 * half + 1) ** 2 > FIELD_VALUES:
        raise ValueError("a field of kernels this large does not travel with the tasks: take fewer nodes or smaller kernels")
    out = np.zeros((size.y + 1, size.x + 1, 2 * half + 1, 2 * half + 1))
    for r in kernels.toLocalIterator():
        out[r.iy, r.ix, r.dy + half, r.dx + half] = r.v
    return out


def shares(at: np.ndarray, places: list[float]) -> np.ndarray:
    """The bilinear weight of every node (second axis) at positions, beyond the outermost nodes as at these."""
    at = np.clip(at, places[0], places[-1])
    i = np.clip(np.searchsorted(places, at, "right") - 1, 0, len(places) - 2)
    p = np.asarray(places)
    f = (at - p[i]) / (p[i + 1] - p[i])
    out = np.zeros((len(at), len(places)))
    out[np.arange(len(at)), i] = 1 - f
    out[np.arange(len(at)), i + 1] += f
    return out


def convolve(cut: DataFrame, keys: list[str], field: np.ndarray, height: int, width: int, spacing: float) -> DataFrame:
    """Tiles in which every pixel's light is spread by the kernel of its own place. A tile takes only the nodes that its pixels lie between; each is one
    convolution of the pixels times their share of that node. Pixels that are not numbers, or beyond the image, give no light."""
    half = field.shape[2] // 2
    ys, xs = nodes(height, width, spacing)
    if field.shape[:2] != (len(ys), len(xs)):
        raise ValueError("the field has another number of nodes")

    def fn(a: np.ndarray, t: dict) -> np.ndarray:
        a = np.nan_to_num(a)
        wy = shares(np.arange(t["y0"] - half, t["y0"] + t["h"] + half), ys)
        wx = shares(np.arange(t["x0"] - half, t["x0"] + t["w"] + half), xs)
        out = np.zeros((t["h"], t["w"]))
        for i in np.flatnonzero(wy.any(0)):
            for j in np.flatnonzero(wx.any(0)):
                part = a * wy[:, i, None] * wx[None, :, j]
                for dy in range(-half, half + 1):
                    for dx in range(-half, half + 1):
                        if k := field[i, j, dy + half, dx + half]:
                            out += k * part[half - dy : half - dy + t["h"], half - dx : half - dx + t["w"]]
        return out

    return tiles.map_tiles(cut, keys, half, fn, "", border="missing")
