"""Light of stars whose cores are clipped, and kernels of frames refined against a restored image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonframe.operators import ranks, tiles


def saturated_light(stamps: DataFrame, kernel: DataFrame, keys: list[str], level: float, noise: float = 0.0, least: int = 10) -> DataFrame:
    """(keys, star_id, light, sky, clipped, used) of stamps (keys, star_id, dy, dx, v), clipped at `level`, by a kernel (keys, dy, dx, p) of unit sum.

    Pixels below the level are fitted by least squares as light times kernel plus sky; a clipped pixel says only that it is at least at
    the level, so the light is raised to where the model reaches level - 3 noise at each of them. Null where fewer than `least` pixels are
    left, or where they do not tell light from sky. Two aggregations by star with partial sums: no stamp is gathered."""
    met = ranks.by_group(stamps.filter("v is not null"), kernel, [*keys, "dy", "dx"])
    inside = F.col("v") < level
    one = lambda c: F.sum(F.when(inside, c)).alias
    p, v = F.col("p"), F.col("v")
    sums = met.groupBy(*keys, "star_id").agg(
        F.count(F.when(inside, 1)).alias("used"), F.count(F.when(~inside, 1)).alias("clipped"), one(p)("__p"), one(v)("__v"), one(p * p)("__pp"), one(p * v)("__pv")
    )
    n = F.col("used").cast("double")
    spread = n * F.col("__pp") - F.col("__p") * F.col("__p")
    fitted = sums.withColumn("__f", F.when((F.col("used") >= least) & (spread > 1e-12 * n * F.col("__pp")), (n * F.col("__pv") - F.col("__p") * F.col("__v")) / spread))
    fitted = fitted.withColumn("sky", (F.col("__v") - F.col("__f") * F.col("__p")) / n).select(*keys, "star_id", "used", "clipped", "__f", "sky")
    over = ranks.by_group(met.filter(~inside & (F.col("p") > 0)), fitted.select(*keys, "star_id", "sky"), [*keys, "star_id"])
    bound = over.groupBy(*keys, "star_id").agg(F.max((level - 3 * noise - F.col("sky")) / F.col("p")).alias("__least"))
    out = ranks.by_group(fitted, bound, [*keys, "star_id"], "left")
    return out.select(*keys, "star_id", F.when(F.col("__f").isNotNull(), F.greatest("__f", "__least")).alias("light"), "sky", "clipped", "used")


def simplex(k: np.ndarray) -> np.ndarray:
    """The nearest kernel without negative values and with unit sum."""
    u = np.sort(k)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(k - over[np.flatnonzero(u > over)[-1]], 0)


def accelerated(gram: np.ndarray, right: np.ndarray, start: np.ndarray, rounds: int, stall: float) -> tuple[np.ndarray, int]:
    """The kernel on the simplex with the least k' gram k / 2 - right' k, by proximal gradient steps with momentum, which is dropped where a step goes
    uphill; ends when a step moves less than `stall`, or after `rounds`. Returns the steps taken, too."""
    step = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-30)
    k = y = simplex(start)
    t = 1.0
    for i in range(1, rounds + 1):
        new = simplex(y - step * (gram @ y - right))
        if (y - new) @ (new - k) > 0:
            t, y = 1.0, k
            new = simplex(k - step * (gram @ k - right))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - k)
        moved, k, t = np.abs(new - k).max(), new, t2
        if moved < stall:
            return k, i
    return k, rounds


def refined_kernels(image: DataFrame, frames: DataFrame, keys: list[str], frame: str, half: int, rounds: int = 2000, stall: float = 1e-9) -> DataFrame:
    """(keys, frame, kernel, rounds, residual): for every frame the kernel of unit sum, nowhere negative, that takes the image to it with least squares.

    `image` and `frames` are tiles (keys..., frame for the latter) on one grid; pixels of a frame that are not numbers do not count, and the image
    is 0 beyond its edge. The least-squares problem of a frame is one small matrix: every task adds up those of its tiles, and what
    tasks have is added by frame, so no frame is gathered; then each frame's steps are local. `rounds` of the result equal to the
    bound says that the stall rule was not met. `residual` is the sum of squares that remains."""
    size = 2 * half + 1
    padded = tiles.map_tiles(image, keys, half, lambda a, t: [(t["ty"], t["tx"], np.nan_to_num(a).tobytes())], "__ty int, __tx int, around binary", rows=True, border="missing")
    named = padded.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__ty", "__tx", "around")
    on = (F.col("ty") == F.col("__ty")) & (F.col("tx") == F.col("__tx"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    pairs = frames.join(named, on).select(*keys, frame, "h", "w", "data", "around")
    names = [*keys, frame]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                y = np.frombuffer(r.data, np.float32).reshape(r.h, r.w).astype(float)
                a = np.frombuffer(r.around).reshape(r.h + 2 * half, r.w + 2 * half)
                known = np.isfinite(y)
                # Row p of x: the pixel that offset (dy, dx) of the kernel brings to a place.
                x = np.stack([a[half - dy : half - dy + r.h, half - dx : half - dx + r.w][known] for dy in range(-half, half + 1) for dx in range(-half, half + 1)])
                full = np.concatenate([x, y[known][None]])
                key = tuple(getattr(r, n) for n in names)
                sums[key] = sums.get(key, 0) + full @ full.T
        yield pd.DataFrame([[*k, m.ravel().tolist()] for k, m in sums.items()], columns=[*names, "sums"])

    types = ", ".join(f"{n} {frames.schema[n].dataType.simpleString()}" for n in names)

    def solve(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        m = np.sum(np.stack(parts["sums"].to_numpy()), axis=0).reshape(size * size + 1, -1)
        gram, right = m[:-1, :-1], m[:-1, -1]
        k, taken = accelerated(gram, right, np.full(size * size, 1 / size**2), rounds, stall)
        return pd.DataFrame([[*key, k.tolist(), taken, float(max(0.0, m[-1, -1] - 2 * k @ right + k @ gram @ k))]], columns=[*names, "kernel", "rounds", "residual"])

    return pairs.mapInPandas(add, f"{types}, sums array<double>").groupBy(*names).applyInPandas(solve, f"{types}, kernel array<double>, rounds int, residual double")
