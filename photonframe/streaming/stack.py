"""Integration of frames as they arrive: keyed state per tile holds what every pixel needs, so that a frame is read once and then gone.

A pixel's state: the exact count, mean and sum of squared deviations, and BINS intervals of values that lie apart, each with its count, sum, sum
of squares, least and greatest value. A value outside all intervals becomes one of its own, and of too many the two that make the narrowest
one are joined, so outliers stay apart from the bulk. Means are exact. A clipped mean is exact but for intervals that hold a clipping limit:
they count by their own mean, and `error` states how far the result moves if in every pass all of them are kept, or all left out, or if
each of their values in the last pass is misjudged. State is 24 + 40 BINS bytes for each pixel, whatever the number of frames.

Frames may come late and in any order: merging is commutative. A frame that comes again is known by its name and left out, so a producer may
resend after a failure; Spark's checkpoint replays what a lost executor or a restart interrupts. Pixels that are not numbers do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BINS = 24
TILE = "ty int, tx int, y0 int, x0 int, h int, w int"
OUTPUT = f"{TILE}, frames long, mean binary, variance binary, clipped binary, kept binary, error binary"


class Pixels:
    """The state of a tile's pixels."""

    def __init__(self, size: int, bins: int = BINS):
        self.count, self.mean, self.squares = np.zeros(size), np.zeros(size), np.zeros(size)
        # Count, sum, sum of squares, least and greatest value of each interval, in ascending order; unused ones last.
        self.cells = np.zeros((5, size, bins))
        self.cells[3:] = np.inf

    def add(self, values: np.ndarray) -> None:
        """One frame's values. Their order does not change the moments, and the intervals only in how values are grouped."""
        at = np.flatnonzero(np.isfinite(values))
        v = values[at].astype(float)
        self.count[at] += 1
        delta = v - self.mean[at]
        self.mean[at] += delta / self.count[at]
        self.squares[at] += delta * (v - self.mean[at])
        inside = (self.cells[3, at] <= v[:, None]) & (v[:, None] <= self.cells[4, at])
        held = inside.any(1)
        place = inside[held].argmax(1)
        for k, x in enumerate((np.ones(held.sum()), v[held], v[held] ** 2)):
            self.cells[k, at[held], place] += x
        self._insert(at[~held], v[~held])

    def _insert(self, at: np.ndarray, v: np.ndarray) -> None:
        """Values outside all intervals of their pixels."""
        one = np.stack([np.ones(len(v)), v, v * v, v, v])[:, :, None]
        cells = np.concatenate([self.cells[:, at], one], axis=2)
        order = np.argsort(cells[3], axis=1, kind="stable")
        cells = np.take_along_axis(cells, order[None], axis=2)
        full = cells[0, :, -1] > 0
        self.cells[:, at[~full]] = cells[:, ~full, :-1]
        cells = cells[:, full]
        if cells.shape[1]:
            j = (cells[4, :, 1:] - cells[3, :, :-1]).argmin(1)
            rows = np.arange(len(j))
            joined = np.concatenate([cells[:3, rows, j] + cells[:3, rows, j + 1], cells[3:4, rows, j], cells[4:, rows, j + 1]])
            skip = np.arange(cells.shape[2] - 1)[None] + (np.arange(cells.shape[2] - 1)[None] > j[:, None])
            cells = np.take_along_axis(cells, skip[None], axis=2)
            cells[:, rows, j] = joined
            self.cells[:, at[full]] = cells

    def clipped(self, low: float, high: float, passes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clipped mean, values kept and the stated error. Each pass keeps what lies within mean - low sigma to mean + high sigma."""
        n, total, squares, least, most = self.cells
        centres = total / np.maximum(n, 1)
        means = []
        with np.errstate(invalid="ignore", divide="ignore"):
            for first, last in ((centres, centres), (most, least), (least, most)):
                # By an interval's mean; if any of it lies within; only if all of it does.
                keep = n > 0
                for _ in range(passes):
                    kept = (n * keep).sum(1)
                    mean = (total * keep).sum(1) / kept
                    sigma = np.sqrt(np.maximum((squares * keep).sum(1) / kept - mean**2, 0))
                    slack = 1e-12 * np.maximum(np.abs(mean), 1) + 1e-7 * sigma
                    a, b = (mean - low * sigma - slack)[:, None], (mean + high * sigma + slack)[:, None]
                    keep &= (first >= a) & (last <= b)
                means.append((total * keep).sum(1) / (n * keep).sum(1))
                if len(means) == 1:
                    count = (n * keep).sum(1)
                    unsure = (n * (((least < a) & (most >= a)) | ((least <= b) & (most > b)))).sum(1)
                    spread = unsure * np.maximum(means[0] - a[:, 0], b[:, 0] - means[0]) / np.maximum(count - unsure, 1)
            error = np.fmax(spread, np.fmax(np.abs(means[1] - means[0]), np.abs(means[2] - means[0])))
        return means[0], count, error

    def result(self, low: float, high: float, passes: int) -> dict[str, bytes]:
        seen = self.count > 0
        mean, kept, error = self.clipped(low, high, passes)
        blank = lambda a: np.where(seen, a, np.nan).tobytes()
        return {"mean": blank(self.mean), "variance": blank(self.squares / np.maximum(self.count, 1)), "clipped": blank(mean), "kept": np.where(seen, kept, 0).tobytes(), "error": blank(error)}

    def packed(self) -> bytes:
        return np.concatenate([self.count, self.mean, self.squares, self.cells.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, size: int, bins: int) -> Pixels:
        flat = np.frombuffer(data).copy()
        out = cls(0, bins)
        out.count, out.mean, out.squares = flat[: 3 * size].reshape(3, size)
        out.cells = flat[3 * size :].reshape(5, size, bins)
        return out


class _Integration(StatefulProcessor):
    """State of one tile: the packed pixels, and the names of the frames in them."""

    def __init__(self, keys: list[str], frame: str, low: float, high: float, passes: int, bins: int):
        self.keys, self.frame, self.clip, self.bins = keys, frame, (low, high, passes), bins

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pixels = handle.getValueState("pixels", f"{TILE}, frames long, data binary")
        self.names = handle.getMapState("names", "name string", "one boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        state = self.pixels.get() if self.pixels.exists() else None
        place, frames = (tuple(state[:6]), state[6]) if state else (None, 0)
        pixels = Pixels.unpacked(state[7], place[4] * place[5], self.bins) if state else None
        for frame in rows:
            for r in frame.itertuples(index=False):
                name = str(getattr(r, self.frame))
                if self.names.containsKey((name,)):
                    continue
                if pixels is None:
                    place, pixels = (r.ty, r.tx, r.y0, r.x0, r.h, r.w), Pixels(r.h * r.w, self.bins)
                pixels.add(np.frombuffer(r.data, np.float32))
                self.names.updateValue((name,), (True,))
                frames += 1
        place = tuple(int(p) for p in place)
        self.pixels.update((*place, frames, pixels.packed()))
        names = ["ty", "tx", "y0", "x0", "h", "w", "frames"]
        yield pd.DataFrame([{**dict(zip(self.keys, key)), **dict(zip(names, (*place, frames))), **pixels.result(*self.clip)}])

    def close(self) -> None:
        pass


def integrate(frames: DataFrame, keys: list[str], frame: str = "frame", low: float = 4.0, high: float = 3.0, passes: int = 3, bins: int = BINS) -> DataFrame:
    """(keys, tile, frames, mean, variance, clipped, kept, error) of tile rows (keys, frame, ty, tx, y0, x0, h, w, data): arrays of double for the tile's
    pixels. On a stream, the update mode gives every tile that a batch touched, as it now stands; needs the RocksDB state store. On a table, each
    tile once. A tile's frames of one batch stream through its task, which holds one frame and the state."""
    types = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    rows = frames.select(*keys, frame, "ty", "tx", "y0", "x0", "h", "w", "data")
    if frames.isStreaming:
        return rows.groupBy(*keys, "ty", "tx").transformWithStateInPandas(_Integration([*keys, "ty", "tx"], frame, low, high, passes, bins), f"{types}, {OUTPUT}", "Update", "None")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by tile, so one state is held at a time."""
        last, names, pixels, place = None, set(), None, None

        def done() -> pd.DataFrame:
            at = ["ty", "tx", "y0", "x0", "h", "w", "frames"]
            return pd.DataFrame([{**dict(zip([*keys, "ty", "tx"], last)), **dict(zip(at, (*place, len(names)))), **pixels.result(low, high, passes)}], columns=[*keys, *(x.split()[0] for x in OUTPUT.split(", "))])

        for batch in batches:
            for r in batch.itertuples(index=False):
                key = (*(None if (v := getattr(r, k)) is None or v != v else v for k in keys), r.ty, r.tx)
                if key != last:
                    if last is not None:
                        yield done()
                    last, names, place, pixels = key, set(), (r.ty, r.tx, r.y0, r.x0, r.h, r.w), Pixels(r.h * r.w, bins)
                if (name := str(getattr(r, frame))) not in names:
                    names.add(name)
                    pixels.add(np.frombuffer(r.data, np.float32))
        if last is not None:
            yield done()

    sorted_rows = rows.repartition(*keys, "ty", "tx").sortWithinPartitions(*keys, "ty", "tx", frame)
    return sorted_rows.mapInPandas(fold, f"{types}, {OUTPUT}")


def pixels_of(stack: DataFrame, keys: list[str]) -> DataFrame:
    """The long table (keys, y, x, mean, variance, clipped, kept, error) of an integration, without the pixels that no frame has."""
    columns = ("mean", "variance", "clipped", "kept", "error")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                y, x = np.mgrid[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]
                values = {c: np.frombuffer(getattr(r, c)) for c in columns}
                seen = np.isfinite(values["mean"])
                yield pd.DataFrame({**{k: [getattr(r, k)] * int(seen.sum()) for k in keys}, "y": y.ravel()[seen], "x": x.ravel()[seen], **{c: v[seen] for c, v in values.items()}})

    types = ", ".join(f"{k} {stack.schema[k].dataType.simpleString()}" for k in keys)
    return stack.mapInPandas(run, f"{types}, y int, x int, mean double, variance double, clipped double, kept double, error double")
