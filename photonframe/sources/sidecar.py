"""Strict JSON side files and pictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonframe.operators import kernels


def cleaned(c: Column, kind: T.DataType) -> Column:
    """A value without not-a-number or infinite parts, which become null, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: cleaned(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: cleaned(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(cleaned(c[f.name], f.dataType).alias(f.name) for f in kind)))
    return c


def write_sidecars(df: DataFrame, path: str) -> None:
    """One strict JSON document a row."""
    df.select(*(cleaned(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema)).write.option("ignoreNullFields", "false").json(path)


def pictures(images: DataFrame, depth: int = 8) -> DataFrame:
    """(name, png) of rows (name, h, w, data: float32 of h, w and three channels in 0 to 1)."""
    top = 2**depth - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.float32).reshape(r["h"], r["w"], 3)
                out = kernels.png((np.clip(np.nan_to_num(a), 0, 1) * top + 0.5).astype(np.uint16 if depth == 16 else np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([r["name"]]), pa.array([out], pa.binary())], ["name", "png"])

    return images.select("name", "h", "w", "data").mapInArrow(run, "name string, png binary")
