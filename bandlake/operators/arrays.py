"""Pixel arrays in tasks, on numpy: what whole arrays need at once stays vectorised, in 32-bit arithmetic like the column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, FloatType, StructField, StructType

from ..session import in_tasks

_ONE, _HALF = np.float32(1), np.float32(0.5)


def values(row: pa.Scalar) -> np.ndarray:
    """A list's numbers as 32-bit floats, nulls as 0."""
    return np.zeros(0, np.float32) if not row.is_valid else row.values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32, copy=False)


def resampled(px: np.ndarray, width: int, height: int, to_width: int, to_height: int) -> np.ndarray:
    """Bilinear at half-pixel centres; the same size is the same array."""
    if (width, height) == (to_width, to_height):
        return px

    def axis(size: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(to, dtype=np.float32) + _HALF) * (np.float32(size) / np.float32(to)) - _HALF
        low = np.floor(at)
        first = np.clip(low, 0, size - 1).astype(np.int64)
        return first, np.minimum(first + 1, size - 1), np.clip(at - low, np.float32(0), _ONE)

    grid = px.reshape(height, width)
    x0, x1, fx = axis(width, to_width)
    y0, y1, fy = axis(height, to_height)
    out = np.empty((to_height, to_width), np.float32)
    for at in range(0, to_height, 256):  # strips of rows bound the memory
        rows = slice(at, at + 256)
        above, below, part = grid[y0[rows]], grid[y1[rows]], fy[rows, None]
        out[rows] = (above[:, x0] * (_ONE - fx) + above[:, x1] * fx) * (_ONE - part) + (below[:, x0] * (_ONE - fx) + below[:, x1] * fx) * part
    return out.ravel()


def quantized(px: np.ndarray) -> np.ndarray:
    """Bytes of 0..1, cut; what is no number counts as 0."""
    return (np.clip(np.nan_to_num(px, nan=0.0), 0, 1).astype(np.float32) * np.float32(255)).astype(np.uint8)


def interleaved(channels: list[bytes | None], pixels: int, fill: tuple[int, ...]) -> bytes:
    """Bytes of the channels side by side; an absent channel is its fill, absent pixels are 0."""
    out = np.zeros((pixels, len(channels)), np.uint8)
    for k, channel in enumerate(channels):
        if channel is None:
            out[:, k] = fill[k]
        else:
            own = np.frombuffer(channel, np.uint8)[:pixels]
            out[: len(own), k] = own
    return out.tobytes()


def mapped(df: DataFrame, function: Callable, name: str, type_: DataType, *columns: Column | str) -> DataFrame:
    """``df`` with ``name`` = ``function`` of the Arrow scalars of ``columns``, row by row in tasks; the column may be there before."""
    kept = [c for c in df.columns if c != name]
    cols = df.select(F.struct(*kept).alias("kept"), *[(F.col(c) if isinstance(c, str) else c).alias(f"a{k}") for k, c in enumerate(columns)])
    schema = StructType([cols.schema["kept"], StructField("made", type_)])
    arrow = {FloatType: pa.float32(), BinaryType: pa.binary()}
    item = pa.list_(arrow[type(type_.elementType)]) if isinstance(type_, ArrayType) else arrow[type(type_)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 16):  # arrays may be large
                part = batch.slice(at, 16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([function(*row) for row in zip(*part.columns[1:], strict=True)], item)], names=["kept", "made"])

    made = cols.transform(in_tasks, run, schema)
    return made.select(*[F.col("made").alias(c) if c == name else F.col("kept")[c].alias(c) for c in (df.columns if name in df.columns else [*df.columns, name])])
