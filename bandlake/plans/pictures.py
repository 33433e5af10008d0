"""PNG files for the raster queries; test material, no part of the library's sources."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import in_tasks


def _png(width: int, height: int, channels: int, px: list[int]) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    colour = {1: 0, 3: 2, 4: 6}[channels]
    rows = np.array(px, np.uint8).reshape(height, width * channels)
    body = np.concatenate((np.zeros((height, 1), np.uint8), rows), axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def _pngs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_png(*row) for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])


def png_files(images: DataFrame) -> DataFrame:
    """path, content: PNG files of images (path, width, height, channels: 1, 3 or 4, px: interleaved bytes as whole numbers)."""
    return images.select("path", "width", "height", "channels", "px").transform(in_tasks, _pngs, "path string, content binary")
