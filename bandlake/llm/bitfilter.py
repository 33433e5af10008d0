"""A bit filter of fixed size over 64-bit hashes: it may keep too much, never too little, so exact joins follow it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**24 cells: 2 MB on the driver and in each worker, whatever the input; a full filter keeps everything.
BITS = 24


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many leading underscores as it takes to differ from ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def cell(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BITS)


def _words(hashes: DataFrame, column: str) -> DataFrame:
    cells = hashes.select(cell(F.col(column)).alias("cell"))
    return cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))


def split(rows: DataFrame, id_col: str, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is surely not in ``ids``, the others), without a shuffle of ``rows``; null ids are never in ``ids``."""
    words = _words(ids.where(F.col(column).isNotNull()).select(F.xxhash64(F.col(column).cast("long")).alias("__h")), "__h")
    at, word, bits = unused(rows.columns, "cell", "word", "bits")
    words = words.select(F.col("word").alias(word), F.col("bits").alias(bits))
    held = rows.withColumn(at, cell(F.xxhash64(F.col(id_col).cast("long")))).join(F.broadcast(words), F.shiftright(F.col(at), 6) == F.col(word), "left")
    hit = F.col(id_col).isNotNull() & F.coalesce(F.expr(f"(shiftright({bits}, cast({at} & 63 as int)) & 1) = 1"), F.lit(False))
    return held.where(~hit).select(*rows.columns), held.where(hit).select(*rows.columns)


def without_ids(rows: DataFrame, id_col: str, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` but for those whose id is in ``ids``; only rows that the filter can't clear are shuffled."""
    quiet, loud = split(rows, id_col, ids, column)
    (name,) = unused(rows.columns, "gone")
    gone = ids.select(F.col(column).alias(name)).distinct()
    return quiet.unionAll(loud.join(gone, F.col(id_col) == F.col(name), "left_anti"))


def build(hashes: DataFrame, column: str):
    """A broadcast of the filter's 64-bit words for a long column of well-mixed hashes."""
    found = _words(hashes, column).toPandas()  # at most 2**18 rows
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[found.word.to_numpy(np.int64)] = found.bits.to_numpy(np.int64)
    return hashes.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def has(bits: np.ndarray, hashed: int) -> bool:
    at = (hashed & (1 << 64) - 1) >> (64 - BITS)
    return bool((int(bits[at >> 6]) >> (at & 63)) & 1)


def has_each(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """``has`` for an array of unsigned hashes."""
    at = hashed >> np.uint64(64 - BITS)
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
