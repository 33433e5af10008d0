"""Images in tiles, so that no row or task holds a whole band.

A tile is a row: the image's keys, width and height of the whole, tx and ty (its place in the grid of ``side`` pixels), px
(row-major floats of the tile; those at the right and lower edge are smaller). Each result pixel is worked out from the same
source pixels in the same arithmetic as by the operators on whole bands. Pixels from neighbouring tiles come by a join on
the tile they are needed in; a tile only sends the rows and columns that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import bands as B
from ..session import in_tasks, settle
from . import arrays, pixels
from .masks import component_labels
from .ordinals import running

SIDE = 1024
#: Pixels of tiles of one shape that are worked on together.
AT_ONCE = 1 << 22
BILINEAR, NEAREST = "bilinear", "nearest"
_PLACE = ["width", "height", "tx", "ty"]


def _keys(df: DataFrame, *more: str) -> list[str]:
    return [c for c in df.columns if c not in {*_PLACE, "px", "rgba", *more}]


def _schema(keyed: DataFrame, more: str) -> StructType:
    """The keys as they are in ``k``, then other columns."""
    return StructType([keyed.schema["k"], *StructType.fromDDL(more).fields])


def _stack(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` numbers of the lists in ``rows``, a row each."""
    own = column.take(pa.array(rows))
    if own.null_count or (np.diff(own.offsets.to_numpy()) != size).any():
        return np.stack([arrays.values(v)[:size] for v in own])
    return own.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, size)


def _lists(grids: np.ndarray) -> pa.Array:
    """A list of each of the grids, row-major."""
    size = int(np.prod(grids.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(grids) + 1, dtype=np.int32) * size, pa.int32()), pa.array(np.ascontiguousarray(grids, np.float32).ravel()))


def _alike(columns: list[np.ndarray], pixels_: Callable[..., int]) -> Iterator[tuple[list[int], np.ndarray]]:
    """(values, places) of rows that agree in all ``columns``, as many at a time as have ``AT_ONCE`` pixels together."""
    if not len(columns[0]):
        return
    values, inverse = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
    order = np.argsort(inverse.ravel(), kind="stable")
    cuts = np.searchsorted(inverse.ravel()[order], np.arange(len(values) + 1))
    for own, lo, hi in zip(values.tolist(), cuts[:-1], cuts[1:], strict=True):
        step = max(1, AT_ONCE // max(1, pixels_(*own)))
        for at in range(lo, hi, step):
            yield own, order[at : min(at + step, hi)]


def _ints(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _batch(keys: pa.Array, rows: np.ndarray, numbers: dict[str, int], **columns: pa.Array) -> pa.RecordBatch:
    """Rows with the keys of ``rows``, the same whole numbers in each, and further columns."""
    whole = [pa.array(np.full(len(rows), v, np.int32)) for v in numbers.values()]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), *whole, *columns.values()], names=["k", *numbers, *columns])


def _gathered(df: DataFrame, by: list[str], order: list[str], function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``function`` of batches that hold the groups of ``by`` as a whole, many at once; rows are sorted, and the first of a group has ``nth`` 1."""
    sorted_ = df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("nth").to_numpy() == 1)
            if not len(starts):
                held.append(batch)
                continue
            for part in ([*held, batch.slice(0, starts[0])], [batch.slice(starts[0], starts[-1] - starts[0])]):
                if sum(len(b) for b in part):
                    yield from function(pa.concat_batches(part))
            held = [batch.slice(starts[-1])]
        if sum(len(b) for b in held):
            yield from function(pa.concat_batches(held))

    return sorted_.transform(in_tasks, run, schema)


def cut(bands: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of whole bands (keys, width, height, px); a band without pixels has none."""
    keys = _keys(bands)
    given = bands.select(F.struct(*keys).alias("k"), "width", "height", "px")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (w, h), rows in _alike(_ints(batch, "width", "height"), lambda w, h: w * h):
                if min(w, h) < 1:
                    continue
                grid = _stack(batch.column("px"), rows, w * h).reshape(-1, h, w)
                for y in range(0, h, side):
                    for x in range(0, w, side):
                        place = {"width": w, "height": h, "tx": x // side, "ty": y // side}
                        yield _batch(batch.column("k"), rows, place, px=_lists(grid[:, y : y + side, x : x + side]))

    return given.transform(in_tasks, run, _schema(given, "width int, height int, tx int, ty int, px array<float>")).select("k.*", *_PLACE, "px")


@lru_cache(64)
def _axis(size: int, to: int, way: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first source place, second, share of the second) of each result place."""
    at = (np.arange(to, dtype=np.float32) + np.float32(0.5)) * (np.float32(size) / np.float32(to)) - np.float32(0.5)
    if way == NEAREST:
        near = np.arange(to) if size == to else np.clip(np.copysign(np.floor(np.abs(at) + np.float32(0.5)), at), 0, size - 1).astype(np.int64)
        return near, near, np.zeros(to, np.float32)
    low = np.floor(at)
    first = np.clip(low, 0, size - 1).astype(np.int64)
    return first, np.minimum(first + 1, size - 1), np.clip(at - low, np.float32(0), np.float32(1))


def _needed(axis: tuple[np.ndarray, np.ndarray, np.ndarray], tile: int, side: int) -> np.ndarray:
    part = slice(tile * side, (tile + 1) * side)
    return np.unique(np.concatenate((axis[0][part], axis[1][part])))


def resample(tiles: DataFrame, to_width: Column, to_height: Column, *, side: int = SIDE, way: str = BILINEAR) -> DataFrame:
    """Tiles of the images at another size, by the arithmetic of ``pixels.downsample`` or, ``nearest``, of ``masks.threshold_resample`` (then 0 and 1).

    An image of no size at either end has no tiles.
    """
    keys = _keys(tiles)
    given = tiles.select(F.struct(*keys).alias("k"), *_PLACE, to_width.cast("int").alias("to_w"), to_height.cast("int").alias("to_h"), "px")
    patch = "to_w int, to_h int, out_x int, out_y int, row int, col int, rows int, cols int, patch array<float>"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (w, h, tx, ty, to_w, to_h), at in _alike(_ints(batch, *_PLACE, "to_w", "to_h"), lambda *_: side * side):
                if min(w, h, to_w, to_h) < 1:
                    continue
                own_h, own_w = min(side, h - ty * side), min(side, w - tx * side)
                grid = _stack(batch.column("px"), at, own_h * own_w).reshape(-1, own_h, own_w)
                across, down = _axis(w, to_w, way), _axis(h, to_h, way)
                for oy in range(-(-to_h // side)):
                    rows = _needed(down, oy, side)
                    r0, r1 = np.searchsorted(rows, [ty * side, ty * side + own_h])
                    if r0 == r1:
                        continue
                    for ox in range(-(-to_w // side)):
                        cols = _needed(across, ox, side)
                        c0, c1 = np.searchsorted(cols, [tx * side, tx * side + own_w])
                        if c0 < c1:
                            part = grid[:, (rows[r0:r1] - ty * side)[:, None], cols[c0:c1] - tx * side]
                            numbers = {"w": w, "h": h, "to_w": to_w, "to_h": to_h, "out_x": ox, "out_y": oy, "row": r0, "col": c0, "rows": r1 - r0, "cols": c1 - c0}
                            yield _batch(batch.column("k"), at, numbers, patch=_lists(part))

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nth, row, col, n_rows, n_cols = _ints(batch, "nth", "row", "col", "rows", "cols")
        heads = np.flatnonzero(nth == 1)
        ends = np.append(heads[1:], len(nth))
        for (w, h, to_w, to_h, ox, oy), own in _alike([c[heads] for c in _ints(batch, "w", "h", "to_w", "to_h", "out_x", "out_y")], lambda *_: side * side):
            across, down = _axis(w, to_w, way), _axis(h, to_h, way)
            rows, cols = _needed(down, oy, side), _needed(across, ox, side)
            grid = np.zeros((len(own), len(rows), len(cols)), np.float32)
            sizes = ends[own] - heads[own]
            group = np.repeat(np.arange(len(own)), sizes)
            at = np.repeat(heads[own] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(len(group))
            for (r, c, n, m), some in _alike([x[at] for x in (row, col, n_rows, n_cols)], lambda r, c, n, m: n * m):
                grid[group[some], r : r + n, c : c + m] = _stack(batch.column("patch"), at[some], n * m).reshape(-1, n, m)
            y, x = slice(oy * side, (oy + 1) * side), slice(ox * side, (ox + 1) * side)
            y0, y1, fy = np.searchsorted(rows, down[0][y]), np.searchsorted(rows, down[1][y]), down[2][y][:, None]
            x0, x1, fx = np.searchsorted(cols, across[0][x]), np.searchsorted(cols, across[1][x]), across[2][x]
            one = np.float32(1)
            if way == NEAREST:
                out = (grid[:, y0[:, None], x0] > 0).astype(np.float32)
            elif (w, h) == (to_w, to_h):
                out = grid[:, y0[:, None], x0]
            else:
                above, below = grid[:, y0], grid[:, y1]
                out = (above[:, :, x0] * (one - fx) + above[:, :, x1] * fx) * (one - fy) + (below[:, :, x0] * (one - fx) + below[:, :, x1] * fx) * fy
            yield _batch(batch.column("k"), heads[own], {"width": to_w, "height": to_h, "tx": ox, "ty": oy}, px=_lists(out))

    sent = given.transform(in_tasks, send, _schema(given, f"w int, h int, {patch}"))
    made = _gathered(sent, ["k", "out_x", "out_y"], ["row", "col"], build, _schema(sent, "width int, height int, tx int, ty int, px array<float>"))
    return made.select("k.*", *_PLACE, "px")


def pack(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """Layers of each tile (keys without band, width, height, tx, ty, layer, rgba), as ``pixels.pack_layers`` makes them of whole bands."""
    own = tiles.withColumn("__w", F.col("width")).withColumn("__h", F.col("height"))
    inner = own.withColumn("width", F.least(F.lit(side), F.col("__w") - F.col("tx") * side)).withColumn("height", F.least(F.lit(side), F.col("__h") - F.col("ty") * side))
    extra = (*[k for k in _keys(tiles) if k not in ("image_id", "band")], "tx", "ty", "__w", "__h")
    packed = pixels.pack_layers(inner, extra)
    return packed.withColumn("width", F.col("__w")).withColumn("height", F.col("__h")).drop("__w", "__h")


def pyramid(tiles: DataFrame, *, min_side: int = B.MIN_SIDE, side: int = SIDE) -> DataFrame:
    """Tiles with ``level``, each level from the one before, as ``pixels.pyramid_bands`` does."""
    level = settle(tiles.withColumn("level", F.lit(0)), "tiled-level")
    depth = level.agg(F.max(B.num_levels(F.col("width"), F.col("height"), min_side))).first()[0] or 1
    out = level
    for n in range(1, depth):
        larger = level.where((F.col("width") > min_side) | (F.col("height") > min_side)).drop("level")
        level = settle(resample(larger, F.ceil(F.col("width") / 2), F.ceil(F.col("height") / 2), side=side).withColumn("level", F.lit(n)), "tiled-level")
        out = out.unionByName(level)
    return out


def whole(tiles: DataFrame, side: int = SIDE, column: str = "px", depth: int = 1) -> DataFrame:
    """Bands, or layers of ``depth`` bytes a pixel, put together again: for images whose rows fit a task."""
    keys = _keys(tiles, column)
    given = tiles.select(F.struct(*keys).alias("k"), *_PLACE, column)

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nth, tx, ty = _ints(batch, "nth", "tx", "ty")
        heads = np.flatnonzero(nth == 1)
        ends = np.append(heads[1:], len(nth))
        for (w, h), own in _alike([c[heads] for c in _ints(batch, "width", "height")], lambda w, h: w * h * depth):
            out = np.zeros((len(own), h, w, depth), np.float32 if column == "px" else np.uint8)
            sizes = ends[own] - heads[own]
            group = np.repeat(np.arange(len(own)), sizes)
            at = np.repeat(heads[own] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(len(group))
            for (x, y), some in _alike([tx[at], ty[at]], lambda *_: side * side * depth):
                rows, cols = min(side, h - y * side), min(side, w - x * side)
                if column == "px":
                    tiles_ = _stack(batch.column(column), at[some], rows * cols)
                else:
                    tiles_ = np.frombuffer(b"".join(batch.column(column).take(pa.array(at[some])).to_pylist()), np.uint8)
                out[group[some], y * side : y * side + rows, x * side : x * side + cols] = tiles_.reshape(-1, rows, cols, depth)
            made = _lists(out) if column == "px" else pa.array([image.tobytes() for image in out], pa.binary())
            yield _batch(batch.column("k"), heads[own], {"width": w, "height": h}, **{column: made})

    schema = _schema(given, f"width int, height int, {column} {'array<float>' if column == 'px' else 'binary'}")
    return _gathered(given, ["k"], ["ty", "tx"], build, schema).select("k.*", "width", "height", column)


def _linked(edges: DataFrame) -> DataFrame:
    """(mask_id, node, root) of links (mask_id, a, b): the least node that a node reaches. Stars are made larger and smaller in turn until nothing changes."""
    links = settle(edges.where("a <> b").selectExpr("mask_id", "greatest(a, b) AS a", "least(a, b) AS b").distinct(), "links")
    while True:
        both = links.unionByName(links.selectExpr("mask_id", "b AS a", "a AS b"))
        least = both.groupBy("mask_id", "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, ["mask_id", "a"]).where("b > a").select("mask_id", F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.where("a <> b").distinct(), "links")
        least = large.groupBy("mask_id", "a").agg(F.min("b").alias("m"))
        small = large.join(least, ["mask_id", "a"]).select("mask_id", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("mask_id", "a", F.col("m").alias("b")))
        made = settle(small.where("a <> b").distinct(), "links")
        same = made.count() == links.count() and made.exceptAll(links).isEmpty()
        links = made
        if same:
            return links.select("mask_id", F.col("a").alias("node"), F.col("b").alias("root"))


def label_components(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """mask_id, component (from 1 in scan order), pixels, first (place of its first pixel): ``masks.label_components`` for masks in tiles.

    ``tiles`` has mask_id, width, height, tx, ty, px; foreground is above 0. Tiles are labelled apart by the place of each
    part's first pixel; parts that touch over a border are joined.
    """
    given = tiles.select("mask_id", *_PLACE, "px")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (w, h, tx, ty), own in _alike(_ints(batch, *_PLACE), lambda *_: side * side):
                n, rows, cols = len(own), min(side, h - ty * side), min(side, w - tx * side)
                # tiles one below the other, a row of background between them: labels rise from tile to tile
                grid = np.zeros((n, rows + 1, cols), bool)
                grid[:, :rows] = _stack(batch.column("px"), own, rows * cols).reshape(n, rows, cols) > 0
                labels = component_labels(grid.reshape(-1, cols)).reshape(n, rows + 1, cols)[:, :rows]
                names, at = np.unique(labels, return_index=True)
                tile, inner = np.divmod(at, rows * cols)
                place = np.zeros(labels.max() + 1, np.int64)
                place[names] = (ty * side + inner // cols) * w + tx * side + inner % cols + 1
                place[0] = 0
                offsets = np.append(0, np.cumsum(np.bincount(tile[names > 0], minlength=n)))
                masks_ = batch.column("mask_id").take(pa.array(own))

                def found_rows(kind: str, i: int, j: int, after: int, nodes: pa.Array, sizes: pa.Array | None = None) -> pa.RecordBatch:
                    fixed = [pa.array(np.full(n, v)) for v in (i, j)]
                    return pa.RecordBatch.from_arrays(
                        [masks_, pa.array([kind] * n), *fixed, nodes, pa.nulls(n, pa.list_(pa.int64())) if sizes is None else sizes, pa.array(np.full(n, after, np.int32))],
                        names=["mask_id", "kind", "i", "j", "nodes", "pixels", "after"],
                    )

                lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int64()))
                yield found_rows("part", 0, 0, 0, lists(offsets, place[1:]), lists(offsets, np.bincount(labels.ravel())[1:]))
                for kind, i, j, line in (("down", ty, tx, labels[:, 0]), ("down", ty + 1, tx, labels[:, -1]), ("right", tx, ty, labels[:, :, 0]), ("right", tx + 1, ty, labels[:, :, -1])):
                    after = int(i == (ty if kind == "down" else tx))
                    yield found_rows(kind, i, j, after, lists(np.arange(n + 1) * line.shape[1], place[line].ravel()))

    found = settle(given.transform(in_tasks, run, "mask_id long, kind string, i long, j long, nodes array<long>, pixels array<long>, after int"), "tile-labels")
    parts = found.where("kind = 'part'").select("mask_id", F.explode(F.arrays_zip("nodes", "pixels")).alias("p")).select("mask_id", F.col("p.nodes").alias("node"), "p.pixels")
    borders = found.where("kind <> 'part'").groupBy("mask_id", "kind", "i", "j").agg(F.max(F.when(F.col("after") == 1, F.col("nodes"))).alias("l"), F.max(F.when(F.col("after") == 0, F.col("nodes"))).alias("r"))
    edges = borders.select("mask_id", F.explode(F.arrays_zip("l", "r")).alias("e")).select("mask_id", F.col("e.l").alias("a"), F.col("e.r").alias("b")).where("a > 0 AND b > 0")
    joined = parts.join(_linked(edges), ["mask_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    whole_ones = settle(joined.groupBy("mask_id", "root").agg(F.sum("pixels").alias("pixels"), (F.min("node") - 1).alias("first")), "components")
    return running(whole_ones, "mask_id", ["first"], F.lit(1), "component").select("mask_id", "component", "pixels", "first")
