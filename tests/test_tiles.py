"""Tiles against the operators on whole bands and masks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.operators import masks, pixels, tiles


@pytest.fixture(scope="module")
def bands(spark):
    rng = np.random.default_rng(3)
    rows = [(i, b, w, h, rng.uniform(0, 1, w * h).astype(np.float32).tolist()) for i, (w, h, n) in enumerate([(23, 17, 5), (8, 8, 1), (1, 30, 2), (16, 7, 3)]) for b in range(n)]
    return spark.createDataFrame(rows, "image_id long, band int, width int, height int, px array<float>").cache()


def same(a, b, *keys):
    x, y = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (a, b))
    assert set(x) == set(y) and x
    for k in x:
        for c in ("width", "height", "px", "rgba"):
            if c in a.columns:
                assert x[k][c] == y[k][c], (k, c)


@pytest.mark.parametrize("side", [5, 64])
def test_sizes(bands, side):
    cut = tiles.cut(bands, side)
    assert cut.agg(F.max(F.size("px"))).first()[0] <= side * side
    same(tiles.whole(cut, side), bands, "image_id", "band")
    for w, h in ((F.ceil(F.col("width") / 2), F.ceil(F.col("height") / 2)), (F.col("width") * 4, F.col("height") * 4), (F.col("width"), F.col("height"))):
        same(tiles.whole(tiles.resample(cut, w, h, side=side), side), pixels.downsample(bands, w, h), "image_id", "band")


def test_pyramid_layers_and_thumbnails(bands):
    made = tiles.pyramid(tiles.cut(bands, 5), min_side=2, side=5)
    same(tiles.whole(made, 5), pixels.pyramid_bands(bands, min_side=2), "image_id", "band", "level")
    layers = tiles.whole(tiles.pack(made, 5), 5, "rgba", 4)
    same(layers, pixels.build_pyramid(bands, min_side=2)[0], "image_id", "level", "layer")
    same(tiles.whole(tiles.cut(pixels.normalize_cube(bands), 5), 5), tiles.whole(pixels.normalize_cube(tiles.cut(bands, 5)), 5), "image_id", "band")


def test_thresholds(spark, bands):
    for w, h in ((F.lit(9), F.lit(11)), (F.col("width") * 3, F.col("height") * 2)):
        shifted = bands.withColumn("px", F.transform("px", lambda v: (v - 0.5).cast("float"))).withColumn("w", w.cast("int")).withColumn("h", h.cast("int"))
        want = shifted.select("image_id", "band", masks.threshold_resample(F.col("px"), F.col("width"), F.col("height"), F.col("w"), F.col("h")).alias("cells"))
        got = tiles.whole(tiles.resample(tiles.cut(shifted.drop("w", "h"), 6), w, h, side=6, way=tiles.NEAREST), 6)
        assert {(r.image_id, r.band): [int(v) for v in r.px] for r in got.collect()} == {(r.image_id, r.band): list(r.cells) for r in want.collect()}


def test_components_over_borders(spark):
    rng = np.random.default_rng(11)
    grids = [rng.uniform(size=(h, w)) < p for h, w, p in [(20, 31, 0.6), (1, 40, 0.8), (33, 9, 0.5), (16, 16, 1.0), (5, 5, 0.0), (24, 24, 0.62)]]
    spiral = np.zeros((21, 21), bool)
    spiral[::4, :] = True
    spiral[1::4, -1] = spiral[2::4, -1] = spiral[3::4, 0] = True
    grids.append(spiral)
    rows = [(k, g.shape[1], g.shape[0], g.astype(np.float32).ravel().tolist()) for k, g in enumerate(grids)]
    frame = spark.createDataFrame(rows, "mask_id long, width int, height int, px array<float>")
    want = masks.label_components(frame.withColumn("cells", F.transform("px", lambda v: v.cast("int"))))
    got = tiles.label_components(tiles.cut(frame, 6), 6)
    found = [tuple(r) for r in got.select("mask_id", "component", "pixels", "first").collect()]
    assert sorted(found) == sorted(tuple(r) for r in want.select("mask_id", "component", "pixels", "first").collect())
    assert tiles.label_components(tiles.cut(frame.limit(0), 6), 6).count() == 0


def test_many_small_images_at_once(spark):
    """Images of several sizes whose tiles are spread over Arrow batches; no image or tile is a Python call of its own."""
    rng = np.random.default_rng(5)
    sizes = [(8, 8), (13, 4), (1, 1), (6, 11)]
    rows = [(i, 0, w, h, rng.normal(size=w * h).astype(np.float32).tolist()) for i in range(60) for w, h in [sizes[i % 4]]]
    frame = spark.createDataFrame(rows, "image_id long, band int, width int, height int, px array<float>")
    made = tiles.whole(tiles.resample(tiles.cut(frame, 5), F.col("width") * 2, F.col("height") + 3, side=5), 5)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            same(made, pixels.downsample(frame, F.col("width") * 2, F.col("height") + 3), "image_id", "band")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
