from pyspark.sql import functions as F

from bandlake.functions import bands as B
from bandlake.functions import geometry as G
from bandlake.functions import paths
from bandlake.operators import downloads, masks, pixels, telemetry


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def bands(spark, rows):
    return spark.createDataFrame(rows, "image_id long, band int, width int, height int, px array<float>")


def test_packing_literals(spark):
    got = {r.layer: bytes(r.rgba) for r in pixels.pack_layers(bands(spark, [(1, 0, 2, 2, [0.0, 0.5, 1.0, 0.25])])).collect()}
    assert len(got) == 2
    assert list(got[0][::4]) == [0, 127, 255, 63] and set(got[0][3::4]) == {255}
    assert got[1] == bytes([0, 0, 0, 255]) * 4
    three = bands(spark, [(1, 0, 2, 1, [1.0, 0.0]), (1, 1, 2, 1, [0.0, 1.0]), (1, 2, 2, 1, [0.0, 0.0])])
    assert bytes(pixels.pack_layers(three).where("layer = 0").first().rgba) == bytes([255, 0, 0, 255, 0, 255, 0, 255])
    four = bands(spark, [(1, k, 1, 1, [v]) for k, v in enumerate((1.0, 0.5, 0.0, 0.25))])
    assert bytes(pixels.pack_layers(four).where("layer = 0").first().rgba) == bytes([255, 127, 0, 63])


def test_quantize_edges(spark):
    assert tuple(one(spark, *[B.quantize(F.lit(v).cast("float")) for v in (float("nan"), -1.0, 2.0, 0.999)])) == (0, 0, 255, 254)


def test_bilinear_literals(spark):
    px = F.array(*[B.f32(v) for v in (1, 2, 3, 4)])
    at = lambda x, y: B.bilinear(px, F.lit(2), F.lit(2), B.f32(x), B.f32(y))
    assert tuple(one(spark, at(0.0, 0.0), at(1.0, 1.0), at(0.5, 0.5), at(-1.0, -1.0), at(10.0, 10.0))) == (1.0, 4.0, 2.5, 1.0, 4.0)
    assert one(spark, at(-0.25, 0.0))[0] == 0.25 * 1 + 0.75 * 2


def test_levels(spark):
    n = lambda s: B.num_levels(F.lit(s), F.lit(s))
    assert tuple(one(spark, n(128), n(256), n(512), n(1024), n(4096), n(257))) == (1, 1, 2, 3, 5, 2)
    assert tuple(one(spark, B.floor_size(F.lit(1024), F.lit(2)), B.floor_size(F.lit(64), F.lit(7)), B.ceil_size(F.lit(5), F.lit(1)))) == (256, 1, 3)


def test_ids(spark):
    path = "nested/path/日本語 file.png"
    code = paths.encode_image_id(F.lit(path))
    row = one(spark, paths.decode_image_id(code), paths.decode_image_id(F.lit("id:abc")), paths.decode_image_id(F.lit("id:ff")), paths.decode_image_id(F.lit("x")), paths.legacy_id(F.lit("file name (1).jpg")), paths.legacy_id(F.lit("a/b.png")), paths.legacy_id(F.lit("a_b.png")))
    assert tuple(row) == (path, None, None, None, "file_name__1__jpg", "a_b_png", "a_b_png")
    assert tuple(one(spark, paths.is_supported(F.lit("a/.npy")), paths.is_supported(F.lit("x.JPG")), paths.is_supported(F.lit("x.txt")))) == (False, True, False)


def test_upload_paths(spark):
    reason = lambda n: paths.upload_path(F.lit("r"), F.lit(n))[1]
    assert tuple(one(spark, *[reason(n) for n in ("a\\b.png", " ", "/a", "a/../b", "a:b/..", "././")])) == (None, "empty", "absolute", "parent", "colon", "empty")
    assert one(spark, paths.upload_path(F.lit("r"), F.lit(" a//./ b .png "))[0])[0] == "r/a/b .png"


def test_parts_partition_the_input(spark):
    files = spark.createDataFrame([("p", f"{i:03d}", s) for i, s in enumerate((5, 6, 0, 50, 1, 9, 1))], "project string, path string, size_bytes long")
    plan = downloads.plan_parts(files, 11)
    assert [r.part for r in plan.orderBy("path").collect()] == [0, 0, 1, 2, 3, 3, 3]
    assert downloads.part_info(plan).orderBy("part").first().file_name == "p_images_part001.zip"


def test_latency_takes_the_upper_median(spark):
    log = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)], "k string, v double")
    assert telemetry.latency_summary(log, "k", "v").first()["median"] == 3.0


def test_lines_parse_and_print(spark):
    detect = lambda t: G.parse_detect_line(F.lit(t))["error"]
    assert tuple(one(spark, *[detect(t) for t in ("1 .5 0.5 1e-1 inf", "1 2", "-1 0 0 0 0", "1 0 0 0 5f")])) == (None, "expected 5 values: class cx cy w h", "invalid class index", "invalid h")
    box = G.box(*[F.lit(v) for v in (10.0, 20.0, 30.0, 40.0)])
    assert one(spark, G.detect_line(F.lit(2), box, F.lit(100), F.lit(100)))[0] == "2 0.250000 0.400000 0.300000 0.400000"


def test_coco_shapes(spark):
    none = F.lit(None).cast("array<float>")
    flat = lambda *v: F.array(*[F.lit(float(x)) for x in v]).cast("array<float>")
    read = lambda b, s, p: G.coco_geometry(b, s, p)
    row = one(spark, read(none, flat(0, 0, 1), none)["error"], read(flat(1, 2, 3, 4), none, none)["geometry"]["kind"], read(flat(1, 2, 3, 4), flat(*range(7)), none)["error"], read(none, flat(5, 6), none)["geometry"]["kind"], read(none, none, flat(1, 1))["geometry"]["kind"])
    assert row[0].startswith("COCO annotation did not") and row[1] == "bounding_box" and row[2].startswith("Segmentation polygon has odd") and row[3] == row[4] == "point"


def test_unknown_datumaro_box_tag(spark):
    v = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)])
    got = one(spark, G.datumaro_geometry(F.lit("bbox"), v, "skip_unsupported")["skipped"], G.datumaro_geometry(F.lit("bbox"), v, "strict")["error"], G.datumaro_geometry(F.lit("bbox"), v, "strict", ("b_box", "bbox"))["geometry"]["kind"])
    assert tuple(got) == (True, "Unknown Datumaro annotation type", "bounding_box")


def test_masks():
    import numpy as np

    grid = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 0, 1, 1]], bool)
    labels = masks.component_labels(grid)
    assert labels.max() == 4 and (labels > 0).sum() == grid.sum()
    assert masks.outline(labels == 1) == [(0, 0), (1, 0), (1, 1)]
    assert masks.mask_polygon(np.zeros((3, 3), bool)).shape == (0, 2)
    line = np.array([(x, 0.0) for x in range(10)] + [(9.0, y) for y in range(1, 10)])
    assert masks.simplify(line, 0.5).tolist() == [[0, 0], [9, 0], [9, 9]]


def test_arrays_in_tasks_equal_column_functions(spark):
    """Resampling and quantising on numpy give what the column functions give, pixel by pixel."""
    import random

    import numpy as np

    from bandlake.functions import bands
    from bandlake.operators import arrays

    rng = random.Random(9)
    rows = []
    for k in range(60):
        w, h, tw, th = (rng.randrange(1, 9) for _ in range(4))
        rows.append((k, w, h, tw, th, [rng.uniform(-0.5, 1.5) for _ in range(w * h)]))
    rows.append((60, 2, 1, 3, 300, [float("nan"), 0.25]))
    frame = spark.createDataFrame(rows, "k int, w int, h int, tw int, th int, px array<float>")
    cols = [F.col(c) for c in ("px", "w", "h", "tw", "th")]
    for r in frame.select("*", bands.resample(*cols).alias("q"), F.transform("px", bands.quantize).alias("b")).collect():
        got = arrays.resampled(np.array(r.px, np.float32), r.w, r.h, r.tw, r.th)
        assert np.array_equal(got, np.array(r.q, np.float32), equal_nan=True)
        assert arrays.quantized(np.array(r.px, np.float32)).tolist() == r.b


def test_postprocessing_by_steps(spark):
    """One pass over a mask equals upsampling, thresholding, tracing and scaling one by one; with outlines of above 500 and 1,000 points."""
    import random

    from bandlake.operators import masks

    rng = random.Random(3)
    rows = [(k, w, h, [rng.uniform(-1, 1) for _ in range(w * h)]) for k, (w, h) in enumerate([(1, 1), (3, 2), (8, 8), (5, 9), (40, 40)])] + [(9, 60, 60, [1.0 if y % 4 < 2 or x == 0 else -1.0 for y in range(60) for x in range(60)]), (10, 4, 4, [-1.0] * 16)]
    frame = spark.createDataFrame(rows, "mask_id long, width int, height int, px array<float>")
    to_w, to_h = F.col("width") * 9, F.lit(1300)
    got = {r.mask_id: r.polygon for r in masks.postprocess_masks(frame, to_w, to_h).collect()}
    w, h, sx, sy = masks.contour_grid(to_w, to_h)
    sized = frame.select("*", w.alias("gw"), h.alias("gh"), sx.alias("sx"), sy.alias("sy"))
    large = masks.upsample_logits(sized)
    cells = large.withColumn("cells", masks.threshold_resample(F.col("px"), F.col("width"), F.col("height"), F.col("gw"), F.col("gh"))).withColumn("width", F.col("gw")).withColumn("height", F.col("gh"))
    traced = {r.mask_id: r.polygon for r in masks.mask_to_polygon(cells).collect()}
    import numpy as np

    for r in cells.select("mask_id", "sx", "sy").collect():
        want = np.array(traced[r.mask_id], np.float32).reshape(-1, 2) * np.array([r.sx, r.sy], np.float32)
        assert np.array_equal(np.array(got[r.mask_id], np.float32), want.ravel())
    assert len(got[9]) > 100 and got[10] == []


def test_parts_of_a_large_project(spark):
    from bandlake.operators import downloads

    rows = [("p", f"{i:05}", 1 + i * 7919 % 50) for i in range(3000)] + [("q", "a", 500), ("q", "b", None), (None, "c", 3)]
    got = downloads.plan_parts(spark.createDataFrame(rows, "project string, path string, size_bytes long"), 100).collect()
    want, part, used = {}, 0, 0
    for _, path, size in rows[:3000]:
        if used + size > 100:
            part, used = part + 1, 0
        used += size
        want["p", path] = part
    want |= {("q", "a"): 0, ("q", "b"): 1, (None, "c"): 0}
    assert {(r.project, r.path): r.part for r in got} == want


def test_latency_medians(spark):
    import random

    from bandlake.operators import telemetry

    rng = random.Random(2)
    rows = [(k, rng.randrange(20_000)) for k in ("a", "b", None) for _ in range(rng.randrange(1, 400))] + [("c", 5)]
    for r in telemetry.latency_summary(spark.createDataFrame(rows, "k string, v long"), "k", "v").collect():
        own = sorted(v for k, v in rows if k == r.k)
        assert (r.min, r.median, r.mean) == (own[0], own[len(own) // 2], sum(own) / len(own))
