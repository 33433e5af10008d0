import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.operators import annotations as A
from bandlake.operators import catalog, downloads, pixels
from bandlake.sources import bundles, files
from bandlake.streaming import jobs


def npy(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def write(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_npy_files(spark, tmp_path):
    cube = np.random.default_rng(17).uniform(-2, 3, (6, 3, 4)).astype(np.float32)
    write(tmp_path, "a/cube.npy", npy(cube))
    write(tmp_path, "flat.npy", npy(cube[0]))
    write(tmp_path, "broken.npy", b"nothing")
    write(tmp_path, "notes.txt", b"x")
    listed = catalog.catalog(files.list_files(spark, str(tmp_path))).collect()
    assert [r.path for r in listed] == ["a/cube.npy", "broken.npy", "flat.npy"] and listed[0].format == "NPY"
    read = files.read_files(spark, str(tmp_path)).where("path LIKE '%.npy'")
    meta = {r.path: r for r in files.npy_meta(read).collect()}
    assert (meta["a/cube.npy"].bands, meta["a/cube.npy"].height, meta["a/cube.npy"].width) == (6, 3, 4)
    assert meta["flat.npy"].error.startswith("expected a cube") and meta["broken.npy"].error == "not an NPY file"
    bands = files.read_npy(read)
    assert bands.count() == 6 and np.allclose(bands.where("band = 4").first().px, cube[4].ravel())
    assert pixels.pack_layers(pixels.normalize_cube(bands.withColumn("px", F.col("px").cast("array<float>")))).count() == 2


def test_archives_hold_their_part(spark):
    table = spark.createDataFrame([("p", f"{c}.png", 10, bytes([k] * 10)) for k, c in enumerate("cab")], "project string, path string, size_bytes long, content binary")
    parts = files.write_zip_parts(downloads.plan_parts(table, 20), table).orderBy("part").collect()
    names = [zipfile.ZipFile(io.BytesIO(bytes(p.archive))).namelist() for p in parts]
    assert names == [["a.png", "b.png"], ["c.png"]]


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([("a", 5, True), ("a", 8, False), ("b", 1, True)], "endpoint string, latency_ms long, ok boolean")
    log.write.parquet(f"{tmp_path}/log")
    query = jobs.endpoint_metrics_stream(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")).writeStream.outputMode("complete").format("memory").queryName("metrics").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("metrics").collect()} == {("a", 2, 1, 6, 8), ("b", 1, 0, 1, 1)}


def test_only_new_and_changed_files_are_built(spark, tmp_path):
    cube = lambda k: npy(np.arange(4 * 6 * 5, dtype=np.uint8).reshape(4, 6, 5) * k % 251)
    given, store, state = (f"{tmp_path}/{n}" for n in ("in", "store", "seen"))
    look = lambda: jobs.incremental_pyramids(spark, given, store, state, f"{tmp_path}/check", min_side=2).awaitTermination()
    built = lambda: {r.image_id: r.n for r in spark.read.parquet(f"{store}/meta").where("level = 0").groupBy("image_id").agg(F.count("*").alias("n")).collect()}
    for name, k in (("a/x.npy", 1), ("y.npy", 2), ("z.npy", 3)):
        write(tmp_path, f"in/{name}", cube(k))
    write(tmp_path, "in/broken.npy", b"nothing")
    write(tmp_path, "in/notes.txt", b"x")
    look()
    assert built() == {"a/x.npy": 1, "y.npy": 1, "z.npy": 1}
    look()  # nothing has changed
    assert built() == {"a/x.npy": 1, "y.npy": 1, "z.npy": 1}
    before = {(r.image_id, r.layer): bytes(r.rgba) for r in files.read_level(spark, store, 0).collect()}
    write(tmp_path, "in/y.npy", cube(7))  # in its place
    write(tmp_path, "in/w.npy", cube(4))
    write(tmp_path, "in/broken.npy", cube(5))
    look()
    assert built() == {"a/x.npy": 1, "y.npy": 2, "z.npy": 1, "w.npy": 1, "broken.npy": 1}
    after = {(r.image_id, r.layer): bytes(r.rgba) for r in files.read_level(spark, store, 0).collect()}
    assert after["y.npy", 0] != before["y.npy", 0] and after["z.npy", 0] == before["z.npy", 0]
    direct = files.read_npy(files.read_files(spark, given).where("path = 'y.npy'")).withColumn("px", F.col("px").cast("array<float>"))
    assert after["y.npy", 0] == bytes(pixels.pack_layers(pixels.normalize_cube(direct)).where("layer = 0").first().rgba)
    seen = {r.path: (r.error, r.look) for r in jobs.seen_files(spark, state).collect()}
    assert seen == {"a/x.npy": (None, 0), "y.npy": (None, 2), "z.npy": (None, 0), "w.npy": (None, 2), "broken.npy": (None, 2)}
    jobs.compact_seen(spark, state, f"{tmp_path}/seen2")
    assert jobs.fresh_files(files.list_files(spark, given), jobs.seen_files(spark, f"{tmp_path}/seen2")).count() == 0


def test_a_repeated_look_replaces_its_builds(spark, tmp_path):
    write(tmp_path, "in/x.npy", npy(np.ones((4, 2, 2), np.uint8)))
    for _ in range(2):  # as if the first had broken off before it noted what it saw
        assert jobs.build_fresh(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/state-{_}", min_side=1) == 1
    assert files.read_level(spark, f"{tmp_path}/store", 0).count() == 2 and files.read_pyramid_meta(spark, f"{tmp_path}/store").count() == 2
    assert jobs.build_fresh(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/state-1") == 0


def test_rejected_rasters_and_roots(spark, tmp_path):
    write(tmp_path, "a.png", b"no image")
    write(tmp_path, "b.webp", b"RIFF")
    write(tmp_path, "c.txt", b"x")
    assert {(r.origin.rsplit("/", 1)[1], r.error) for r in files.rejected_rasters(spark, str(tmp_path)).collect()} == {("a.png", "not a readable image"), ("b.webp", "no reader for WebP")}
    with pytest.raises(ValueError, match="mounted"):
        files.write_files(spark.createDataFrame([("x", b"1")], "path string, content binary"), "hdfs://nn/x")


def dataset(spark):
    images = spark.createDataFrame([("d", 1, "meadow.png", 333, 77, 0), ("d", 2, "harbour.png", 58, 91, 1)], "dataset_id string, image_id long, file_name string, width long, height long, ord long")
    categories = spark.createDataFrame([("d", 5, "barley", 0), ("d", 3, "gull", 1)], "dataset_id string, category_id long, name string, ord long")
    box, dot = ("bounding_box", 101.0, 12.5, 44.0, 31.0, None), ("point", 250.5, 8.25, None, None, None)
    polygon = ("polygon", None, None, None, None, [(3.5, 61.0), (40.25, 9.0), (77.0, 70.5), (20.0, 72.0)])
    rows = [("d", k, 1, 5, g, k) for k, g in enumerate((box, polygon, dot))]
    from bandlake.functions.geometry import GEOMETRY_TYPE

    return A.Dataset(images, categories, spark.createDataFrame(rows, f"dataset_id string, annotation_id long, image_id long, category_id long, geometry {GEOMETRY_TYPE}, ord long"))


def test_round_trips(spark):
    ds = dataset(spark)
    bundle = lambda docs: docs.withColumn("ord", F.lit(0).cast("long"))
    assert A.roundtrip_diff(ds, bundles.read_coco(bundle(A.coco_documents(ds)[0]))[0]).count() == 0
    assert A.roundtrip_diff(ds, bundles.read_datumaro(bundle(A.datumaro_documents(ds)))[0]).count() == 0
    only = A.Dataset(ds.images, ds.categories, ds.annotations.where("geometry.kind = 'bounding_box'"))
    flat = A.yolo_bundle(only).withColumn("path", F.replace("path", F.lit("/"), F.lit("__")))
    back, warnings = bundles.read_yolo(flat)
    assert A.roundtrip_diff(only, back, 1).count() == 0
    assert [r.message for r in warnings.collect()] == ["Missing label file 'labels/2.txt'"]


def test_bad_documents(spark):
    document = lambda *shapes: json.dumps({"images": [{"id": 8, "file_name": "m.tif", "width": 64, "height": 32}], "categories": [{"id": 2, "name": "kelp", "supercategory": "sea"}], "annotations": [{"id": k, "image_id": 8, "category_id": 2, **shape} for k, shape in enumerate(shapes)]})
    flags = {"area": 12.0, "iscrowd": 0}
    rows = [
        ("lengths", document({**flags, "bbox": [7, 5, 2.5, 6], "segmentation": {"size": [32, 64], "counts": "0kP"}})),
        ("bad", document({**flags, "segmentation": [[4, 4, 9]]}, {**flags, "segmentation": [[1, 1, 1]]})), ("short", document({**flags, "bbox": [1, 1, 1]})),
        ("lacks", document({"bbox": [7, 5, 2, 6]})), ("cut", document({**flags, "bbox": [1, 2, 3, 4]})[:-3]), ("list", "[1, 2]"),
    ]
    ds, warnings = bundles.read_coco(spark.createDataFrame([(k, 0, "a.json", v) for k, v in rows], "dataset_id string, ord long, path string, content string"))
    found = ds.annotations.collect()
    assert [(r.dataset_id, r.geometry.kind, r.geometry.w) for r in found] == [("lengths", "bounding_box", 2.5)]
    assert sorted((r.dataset_id, r.code) for r in warnings.collect()) == [("bad", "invalid_record"), ("bad", "invalid_record"), ("cut", "parse_error"), ("lacks", "parse_error"), ("list", "parse_error"), ("short", "parse_error")]
