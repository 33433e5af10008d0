"""Plans and results that must hold whatever the number of rows."""

import pytest
from pyspark.sql import functions as F

from bandlake.operators import annotations as A
from bandlake.operators import downloads
from bandlake.plans import fixtures
from bandlake.plans.annotation_queries import dataset
from bandlake.sources import bundles, files, mounted
from tests.test_jobs import dataset as small


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_files_are_never_broadcast(spark):
    wanted = spark.createDataFrame([("d", "labels/1.txt"), ("d", "labels/2.txt")], "dataset_id string, label_path string")
    files = spark.createDataFrame([("d", "labels/1.txt", 0, "one"), ("d", "labels__2.txt", 1, "two")], "dataset_id string, path string, ord long, content string")
    found = bundles.resolve_label_files(wanted, files)
    assert "Broadcast" not in _plan(found)
    assert {r.label_path: r.content for r in found.collect()} == {"labels/1.txt": "one", "labels/2.txt": "two"}


@pytest.mark.parametrize("way", ["datumaro", "coco"])
def test_documents_in_pieces_read_as_one(spark, way):
    ds = small(spark)
    images = spark.range(40).selectExpr("'d' AS dataset_id", "id AS image_id", "concat('f', id) AS file_name", "9L AS width", "7L AS height", "id AS ord")
    rows = ds.annotations.crossJoin(spark.range(1, 40).withColumnRenamed("id", "k")).withColumn("image_id", F.col("k")).withColumn("annotation_id", F.col("annotation_id") + 10 * F.col("k")).withColumn("ord", F.col("annotation_id")).drop("k")
    ds = A.Dataset(images, ds.categories, rows)
    write = (lambda most: A.datumaro_documents(ds, most=most)) if way == "datumaro" else (lambda most: A.coco_documents(ds, most=most)[0])
    read = bundles.read_datumaro if way == "datumaro" else bundles.read_coco
    docs = write(20).withColumn("ord", F.lit(0).cast("long")).cache()
    assert docs.count() > 5
    assert docs.agg(F.max(F.length("content"))).first()[0] < 4_000
    assert write(100_000).count() == 1
    back, warnings = read(docs)
    assert warnings.count() == 0
    assert A.roundtrip_diff(ds, back).count() == 0
    told = back.annotations.orderBy("ord").select("annotation_id").collect()
    assert [r[0] for r in told] == sorted(r[0] for r in rows.select("annotation_id").collect())
    assert [r[0] for r in back.images.orderBy("ord").select("file_name").collect()] == [f"f{k}" for k in range(40)]
    assert back.categories.count() == 2
    broken = docs.withColumn("content", F.when(F.col("piece") == 2, "{").otherwise(F.col("content")))
    left, warnings = read(broken)
    assert left.annotations.count() == 0
    assert [(r.code, r.message.split(": ")[1]) for r in warnings.collect()] == [("parse_error", "not a JSON document")]


def test_a_request_has_one_row_though_its_file_is_listed_twice(spark):
    requests = spark.createDataFrame([(1, "a/x.png"), (2, "a/y.png")], "request_id long, path string")
    listed = spark.createDataFrame([("a/x.png", b"1"), ("a/x.png", b"1")], "path string, content binary")
    assert sorted((r.request_id, r.found) for r in files.raw_bytes(requests, listed).collect()) == [(1, True), (2, False)]


def test_files_of_one_path_are_as_many_entries(spark, tmp_path):
    table = spark.createDataFrame([("p", "x", b"1", 60), ("p", "x", b"2", 60), ("p", "y", b"3", 10)], "project string, path string, content binary, size_bytes long")
    plan = downloads.plan_parts(table, 100).cache()
    wanted = [(0, "x", b"1"), (1, "x", b"2"), (1, "y", b"3")]
    mounted.save_zip_parts(plan, table, str(tmp_path / "out"))
    saved = files.read_files(spark, str(tmp_path / "out")).select(F.lit("p").alias("project"), (F.regexp_extract("path", r"_part(\d+)\.zip$", 1).cast("int") - 1).alias("part"), F.col("content").alias("archive"))
    for archives in (files.write_zip_parts(plan, table), saved):
        assert sorted((r.part, r.path, bytes(r.content)) for r in files.read_zip_parts(archives).collect()) == wanted


def test_annotations_are_worked_out_once_with_the_corners_of_the_view(spark):
    given = "/root/testdata/sf0.001"
    made = dataset(spark, given).annotations.select("annotation_id", "geometry.kind", F.to_json("geometry.points").alias("points"))
    optimized = made._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("l_linenumber#") and optimized.count("Relation [l_orderkey") == 1
    view_points = fixtures.view(spark, given, "fx_vertices").groupBy("annotation_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "vx", "vy"))), lambda v: F.struct(v["vx"].alias("x"), v["vy"].alias("y")))).alias("wanted"))
    assert made.where("kind = 'polygon'").join(view_points, "annotation_id", "left").where("NOT (points <=> wanted)").isEmpty()
