"""Pieces of a large dataset's documents stay apart, and are written and read few at a time."""

import glob
import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from bandlake.operators import annotations as A
from bandlake.session import settle, shared_dir
from bandlake.sources import bundles as B


def _small(spark) -> A.Dataset:
    images = spark.range(6).selectExpr("concat('d', id % 1) AS dataset_id", "id AS image_id", "concat(id, '.png') AS file_name", "9L AS width", "9L AS height", "id AS ord")
    categories = spark.range(1).selectExpr("concat('d', id % 1) AS dataset_id", "id AS category_id", "'a' AS name", "id AS ord")
    box = "named_struct('kind', 'bounding_box', 'x', CAST(1 AS FLOAT), 'y', CAST(1 AS FLOAT), 'w', CAST(2 AS FLOAT), 'h', CAST(2 AS FLOAT), 'points', CAST(NULL AS ARRAY<STRUCT<x: FLOAT, y: FLOAT>>)) AS geometry"
    annotations = spark.range(18).selectExpr("concat('d', id % 1) AS dataset_id", "id AS annotation_id", "id % 6 AS image_id", "0L AS category_id", box, "id AS ord")
    return A.Dataset(images, categories, annotations)


def test_pieces_of_a_dataset_do_not_meet_in_a_task(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ds = _small(spark)
        for made in (A.coco_documents(ds, most=4)[0], A.datumaro_documents(ds, most=4)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            upper = plan[: plan.index("collect_list")]  # what is joined to the pieces once they are gathered
            assert not re.search(r"SortMergeJoin \[dataset_id#\d+\]", upper)
            assert made.groupBy("piece").count().count() > 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_texts_of_megabytes_are_written_in_small_row_groups(spark):
    rows = [("d", 0, "a.json", k, random.Random(k).randbytes(1 << 19).hex()) for k in range(40)]
    bundles = spark.createDataFrame(rows, "dataset_id string, ord long, path string, piece long, content string").coalesce(1)
    root = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/bundle-*"))
    found = B._document(bundles, None, False)
    assert found.select("piece", F.length("content").alias("n")).agg(F.count("*"), F.sum("n"), F.sum("piece")).first()[:] == (40, 40 << 20, 780)
    (made,) = set(glob.glob(f"{root}/bundle-*")) - before
    groups = [g.total_byte_size for f in glob.glob(f"{made}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert max(groups) < 24 << 20 < sum(groups)


def test_a_bundle_without_a_document_beside_others(spark):
    rows = [("d", 0, "a.json", 0, "{"), ("d", 0, "a.json", 1, "}"), ("e", 0, "b.txt", 0, "x"), (None, 0, "c.json", 0, "y")]
    bundles = spark.createDataFrame(rows, "dataset_id string, ord long, path string, piece long, content string")
    found = {tuple(r) for r in B._document(bundles, None, False).collect()}
    assert found == {("d", 0, "{"), ("d", 1, "}"), ("e", 0, None), (None, 0, "y")}


def test_a_document_is_taken_apart_behind_the_scan(spark):
    rows = [("d", k, '{"items": [{"id": 1}, {"id": 2}]}') for k in range(3)]
    doc = settle(spark.createDataFrame(rows, "dataset_id string, piece long, content string").select("dataset_id", "piece", F.parse_json("content").alias("d")), "docs")
    listed = B._listed(doc, "$.items", "array<struct<id:bigint,more:variant>>")
    scan = next(x for x in listed._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "variant" in scan and "array" not in scan
    assert sorted((r.ord >> 32, r.ord & 3, r.x.id) for r in listed.collect()) == [(k, i, i + 1) for k in range(3) for i in range(2)]
