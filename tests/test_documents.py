"""Strict documents and what passes through readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from bandlake.functions import documents as D
from bandlake.operators import annotations as A
from bandlake.sources import bundles
from tests.test_jobs import dataset

KIND = D.fields({"id": D.whole(0, 9)}, {"tags": D.array(D.string, 2), "n": D.number}, {"next": D.either(D.string, D.array(D.whole()))}, D.tagged("type", {"a": D.fields({"x": D.numbers(0, 255)})}))
CASES = {
    '{"id":1,"type":"b"}': None, ' {"id":9,"tags":["x","y"],"n":1e2,"next":null,"type":"a","x":[0,255],"more":{}} ': None, '{"id":1,"type":"b","next":[1]}': None, '{"id":1,"type":"a","x":[]}': None,
    '{"id":10,"type":"b"}': "id: expected a whole number from 0 to 9", '{"id":1.0,"type":"b"}': "id: expected a whole number from 0 to 9", '{"id":"1","type":"b"}': "id: expected a whole number from 0 to 9", '{"id":null,"type":"b"}': "id: expected a whole number from 0 to 9",
    '{"type":"b"}': "id: missing", '{"id":1}': "type: missing", '{"id":1,"type":4}': "type: expected a string", "[]": "expected an object", "7": "expected an object",
    '{"id":1,"type":"b","tags":["x"]}': "tags: expected 2 values", '{"id":1,"type":"b","tags":null}': "tags: expected an array", '{"id":1,"type":"b","tags":["x",2]}': "tags: [] expected a string", '{"id":1,"type":"b","n":"2"}': "n: expected a number",
    '{"id":1,"type":"b","next":7}': "next: expected an array", '{"id":1,"type":"a"}': "x: missing", '{"id":1,"type":"a","x":[256]}': "x: expected an array of whole numbers from 0 to 255", '{"id":1,"type":"a","x":[null]}': "x: expected an array of whole numbers from 0 to 255",
    **dict.fromkeys(['{"id":1,"type":"b"} x', '{"id":1,"type":"b"}}', '{"id":1,"type":"b"},{}', '{"id":1,"type":"b"},"k":true}', "", " ", "{", "{'id':1}", '{"id":NaN,"type":"b"}', '{"id":1,"id":2,"type":"b"}', None], "not a JSON document"),
}


def test_what_is_wrong_with_a_document(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "k int, text string")
    found = {r.k: r.wrong for r in rows.select("k", D.problem(F.col("text"), KIND).alias("wrong")).collect()}
    assert found == dict(enumerate(CASES.values()))


def test_each_wrong_document_has_one_row(spark):
    item = lambda **more: json.dumps({"categories": {"label": [{"name": "a"}]}, "items": [{"id": "x", "annotations": [{"type": "b_box", "bbox": [1, 2, 3, 4], **more}]}]})
    rows = [
        ("fine", 0, "annotations/default.json", item(attributes={"occluded": True, "deep": [1, {"a": None}]})), ("label", 0, "a.json", item(label=-1)), ("short", 0, "a.json", item(bbox=[1, 2, 3])), ("none", 0, "a.json", item(bbox=None)),
        ("list", 0, "a.json", item(attributes=[])), ("text", 0, "a.json", "nothing"), ("cut", 0, "a.json", item()[:-1]), ("tail", 0, "a.json", item() + "]"), ("empty", 0, "a.txt", item()), ("kind", 0, "a.json", item(type=None)),
    ]
    ds, warnings = bundles.read_datumaro(spark.createDataFrame(rows, "dataset_id string, ord long, path string, content string"))
    assert [(r.dataset_id, json.loads(r.text)) for r in ds.annotations.select("dataset_id", A.attributes_text(ds.annotations).alias("text")).collect()] == [("fine", {"deep": [1, {"a": None}], "occluded": True})]
    codes = sorted((r.dataset_id, r.code) for r in warnings.where("code <> 'missing_image_dimensions'").collect())
    assert codes == sorted([(r[0], "parse_error") for r in rows if r[0] not in ("fine", "empty")] + [("empty", "invalid_bundle")])


@pytest.mark.parametrize("way", ["datumaro", "coco"])
def test_attributes_and_info_make_the_round_trip(spark, way):
    ds = dataset(spark)
    told = F.when(F.col("annotation_id") == 1, F.parse_json(F.lit('{"z":1.5,"a":[true,{"b":null}],"n":"é"}')))
    info = spark.createDataFrame([("d", "about", "v1", 2020, "me", "today")], "dataset_id string, description string, version string, year long, contributor string, date_created string")
    ds = A.Dataset(ds.images, ds.categories, ds.annotations.withColumn("attributes", told), info)
    docs = A.datumaro_documents(ds) if way == "datumaro" else A.coco_documents(ds)[0]
    back, warnings = (bundles.read_datumaro if way == "datumaro" else bundles.read_coco)(docs.withColumn("ord", F.lit(0).cast("long")))
    assert warnings.count() == 0
    assert A.roundtrip_diff(ds, back).count() == 0
    lost = A.roundtrip_diff(ds, back, attributes=True).collect()
    assert len(lost) == (0 if way == "datumaro" else 2)  # COCO has no attributes
    assert tuple(back.info.first()) == (("d", "about", "", None, "", "") if way == "datumaro" else ("d", "about", "v1", 2020, "me", "today"))
    merged = A.merge_datasets(ds, back)
    assert sorted(r.t for r in merged.annotations.select(A.attributes_text(merged.annotations).alias("t")).collect()).count("{}") == (4 if way == "datumaro" else 5)


def test_bundles_are_judged_as_a_whole(spark):
    good = '{"files":[{"path":"a","bytes":[1,255],"mime_type":"t"}]}'
    cases = {good: "ok", good + " x": "invalid", "": "empty", "{}": "invalid", '{"files":null}': "invalid", good.replace("255", "256"): "invalid", good.replace("255", "-1"): "invalid", good.replace("255", "2.0"): "invalid", good.replace('"a"', "1"): "invalid", good.replace('"t"', "1"): "invalid", good.replace('"t"', "null"): "ok"}
    rows = spark.createDataFrame(list(enumerate(cases)), "dataset_id int, payload string")
    assert {r.dataset_id: r.status for r in bundles.validate_bundles(rows).collect()} == dict(enumerate(cases.values()))
    assert sorted((r.dataset_id, r.path, r.n_bytes, r.mime) for r in bundles.bundle_files(rows).collect()) == [(0, "a", 2, "t"), (10, "a", 2, None)]
