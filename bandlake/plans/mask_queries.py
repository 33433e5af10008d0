"""Mask, prompt and model queries: logit grids of 8 x 8 come from the embeddings, prompts from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.bands import f32
from ..operators import masks as M
from ..operators import tiles
from ..operators import models as X
from .fixtures import rows, view
from .pixel_queries import _resampled


def grids(s: SparkSession, d: str) -> DataFrame:
    px = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"].cast("float"))
    return view(s, d, "fx_values").groupBy(F.col("vec_id").alias("mask_id")).agg(px.alias("px")).select("mask_id", F.lit(8).alias("width"), F.lit(8).alias("height"), "px")


def cells(s: SparkSession, d: str) -> DataFrame:
    return grids(s, d).withColumn("cells", F.transform("px", lambda v: (v > 0).cast("int")))


def prompts(s: SparkSession, d: str) -> DataFrame:
    """Prompts as arrays, with the size of their image where it is known."""
    p = view(s, d, "fx_prompts").join(view(s, d, "fx_images").select("image_id", "width", "height", "num_bands"), "image_id")
    point = F.struct(F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), F.col("label"))
    points = F.when(F.col("prompt_id") % 5 == 0, F.array().cast(M.POINTS)).otherwise(F.array(point).cast(M.POINTS))
    box = F.when(F.col("has_box"), F.array(F.col("px"), F.col("py"), F.col("px") + f32(30.0), F.col("py") + f32(20.0)))
    return p.withColumn("points", points).withColumn("box", box)


def _entry(k: str) -> str:
    """A prompt entry as JSON text, of one of eleven shapes by ``k``, with numbers from it."""
    x, y = f"CAST({k} % 97 AS STRING)", f"CAST({k} % 13 AS STRING)"
    shapes = [f"'[' || {x} || ',' || {y} || '.5]'"] * 5 + [f"""'["' || {x} || '",2]'""", f"'[' || {x} || ']'", x, f"""'{{"x":' || {x} || ',"y":' || {y} || ',"label":1}}'""", f"""'{{"x":"' || {x} || '","y":2,"label":1}}'""", f"""'{{"x":' || {x} || ',"y":2,"label":1.5}}'"""]
    return f"CASE {k} % 11 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shapes)) + " END"


_RAW = f"""SELECT event_id, CASE event_id % 17 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '5' WHEN 3 THEN '{{"x":1}}' WHEN 4 THEN 'no json' WHEN 5 THEN '[' || {_entry("event_id")} || ']'
  WHEN 6 THEN '[' || {_entry("event_id")} || ', ' || {_entry("(event_id * 7 + 1)")} || ', ' || {_entry("(event_id * 5 + 3)")} || ']' ELSE '[' || {_entry("event_id")} || ', ' || {_entry("(event_id * 3 + user_id)")} || ']' END AS points,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '[1]' ELSE '[1,0]' END AS labels FROM events"""
_MODELS = """SELECT s_nationkey % 5 AS server, s_suppkey AS ord, s_name AS id, CASE s_suppkey % 3 WHEN 0 THEN 'detection' ELSE 'segmentation' END AS type,
  CASE s_suppkey % 5 WHEN 0 THEN 'point_list,bbox' WHEN 1 THEN 'bbox' WHEN 2 THEN 'text' WHEN 3 THEN 'image_region' ELSE 'point_list' END AS i, CASE s_suppkey % 4 WHEN 0 THEN 'mask' WHEN 1 THEN 'polygon_list' WHEN 2 THEN 'score' ELSE 'score,mask' END AS o FROM supplier"""
#: The regions, and a server without models.
_SERVERS = "(SELECT r_regionkey FROM region UNION ALL SELECT 9)"


def _models(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d, _MODELS).select("server", "ord", "id", "type", F.split("i", ",").alias("inputs"), F.split("o", ",").alias("outputs"))


def _segment(s: SparkSession, d: str) -> DataFrame:
    planned = M.plan_encodes(view(s, d, "fx_prompts").select("prompt_id", "image_id", "r", "g", "b", "px", "py"), view(s, d, "fx_images"))

    def encode(image):  # noqa: ANN001, ANN202
        return image["width"].iat[0], image["height"].iat[0]

    def decode(encoded, prompt):  # noqa: ANN001, ANN202
        x2, y2 = min(prompt["px"] + 24.0, encoded[0]), min(prompt["py"] + 24.0, encoded[1])
        return [max(prompt["px"] - 24.0, 0.0), max(prompt["py"] - 24.0, 0.0), x2, y2], 0.93

    return M.batch_segment(planned, encode, decode).select("prompt_id", "key", *[F.round(F.col("polygon")[k].cast("double"), 3).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], F.col("score").cast("double").alias("score"))


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    requests = rows(s, d, "SELECT event_id AS request_id, user_id AS image_id, CASE WHEN event_id % 13 = 0 THEN 'other' ELSE 'box' END AS model, CASE WHEN event_id % 7 = 0 THEN 'bad' END AS error FROM events")
    return M.request_outcome(requests, s.createDataFrame([("box",)], "model string"), view(s, d, "fx_images").select("image_id", paths.loader_for(F.col("path")).alias("loader")))


def _failures(s: SparkSession, d: str) -> DataFrame:
    """Outcomes of requests to a model that fails for some images and prompts."""
    prompts = view(s, d, "fx_prompts").select("prompt_id", "image_id", "r", "g", "b", "px")

    def encode(image):  # noqa: ANN001, ANN202
        if image["image_id"].iat[0] % 5 == 0:
            raise MemoryError("no room")
        return int(image["width"].iat[0])

    def decode(encoded, prompt):  # noqa: ANN001, ANN202
        if prompt["prompt_id"] % 11 == 0:
            raise ValueError(prompt["prompt_id"])
        return ["no", "polygon"] if prompt["prompt_id"] % 17 == 0 else ([0.0, 0.0, float(encoded), 1.0], 0.5)

    results = M.batch_segment(M.plan_encodes(prompts, view(s, d, "fx_images")), encode, decode)
    requests = rows(s, d, "SELECT event_id AS request_id, user_id AS image_id, CASE WHEN event_id % 13 = 0 THEN 'other' ELSE 'box' END AS model, CASE WHEN event_id % 7 = 0 THEN 'bad' END AS error FROM events")
    images = view(s, d, "fx_images").select("image_id", paths.loader_for(F.col("path")).alias("loader"))
    return M.request_outcome(requests, s.createDataFrame([("box",)], "model string"), images, results.select(F.col("prompt_id").alias("request_id"), "error"))


def _warm(s: SparkSession, d: str) -> DataFrame:
    def encode(image):  # noqa: ANN001, ANN202
        if image["image_id"].iat[0] % 5 == 0:
            raise MemoryError("no room")

    return M.warm(M.plan_encodes(view(s, d, "fx_prompts").select("prompt_id", "image_id", "r", "g", "b"), view(s, d, "fx_images")), encode)


def _flags(s: SparkSession, d: str) -> DataFrame:
    servers = rows(s, d, "SELECT r_regionkey AS server, CASE WHEN r_regionkey = 1 THEN true END AS inference, CASE WHEN r_regionkey = 2 THEN false END AS segmentation, r_regionkey = 3 AS progressive, CASE WHEN r_regionkey = 4 THEN true END AS thumbnails, CASE WHEN r_regionkey = 0 THEN true END AS downloads, CASE r_regionkey % 2 WHEN 0 THEN 'chunked' ELSE 'single_zip' END AS download_mode FROM (SELECT r_regionkey FROM region UNION ALL SELECT 9)")
    return X.server_flags(servers, _models(s, d))


QUERIES = {
    "m1_normalize_prompts": lambda s, d: rows(s, d, _RAW).withColumn("n", M.normalize_prompts(F.col("points"), F.col("labels"))).select("event_id", "n.error", F.array_join(F.transform("n.points", lambda p: F.format_string("%.1f %.1f %d", p["x"], p["y"], p["label"])), ",").alias("points")),
    "m2_validate_prompts": lambda s, d: prompts(s, d).select("prompt_id", M.validate_prompts(F.col("points"), F.col("box")).alias("error")),
    "m3_embedding_key": lambda s, d: M.plan_encodes(view(s, d, "fx_prompts"), view(s, d, "fx_images")).select("prompt_id", "key"),
    "m4_plan_encodes": lambda s, d: M.plan_encodes(view(s, d, "fx_prompts"), view(s, d, "fx_images")).groupBy("image_id").agg(F.countDistinct("key").alias("encodes"), F.count("*").alias("decodes")),
    "m5_batch_segment": _segment,
    "m6_box_model": lambda s, d: prompts(s, d).withColumn("m", M.box_model(F.col("points"), F.col("box"), F.col("width"), F.col("height"))).select("prompt_id", *[F.col("m.polygon")[k].cast("double").alias(n) for k, n in ((0, "x1"), (1, "y1"), (4, "x2"), (5, "y2"))]),
    "m7_scale_prompts": lambda s, d: prompts(s, d).select("prompt_id", F.posexplode(M.scale_prompts(F.col("points"), F.col("box"), F.col("width"), F.col("height"))).alias("i", "p")).select("prompt_id", "i", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"), "p.label"),
    "m8_upsample_logits": lambda s, d: M.upsample_logits(grids(s, d), 2).select("mask_id", F.posexplode("px").alias("i", "v")).withColumn("v", F.round(F.col("v").cast("double"), 5) + 0.0),
    "m9_threshold_resample": lambda s, d: grids(s, d).select("mask_id", F.array_join(M.threshold_resample(F.col("px"), F.col("width"), F.col("height"), F.lit(5), F.lit(11)), "").alias("cells")),
    "m8_tiled_upsample": lambda s, d: tiles.whole(tiles.resample(tiles.cut(grids(s, d).select("mask_id", "width", "height", "px"), 5), F.lit(16), F.lit(16), side=5), 5).select("mask_id", F.posexplode("px").alias("i", "v")).withColumn("v", F.round(F.col("v").cast("double"), 5) + 0.0),
    "m9_tiled_threshold": lambda s, d: tiles.whole(tiles.resample(tiles.cut(grids(s, d).select("mask_id", "width", "height", "px"), 5), F.lit(5), F.lit(11), side=5, way=tiles.NEAREST), 5).select("mask_id", F.array_join(F.transform("px", lambda v: v.cast("int")), "").alias("cells")),
    "m10_tiled_components": lambda s, d: tiles.label_components(tiles.cut(cells(s, d).select("mask_id", "width", "height", F.transform("cells", lambda v: v.cast("float")).alias("px")), 3), 3).select("mask_id", "first", "pixels"),
    "m10_label_components": lambda s, d: M.label_components(cells(s, d)).select("mask_id", "first", "pixels"),
    "m11_largest_component": lambda s, d: M.largest_component(M.label_components(cells(s, d))).select("mask_id", "first", "pixels"),
    "m12_mask_to_polygon": lambda s, d: M.mask_to_polygon(cells(s, d)),
    "m13_simplify_polygons": lambda s, d: M.simplify_polygons(M.mask_to_polygon(cells(s, d)), 1.0),
    "m14_contour_grid_scale": lambda s, d: view(s, d, "fx_images").select("image_id", *[c.cast("double").alias(n) for c, n in zip(M.contour_grid(F.col("width"), F.col("height")), ("w", "h", "sx", "sy"), strict=True)]),
    "m15_postprocess_masks": lambda s, d: M.postprocess_masks(grids(s, d), F.lit(40), F.lit(24)),
    "m16_vector_diff": lambda s, d: grids(s, d).join(grids(s, d).select((F.col("mask_id") + 1).alias("mask_id"), F.col("px").alias("q")), "mask_id").withColumn("d", M.vector_diff(F.col("px"), F.col("q"))).select("mask_id", "d.error", F.round(F.col("d.max").cast("double"), 6).alias("max"), F.round("d.mean", 6).alias("mean")),
    "m17_mask_agreement": lambda s, d: prompts(s, d).withColumn("a", M.box_model(F.col("points"), F.col("box"), F.col("width"), F.col("height"))["polygon"]).withColumn("b", M.box_model(F.col("points"), F.lit(None).cast("array<float>"), F.col("width"), F.col("height"))["polygon"]).withColumn("m", M.mask_agreement(F.col("a"), F.col("b"))).select("prompt_id", F.col("m.difference").cast("double").alias("difference"), "m.agrees"),
    "m18_segment_response": lambda s, d: rows(s, d, "SELECT event_id, event_id % 3 AS k FROM events").select("event_id", M.segment_response(F.when(F.col("k") > 0, F.array(F.array(f32(1.0), f32(2.5)))), F.when(F.col("k") > 1, F.array(f32(0.5)))).alias("body")),
    "m19_request_outcome": _outcomes,
    "m19_model_failures": _failures,
    "m19_warm_requests": _warm,
    "x1_prompt_capabilities": lambda s, d: X.prompt_capabilities(_models(s, d)),
    "x2_server_flags": _flags,
    "x3_find_models": lambda s, d: X.find_models(_models(s, d), "detection"),
}

_P = """p AS (SELECT f.prompt_id, f.image_id, r, g, b, px, py, label, has_box, width, height, num_bands FROM fx_prompts f JOIN fx_images i ON i.image_id = f.image_id)"""
_KEY = "image_id || '#' || least(r, num_bands - 1) || ':' || least(g, num_bands - 1) || ':' || least(b, num_bands - 1)"
_DOT = "prompt_id % 5 <> 0 AND label = 1"
_XY = {
    "x1": f"CASE WHEN {{box}} THEN px WHEN {_DOT} THEN greatest(px - 24.0::FLOAT, 0.0::FLOAT) ELSE 0.0::FLOAT END",
    "y1": f"CASE WHEN {{box}} THEN py WHEN {_DOT} THEN greatest(py - 24.0::FLOAT, 0.0::FLOAT) ELSE 0.0::FLOAT END",
    "x2": f"CASE WHEN {{box}} THEN px + 30.0::FLOAT WHEN {_DOT} THEN least(px + 24.0::FLOAT, CAST(width AS FLOAT)) ELSE 32.0::FLOAT END",
    "y2": f"CASE WHEN {{box}} THEN py + 20.0::FLOAT WHEN {_DOT} THEN least(py + 24.0::FLOAT, CAST(height AS FLOAT)) ELSE 32.0::FLOAT END",
}
_GRID = "v AS (SELECT vec_id AS mask_id, list(CAST(v AS FLOAT) ORDER BY i) AS px FROM fx_values GROUP BY vec_id)"
_REACH = """c AS (SELECT vec_id AS mask_id, i FROM fx_values WHERE CAST(v AS FLOAT) > 0),
e AS (SELECT a.mask_id, a.i, b.i AS j FROM c a JOIN c b ON a.mask_id = b.mask_id AND (abs(a.i - b.i) = 8 OR (abs(a.i - b.i) = 1 AND a.i // 8 = b.i // 8))),
t AS (SELECT mask_id, i AS root, i FROM c UNION SELECT t.mask_id, t.root, e.j FROM t JOIN e ON e.mask_id = t.mask_id AND e.i = t.i),
l AS (SELECT mask_id, i, min(root) AS first FROM t GROUP BY mask_id, i),
s AS (SELECT mask_id, CAST(first AS BIGINT) AS first, count(*) AS pixels FROM l GROUP BY mask_id, first)"""
_NEAR = "CAST(least(greatest(round((CAST({k} AS FLOAT) + 0.5::FLOAT) * (8.0::FLOAT / {n}.0::FLOAT) - 0.5::FLOAT), 0), 7) AS INT)"
_NUMBER = "coalesce(json_type(v, '{}') IN ('DOUBLE', 'BIGINT', 'UBIGINT'), false)"
_WHOLE = "coalesce(json_type(v, '{}') IN ('BIGINT', 'UBIGINT'), false)"
_MASKS = "type = 'segmentation' AND (list_contains(string_split(o, ','), 'mask') OR list_contains(string_split(o, ','), 'polygon_list'))"
_IN = "list_contains(string_split(i, ','), '{t}')"

SQL = {
    "m1_normalize_prompts": f"""WITH r AS ({_RAW}), j AS (SELECT event_id, points IS NULL AS none, try_cast(points AS JSON) AS j, from_json(labels, '["INTEGER"]') AS m FROM r),
      i AS (SELECT *, json_type(j) AS kind, CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]') END AS items FROM j),
      e AS (SELECT *, json_type(items[1]) AS shape,
        list_transform(items, lambda v: CASE WHEN json_type(v) <> 'ARRAY' THEN '{M.NO_PAIR}' WHEN json_array_length(v) <> 2 THEN '{M.NOT_TWO}' WHEN NOT {_NUMBER.format("$[0]")} THEN '{M.PAIR_X}' WHEN NOT {_NUMBER.format("$[1]")} THEN '{M.PAIR_Y}' END) AS pe,
        list_transform(items, lambda v: CASE WHEN NOT {_NUMBER.format("$.x")} THEN '{M.OBJECT_X}' WHEN NOT {_NUMBER.format("$.y")} THEN '{M.OBJECT_Y}' WHEN NOT {_WHOLE.format("$.label")} THEN '{M.OBJECT_LABEL}' END) AS oe FROM i),
      f AS (SELECT *, CASE WHEN none OR len(items) = 0 THEN NULL WHEN kind IS NULL OR kind <> 'ARRAY' THEN '{M.NO_ARRAY}'
        WHEN shape = 'ARRAY' THEN CASE WHEN m IS NULL THEN '{M.NO_LABELS}' WHEN len(m) <> len(items) THEN '{M.UNEQUAL}' ELSE list_filter(pe, lambda x: x IS NOT NULL)[1] END
        WHEN shape = 'OBJECT' THEN list_filter(oe, lambda x: x IS NOT NULL)[1] ELSE '{M.NO_SHAPE}' END AS error FROM e)
      SELECT event_id, error, CASE WHEN error IS NULL THEN coalesce(array_to_string(list_transform(items, lambda v, k: CASE WHEN shape = 'ARRAY' THEN printf('%.1f %.1f %d', CAST(v->'$[0]' AS DOUBLE), CAST(v->'$[1]' AS DOUBLE), m[k]) ELSE printf('%.1f %.1f %d', CAST(v->'$.x' AS DOUBLE), CAST(v->'$.y' AS DOUBLE), CAST(v->'$.label' AS INT)) END), ','), '') END AS points FROM f""",
    "m2_validate_prompts": f"WITH {_P} SELECT prompt_id, CASE WHEN prompt_id % 5 = 0 AND NOT has_box THEN 'At least one prompt (points or box) is required' END AS error FROM p",
    "m3_embedding_key": f"WITH {_P} SELECT prompt_id, {_KEY} AS key FROM p",
    "m4_plan_encodes": f"WITH {_P} SELECT image_id, count(DISTINCT {_KEY}) AS encodes, count(*) AS decodes FROM p GROUP BY image_id",
    "m5_batch_segment": f"WITH {_P} SELECT prompt_id, {_KEY} AS key, round(greatest(px::DOUBLE - 24, 0), 3) AS x1, round(greatest(py::DOUBLE - 24, 0), 3) AS y1, round(least(px::DOUBLE + 24, width), 3) AS x2, round(least(py::DOUBLE + 24, height), 3) AS y2, 0.93::FLOAT::DOUBLE AS score FROM p",
    "m6_box_model": f"WITH {_P} SELECT prompt_id, " + ", ".join(f"({e.format(box='has_box')})::DOUBLE AS {n}" for n, e in _XY.items()) + " FROM p",
    "m7_scale_prompts": f"""WITH {_P}, q AS (SELECT *, CAST(1024 AS FLOAT) / CAST(width AS FLOAT) AS sx, CAST(1024 AS FLOAT) / CAST(height AS FLOAT) AS sy FROM p),
      z AS (SELECT prompt_id, 0 AS o, px * sx AS x, py * sy AS y, label FROM q WHERE prompt_id % 5 <> 0 UNION ALL SELECT prompt_id, 1, px * sx, py * sy, 2 FROM q WHERE has_box UNION ALL SELECT prompt_id, 2, (px + 30.0::FLOAT) * sx, (py + 20.0::FLOAT) * sy, 3 FROM q WHERE has_box
        UNION ALL SELECT prompt_id, 0, 0.0::FLOAT, 0.0::FLOAT, -1 FROM q WHERE prompt_id % 5 = 0 AND NOT has_box)
      SELECT prompt_id, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY o) - 1 AS INT) AS i, x::DOUBLE AS x, y::DOUBLE AS y, label FROM z""",
    "m8_upsample_logits": f"WITH {_GRID}, u AS (SELECT mask_id, {_resampled('px', 8, 8, 16, 16)} AS q FROM v) SELECT mask_id, generate_subscripts(q, 1) - 1 AS i, round(unnest(q)::DOUBLE, 5) + 0.0 AS v FROM u",
    "m9_threshold_resample": f"WITH {_GRID} SELECT mask_id, array_to_string(list_transform(range(55), lambda k: CAST(px[{_NEAR.format(k='(k // 5)', n=11)} * 8 + {_NEAR.format(k='(k % 5)', n=5)} + 1] > 0 AS INT)), '') AS cells FROM v",
    "m10_label_components": f"WITH RECURSIVE {_REACH} SELECT mask_id, first, pixels FROM s",
    "m11_largest_component": f"WITH RECURSIVE {_REACH}, o AS (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY pixels DESC, first DESC) AS n FROM s) SELECT mask_id, first, pixels FROM o WHERE n = 1",
    "m14_contour_grid_scale": "SELECT image_id, least(width, 1024)::DOUBLE AS w, least(height, 1024)::DOUBLE AS h, (CAST(width AS FLOAT) / CAST(least(width, 1024) AS FLOAT))::DOUBLE AS sx, (CAST(height AS FLOAT) / CAST(least(height, 1024) AS FLOAT))::DOUBLE AS sy FROM fx_images",
    "m16_vector_diff": "SELECT a.vec_id AS mask_id, CAST(NULL AS VARCHAR) AS error, round(max(abs(CAST(a.v AS FLOAT) - CAST(b.v AS FLOAT)))::DOUBLE, 6) AS max, round(avg(abs(CAST(a.v AS FLOAT) - CAST(b.v AS FLOAT))::DOUBLE), 6) AS mean FROM fx_values a JOIN fx_values b ON b.vec_id + 1 = a.vec_id AND b.i = a.i GROUP BY a.vec_id",
    "m17_mask_agreement": f"WITH {_P}, d AS (SELECT prompt_id, greatest(" + ", ".join(f"abs({f}({_XY[a].format(box='has_box')}, {_XY[b].format(box='has_box')}) - {f}({_XY[a].format(box='false')}, {_XY[b].format(box='false')}))" for a, b in (("x1", "x2"), ("y1", "y2")) for f in ("least", "greatest")) + ") AS m FROM p) SELECT prompt_id, m::DOUBLE AS difference, m <= 24 AS agrees FROM d",
    "m18_segment_response": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"masks":[]}' WHEN 1 THEN '{"masks":[[1.0,2.5]]}' ELSE '{"masks":[[1.0,2.5]],"scores":[0.5]}' END AS body FROM events""",
    "m19_request_outcome": """WITH o AS (SELECT event_id AS request_id, CASE WHEN event_id % 13 = 0 THEN 'model_not_found' WHEN event_id % 7 = 0 THEN 'invalid_inputs' WHEN i.image_id IS NULL THEN 'image_not_found' WHEN i.image_id % 6 > 3 THEN 'unsupported_format' ELSE 'ok' END AS code FROM events LEFT JOIN fx_images i ON i.image_id = user_id)
      SELECT request_id, code, CASE code WHEN 'ok' THEN 200 WHEN 'image_not_found' THEN 404 ELSE 400 END AS status FROM o""",
    "m19_model_failures": """WITH o AS (SELECT event_id AS request_id, CASE WHEN event_id % 13 = 0 THEN 'model_not_found' WHEN event_id % 7 = 0 THEN 'invalid_inputs' WHEN i.image_id IS NULL THEN 'image_not_found' WHEN i.image_id % 6 > 3 THEN 'unsupported_format'
        WHEN i.image_id % 5 = 0 THEN 'model_prepare_failed' WHEN event_id % 11 = 0 THEN 'inference_failed' WHEN event_id % 17 = 0 THEN 'internal_error' ELSE 'ok' END AS code FROM events LEFT JOIN fx_images i ON i.image_id = user_id)
      SELECT request_id, code, CASE WHEN code = 'ok' THEN 200 WHEN code = 'image_not_found' THEN 404 WHEN code IN ('model_prepare_failed', 'inference_failed', 'internal_error') THEN 500 ELSE 400 END AS status FROM o""",
    "m19_warm_requests": f"WITH {_P} SELECT DISTINCT {_KEY} AS key, CASE WHEN image_id % 5 = 0 THEN 'model_prepare_failed' END AS error, CASE WHEN image_id % 5 = 0 THEN 'MemoryError: no room' END AS message FROM p",
    "x1_prompt_capabilities": f"WITH m AS ({_MODELS}) SELECT ord, id, type, {_MASKS} AND {_IN.format(t='point_list')} AS point, {_MASKS} AND {_IN.format(t='bbox')} AS bbox, {_MASKS} AND {_IN.format(t='point_list')} AND {_IN.format(t='bbox')} AS point_bbox, {_MASKS} AND {_IN.format(t='text')} AS text, {_MASKS} AND {_IN.format(t='image_region')} AS example FROM m",
    "x2_server_flags": f"""WITH m AS ({_MODELS}), b AS (SELECT server, count(*) AS n, bool_or({_MASKS} AND {_IN.format(t='point_list')}) AS q FROM m GROUP BY server),
      f AS (SELECT r_regionkey AS server, r_regionkey = 1 OR coalesce(n, 0) > 0 AS inference, coalesce(q, false) AS segmentation, r_regionkey % 2 = 0 AS chunked, r_regionkey = 3 AS prog FROM {_SERVERS} r LEFT JOIN b ON b.server = r_regionkey)
      SELECT server, inference, segmentation, chunked, prog OR inference AS progressive, server = 4 OR server = 0 OR chunked AS thumbnails, CASE WHEN segmentation THEN 'segmentation' WHEN inference OR prog THEN 'full' ELSE 'core' END AS profile FROM f""",
    "x3_find_models": f"WITH m AS ({_MODELS}) SELECT server, arg_min(id, ord) FILTER (type = 'detection') AS first_of_kind, arg_min(id, ord) FILTER ({_MASKS} AND {_IN.format(t='point_list')}) AS first_promptable FROM m GROUP BY server",
}
# tiles give what whole masks give
SQL |= {"m8_tiled_upsample": SQL["m8_upsample_logits"], "m9_tiled_threshold": SQL["m9_threshold_resample"], "m10_tiled_components": SQL["m10_label_components"]}
