"""Annotation bundles: reading COCO, Datumaro and YOLO into datasets, and project states.

A bundle is rows dataset_id, ord, path, content (text). Every reader returns (dataset, warnings: dataset_id, code, message).
A JSON document may come in pieces, rows of one ord and path that are told apart by ``piece``, from 0: each is a document by itself, whose
lists go on with those of the one before; info and categories are taken from piece 0. One wrong piece makes the document wrong.
JSON documents are VARIANT, so that attributes of any kind pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import geometry as G
from ..operators.annotations import KEY, Dataset
from ..operators.ordinals import running
from ..session import settle

MAX_STATE_BYTES = 64 << 20


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Text files below ``root``, one folder per dataset, ordered by path; names may hold any character."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit("/" + root.split(":", 1)[-1].strip("/") + "/"), "/+", "/")
    below = F.substring(F.regexp_replace("path", r"^\w+:/*", "/"), F.length(base) + 1, F.lit(1 << 20))
    named = settle(found.select(F.substring_index(below, "/", 1).alias(KEY), F.regexp_extract(below, "^[^/]+/(.*)$", 1).alias("path"), F.decode("content", "UTF-8").alias("content")).where("path <> ''"), "bundle-files")
    ranked = named.select(KEY, "path").withColumn("ord", (F.row_number().over(Window.partitionBy(KEY).orderBy("path")) - 1).cast("long"))
    return named.join(ranked, [KEY, "path"]).select(KEY, "ord", "path", "content")


def file_by_path(bundles: DataFrame, path: str) -> DataFrame:
    return bundles.where(F.col("path") == path).groupBy(KEY).agg(F.min_by(F.struct("path", "content", "ord"), "ord").alias("file"))


def first_by_suffix(bundles: DataFrame, suffix: str) -> DataFrame:
    return bundles.where(F.endswith("path", F.lit(suffix))).groupBy(KEY).agg(F.min_by(F.struct("path", "content", "ord"), "ord").alias("file"))


def _document(bundles: DataFrame, exact: str | None, any_file: bool) -> DataFrame:
    """dataset_id, piece, content of the file that holds the annotations; content is null for none."""
    path, at = F.col("path"), F.struct("ord", "path")
    rules = ([path == exact] if exact else []) + [F.endswith(path, F.lit(".json"))] + ([F.lit(True)] if any_file else [])
    held = bundles if "piece" in bundles.columns else bundles.withColumn("piece", F.lit(0).cast("long"))
    held = settle(held.select(KEY, "ord", "path", "piece", "content"), "bundle", large_rows=True)
    chosen = settle(held.groupBy(KEY).agg(F.coalesce(*[F.min(F.when(rule, at)) for rule in rules]).alias("at")), "chosen")
    # an inner join, as that can look few datasets up without gathering all pieces of one in a task
    same = F.col(f"c.{KEY}").eqNullSafe(F.col(f"h.{KEY}")) & (F.col("c.at.ord") == F.col("h.ord")) & (F.col("c.at.path") == F.col("h.path"))
    found = held.alias("h").join(chosen.alias("c"), same).select(f"c.{KEY}", F.coalesce("h.piece", F.lit(0)).alias("piece"), "h.content")
    none = chosen.where("at.ord IS NULL OR at.path IS NULL")
    return found.unionByName(none.select(KEY, F.lit(0).cast("long").alias("piece"), F.lit(None).cast("string").alias("content")))


_ID, _SIZE = D.whole(), D.whole(0, (1 << 32) - 1)
_COCO_KIND = D.fields(default={
    "info": D.fields(default={"year": _SIZE, **dict.fromkeys(("version", "description", "contributor", "url", "date_created"), D.string)}),
    "images": D.array(D.fields({"id": _ID, "file_name": D.string, "width": _SIZE, "height": _SIZE}, optional={"license": _SIZE, **dict.fromkeys(("coco_url", "flickr_url", "date_captured"), D.string)})),
    "annotations": D.array(D.fields(
        {"id": _ID, "image_id": _ID, "category_id": _ID, "area": D.number, "iscrowd": D.whole(0, 255)},
        optional={"bbox": D.array(D.number, 4), "segmentation": D.either(D.array(D.array(D.number)), D.fields(default={"size": D.array(_SIZE)})), "point": D.array(D.number, 2)},
    )),
    "categories": D.array(D.fields({"id": _ID, "name": D.string, "supercategory": D.string})),
    "licenses": D.array(D.fields({"id": _SIZE, "name": D.string, "url": D.string})),
})
_COCO_IMAGES, _COCO_CATEGORIES = "array<struct<id:bigint,file_name:string,width:bigint,height:bigint>>", "array<struct<id:bigint,name:string>>"
_COCO_ANNOTATIONS = "array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<float>,segmentation:variant,area:float,iscrowd:int,point:array<float>>>"


def _judged(bundles: DataFrame, kind: D.Kind, exact: str | None, any_file: bool, label: str) -> tuple[DataFrame, DataFrame]:
    """(dataset_id, piece, d: the pieces of the document of each sound bundle as VARIANT; warnings: one row for each bundle without document or with a wrong one)."""
    doc = _document(bundles, exact, any_file).withColumn("d", D.whole_document(F.col("content")))
    found = F.when(F.col("content").isNull(), "no document in the bundle").when(F.col("d").isNull(), "not a JSON document").otherwise(kind(F.col("d")))
    doc = settle(doc.withColumn("wrong", found).withColumn("none", F.col("content").isNull()).drop("content"), label.lower(), large_rows=True)
    wrong = settle(doc.where("wrong IS NOT NULL").groupBy(KEY).agg(F.min_by(F.struct("wrong", "none"), "piece").alias("w")).select(KEY, "w.*"), "wrong-documents")
    bad = wrong.select(KEY, F.when(F.col("none"), "invalid_bundle").otherwise("parse_error").alias("code"), F.concat(F.lit(f"{label} document can't be read: "), F.col("wrong")).alias("message"))
    good = doc.where("wrong IS NULL").alias("d").join(wrong.alias("w"), F.col(f"d.{KEY}").eqNullSafe(F.col(f"w.{KEY}")), "left_anti")
    return good.select(KEY, "piece", "d"), bad


def _listed(doc: DataFrame, path: str, schema: str) -> DataFrame:
    """dataset_id, ord, x: the entries of an array of the documents, in order; the piece is the upper half of ord."""
    # asked for through a condition, the array isn't taken apart by the scan, which would hold those of all rows of a batch at once
    one = F.when(F.col("piece").isNotNull(), F.col("d"))
    listed = doc.select(KEY, "piece", F.posexplode(F.try_variant_get(one, path, schema)).alias("pos", "x"))
    return listed.select(KEY, (F.shiftleft(F.col("piece").cast("long"), 32) + F.col("pos")).alias("ord"), "x")


def _info(doc: DataFrame) -> DataFrame:
    """dataset_id, description, version, year, contributor, date_created; absent ones are empty or null (year)."""
    text = lambda c: F.coalesce(F.try_variant_get("d", f"$.info.{c}", "string"), F.lit("")).alias(c)
    return doc.where("piece = 0").select(KEY, text("description"), text("version"), F.try_variant_get("d", "$.info.year", "bigint").alias("year"), text("contributor"), text("date_created"))


def read_coco(bundles: DataFrame) -> tuple[Dataset, DataFrame]:
    """A document that is not whole JSON of the right kinds and ranges counts as a whole (one ``parse_error``), as does a bundle without one (``invalid_bundle``).

    An annotation without usable shape is skipped. The format has no attributes. Ids must fit a BIGINT.
    """
    good, bad = _judged(bundles, _COCO_KIND, None, True, "COCO")
    images = _listed(good, "$.images", _COCO_IMAGES).select(KEY, F.col("x.id").alias("image_id"), "x.file_name", "x.width", "x.height", "ord")
    categories = _listed(good.where("piece = 0"), "$.categories", _COCO_CATEGORIES).select(KEY, F.col("x.id").alias("category_id"), "x.name", "ord")
    first = F.get(F.try_variant_get("x.segmentation", "$", "array<array<float>>"), F.lit(0))
    read = _listed(good, "$.annotations", _COCO_ANNOTATIONS).withColumn("r", G.coco_geometry(F.col("x.bbox"), first, F.col("x.point")))
    annotations = read.where("r.error IS NULL").select(KEY, F.col("x.id").alias("annotation_id"), "x.image_id", "x.category_id", F.col("r.geometry").alias("geometry"), F.parse_json(F.lit("{}")).alias("attributes"), "ord")
    skipped = read.where("r.error IS NOT NULL").select(KEY, F.lit("invalid_record").alias("code"), F.concat(F.lit("Skipped invalid COCO annotation "), F.col("x.id").cast("string"), F.lit(": "), F.col("r.error")).alias("message"))
    year = _info(good).withColumn("year", F.coalesce("year", F.lit(0)))  # this format's year is never absent
    return Dataset(images, categories, annotations, year), skipped.unionByName(bad)


_DATUMARO_ITEMS = """array<struct<id:string,image:struct<path:string,size:array<bigint>>,
annotations:array<struct<id:bigint,label:bigint,type:string,bbox:array<float>,points:array<float>,attributes:variant>>>>"""


def _datumaro_kind(bbox_tags: tuple[str, ...]) -> D.Kind:
    attributes = D.fields()
    points = D.fields({"points": D.array(D.number)})
    shape = D.tagged("type", {**dict.fromkeys(bbox_tags, D.fields({"bbox": D.array(D.number, 4)})), "polygon": points, "points": points})
    annotation = D.fields(default={"group": _ID, "attributes": attributes}, optional={"id": _ID, "label": _ID}, more=shape)
    image = D.fields({"path": D.string}, optional={"size": D.array(_SIZE, 2)})
    label = D.fields({"name": D.string}, default={"parent": D.string, "attributes": D.array(D.string)})
    item = D.fields({"id": D.string}, default={"annotations": D.array(annotation), "attributes": attributes}, optional={"image": image})
    return D.fields({"categories": D.fields(default={"label": D.array(label)})}, default={"info": D.fields(default={"description": D.string}), "items": D.array(item)})


def number_missing(rows: DataFrame, given: Column, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: given ids, else the next of a counter from 1 that only missing ones advance; it may collide with given ids."""
    counted = running(rows, KEY, order, given.isNull(), "__nth")
    return counted.withColumn(name, F.coalesce(given, "__nth")).drop("__nth")


def read_datumaro(bundles: DataFrame, policy: str = "allow_lossy_warn", bbox_tags: tuple[str, ...] = ("b_box",)) -> tuple[Dataset, DataFrame]:
    """Attributes of annotations and the description are kept; documents are judged as in ``read_coco``."""
    doc, bad = _judged(bundles, _datumaro_kind(bbox_tags), "annotations/default.json", False, "Datumaro")
    categories = _listed(doc.where("piece = 0"), "$.categories.label", "array<struct<name:string>>").select(KEY, F.col("ord").alias("category_id"), "x.name", "ord")
    counts = categories.groupBy(KEY).agg(F.count("*").alias("n_labels"))
    items = _listed(doc, "$.items", _DATUMARO_ITEMS)
    given = F.when(F.col("x.id").rlike(r"^\+?\d+$"), F.col("x.id").try_cast("long"))
    items = settle(number_missing(items, given, ["ord"], "image_id"), "datumaro-items")
    size, at_least = F.col("x.image.size"), lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    images = items.select(KEY, "image_id", F.coalesce("x.image.path", F.concat("x.id", F.lit(".png"))).alias("file_name"), at_least(F.get(size, F.lit(1))).alias("width"), at_least(F.get(size, F.lit(0))).alias("height"), F.col("ord").cast("long").alias("ord"))
    no_size = items.where(size.isNull()).select(KEY, F.lit("missing_image_dimensions").alias("code"), F.concat(F.lit("Item "), F.col("x.id"), F.when(F.col("x.image").isNull(), " missing image info; defaulting to 1x1").otherwise(" missing image size; defaulting to 1x1")).alias("message"))
    rows = items.select(KEY, "image_id", "ord", F.col("x.id").alias("item"), F.posexplode("x.annotations").alias("at", "a")).join(counts, KEY, "left")
    label = F.coalesce("a.label", F.lit(0))
    rows = rows.withColumn("label", label).withColumn("in_range", F.col("label") < F.coalesce("n_labels", F.lit(0))).withColumn("r", G.datumaro_geometry(F.col("a.type"), F.coalesce("a.bbox", "a.points"), policy, bbox_tags))
    rows = settle(rows, "datumaro-annotations")
    accepted = rows.where("in_range AND r.geometry IS NOT NULL")
    accepted = settle(running(accepted.withColumn("given", F.col("a.id")), KEY, ["ord", "at"], F.lit(1), "nth"), "datumaro-accepted")
    accepted = number_missing(accepted, F.col("given"), ["ord", "at"], "annotation_id")
    annotations = accepted.select(KEY, "annotation_id", "image_id", F.col("label").alias("category_id"), F.col("r.geometry").alias("geometry"), F.coalesce("a.attributes", F.parse_json(F.lit("{}"))).alias("attributes"), (F.col("nth") - 1).alias("ord"))
    outside = rows.where(~F.col("in_range")).select(KEY, F.lit("invalid_record").alias("code"), F.concat(F.lit("Item "), F.col("item"), F.lit(" references invalid label "), F.col("label").cast("string")).alias("message"))
    failed = rows.where("in_range AND r.error IS NOT NULL").select(KEY, F.lit("parse_error").alias("code"), F.col("r.error").alias("message"))
    dropped = rows.where("in_range AND r.skipped").select(KEY, F.lit("skipped").alias("code"), F.concat(F.lit("Item "), F.col("item")).alias("message"))
    return Dataset(images, categories, annotations, _info(doc)), no_size.unionByName(outside).unionByName(failed).unionByName(dropped).unionByName(bad)


def resolve_label_files(wanted: DataFrame, bundles: DataFrame, strict_basename: bool = False) -> DataFrame:
    """``wanted`` (dataset_id, label_path, ...) with content: the exact path, else with separators as ``__``, else the first file that ends with the base name.

    Files are told apart by their ``ord``. As a plain suffix, ``1.txt`` also ends ``11.txt``; ``strict_basename`` wants the whole name.
    """
    files = bundles.select(KEY, "path", "ord")  # contents are fetched last
    # joins are by sorting: as many rows on either side as there are files, whatever their columns' sizes make Spark believe
    least = lambda df, *keys: df.groupBy(KEY, *keys).agg(F.min("ord").alias("at"))
    by_path = least(files, "path")
    a = wanted.join(by_path.select(KEY, F.col("path").alias("label_path"), F.col("at").alias("f1")).hint("merge"), [KEY, "label_path"], "left")
    a = a.withColumn("flat", F.regexp_replace("label_path", r"[/\\]", "__")).join(by_path.select(KEY, F.col("path").alias("flat"), F.col("at").alias("f2")).hint("merge"), [KEY, "flat"], "left")
    a = a.withColumn("base", F.regexp_extract("label_path", r"([^/\\]*)$", 1))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    # a base name holds no separator, so it can only end a file's name
    ends = F.array(F.regexp_extract("path", r"([^/\\]*)$", 1)) if strict_basename else F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.right(name, n))
    by_end = least(files.select(KEY, "ord", F.explode(ends).alias("base")), "base").select(KEY, "base", F.col("at").alias("f3"))
    a = a.join(by_end.hint("merge"), [KEY, "base"], "left").withColumn("at", F.coalesce("f1", "f2", "f3")).drop("f1", "f2", "f3", "flat", "base")
    return a.join(bundles.select(KEY, F.col("ord").alias("at"), "content").hint("merge"), [KEY, "at"], "left").drop("at")


def read_yolo(bundles: DataFrame, *, shape: str = "bbox", strict_basename: bool = False) -> tuple[Dataset, DataFrame]:
    """Detect (``bbox``) or segmentation (``polygon``) bundles: classes.txt, image_meta.json if there, label files."""
    bundles = settle(bundles, "yolo")
    classes = bundles.where("path = 'classes.txt'")
    names = F.filter(F.transform(F.split("content", r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    categories = classes.select(KEY, F.posexplode(names).alias("ord", "name")).select(KEY, F.col("ord").cast("long").alias("category_id"), "name", F.col("ord").cast("long").alias("ord"))
    counts = categories.groupBy(KEY).agg(F.count("*").alias("n_classes"))
    meta_schema = "array<struct<id:bigint,file_name:string,width:bigint,height:bigint,label_path:string>>"
    metas = bundles.where("path = 'image_meta.json'").select(KEY, F.posexplode(F.from_json("content", meta_schema)).alias("ord", "m"))
    with_meta = bundles.where("path = 'image_meta.json'").select(KEY).distinct()
    labels = bundles.where(F.endswith("path", F.lit(".txt")) & (F.col("path") != "classes.txt")).join(with_meta, KEY, "left_anti")
    labels, place = running(labels, KEY, ["ord"], F.lit(1), "place"), F.col("place")
    guessed = labels.select(KEY, (place - 1).alias("ord"), F.struct(place.cast("long").alias("id"), F.replace(F.replace("path", F.lit("labels/"), F.lit("")), F.lit(".txt"), F.lit(".png")).alias("file_name"), F.lit(1).cast("long").alias("width"), F.lit(1).cast("long").alias("height"), F.col("path").alias("label_path")).alias("m"))
    meta = metas.unionByName(guessed)
    images = meta.select(KEY, F.col("m.id").alias("image_id"), "m.file_name", F.greatest("m.width", F.lit(1)).alias("width"), F.greatest("m.height", F.lit(1)).alias("height"), F.col("ord").cast("long").alias("ord"))
    wanted = meta.select(KEY, F.col("m.id").alias("image_id"), F.col("m.label_path").alias("label_path"), F.col("m.width").alias("width"), F.col("m.height").alias("height"), "ord")
    found = settle(resolve_label_files(settle(wanted, "yolo-images"), bundles, strict_basename), "yolo-labels")
    parse = G.parse_detect_line if shape == "bbox" else G.parse_seg_line
    lines = found.where("content IS NOT NULL").select(KEY, "image_id", "width", "height", "ord", "label_path", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line")).where(F.trim("line") != "")
    lines = settle(lines.withColumn("p", parse(F.col("line"))).join(counts, KEY, "left"), "yolo-lines")
    valid = F.col("p.error").isNull()
    in_range = F.col("p.class") < F.coalesce("n_classes", F.lit(0))
    made = G.denormalize_bbox(F.col("p.values"), F.col("width"), F.col("height")) if shape == "bbox" else G.denormalize_polygon(F.col("p.values"), F.col("width"), F.col("height"))
    nth = F.col("nth")
    annotations = running(lines.where(valid & in_range), KEY, ["ord", "at"], F.lit(1), "nth").select(KEY, nth.alias("annotation_id"), "image_id", F.col("p.class").alias("category_id"), made.alias("geometry"), F.parse_json(F.lit("{}")).alias("attributes"), (nth - 1).alias("ord"))
    message = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("message")
    number = (F.col("at") + 1).cast("string")
    bad = F.lit("invalid_record").alias("code")
    warnings = [
        lines.where(~valid).select(KEY, bad, message("Skipped invalid line ", number, " in '", F.col("label_path"), "': ", F.col("p.error"))),
        lines.where(valid & ~in_range).select(KEY, bad, message("Line ", number, " in '", F.col("label_path"), "' references out-of-range class ", F.col("p.class").cast("string"))),
        found.where("content IS NULL").select(KEY, bad, message("Missing label file '", F.col("label_path"), "'")),
        bundles.select(KEY).distinct().join(with_meta, KEY, "left_anti").select(KEY, F.lit("missing_image_dimensions").alias("code"), message("Missing YOLO metadata file; imported coordinates remain normalized")),
    ]
    out = warnings[0]
    for part in warnings[1:]:
        out = out.unionByName(part)
    return Dataset(images, categories, annotations), out


_BUNDLE_KIND = D.fields(default={"files": D.array(D.fields({"path": D.string, "bytes": D.numbers(0, 255)}, optional={"mime_type": D.string}))})


def validate_bundles(states: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows with status: ok, empty, too_large or invalid (not exactly one JSON bundle with a file; each file needs a path and bytes, whole numbers from 0 to 255, and may have a type)."""
    size = F.octet_length(payload)
    judged = F.when((size > 0) & (size <= MAX_STATE_BYTES), D.whole_document(F.col(payload)))  # others are not parsed
    right = judged.isNotNull() & _BUNDLE_KIND(judged).isNull() & (F.size(F.try_variant_get(judged, "$.files", "array<variant>")) > 0)
    return states.withColumn("status", F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > MAX_STATE_BYTES, "too_large").when(F.coalesce(right, F.lit(False)), "ok").otherwise("invalid"))


def bundle_files(states: DataFrame, payload: str = "payload", key: str = KEY) -> DataFrame:
    """dataset_id, ord, path, n_bytes, mime of each file of the states that ``validate_bundles`` finds sound."""
    sound = validate_bundles(states.select(key, payload), payload).where("status = 'ok'")
    files = F.try_variant_get(F.parse_json(payload), "$.files", "array<struct<path:string,bytes:array<int>,mime_type:string>>")
    return sound.select(key, F.posexplode(files).alias("ord", "f")).select(key, "ord", "f.path", F.size("f.bytes").alias("n_bytes"), F.col("f.mime_type").alias("mime"))


def load_project_states(saved: DataFrame, wanted: DataFrame) -> DataFrame:
    """project, payload, found: the newest version of each wanted project."""
    newest = saved.groupBy("project").agg(F.max_by("payload", "version").alias("payload"), F.lit(True).alias("found"))
    return wanted.join(newest, "project", "left").select("project", "payload", F.coalesce("found", F.lit(False)).alias("found"))
