"""Annotation datasets: class indexes, lookups, label lines, merging, comparing and reports.

A dataset is frames keyed by dataset_id: ``images`` (image_id, file_name, width, height, ord), ``categories`` (category_id, name,
ord), ``annotations`` (annotation_id, image_id, category_id, geometry, attributes, ord) and, where it is known, ``info`` (description,
version, year, contributor, date_created). ``ord`` is the input order, ``attributes`` a VARIANT object, which may be null or absent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import geometry as G
from ..session import settle, ship
from .ordinals import pieces

KEY = "dataset_id"
#: Annotations and corners of a piece of a document.
PIECE = 10_000


@dataclass(frozen=True)
class Dataset:
    images: DataFrame
    categories: DataFrame
    annotations: DataFrame
    info: DataFrame | None = None


def attributes_text(annotations: DataFrame) -> Column:
    """The attributes as JSON with sorted keys, ``{}`` for none."""
    return F.coalesce(F.to_json("attributes"), F.lit("{}")) if "attributes" in annotations.columns else F.lit("{}")


def _first(heads: DataFrame) -> DataFrame:
    """Rows by dataset for piece 0 alone: joined by dataset and piece, pieces stay where they are instead of all of a dataset meeting in one task."""
    return heads.withColumn("piece", F.explode(F.array(F.lit(0).cast("long"))))  # a literal would be taken out of the join's keys


def _described(documents: DataFrame, ds: Dataset, info: str) -> DataFrame:
    """``documents`` with the dataset's info at piece 0, or with ``info`` as the description."""
    text = lambda c, other="": F.coalesce(F.col(f"i.{c}"), F.lit(other)).alias(c)
    given = ds.info if ds.info is not None else ds.images.select(KEY).distinct().select(KEY, F.lit(info).alias("description"), F.lit("").alias("version"), F.lit(None).cast("long").alias("year"), F.lit("").alias("contributor"), F.lit("").alias("date_created"))
    packed = given.select(KEY, F.struct("description", "version", "year", "contributor", "date_created").alias("i"))
    about = F.struct(text("description", info), text("version"), F.coalesce("i.year", F.lit(0)).alias("year"), text("contributor"), text("date_created"))
    return documents.join(_first(packed), [KEY, "piece"], "left").withColumn("info", about).drop("i")


def dense_class_index(categories: DataFrame) -> DataFrame:
    """dataset_id, category_id, name, class_index: places from 0 by id; of a repeated id the last place counts."""
    order = Window.partitionBy(KEY).orderBy("category_id", "ord")
    placed = categories.withColumn("class_index", (F.row_number().over(order) - 1).cast("int"))
    return placed.groupBy(KEY, "category_id").agg(F.max_by("name", "class_index").alias("name"), F.max("class_index").alias("class_index"))


def lookup_class(annotations: DataFrame, index: DataFrame) -> DataFrame:
    return annotations.join(index.select(KEY, "category_id", "class_index"), [KEY, "category_id"])


def unknown_categories(ds: Dataset) -> DataFrame:
    """Annotations of existing images whose category does not exist: any of them fails a YOLO or Datumaro export."""
    known = ds.annotations.join(ds.images.select(KEY, "image_id").distinct(), [KEY, "image_id"], "left_semi")
    return known.join(ds.categories.select(KEY, "category_id").distinct(), [KEY, "category_id"], "left_anti")


def orphans(ds: Dataset) -> DataFrame:
    """Annotations whose image does not exist."""
    return ds.annotations.join(ds.images.select(KEY, "image_id").distinct(), [KEY, "image_id"], "left_anti")


def annotations_by_image(annotations: DataFrame, value: Column) -> DataFrame:
    """dataset_id, image_id, items: ``value`` of each annotation in input order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", value.alias("v"))))
    return annotations.groupBy(KEY, "image_id").agg(F.transform(listed, lambda x: x["v"]).alias("items"))


def images_with_annotations(ds: Dataset, value: Column) -> DataFrame:
    """Every image with its annotations' values, an empty array for none."""
    grouped = annotations_by_image(ds.annotations, value)
    joined = ds.images.join(grouped, [KEY, "image_id"], "left")
    return joined.withColumn("items", F.coalesce("items", F.array().cast(dict(grouped.dtypes)["items"])))


def violations(ds: Dataset, policy: str, shape: str) -> DataFrame:
    """annotation_id and reason for all that fails a YOLO export (``shape``: bbox or polygon) as a whole."""
    g = F.col("geometry")
    found = lookup_class(ds.annotations, dense_class_index(ds.categories)).join(ds.images.select(KEY, "image_id", "width", "height"), [KEY, "image_id"])
    own = "bounding_box" if shape == "bbox" else "polygon"
    target = G.to_bbox(g, policy) if shape == "bbox" else G.to_polygon(g, policy)
    reason = F.when(F.lit(policy == "strict") & (g["kind"] != own), "strict_policy").when(target.isNotNull() & ((F.col("width") == 0) | (F.col("height") == 0)), "zero_dimensions")
    if shape == "polygon":
        reason = reason.when(F.size(target) < 3, "fewer_than_3_points")
    bad = found.select(KEY, "annotation_id", reason.alias("reason")).where("reason IS NOT NULL")
    return bad.unionByName(unknown_categories(ds).select(KEY, "annotation_id", F.lit("unknown_category").alias("reason")))


def label_lines(ds: Dataset, *, shape: str = "bbox", policy: str = "allow_lossy_warn", clamp: bool = True) -> DataFrame:
    """dataset_id, image_id, file_name, width, height, ord, items: YOLO lines of every image in input order.

    Annotations that ``violations`` lists, and those that the policy skips, have no line.
    """
    g, w, h = F.col("geometry"), F.col("width"), F.col("height")
    known = lookup_class(ds.annotations, dense_class_index(ds.categories)).join(ds.images.select(KEY, "image_id", "width", "height"), [KEY, "image_id"]).where("width > 0 AND height > 0")
    if shape == "bbox":
        made = known.withColumn("t", G.to_bbox(g, policy)).where("t IS NOT NULL")
        line = G.detect_line(F.col("class_index"), G.clamp_bbox(F.col("t"), w, h) if clamp else F.col("t"), w, h)
    else:
        made = known.withColumn("t", G.to_polygon(g, policy)).where("t IS NOT NULL AND size(t) >= 3")
        line = G.seg_line(F.col("class_index"), G.clamp_polygon(F.col("t"), w, h) if clamp else F.col("t"), w, h)
    return images_with_annotations(Dataset(ds.images, ds.categories, made.withColumn("line", line)), F.col("line"))


def yolo_bundle(ds: Dataset, *, shape: str = "bbox", policy: str = "allow_lossy_warn", clamp: bool = True, include_empty_images: bool = False) -> DataFrame:
    """Bundle files (dataset_id, ord, path, content): classes.txt, a label file per image with lines, image metadata."""
    lines = label_lines(ds, shape=shape, policy=policy, clamp=clamp)
    path = F.concat(F.lit("labels/"), F.col("image_id").cast("string"), F.lit(".txt"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category_id", "ord", "name"))), lambda x: x["name"]), "\n")
    classes = ds.categories.groupBy(KEY).agg(names.alias("content")).select(KEY, F.lit(0).cast("long").alias("ord"), F.lit("classes.txt").alias("path"), "content")
    body = F.when(F.size("items") > 0, F.concat(F.array_join("items", "\n"), F.lit("\n"))).otherwise("")
    kept = lines if include_empty_images else lines.where(F.size("items") > 0)
    labels = kept.select(KEY, (F.col("ord") + 1).cast("long").alias("ord"), path.alias("path"), body.alias("content"))
    entry = F.struct(F.col("image_id").alias("id"), "file_name", "width", "height", path.alias("label_path"))
    meta = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"]))
    metas = ds.images.groupBy(KEY).agg(meta.alias("content"), (F.max("ord") + 2).cast("long").alias("ord")).select(KEY, "ord", F.lit("image_meta.json").alias("path"), "content")
    return classes.unionByName(labels).unionByName(metas)


def _in_pieces(df: DataFrame, entry: Column, weight: Column, most: int, name: str) -> DataFrame:
    """dataset_id, piece, ``name``: the entries in input order, dealt into pieces."""
    dealt = pieces(df.select(KEY, "ord", entry.alias("e"), weight.alias("w")), KEY, "ord", F.col("w"), most)
    return dealt.groupBy(KEY, "piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "e"))), lambda x: x["e"]).alias(name))


def coco_documents(ds: Dataset, info: str = "", most: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(dataset_id, path, piece, content: JSON documents; violations: dataset_id, annotation_id, reason).

    A dataset of more than ``most`` images, or annotations and corners, is a document in several pieces: each is a document by itself, whose lists go on
    with those of the piece before; info, licenses and categories stand in the first, piece 0. So no row holds a whole dataset.
    """
    made = ds.annotations.join(ds.images.select(KEY).distinct(), KEY, "left_semi").withColumn("c", G.coco_fields(F.col("geometry")))
    entry = F.struct(F.col("annotation_id").alias("id"), "image_id", "category_id", "c.bbox", "c.segmentation", "c.area", F.lit(0).alias("iscrowd"), F.col("c.point").alias("point"))
    images = _in_pieces(ds.images, F.struct(F.col("image_id").alias("id"), "file_name", "width", "height"), F.lit(1), most, "images")
    annotations = _in_pieces(made.where("c.error IS NULL"), entry, _weight("geometry"), most, "annotations")
    category = F.struct(F.col("category_id").alias("id"), "name", F.lit("none").alias("supercategory"))
    categories = ds.categories.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", category.alias("e")))), lambda x: x["e"]).alias("categories"))
    joined = _described(images.join(annotations, [KEY, "piece"], "full").join(_first(categories), [KEY, "piece"], "left"), ds, info)
    head = lambda c: F.when(F.col("piece") == 0, c)
    empty = lambda c: F.coalesce(c, head(F.array().cast(joined.schema[c].dataType)))
    doc = F.to_json(F.struct(head(F.col("info")).alias("info"), head(F.array().cast("array<string>")).alias("licenses"), "images", empty("annotations").alias("annotations"), head(empty("categories")).alias("categories")))
    bad = made.where("c.error IS NOT NULL").select(KEY, "annotation_id", F.col("c.error").alias("reason"))
    return joined.select(KEY, F.lit("annotations.json").alias("path"), "piece", doc.alias("content")), bad


def _weight(geometry: str) -> Column:
    return F.lit(1) + F.greatest(F.size(f"{geometry}.points"), F.lit(0))


def datumaro_documents(ds: Dataset, info: str = "", most: int = PIECE) -> DataFrame:
    """dataset_id, path, piece, content: label list by category id, items in image order, sizes as [height, width], attributes as they are.

    A dataset of more than ``most`` items, annotations and numbers is in several pieces, as in ``coco_documents``; an item is never divided.
    """
    g = F.col("geometry")
    index = dense_class_index(ds.categories)
    kind = F.when(g["kind"] == "bounding_box", "b_box").when(g["kind"] == "polygon", "polygon").otherwise("points")
    bbox = F.when(g["kind"] == "bounding_box", G.box(g["x"], g["y"], g["w"], g["h"]))
    flat = F.when(g["kind"] == "polygon", G.flatten_points(g["points"])).when(g["kind"] == "point", F.array(g["x"], g["y"]))
    known = lookup_class(ds.annotations, index)
    entry = F.struct(F.col("annotation_id").alias("id"), F.col("class_index").alias("label"), F.lit(0).alias("group"), kind.alias("type"), bbox.alias("bbox"), flat.alias("points"), attributes_text(known).alias("attributes"))
    items = images_with_annotations(Dataset(ds.images, ds.categories, known), entry)
    item = F.struct(F.col("image_id").cast("string").alias("id"), F.struct(F.col("file_name").alias("path"), F.array("height", "width").alias("size")).alias("image"), F.col("items").alias("annotations"), F.lit("{}").alias("attributes"))
    weight = F.aggregate("items", F.lit(1).cast("long"), lambda n, a: n + 1 + F.greatest(F.size(a["points"]), F.lit(0)) + F.floor(F.length(a["attributes"]) / 16))
    listed = _in_pieces(items, item, weight, most, "items")
    label = F.struct("name", F.lit("").alias("parent"), F.array().cast("array<string>").alias("attributes"))
    labels = ds.categories.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("category_id", "ord", label.alias("e")))), lambda x: x["e"]).alias("label"))
    # VARIANT can't be sorted, so attributes are text until here
    whole = lambda x: x.withField("attributes", F.parse_json(x["attributes"]))
    full = F.transform("items", lambda i: whole(i.withField("annotations", F.transform(i["annotations"], whole))))
    head = lambda c: F.when(F.col("piece") == 0, F.col(c))
    doc = F.to_json(F.struct(F.when(F.col("piece") == 0, F.struct("info.description")).alias("info"), F.struct(head("label").alias("label")).alias("categories"), full.alias("items")))
    return _described(listed.join(_first(labels), [KEY, "piece"], "left"), ds, info).select(KEY, F.lit("annotations/default.json").alias("path"), "piece", doc.alias("content"))


def select_scope(ds: Dataset, scope: str, indices: list[int] | None = None, current: int = 0) -> Dataset:
    """The dataset of some images: ``whole_project``, ``current_image`` or ``selected_image_indices`` (places from 0 in image order)."""
    if scope == "whole_project":
        return ds
    wanted = [current] if scope == "current_image" else list(indices or ())
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("ord")) - 1
    images = ds.images.withColumn("place", place).where(F.col("place").isin(wanted)).drop("place")
    return Dataset(images, ds.categories, ds.annotations.join(images.select(KEY, "image_id"), [KEY, "image_id"], "left_semi"), ds.info)


def merge_datasets(base: Dataset, incoming: Dataset, *, categories: str = "match_by_id", annotations: str = "merge_append") -> Dataset:
    """One dataset of two. Categories match by id or by name, or the incoming ones replace all; annotations of incoming images replace or join the others.

    A category that matches by name takes the base's id; one without match keeps its own, or the next free one where that is taken.
    Images match by id, and the base's rows win. Attributes stay with their annotations; the base's info stays.
    """
    own = base.categories.select(KEY, "category_id", "name", "ord")
    new = incoming.categories.select(KEY, "category_id", "name", "ord")
    if categories == "replace_all":
        merged, remap = new, new.select(KEY, "category_id", F.col("category_id").alias("to"))
    elif categories == "match_by_id":
        merged = own.unionByName(new.join(own.select(KEY, "category_id"), [KEY, "category_id"], "left_anti"))
        remap = new.select(KEY, "category_id", F.col("category_id").alias("to"))
    else:
        by_name = own.groupBy(KEY, "name").agg(F.min("category_id").alias("known"))
        top = own.groupBy(KEY).agg(F.max("category_id").alias("top"))
        taken = own.select(KEY, "category_id", F.lit(True).alias("taken"))
        found = new.join(by_name, [KEY, "name"], "left").join(taken, [KEY, "category_id"], "left").join(top, KEY, "left")
        moved = F.col("known").isNull() & F.col("taken").isNotNull()
        nth = F.sum(moved.cast("long")).over(Window.partitionBy(KEY).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
        highest = F.greatest(F.col("top"), F.max("category_id").over(Window.partitionBy(KEY)))
        found = found.withColumn("to", F.coalesce("known", F.when(moved, highest + nth), "category_id"))
        merged = own.unionByName(found.where("known IS NULL").select(KEY, F.col("to").alias("category_id"), "name", "ord"))
        remap = found.select(KEY, "category_id", "to")
    images = base.images.unionByName(incoming.images.join(base.images.select(KEY, "image_id"), [KEY, "image_id"], "left_anti"))
    own_rows, new_rows = (a if "attributes" in a.columns else a.withColumn("attributes", F.parse_json(F.lit("{}"))) for a in (base.annotations, incoming.annotations))
    moved_rows = new_rows.join(remap, [KEY, "category_id"]).withColumn("category_id", F.col("to")).select(*own_rows.columns)
    kept = own_rows if annotations == "merge_append" else own_rows.join(incoming.images.select(KEY, "image_id"), [KEY, "image_id"], "left_anti")
    info = base.info if base.info is not None else incoming.info
    return Dataset(images, merged, kept.unionByName(moved_rows), info)


def semantic_rows(ds: Dataset, attributes: bool = False) -> DataFrame:
    """dataset_id, file_name, category, kind, numbers (array of double), told (the ``attributes``, if they count): what two datasets are compared by, whatever their ids."""
    g = F.col("geometry")
    flat = F.when(g["kind"] == "polygon", G.flatten_points(g["points"])).when(g["kind"] == "point", F.array(g["x"], g["y"])).otherwise(F.array(g["x"], g["y"], g["w"], g["h"]))
    joined = ds.annotations.join(ds.images.select(KEY, "image_id", "file_name"), [KEY, "image_id"]).join(ds.categories.select(KEY, "category_id", F.col("name").alias("category")), [KEY, "category_id"])
    told = attributes_text(ds.annotations) if attributes else F.lit("")
    return joined.select(KEY, "file_name", "category", g["kind"].alias("kind"), flat.cast("array<double>").alias("numbers"), told.alias("told"))


def _clusters(rows: np.ndarray, tolerance: float) -> Iterator[np.ndarray]:
    """Row numbers parted wherever some column has a gap of more than ``tolerance``; every column is looked at until nothing parts any more."""
    waiting = [(np.arange(len(rows)), 0, 0)]
    while waiting:
        own, column, still = waiting.pop()
        if len(own) < 2 or still == rows.shape[1]:
            yield own
            continue
        order = own[np.argsort(rows[own, column], kind="stable")]
        ends = np.flatnonzero(np.diff(rows[order, column]) > tolerance) + 1
        following = (column + 1) % rows.shape[1]
        waiting += [(part, following, 0 if len(ends) else still + 1) for part in np.split(order, ends)]


def _unmatched(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of each left and right value find no partner when as many as possible do; ``near`` says who may."""
    left, right = left.copy(), right.copy()
    flow = np.zeros(near.shape, np.int64)

    def push(i: int, much: int, seen: set[int]) -> int:
        for j in np.flatnonzero(near[i]).tolist():
            if j in seen:
                continue
            seen.add(j)
            if right[j]:
                moved = min(much, int(right[j]))
                right[j] -= moved
                flow[i, j] += moved
                return moved
            for k in np.flatnonzero(flow[:, j]).tolist():
                if k != i and (moved := push(k, min(much, int(flow[k, j])), seen)):
                    flow[k, j] -= moved
                    flow[i, j] += moved
                    return moved
        return 0

    for i in range(len(left)):
        while left[i] and (moved := push(i, int(left[i]), set())):
            left[i] -= moved
    return left, right


def roundtrip_diff(a: Dataset, b: Dataset, tolerance: float = 1e-3, attributes: bool = False) -> DataFrame:
    """dataset_id, file_name, category, shape, side: rows of one dataset without partner in the other; all numbers of partners differ by ``tolerance`` at most.

    Each row has one partner, and as many as possible have one. Equal rows are counted first. Those of a file, category and kind are
    parted where the first number has a gap of more than the tolerance; only parts with several different rows are matched in Python.
    """
    key = [KEY, "file_name", "category", "kind", "told"]
    side = lambda ds, l, r: semantic_rows(ds, attributes).select(*key, "numbers", F.lit(l).alias("l"), F.lit(r).alias("r"))
    counts = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(*key, "numbers").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    within = Window.partitionBy(*key, F.size("numbers")).orderBy(F.get("numbers", F.lit(0)))
    gap = F.coalesce(F.get("numbers", F.lit(0)) - F.lag(F.get("numbers", F.lit(0))).over(within) > tolerance, F.lit(True))
    parted = counts.withColumn("gap", gap.cast("int")).withColumn("part", F.sum("gap").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parted = settle(parted.withColumn("n", F.size("numbers")).withColumn("others", F.count("*").over(Window.partitionBy(*key, "n", "part"))).drop("gap"), "compared")
    alone = parted.where("others = 1").select(*key, "numbers", F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("l"), F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("r"))
    ship(parted.sparkSession)

    def match(table: pa.Table) -> pa.Table:
        rows = np.stack([v.values.to_numpy() for v in table.column("numbers")])
        left, right = (table.column(c).to_numpy().copy() for c in "lr")
        for own in _clusters(rows, tolerance):
            near = (np.abs(rows[own][:, None, :] - rows[own][None, :, :]) <= tolerance).all(axis=2)
            left[own], right[own] = _unmatched(left[own], right[own], near)
        kept = table.select([*key, "numbers"])
        return kept.append_column("l", pa.array(left)).append_column("r", pa.array(right))

    schema = StructType([*[alone.schema[c] for c in (*key, "numbers")], StructField("l", LongType()), StructField("r", LongType())])
    matched = parted.where("others > 1").groupBy(*key, "n", "part").applyInArrow(match, schema)
    text = F.array_join(F.transform("numbers", lambda v: F.format_string("%.3f", F.round(v, 3) + 0.0)), " ")
    shape = F.when(F.col("told") == "", F.concat_ws(" ", "kind", text)).otherwise(F.concat_ws(" ", "kind", text, "told"))
    rest = alone.unionByName(matched).where("l > 0 OR r > 0").withColumn("side", F.explode(F.concat(F.array_repeat(F.lit("left"), F.col("l").cast("int")), F.array_repeat(F.lit("right"), F.col("r").cast("int")))))
    return rest.select(KEY, "file_name", "category", shape.alias("shape"), "side")


#: Fixed capabilities by format: several images, boxes, polygons, points, attributes.
CAPABILITIES = (("coco", True, True, True, True, False), ("datumaro", True, True, True, True, True), ("yolo_detect", True, True, False, False, False), ("yolo_segmentation", True, False, True, False, False))


def format_capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAPABILITIES), "format string, multi_image boolean, bbox boolean, polygon boolean, point boolean, attributes boolean")


def unsupported_shapes(annotations: DataFrame, spark: SparkSession) -> DataFrame:
    """format, kind, annotations: how many annotations a format can't hold without conversion."""
    caps = F.broadcast(format_capabilities(spark))  # four rows
    counts = annotations.groupBy(F.col("geometry.kind").alias("kind")).agg(F.count("*").alias("annotations"))
    holds = F.when(F.col("kind") == "bounding_box", F.col("bbox")).when(F.col("kind") == "polygon", F.col("polygon")).otherwise(F.col("point"))
    return counts.crossJoin(caps).where(~holds).select("format", "kind", "annotations")


def import_report(ds: Dataset, skipped: DataFrame) -> DataFrame:
    """dataset_id, images, categories, annotations, skipped; ``skipped`` has dataset_id and a row for each skipped annotation."""
    count = lambda df, name: df.groupBy(KEY).agg(F.count("*").alias(name))
    out = count(ds.images, "images")
    for part in (count(ds.categories, "categories"), count(ds.annotations, "annotations"), count(skipped, "skipped")):
        out = out.join(part, KEY, "left")
    return out.na.fill(0)


def warnings_by_code(warnings: DataFrame) -> DataFrame:
    """dataset_id, code, warnings, first: how many of each code, and the least message."""
    return warnings.groupBy(KEY, "code").agg(F.count("*").alias("warnings"), F.min("message").alias("first"))


def merged_capabilities(spark: SparkSession, formats: DataFrame, by: str) -> DataFrame:
    """``by`` and the five flags, each set if any of the group's formats (``by``, format) has it; unknown formats count for nothing."""
    caps = F.broadcast(format_capabilities(spark))  # four rows
    flags = ("multi_image", "bbox", "polygon", "point", "attributes")
    return formats.join(caps, "format").groupBy(by).agg(*[F.bool_or(f).alias(f) for f in flags])
