"""Column functions on annotation geometry.

A geometry is a struct kind, x, y, w, h, points; ``kind`` is bounding_box, polygon or point. Coordinates are 32-bit floats; every
quotient is cast back at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bands import f32

POINT_TYPE = "struct<x:float,y:float>"
GEOMETRY_TYPE = f"struct<kind:string,x:float,y:float,w:float,h:float,points:array<{POINT_TYPE}>>"
POLICIES = ("strict", "allow_lossy_warn", "skip_unsupported")


def point(x: Column, y: Column) -> Column:
    return F.struct(f32(x).alias("x"), f32(y).alias("y"))


def geometry(kind: str, *, x=None, y=None, w=None, h=None, points=None) -> Column:
    none = F.lit(None)
    part = lambda v, name: (none if v is None else v).cast("float").alias(name)
    return F.struct(F.lit(kind).alias("kind"), part(x, "x"), part(y, "y"), part(w, "w"), part(h, "h"), (none if points is None else points).cast(f"array<{POINT_TYPE}>").alias("points"))


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(f32(x), f32(y), f32(w), f32(h))


def polygon_bbox(points: Column) -> Column:
    """[x, y, w, h]; zeros for no points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    found = box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    return F.when(F.size(points) > 0, found).otherwise(box(*[F.lit(0.0)] * 4))


def polygon_area(points: Column) -> Column:
    """Shoelace formula in 32-bit floats, vertex by vertex; 0 under three points."""
    n = F.size(points)

    def step(sum_: Column, i: Column) -> Column:
        a, b = F.element_at(points, i + 1), F.element_at(points, (i + 1) % n + 1)
        return sum_ + a["x"] * b["y"] - b["x"] * a["y"]

    return F.when(n >= 3, F.abs(f32(F.aggregate(F.sequence(F.lit(0), n - 1), f32(0.0), step) / f32(2.0)))).otherwise(f32(0.0))


def to_bbox(g: Column, policy: str) -> Column:
    """[x, y, w, h] or null: polygons and points become boxes only under ``allow_lossy_warn``."""
    own = F.when(g["kind"] == "bounding_box", box(g["x"], g["y"], g["w"], g["h"]))
    if policy != "allow_lossy_warn":
        return own
    half = f32(0.5)
    return own.when(g["kind"] == "polygon", polygon_bbox(g["points"])).when(g["kind"] == "point", box(g["x"] - half, g["y"] - half, F.lit(1.0), F.lit(1.0)))


def to_polygon(g: Column, policy: str) -> Column:
    """Vertices or null: boxes give their corners from the top left, points a unit square, only under ``allow_lossy_warn``."""
    own = F.when(g["kind"] == "polygon", g["points"])
    if policy != "allow_lossy_warn":
        return own
    corners = lambda x0, y0, x1, y1: F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))
    half = f32(0.5)
    return own.when(g["kind"] == "bounding_box", corners(g["x"], g["y"], g["x"] + g["w"], g["y"] + g["h"])).when(g["kind"] == "point", corners(g["x"] - half, g["y"] - half, g["x"] + half, g["y"] + half))


def clamp(value: Column, most: Column) -> Column:
    return F.least(F.greatest(value, f32(0.0)), f32(most))


def clamp_bbox(b: Column, width: Column, height: Column) -> Column:
    x1, y1 = clamp(b[0], width), clamp(b[1], height)
    x2, y2 = clamp(b[0] + b[2], width), clamp(b[1] + b[3], height)
    zero = f32(0.0)
    return F.array(x1, y1, F.greatest(x2 - x1, zero), F.greatest(y2 - y1, zero))


def clamp_polygon(points: Column, width: Column, height: Column) -> Column:
    return F.transform(points, lambda p: point(clamp(p["x"], width), clamp(p["y"], height)))


def six(value: Column) -> Column:
    """Six decimals, half to even, as text."""
    return F.bround(value.cast("double").cast("decimal(38,20)"), 6).cast("decimal(38,6)").cast("string")


def detect_line(index: Column, b: Column, width: Column, height: Column) -> Column:
    """``class cx cy w h`` relative to the image."""
    w, h, two = f32(width), f32(height), f32(2.0)
    parts = (f32((b[0] + f32(b[2] / two)) / w), f32((b[1] + f32(b[3] / two)) / h), f32(b[2] / w), f32(b[3] / h))
    return F.concat_ws(" ", index.cast("string"), *[six(p) for p in parts])


def seg_line(index: Column, points: Column, width: Column, height: Column) -> Column:
    """``class x y x y ...`` relative to the image."""
    pair = lambda p: F.concat_ws(" ", six(f32(p["x"] / f32(width))), six(f32(p["y"] / f32(height))))
    return F.concat_ws(" ", index.cast("string"), F.array_join(F.transform(points, pair), " "))


_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)$"


def _float(text: Column) -> Column:
    return F.when(F.lower(text).rlike(_NUMBER), text.try_cast("float"))


def _class(text: Column) -> Column:
    return F.when(text.rlike(r"^\+?\d+$"), text.try_cast("long"))


def _fields(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda s: s != "")


def parse_detect_line(line: Column) -> Column:
    """struct error, class, values (cx, cy, w, h): the first thing wrong names the error."""
    fields = _fields(line)
    names = ("cx", "cy", "w", "h")
    values = [_float(F.get(fields, F.lit(k + 1))) for k in range(4)]
    error = F.when(F.size(fields) != 5, "expected 5 values: class cx cy w h").when(_class(F.get(fields, F.lit(0))).isNull(), "invalid class index")
    for name, value in zip(names, values, strict=True):
        error = error.when(value.isNull(), f"invalid {name}")
    return F.struct(error.alias("error"), _class(F.get(fields, F.lit(0))).alias("class"), F.array(*values).alias("values"))


def parse_seg_line(line: Column) -> Column:
    """struct error, class, values (x, y, x, y, ...): at least three pairs."""
    fields = _fields(line)
    values = F.transform(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))), _float)
    bad = F.array_position(F.transform(values, lambda v: v.isNull()), True)
    error = (
        F.when(F.size(fields) < 7, "expected class + at least 3 xy pairs").when(F.size(fields) % 2 == 0, "expected odd number of values")
        .when(_class(F.get(fields, F.lit(0))).isNull(), "invalid class index")
        .when(bad > 0, F.concat(F.when(bad % 2 == 1, "invalid x at ").otherwise("invalid y at "), (bad + 1).cast("string")))
    )
    return F.struct(error.alias("error"), _class(F.get(fields, F.lit(0))).alias("class"), values.alias("values"))


def pair_points(flat: Column) -> Column:
    """[x, y, x, y, ...] to points."""
    return F.when(F.size(flat) < 2, F.array().cast(f"array<{POINT_TYPE}>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(flat) - 2, F.lit(2)), lambda i: point(F.get(flat, i), F.get(flat, i + 1))))


def flatten_points(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def denormalize_bbox(v: Column, width: Column, height: Column) -> Column:
    """Geometry of relative cx, cy, w, h; sides of the image count as 1 at least."""
    iw, ih, two = f32(F.greatest(width, F.lit(1))), f32(F.greatest(height, F.lit(1))), f32(2.0)
    w, h = v[2] * iw, v[3] * ih
    return geometry("bounding_box", x=v[0] * iw - f32(w / two), y=v[1] * ih - f32(h / two), w=w, h=h)


def denormalize_polygon(v: Column, width: Column, height: Column) -> Column:
    iw, ih = f32(F.greatest(width, F.lit(1))), f32(F.greatest(height, F.lit(1)))
    return geometry("polygon", points=F.transform(pair_points(v), lambda p: point(p["x"] * iw, p["y"] * ih)))


def coco_fields(g: Column) -> Column:
    """struct error, bbox, segmentation (array of flat polygons), area, point of an exported annotation."""
    polygon, dot = g["kind"] == "polygon", g["kind"] == "point"
    half, one = f32(0.5), f32(1.0)
    bbox = F.when(polygon, polygon_bbox(g["points"])).when(dot, box(g["x"] - half, g["y"] - half, one, one)).otherwise(box(g["x"], g["y"], g["w"], g["h"]))
    return F.struct(
        F.when(polygon & (F.size(g["points"]) < 3), "Polygon must contain at least 3 points").alias("error"), bbox.alias("bbox"),
        F.when(polygon, F.array(flatten_points(g["points"]))).alias("segmentation"),
        F.when(polygon, polygon_area(g["points"])).when(dot, one).otherwise(g["w"] * g["h"]).alias("area"), F.when(dot, F.array(g["x"], g["y"])).alias("point"),
    )


def coco_geometry(bbox: Column, first: Column, dot: Column) -> Column:
    """struct error, geometry from bbox, the first flat polygon (null for none or run lengths) and the point extension."""
    n = F.coalesce(F.size(first), F.lit(-1))
    odd, many = n % 2 != 0, n >= 6
    found = (
        F.when(F.size(dot) == 2, geometry("point", x=dot[0], y=dot[1])).when(n == 2, geometry("point", x=F.get(first, F.lit(0)), y=F.get(first, F.lit(1))))
        .when(many & ~odd, geometry("polygon", points=pair_points(first))).when(~many & (F.size(bbox) == 4), geometry("bounding_box", x=bbox[0], y=bbox[1], w=bbox[2], h=bbox[3]))
    )
    error = F.when(found.isNull(), F.when(many & odd, "Segmentation polygon has odd number of coordinates").otherwise("COCO annotation did not contain bbox or usable segmentation"))
    return F.struct(error.alias("error"), found.alias("geometry"))


def datumaro_geometry(kind: Column, values: Column, policy: str, bbox_tags: tuple[str, ...] = ("b_box",)) -> Column:
    """struct error, skipped, geometry. The box tag is ``b_box`` unless more are allowed; other kinds are unknown."""
    n = F.size(values)
    strict, lossy = policy == "strict", policy == "allow_lossy_warn"
    is_box, polygon, dots = kind.isin(*bbox_tags), kind == "polygon", kind == "points"
    unknown = ~(is_box | polygon | dots)
    error = F.when(is_box & (F.coalesce(n, F.lit(0)) != 4), "Datumaro box must have 4 values").when(polygon & ((n < 6) | (n % 2 != 0)), "Datumaro polygon must have an even number of values >= 6").when(dots & (n < 2), "Datumaro points must contain at least one point")
    if strict:
        error = error.when(dots & (n > 2), "Datumaro multi-point annotation cannot map to a single Point").when(unknown, "Unknown Datumaro annotation type")
    first = geometry("point", x=F.get(values, F.lit(0)), y=F.get(values, F.lit(1)))
    found = F.when(is_box, geometry("bounding_box", x=F.get(values, F.lit(0)), y=F.get(values, F.lit(1)), w=F.get(values, F.lit(2)), h=F.get(values, F.lit(3)))).when(polygon, geometry("polygon", points=pair_points(values))).when(dots & ((n == 2) | F.lit(lossy)), first)
    return F.struct(error.alias("error"), (error.isNull() & found.isNull()).alias("skipped"), F.when(error.isNull(), found).alias("geometry"))
