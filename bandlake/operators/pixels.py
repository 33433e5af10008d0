"""Band cubes: normalising, packing into layers, pyramids, thumbnails.

``bands`` has one row per image and band: image_id, band, width, height, px (array of float, row-major). Pixels stay arrays of floats, then
binary columns of bytes; only band rows are joined or grouped, four to a layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from ..functions import bands as B
from ..session import settle
from . import arrays


def normalize_cube(bands: DataFrame) -> DataFrame:
    """Values to 0..1 over all bands of an image: (v - min) * (1 / range) in doubles, 1 for an empty range."""
    range_ = bands.groupBy("image_id").agg(F.min(F.array_min("px")).cast("double").alias("lo"), F.max(F.array_max("px")).cast("double").alias("hi"))
    scale = F.when(F.col("hi") - F.col("lo") > 0, F.lit(1.0) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    value = lambda v: F.least(F.greatest((v.cast("double") - F.col("lo")) * F.col("scale"), F.lit(0.0)), F.lit(1.0)).cast("float")
    return bands.join(range_.withColumn("scale", scale), "image_id").withColumn("px", F.transform("px", value)).drop("lo", "hi", "scale")


def pack_layers(bands: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """image_id, layer, width, height, rgba: band b is channel b mod 4 of layer b div 4.

    Absent bands are 0, absent pixels too; a layer without a fourth band is opaque; there are two layers at least. ``extra`` columns are
    part of the image's key.
    """
    key = ["image_id", *extra]
    images = bands.groupBy(*key).agg(F.max("width").alias("width"), F.max("height").alias("height"), F.count("*").alias("n"))
    layers = images.select(*key, "width", "height", F.explode(F.sequence(F.lit(0), B.num_layers(F.col("n")) - 1)).alias("layer"))
    channel = lambda c: F.max(F.when(F.col("band") % 4 == c, F.col("octets"))).alias(f"c{c}")
    own = quantize_bands(bands).groupBy(*key, F.floor(F.col("band") / 4).cast("int").alias("layer")).agg(*[channel(c) for c in range(4)])
    full = layers.join(own, [*key, "layer"], "left")
    return interleave(full, "rgba", [f"c{c}" for c in range(4)], (0, 0, 0, 255)).select(*key, "layer", "width", "height", "rgba")


def quantize_bands(bands: DataFrame) -> DataFrame:
    """Bands with ``octets`` (one byte a pixel) in place of px."""
    return arrays.mapped(bands, lambda px: arrays.quantized(arrays.values(px)).tobytes(), "octets", BinaryType(), "px").drop("px")


def interleave(rows: DataFrame, name: str, channels: list[str], fill: tuple[int, ...]) -> DataFrame:
    """``rows`` (width, height, ...) with ``name``: the binary ``channels`` pixel by pixel; a null one counts as its fill."""
    return arrays.mapped(rows, lambda w, h, *parts: arrays.interleaved([p.as_py() for p in parts], w.as_py() * h.as_py(), fill), name, BinaryType(), "width", "height", *channels)


def flatten_layers(layers: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """image_id, payload: the layers' bytes in order."""
    key = ["image_id", *extra]
    grouped = layers.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "rgba"))), lambda x: x["rgba"]).alias("parts"))
    return arrays.mapped(grouped, lambda parts: b"".join(parts.as_py()), "payload", BinaryType(), "parts").select(*key, "payload")


def payload_contract(images: DataFrame) -> DataFrame:
    """Adds layers and payload_bytes (width * height * 4 * layers) to width, height, num_bands."""
    layers = B.num_layers(F.col("num_bands"))
    return images.withColumn("layers", layers).withColumn("payload_bytes", F.col("width").cast("long") * F.col("height") * 4 * layers)


def downsample(bands: DataFrame, to_width: Column, to_height: Column) -> DataFrame:
    sized = bands.withColumn("__w", to_width.cast("int")).withColumn("__h", to_height.cast("int"))
    shrink = lambda px, *sizes: arrays.resampled(arrays.values(px), *[x.as_py() for x in sizes])
    out = arrays.mapped(sized, shrink, "px", ArrayType(FloatType()), "px", "width", "height", "__w", "__h")
    return out.withColumn("width", F.col("__w")).withColumn("height", F.col("__h")).drop("__w", "__h")


def pyramid_bands(bands: DataFrame, *, min_side: int = B.MIN_SIDE) -> DataFrame:
    """Bands with ``level``: each level comes from the one before at half size rounded up, until both sides are small.

    An image leaves when it is small enough. Every level is written once, so that the next one starts from it.
    """
    level = settle(bands.withColumn("level", F.lit(0)), "pyramid-level")
    depth = level.agg(F.max(B.num_levels(F.col("width"), F.col("height"), min_side))).first()[0] or 1
    out = level
    for n in range(1, depth):
        larger = level.where((F.col("width") > min_side) | (F.col("height") > min_side))
        level = settle(downsample(larger, F.ceil(F.col("width") / 2), F.ceil(F.col("height") / 2)).withColumn("level", F.lit(n)), "pyramid-level")
        out = out.unionByName(level)
    return out


def build_pyramid(bands: DataFrame, *, min_side: int = B.MIN_SIDE) -> tuple[DataFrame, DataFrame]:
    """(layers by image and level, metadata: level, width, height, num_layers, size_bytes)."""
    layers = pack_layers(pyramid_bands(bands, min_side=min_side), ("level",))
    meta = layers.groupBy("image_id", "level").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.count("*").alias("num_layers"), F.sum(F.octet_length("rgba")).alias("size_bytes"))
    return layers, meta


def stream_level(bands: DataFrame, level: int) -> DataFrame:
    """Layers of one level straight from full resolution, at the size rounded down."""
    at = F.lit(level)
    return pack_layers(downsample(bands, B.floor_size(F.col("width"), at), B.floor_size(F.col("height"), at)))


def select_rgb(bands: DataFrame, picks: DataFrame) -> DataFrame:
    """image_id, rgb: interleaved bytes of the bands ``picks`` (image_id, r, g, b) names, each clamped to the last band."""
    counts = bands.groupBy("image_id").agg((F.max("band") + 1).alias("n"))
    chosen = picks.join(counts, "image_id")
    for c in "rgb":
        chosen = chosen.withColumn(c, F.least(F.col(c), F.col("n") - 1))
    joined = bands.join(chosen, "image_id")
    take = lambda c: F.max(F.when(F.col("band") == F.col(c), F.col("octets"))).alias(f"p{c}")
    grouped = quantize_bands(joined).groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), *[take(c) for c in "rgb"])
    return interleave(grouped, "rgb", ["pr", "pg", "pb"], (0, 0, 0)).select("image_id", "rgb")


def thumbnails(bands: DataFrame, most: int = 256) -> DataFrame:
    """image_id, width, height, rgba: bands 0, 1, 2 as colours if there are three, else band 0 as gray; opaque."""
    w, h = B.thumbnail_size(F.col("width"), F.col("height"), most)
    counts = bands.groupBy("image_id").agg(F.count("*").alias("n"))
    small = downsample(bands.where("band < 3"), w, h)
    channel = lambda c: F.max(F.when(F.col("band") == c, F.col("octets")))
    pick = lambda c: F.when(F.max("n") >= 3, channel(c)).otherwise(channel(0)).alias(f"c{c}")
    grouped = quantize_bands(small).join(counts, "image_id").groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), *[pick(c) for c in range(3)])
    return interleave(grouped.withColumn("c3", F.lit(None).cast("binary")), "rgba", [f"c{c}" for c in range(4)], (0, 0, 0, 255)).select("image_id", "width", "height", "rgba")


def pyramid_thumbnails(layers: DataFrame, fallback: DataFrame) -> DataFrame:
    """Layer 0 of the last level where its size is width * height * 4, else the fallback's pixels."""
    last = layers.where("layer = 0").groupBy("image_id").agg(F.max_by(F.struct("width", "height", "rgba"), "level").alias("t"))
    right = F.octet_length("t.rgba") == F.col("t.width") * F.col("t.height") * 4
    stored = last.where(right).select("image_id", F.col("t.rgba").alias("stored"))
    return fallback.join(stored, "image_id", "left").select("image_id", F.coalesce("stored", "rgba").alias("rgba"))


def image_metadata(images: DataFrame, meta: DataFrame, min_side: int = B.MIN_SIDE) -> DataFrame:
    """Images with status and levels: the stored ones where there are any, else the ladder that would be built."""
    level = F.struct("level", "width", "height")
    stored = meta.groupBy("image_id").agg(F.array_sort(F.collect_list(level)).alias("stored"))
    ladder = F.transform(F.sequence(F.lit(0), B.num_levels(F.col("width"), F.col("height"), min_side) - 1), lambda n: F.struct(n.alias("level"), B.ceil_size(F.col("width"), n).alias("width"), B.ceil_size(F.col("height"), n).alias("height")))
    joined = images.join(stored, "image_id", "left")
    return joined.select(*images.columns, F.when(F.col("stored").isNotNull(), "ready").otherwise("pending").alias("status"), F.coalesce("stored", ladder).alias("levels"))
