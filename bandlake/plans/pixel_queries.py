"""Band, packing and pyramid queries: cubes of 4 bands of 4 x 4 pixels come from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import pixels, tiles
from .fixtures import rows, view


def cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cubes as band rows, normalised by the operator under test where a query needs 0..1."""
    px = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"].cast("float"))
    grouped = view(spark, sf_dir, "fx_values").groupBy("vec_id", F.floor(F.col("i") / 16).cast("int").alias("band")).agg(px.alias("px"))
    return grouped.select(F.col("vec_id").alias("image_id"), "band", F.lit(4).alias("width"), F.lit(4).alias("height"), "px")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_images").select("image_id", "width", "height", "num_bands")


def _norm(s: SparkSession, d: str) -> DataFrame:
    return pixels.normalize_cube(cubes(s, d))


def _with_fewer(s: SparkSession, d: str, most: int) -> DataFrame:
    """All cubes, and every fourth one once more, as an image of ``most`` bands."""
    bands = _norm(s, d)
    return bands.unionByName(bands.where(f"image_id % 4 = 0 AND band < {most}").withColumn("image_id", F.col("image_id") + 1_000_000_000))


def _hexed(df: DataFrame, column: str = "rgba") -> DataFrame:
    return df.withColumn(column, F.hex(column))


def _sizes(s: SparkSession, d: str, *cols) -> DataFrame:
    return images(s, d).select("image_id", *cols)




def _thumb_of_pyramid(s: SparkSession, d: str) -> DataFrame:
    layers, _ = pixels.build_pyramid(_norm(s, d), min_side=1)
    return _hexed(pixels.pyramid_thumbnails(layers, pixels.thumbnails(_with_fewer(s, d, 3), 2)))


def _metadata(s: SparkSession, d: str) -> DataFrame:
    stored = rows(s, d, "SELECT image_id, 0 AS level, width, height FROM fx_images WHERE image_id % 5 = 0")
    found = pixels.image_metadata(images(s, d), stored)
    return found.select("image_id", "status", F.array_join(F.transform("levels", lambda x: F.concat_ws("x", x["level"], x["width"], x["height"])), ",").alias("levels"))


QUERIES = {
    "b1_normalize_cube": lambda s, d: _norm(s, d).select("image_id", "band", F.posexplode("px").alias("i", "v")).withColumn("v", F.col("v").cast("double")),
    "b2_quantize_u8": lambda s, d: view(s, d, "fx_values").select("vec_id", "i", B.quantize(F.col("v").cast("float")).alias("byte")),
    "b3_pack_layers": lambda s, d: _hexed(pixels.pack_layers(_with_fewer(s, d, 3))),
    "b4_num_layers": lambda s, d: images(s, d).select("image_id", B.num_layers(F.col("num_bands")).alias("layers")),
    "b5_flatten_layers": lambda s, d: _hexed(pixels.flatten_layers(pixels.pack_layers(_norm(s, d))), "payload"),
    "b6_payload_contract": lambda s, d: pixels.payload_contract(images(s, d)),
    "b7_pixel_count": lambda s, d: _sizes(s, d, B.pixel_count(F.col("width") * 40, F.col("height") * 40).alias("pixels")),
    "b8_bilinear_sample": lambda s, d: cubes(s, d).select("image_id", "band", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(17)), lambda k: B.bilinear(F.col("px"), F.col("width"), F.col("height"), B.f32(k) * B.f32(0.25), B.f32(4.0) - B.f32(k) * B.f32(0.3)))).alias("v")).withColumn("v", F.round(F.col("v").cast("double"), 5) + 0.0),
    "b9_downsample": lambda s, d: pixels.downsample(_norm(s, d), F.lit(3), F.lit(2)).select("image_id", "band", "width", "height", F.posexplode("px").alias("i", "v")).withColumn("v", F.round(F.col("v").cast("double"), 5)),
    "b10_level_size_floor": lambda s, d: _sizes(s, d, B.floor_size(F.col("width"), F.col("image_id") % 9).alias("w"), B.floor_size(F.col("height"), F.col("image_id") % 9).alias("h")),
    "b11_level_ladder_ceil": lambda s, d: images(s, d).select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), B.num_levels(F.col("width"), F.col("height")) - 1)).alias("level")).select("image_id", "level", B.ceil_size(F.col("width"), F.col("level")).alias("w"), B.ceil_size(F.col("height"), F.col("level")).alias("h")),
    "b12_num_levels": lambda s, d: _sizes(s, d, B.num_levels(F.col("width"), F.col("height")).alias("levels")),
    "b13_clamp_level": lambda s, d: _sizes(s, d, B.clamp_level(F.col("image_id") % 12, (F.col("image_id") % 5).cast("int")).cast("int").alias("level"), (F.col("image_id") % 12 <= B.MAX_LEVEL).alias("valid")),
    "b14_build_pyramid": lambda s, d: _hexed(pixels.build_pyramid(_norm(s, d), min_side=1)[0]),
    "b14_tiled_pyramid": lambda s, d: _hexed(tiles.whole(tiles.pack(tiles.pyramid(tiles.cut(_norm(s, d), 3), min_side=1, side=3), 3), 3, "rgba", 4)),
    "b15_tiled_level": lambda s, d: _hexed(tiles.whole(tiles.pack(tiles.resample(tiles.cut(_norm(s, d), 3), F.floor(F.col("width") / 2), F.floor(F.col("height") / 2), side=3), 3), 3, "rgba", 4)),
    "b9_tiled_downsample": lambda s, d: tiles.whole(tiles.resample(tiles.cut(_norm(s, d), 3), F.lit(3), F.lit(2), side=3), 3).select("image_id", "band", "width", "height", F.posexplode("px").alias("i", "v")).withColumn("v", F.round(F.col("v").cast("double"), 5)),
    "b15_stream_level": lambda s, d: _hexed(pixels.stream_level(_norm(s, d), 1)),
    "b16_progressive_levels": lambda s, d: _sizes(s, d, F.explode(B.progressive_levels((F.col("image_id") % 9).cast("int"), F.lit(5), F.col("image_id") % 2 == 0)).alias("level")),
    "b17_row_chunks": lambda s, d: images(s, d).select("image_id", F.explode(B.row_chunks(F.col("height"))).alias("c")).select("image_id", "c.start", "c.end"),
    "b18_thumbnail_size": lambda s, d: _sizes(s, d, *(c.alias(n) for c, n in zip(B.thumbnail_size(F.col("width"), F.col("height")), "wh", strict=True))),
    "b19_thumbnail_pixels": lambda s, d: _hexed(pixels.thumbnails(_with_fewer(s, d, 1), 2)),
    "b20_pyramid_thumbnail": _thumb_of_pyramid,
    "b21_select_rgb": lambda s, d: _hexed(pixels.select_rgb(_norm(s, d), cubes(s, d).select("image_id").distinct().select("image_id", (F.col("image_id") % 3).cast("int").alias("r"), (F.col("image_id") % 7).cast("int").alias("g"), F.lit(9).alias("b"))), "rgb"),
    "b22_image_metadata": _metadata,
}

_CUBE = """r AS (SELECT vec_id AS image_id, CAST(i // 16 AS INT) AS band, i % 16 AS pos, CAST(v AS FLOAT) AS v FROM fx_values),
m AS (SELECT image_id, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM r GROUP BY image_id),
n AS (SELECT image_id, band, pos, CAST(least(greatest((v::DOUBLE - lo) * CASE WHEN hi - lo > 0 THEN 1.0::DOUBLE / (hi - lo) ELSE 1.0 END, 0), 1) AS FLOAT) AS v FROM r JOIN m USING (image_id)),
c AS (SELECT image_id, band, 4 AS width, 4 AS height, list(v ORDER BY pos) AS px FROM n GROUP BY image_id, band)"""


def _sample(px: str, w: int, h: int, x: str, y: str) -> str:
    def axis(at: str, size: int) -> tuple[str, str, str]:
        low = f"least(greatest(floor({at}), 0), {size - 1})"
        return low, f"least({low} + 1, {size - 1})", f"least(greatest({at} - floor({at}), 0.0::FLOAT), 1.0::FLOAT)"

    (x0, x1, fx), (y0, y1, fy) = axis(x, w), axis(y, h)
    value = lambda r, c: f"{px}[CAST({r} * {w} + {c} AS INT) + 1]"
    upper = f"({value(y0, x0)} * (1.0::FLOAT - {fx}) + {value(y0, x1)} * {fx})"
    lower = f"({value(y1, x0)} * (1.0::FLOAT - {fx}) + {value(y1, x1)} * {fx})"
    return f"({upper} * (1.0::FLOAT - {fy}) + {lower} * {fy})"


def _resampled(px: str, w: int, h: int, tw: int, th: int) -> str:
    x = f"((CAST(k % {tw} AS FLOAT) + 0.5::FLOAT) * (CAST({w} AS FLOAT) / CAST({tw} AS FLOAT)) - 0.5::FLOAT)"
    y = f"((CAST(k // {tw} AS FLOAT) + 0.5::FLOAT) * (CAST({h} AS FLOAT) / CAST({th} AS FLOAT)) - 0.5::FLOAT)"
    return f"list_transform(range({tw * th}), lambda k: {_sample(px, w, h, x, y)})"


def _byte(v: str) -> str:
    return f"CAST(trunc(least(greatest({v}, 0.0::FLOAT), 1.0::FLOAT) * 255.0::FLOAT) AS INT)"


def _hex(v: str) -> str:
    return f"lpad(upper(to_hex({v})), 2, '0')"


def _layers(source: str, key: str = "image_id", where: str = "true") -> str:
    """Layer rows in hex from a CTE with the key, band, width, height and px."""
    channel = lambda c: f"CASE WHEN len(any_value(px) FILTER (band = {c})) > 0 THEN {_hex(_byte(f'(any_value(px) FILTER (band = {c}))[k + 1]'))} ELSE '{'FF' if c % 4 == 3 else '00'}' END"
    parts = []
    for layer in range(2):
        body = " || ".join(channel(4 * layer + c) for c in range(4)) if layer == 0 else "'000000FF'"
        parts.append(f"SELECT {key}, {layer} AS layer, width, height, string_agg(x, '' ORDER BY k) AS rgba FROM (SELECT {key}, width, height, k, {body} AS x FROM {source}, unnest(range(width * height)) u(k) WHERE {where} GROUP BY {key}, width, height, k) GROUP BY {key}, width, height")
    return " UNION ALL ".join(parts)


def _level(n: int, px: str, size: int) -> str:
    return f"l{n + 1} AS (SELECT image_id, band, {size // 2} AS width, {size // 2} AS height, {_resampled(px, size, size, size // 2, size // 2)} AS px FROM {'c' if n == 0 else f'l{n}'})"


_PYRAMID = f"{_CUBE}, {_level(0, 'px', 4)}, {_level(1, 'px', 2)}, a AS (SELECT *, 0 AS level FROM c UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2)"
_LEVELS = "CAST(greatest(ceil(log2(greatest(width, height) / 256.0)), 0) AS INT) + 1"
_SMALL = f"t AS (SELECT image_id, band, 2 AS width, 2 AS height, {_resampled('px', 4, 4, 2, 2)} AS px FROM z WHERE band < 3)"
_FEWER = "z AS (SELECT * FROM c UNION ALL SELECT image_id + 1000000000, band, width, height, px FROM c WHERE image_id % 4 = 0 AND band < {n})"
_GRAY = f"""SELECT image_id, 2 AS width, 2 AS height, string_agg({_hex(_byte("p0[k + 1]"))} || {_hex(_byte("coalesce(p1, p0)[k + 1]"))} || {_hex(_byte("coalesce(p2, p0)[k + 1]"))} || 'FF', '' ORDER BY k) AS rgba
FROM (SELECT image_id, any_value(px) FILTER (band = 0) AS p0, any_value(px) FILTER (band = 1) AS p1, any_value(px) FILTER (band = 2) AS p2 FROM t GROUP BY image_id), unnest(range(4)) u(k) GROUP BY image_id"""

SQL = {
    "b1_normalize_cube": f"WITH {_CUBE} SELECT image_id, band, CAST(pos AS INT) AS i, v::DOUBLE AS v FROM n",
    "b2_quantize_u8": f"SELECT vec_id, i, {_byte('CAST(v AS FLOAT)')} AS byte FROM fx_values",
    "b3_pack_layers": f"WITH {_CUBE}, {_FEWER.format(n=3)} {_layers('z')}",
    "b4_num_layers": "SELECT image_id, greatest((num_bands + 3) // 4, 2) AS layers FROM fx_images",
    "b5_flatten_layers": f"WITH {_CUBE}, y AS ({_layers('c')}) SELECT image_id, string_agg(rgba, '' ORDER BY layer) AS payload FROM y GROUP BY image_id",
    "b6_payload_contract": "SELECT image_id, width, height, num_bands, greatest((num_bands + 3) // 4, 2) AS layers, CAST(width AS BIGINT) * height * 4 * greatest((num_bands + 3) // 4, 2) AS payload_bytes FROM fx_images",
    "b7_pixel_count": "SELECT image_id, CASE WHEN CAST(width AS BIGINT) * 40 * height * 40 <= 4294967295 THEN CAST(width AS BIGINT) * 40 * height * 40 END AS pixels FROM fx_images",
    "b8_bilinear_sample": f"WITH {_CUBE}, o AS (SELECT image_id, band, list(v ORDER BY pos) AS px FROM r GROUP BY image_id, band) SELECT image_id, band, round(unnest(list_transform(range(-1, 18), lambda k: {_sample('px', 4, 4, '(CAST(k AS FLOAT) * 0.25::FLOAT)', '(4.0::FLOAT - CAST(k AS FLOAT) * 0.3::FLOAT)')}))::DOUBLE, 5) + 0.0 AS v FROM o",
    "b9_downsample": f"WITH {_CUBE}, z AS (SELECT image_id, band, {_resampled('px', 4, 4, 3, 2)} AS q FROM c) SELECT image_id, band, 3 AS width, 2 AS height, generate_subscripts(q, 1) - 1 AS i, round(unnest(q)::DOUBLE, 5) AS v FROM z",
    "b10_level_size_floor": "SELECT image_id, greatest(width >> (image_id % 9)::INT, 1) AS w, greatest(height >> (image_id % 9)::INT, 1) AS h FROM fx_images",
    "b11_level_ladder_ceil": f"SELECT image_id, CAST(level AS INT) AS level, CAST(ceil(width / 2.0 ** level) AS INT) AS w, CAST(ceil(height / 2.0 ** level) AS INT) AS h FROM fx_images, unnest(range({_LEVELS})) u(level)",
    "b12_num_levels": f"SELECT image_id, {_LEVELS} AS levels FROM fx_images",
    "b13_clamp_level": "SELECT image_id, CAST(least(image_id % 12, 7, image_id % 5) AS INT) AS level, image_id % 12 <= 7 AS valid FROM fx_images",
    "b14_build_pyramid": f"WITH {_PYRAMID} {_layers('a', 'image_id, level')}",
    "b15_stream_level": f"WITH {_CUBE}, {_level(0, 'px', 4)} {_layers('l1')}",
    "b16_progressive_levels": "SELECT image_id, CAST(unnest(CASE WHEN image_id % 2 = 0 AND least(image_id % 9, 5) > 0 THEN list_reverse(range(least(image_id % 9, 5), 6)) ELSE [least(image_id % 9, 5)] END) AS INT) AS level FROM fx_images",
    "b17_row_chunks": 'SELECT image_id, CAST(a AS INT) AS start, CAST(least(a + 128, height) AS INT) AS "end" FROM fx_images, unnest(range(0, height, 128)) u(a)',
    "b18_thumbnail_size": "SELECT image_id, CASE WHEN greatest(width, height) <= 256 THEN width ELSE CAST(greatest(round(width * (256.0::DOUBLE / greatest(width, height))), 1) AS INT) END AS w, CASE WHEN greatest(width, height) <= 256 THEN height ELSE CAST(greatest(round(height * (256.0::DOUBLE / greatest(width, height))), 1) AS INT) END AS h FROM fx_images",
    "b19_thumbnail_pixels": f"WITH {_CUBE}, {_FEWER.format(n=1)}, {_SMALL} {_GRAY}",
    "b20_pyramid_thumbnail": f"WITH {_PYRAMID}, {_FEWER.format(n=3)}, {_SMALL}, g AS ({_GRAY}), y AS ({_layers('l2')}) SELECT g.image_id, coalesce(y.rgba, g.rgba) AS rgba FROM g LEFT JOIN y ON y.image_id = g.image_id AND layer = 0",
    "b21_select_rgb": f"""WITH {_CUBE}, p AS (SELECT image_id, image_id % 3 AS r, least(image_id % 7, 3) AS g, 3 AS b FROM c GROUP BY image_id)
      SELECT p.image_id, string_agg({_hex(_byte("x.v"))} || {_hex(_byte("y.v"))} || {_hex(_byte("z.v"))}, '' ORDER BY x.pos) AS rgb FROM p JOIN n x ON x.image_id = p.image_id AND x.band = r JOIN n y ON y.image_id = p.image_id AND y.band = g AND y.pos = x.pos JOIN n z ON z.image_id = p.image_id AND z.band = b AND z.pos = x.pos GROUP BY p.image_id""",
    "b22_image_metadata": f"SELECT image_id, CASE WHEN image_id % 5 = 0 THEN 'ready' ELSE 'pending' END AS status, CASE WHEN image_id % 5 = 0 THEN '0x' || width || 'x' || height ELSE array_to_string(list_transform(range({_LEVELS}), lambda n: n || 'x' || CAST(ceil(width / 2.0 ** n) AS INT) || 'x' || CAST(ceil(height / 2.0 ** n) AS INT)), ',') END AS levels FROM fx_images",
}
# tiles give what whole bands give
SQL |= {"b9_tiled_downsample": SQL["b9_downsample"], "b14_tiled_pyramid": SQL["b14_build_pyramid"], "b15_tiled_level": SQL["b15_stream_level"]}
