"""Column functions on image paths, identifiers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed list of image extensions; the last one is a band cube, the others are rasters.
RASTER = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "tif")
CUBE = ("npy",)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The extension of the file name as written; empty for none and for names that are only an extension."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)


def is_supported(path: Column) -> Column:
    return F.lower(extension(path)).isin(*RASTER, *CUBE)


def loader_for(path: Column) -> Column:
    """Which reader takes the file: rasters first, then cubes, else null."""
    ext = F.lower(extension(path))
    return F.when(ext.isin(*RASTER), "standard").when(ext.isin(*CUBE), "npy")


def encode_image_id(path: Column) -> Column:
    return F.concat(F.lit("id:"), F.lower(F.hex(path)))


def decode_image_id(image_id: Column) -> Column:
    """The path of an id, null unless it is ``id:`` and whole hex bytes that are UTF-8."""
    body = F.substring(image_id, 4, 1 << 30)
    right = F.startswith(image_id, F.lit("id:")) & (F.length(body) % 2 == 0) & body.rlike("^[0-9a-fA-F]*$")
    return F.when(right, F.try_validate_utf8(F.unhex(F.when(right, body)).cast("string")))


def legacy_id(path: Column) -> Column:
    return F.regexp_replace(path, r"[^\p{IsAlphabetic}\p{N}_-]", "_")


def is_safe_relative_path(path: Column) -> Column:
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~F.exists(F.split(path, "/"), lambda s: s == "..")


def upload_path(root: Column, name: Column) -> tuple[Column, Column]:
    """(path, reason): the joined clean path, or null and the first rule that the name breaks, segment by segment."""
    clean = F.replace(F.trim(name), F.lit("\\"), F.lit("/"))
    kept = F.filter(F.transform(F.split(clean, "/"), lambda s: F.trim(s)), lambda s: (s != "") & (s != "."))
    wrong = F.filter(F.transform(kept, lambda s: F.when(s == "..", "parent").when(F.contains(s, F.lit("\0")), "nul").when(F.contains(s, F.lit(":")), "colon")), lambda r: r.isNotNull())
    reason = F.when(clean == "", "empty").when(F.startswith(clean, F.lit("/")), "absolute").when(F.size(wrong) > 0, F.get(wrong, F.lit(0))).when(F.size(kept) == 0, "empty")
    return F.when(reason.isNull(), F.concat_ws("/", root, F.array_join(kept, "/"))), reason


def sanitize_filename(name: Column) -> Column:
    """Trimmed, characters that file systems refuse replaced; blank names become ``project``."""
    safe = F.regexp_replace(F.trim(name), r'[/\\:*?"<>|]', "_")
    return F.when(F.trim(safe) == "", "project").otherwise(safe)


def safe_download_name(name: Column) -> Column:
    return F.replace(name, F.lit('"'), F.lit("_"))
