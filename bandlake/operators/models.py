"""Model catalog: what models and servers can do. ``models``: ord, id, type, inputs and outputs (arrays of type names)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt_capabilities(models: DataFrame) -> DataFrame:
    """id and a flag for each kind of prompt that the model turns into masks."""
    has = lambda t: F.array_contains("inputs", t)
    masks = (F.col("type") == "segmentation") & F.arrays_overlap("outputs", F.array(F.lit("polygon_list"), F.lit("mask")))
    example = F.arrays_overlap("inputs", F.array(*[F.lit(t) for t in ("region", "mask", "embedding", "image_region")]))
    flags = {"point": has("point_list"), "bbox": has("bbox"), "point_bbox": has("point_list") & has("bbox"), "text": has("text"), "example": example}
    return models.select("ord", "id", "type", *[F.coalesce(masks & c, F.lit(False)).alias(n) for n, c in flags.items()])


def server_flags(servers: DataFrame, models: DataFrame) -> DataFrame:
    """Flags of servers (server, inference, segmentation, progressive, thumbnails, downloads: null if absent; download_mode) with their fallbacks, and the profile.

    ``models`` has server too. A declared flag or, where it is absent or false, what the models and the download mode imply.
    """
    by = models.join(prompt_capabilities(models).select("ord", "id", "point"), ["ord", "id"]).groupBy("server").agg(F.count("*").alias("n"), F.bool_or("point").alias("promptable"))
    joined = servers.join(by, "server", "left")
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    inference = said("inference") | (F.coalesce("n", F.lit(0)) > 0)
    segmentation = said("segmentation") | F.coalesce("promptable", F.lit(False))
    chunked = F.coalesce(F.col("download_mode") == "chunked", F.lit(False))
    profile = F.when(segmentation, "segmentation").when(inference | said("progressive"), "full").otherwise("core")
    return joined.select("server", inference.alias("inference"), segmentation.alias("segmentation"), chunked.alias("chunked"), (said("progressive") | inference).alias("progressive"), (said("thumbnails") | said("downloads") | chunked).alias("thumbnails"), profile.alias("profile"))


def find_models(models: DataFrame, kind: str) -> DataFrame:
    """server, first_of_kind, first_promptable: ids of the first models in order, null for none."""
    flagged = models.join(prompt_capabilities(models).select("ord", "id", "point"), ["ord", "id"])
    first = lambda c: F.min_by(F.when(c, F.col("id")), F.when(c, F.col("ord")))
    return flagged.groupBy("server").agg(first(F.col("type") == kind).alias("first_of_kind"), first(F.col("point")).alias("first_promptable"))


def is_compatible(server: Column, client: Column) -> Column:
    return server == client
