"""Request metrics, error codes, build status and stale connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle

#: Fixed endpoints of the metrics.
ENDPOINTS = ("image_bands", "sam_infer", "sam_warm")
#: Fixed severities, by rank.
SEVERITIES = ("Info", "Warning", "Error", "Fatal")
#: Fixed error categories, by the code's thousand.
CATEGORIES = {1: "Image", 2: "Pyramid", 3: "Model", 4: "Connection", 5: "Server", 6: "Client"}
#: Fixed error codes: code, name, retryable, retry after so many ms (1000 unless stated).
ERRORS = (
    (1000, "ImageNotFound", False, 1000), (1001, "InvalidLevel", False, 1000), (1002, "ImageCorrupted", False, 1000),
    (1003, "UnsupportedFormat", False, 1000), (1004, "ImageTooLarge", False, 1000), (1010, "NoActiveImage", False, 1000),
    (2000, "PyramidNotReady", True, 5000), (2001, "PyramidBuildFailed", False, 1000), (2002, "PyramidCorrupted", False, 1000),
    (2003, "PyramidStorageFull", False, 1000), (2004, "PyramidTimeout", False, 1000),
    (3010, "ModelNotFound", False, 1000), (3011, "InvalidInput", False, 1000), (3012, "MissingInput", False, 1000),
    (3013, "EmbeddingRequired", False, 1000), (3014, "EmbeddingExpired", False, 1000), (3015, "ModelBusy", True, 2000),
    (3016, "ModelEncodeFailed", False, 1000), (3017, "ModelDecodeFailed", False, 1000), (3018, "ModelOutOfMemory", False, 1000),
    (4000, "ConnectionTimeout", True, 1000), (4001, "ConnectionRefused", False, 1000), (4002, "ConnectionDropped", True, 1000),
    (4003, "ProtocolMismatch", False, 1000), (4004, "AuthRequired", False, 1000), (4005, "AuthFailed", False, 1000),
    (4006, "RateLimited", True, 10000), (4007, "SessionExpired", True, 1000), (4008, "MaxConnectionsReached", False, 1000),
    (5000, "InternalError", False, 1000), (5001, "ServiceUnavailable", True, 30000), (5002, "StorageError", False, 1000),
    (5003, "OutOfMemory", False, 1000), (5004, "ConfigurationError", False, 1000),
    (6000, "InvalidRequest", False, 1000), (6001, "InvalidAction", False, 1000), (6002, "MissingField", False, 1000), (6003, "InvalidValue", False, 1000),
)


def error_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, CATEGORIES[c // 1000], r, ms) for c, n, r, ms in ERRORS], "code int, name string, category string, retryable boolean, retry_ms int")


def classify_errors(log: DataFrame, spark: SparkSession, code: str = "error_code") -> DataFrame:
    """The log's failed requests with name, category, retryable and retry_ms; an unknown code has no name and category Unknown."""
    known = F.broadcast(error_dimension(spark))  # a few dozen rows
    failed = log.where(F.col(code).isNotNull())
    joined = failed.join(known, failed[code] == known["code"], "left")
    thousand = F.expr(f"{code} div 1000")
    names = F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    return joined.select(*[failed[c] for c in failed.columns], "name", F.coalesce(F.col("category"), names[thousand], F.lit("Unknown")).alias("category"), F.coalesce("retryable", F.lit(False)).alias("retryable"), F.coalesce("retry_ms", F.lit(1000)).alias("retry_ms"))


def endpoint_metrics(log: DataFrame, spark: SparkSession) -> DataFrame:
    """Requests, errors, integer mean and maximum latency by endpoint; one without requests has zeros."""
    ends = spark.createDataFrame([(e,) for e in ENDPOINTS], "endpoint string")
    sums = log.groupBy("endpoint").agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("errors"), F.sum("latency_ms").alias("total"), F.max("latency_ms").alias("max_latency_ms"))
    joined = ends.join(sums, "endpoint", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("endpoint", zero("requests"), zero("errors"), F.coalesce(F.expr("total div requests"), F.lit(0)).alias("avg_latency_ms"), zero("max_latency_ms"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def latency_summary(log: DataFrame, by: str, value: str, *, ranges: int = 200) -> DataFrame:
    """Least, upper median and mean by group: the median is the value at place n div 2 of the sorted ones.

    Equal values are counted first. Of each group the quantiles of its distinct values are estimated, which cut them into
    ``ranges`` of about equal numbers; counts by range tell which one holds the median, and only that one is sorted.
    """
    counts = settle(log.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("by"), F.col(value).alias("v")).agg(F.count("*").alias("times")), "value-counts")
    cuts = F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 10 * ranges)
    groups = counts.groupBy("by").agg(F.min("v").alias("min"), F.sum("times").alias("n"), (F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("mean"), cuts.alias("cuts"))
    groups = settle(groups, "groups")  # a row a group
    placed = counts.alias("c").join(groups.select(F.col("by").alias("g"), "cuts").alias("q"), F.expr("c.by <=> q.g"))
    ranged = placed.select("by", "v", "times", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("range"))
    sums = ranged.groupBy("by", "range").agg(F.sum("times").alias("times"))
    before = F.coalesce(F.sum("times").over(Window.partitionBy("by").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = sums.select("by", "range", before.alias("before"), "times").alias("s").join(groups.alias("g"), F.expr("s.by <=> g.by AND s.before <= g.n div 2 AND s.before + s.times > g.n div 2"))
    chosen = reached.select(F.col("g.by").alias("key"), "s.range", "s.before", "n", "min", "mean").alias("k")
    near = ranged.alias("r").join(chosen, F.expr("r.by <=> k.key AND r.range = k.range"))
    upto = F.col("before") + F.sum("times").over(Window.partitionBy("key").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    met = near.withColumn("upto", upto).where("upto > n div 2").groupBy(F.col("key").alias(by))
    return met.agg(F.first("min").alias("min"), F.min("v").alias("median"), F.first("mean").alias("mean"))


def pyramid_status(text: Column) -> Column:
    kind = F.trim(text)
    return F.when(kind == "ready", "ready").when(kind == "building", "building").when(F.startswith(kind, F.lit("failed:")), "failed").otherwise("pending")


def pending_builds(images: DataFrame, status: DataFrame) -> DataFrame:
    """Images to build: without status, pending or failed."""
    known = status.select("image_id", pyramid_status(F.col("status_text")).alias("status"))
    return images.join(known, "image_id", "left").where(~F.coalesce("status", F.lit("pending")).isin("ready", "building")).select("image_id", F.coalesce("status", F.lit("pending")).alias("status"))


def build_outcomes(builds: DataFrame) -> DataFrame:
    """Counts of generated, skipped and failed by project."""
    return builds.groupBy("project").pivot("outcome", ["generated", "skipped", "failed"]).count().na.fill(0)


def build_progress(level: Column, levels: Column, seconds: int = 2) -> tuple[Column, Column]:
    """(share done, estimated seconds left or null before the first level)."""
    return level / levels, F.when(level > 0, (levels - level) * seconds)


def stale_connections(beats: DataFrame, *, key: str = "user_id", at: str = "ts", timeout: int = 90) -> DataFrame:
    """Sessions by connection: a gap of more than ``timeout`` whole seconds ends one."""
    ms = F.expr(f"unix_millis(cast({at} as timestamp))")
    order = Window.partitionBy(key).orderBy("ms")
    gap = F.floor((F.col("ms") - F.lag("ms").over(order)) / 1000)
    marked = beats.select(key, ms.alias("ms")).withColumn("fresh", F.coalesce(gap > timeout, F.lit(True)).cast("int"))
    numbered = marked.withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("beats"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def server_info(files: DataFrame, counts: DataFrame, version: str = "1.0.0") -> DataFrame:
    return counts.select("project", "images", F.lit(version).alias("version"))
