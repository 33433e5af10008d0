"""Mixing sources to target weights by exponential-key (Efraimidis-Spirakis) sampling.

Only DataFrame functions run here. Rows equal in source, id and text are one row with its number of copies. Prefix sums are
taken in two levels: a source of ``n`` such rows is cut into about ``sqrt(n)`` buckets that follow the key's order, bucket sums
are summed up within the source, and rows only within their bucket, so that no source has to fit one task. Buckets are even
whatever the weights: a row's is its key's place in the distribution that the source's weights give its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .bitfilter import unused

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that prose seldom has; their share lowers a document's weight.
JUNK = "!#$%&*|<>=~^"
#: Weights of a source are told apart in quarters of a power of two, at most this many.
CLASSES = 64
#: Copies of a row that are written out at once.
COPIES = 10_000


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; null text has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Quality weight in (0, 1]: 1 / (1 + 20 * share of junk characters); empty or null text weighs 1."""
    junk = F.length(text) - F.length(F.translate(text, JUNK, ""))
    return F.coalesce(1.0 / (1.0 + 20.0 * (junk / F.nullif(F.length(text), F.lit(0)))), F.lit(1.0))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from the MD5 of seed and id: reruns and repeated ids get the same key."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary")), 1, 12), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 48)) / weight


def source_targets(sources: DataFrame, weights: tuple[float, ...], max_epochs: int, budget: Column | None = None) -> DataFrame:
    """Adds ``target``: a share by weight of the whole budget (default: all sizes), at most ``max_epochs`` sizes each.

    ``sources`` has one row per source (source, source_size, n_rows). Weights repeat over the sources by code point, null
    last. What a source can't take goes to the others by weight until none is above: with sources ordered by
    cap / weight, the level is that of the first one whose share stays within its cap. The rows of all sources, one each, meet in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    ranked = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at.cast("int"))).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    total = F.sum("source_size").over(every).cast("double") if budget is None else budget.cast("double")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (total - before) / rest)
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    level = F.max(fits).over(every)
    return levels.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("w")))).drop("w", "cap", "level")


def even_buckets(rows: DataFrame) -> DataFrame:
    """Adds ``bucket`` to rows (src, sample_key, weight): about ``sqrt(n)`` even ranges of a source's ``n`` rows in the key's order.

    Keys of weight w lie below k with probability 1 - exp(-k * w); a source's keys follow the mean of that over its weights, which are
    counted by class. The mean grows with k, so buckets keep the order even where a class is no single weight.
    """
    level = F.least(F.greatest(F.floor(-4 * F.log2("weight")), F.lit(0)), F.lit(CLASSES - 1))
    classes = rows.groupBy("src", level.alias("level")).agg(F.count("*").alias("n"), F.avg("weight").alias("w"))
    spread = classes.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("w", "n"))).alias("spread"), F.sum("n").alias("n_all"))
    above = F.aggregate("spread", F.lit(0.0), lambda total, c: total + c["n"] * F.exp(-c["w"] * F.col("sample_key"))) / F.col("n_all")
    buckets = F.ceil(F.sqrt("n_all"))
    bucket = F.greatest(F.least(F.floor(buckets * (1 - above)), buckets - 1), F.lit(0))
    return rows.join(spread, "src").withColumn("bucket", bucket).drop("spread", "n_all")


def _placed(docs: DataFrame, weights: tuple[float, ...], max_epochs: int, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Distinct rows: doc_id, source, size, source_size, target, epochs, sample_key, tie, copies and ``chosen``, how many of these are selected."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), text_quality(text).alias("weight"), F.xxhash64(text).alias("tie"))
    sized = settle(rows.groupBy("doc_id", "source", "size", "weight", "tie").agg(F.count("*").alias("copies")), "mix-sized")
    keyed = sized.withColumn("sample_key", exponential_key(F.col("doc_id"), F.col("weight"), seed)).withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    words = F.col("size") * F.col("copies")
    sources = keyed.groupBy("src").agg(F.min("source").alias("source"), F.sum(words).alias("source_size"))
    targets = source_targets(sources, weights, max_epochs)
    whole = F.floor(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)) + 1e-9)
    targets = settle(targets.withColumn("epochs", whole.cast("long")).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    held = even_buckets(keyed)
    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("src", "bucket").agg(F.sum(words).alias("bucket_size")).withColumn("before_bucket", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0))).drop("bucket_size")
    inner = Window.partitionBy("src", "bucket").orderBy("sample_key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.join(sums, ["src", "bucket"]).withColumn("before", F.col("before_bucket") + F.coalesce(F.sum(words).over(inner), F.lit(0)))
    room = F.floor((F.col("left") - F.col("before") - F.col("size") / 2) / F.nullif(F.col("size"), F.lit(0))) + 1  # the i-th copy has i * size more before it
    chosen = F.when(F.col("size") > 0, F.greatest(F.least(room, "copies"), F.lit(0))).otherwise(0).cast("long")
    return placed.join(targets.drop("source"), "src").withColumn("chosen", chosen).select("doc_id", "source", "size", "source_size", "target", "epochs", "sample_key", "tie", "copies", "chosen")


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, selected, taken, sample_key, tie (digest of the text).

    Every document is taken ``epochs`` = floor(target / source_size) times; what is left of the target is filled by
    the documents of least key, up to the last one that brings the sum nearer to it. ``taken`` counts words, repeats
    included. Null text has size 0 and is never taken; null sources are a source of their own; repeated rows are rows;
    equal keys are ordered by id and text digest; an empty table gives no rows; further columns are ignored.
    """
    placed = _placed(docs, weights, max_epochs, seed, id_col, source_col, text_col)
    part = placed.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    each = part.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, F.col("copies")) - 1)))
    selected = F.col("copy") < F.col("chosen")
    taken = F.col("size") * (F.col("epochs") + selected.cast("long"))
    return each.select("doc_id", "source", "size", "source_size", "target", "epochs", selected.alias("selected"), taken.alias("taken"), "sample_key", "tie")


def apply_mix(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that the mix takes, all columns, with target, repeats (times taken) and taken (words).

    Rows equal in id and text are one document here and all carry its largest share.
    Columns of the documents that are named target, repeats or taken give way; all others stay, whatever their names.
    """
    own = docs.drop("target", "repeats", "taken")
    key, tie = unused([*own.columns, "target", "repeats", "taken"], "key", "tie")
    repeats = F.col("epochs") + F.least("chosen", F.lit(1))
    placed = _placed(docs, weights, max_epochs, seed, id_col, source_col, text_col).groupBy(F.col("doc_id").alias(key), F.col("tie").alias(tie))
    mix = placed.agg(F.max("target").alias("target"), F.max(repeats).alias("repeats"), F.max(F.col("size") * repeats).alias("taken")).where("taken > 0")
    return own.join(mix, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(tie))).drop(key, tie)
