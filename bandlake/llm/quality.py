"""Quality scores by Bradley-Terry pairwise ranking.

Of each preference pair (a document of label 1 over one of label 0) the logistic loss of the difference of their
features is minimised, which gives every document a strength; strengths are mapped to (0, 1) on the same sample. A
threshold keeps a share of the documents by the score's quantile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import in_tasks, settle
from . import textbits

FEATURES = ("junk", "marks", "capitals", "digits", "words_short", "words_long", "repeats", "pairs_repeat", "mark_ends", "spread", "length")
_CLASS = np.zeros((256, 5))
_CLASS[list(b"#$%&*|<>=~^{}[]\\_@+"), 0] = 1
_CLASS[list(b"!?;:"), 1] = 1
_CLASS[list(range(65, 91)), 2] = 1
_CLASS[list(range(48, 58)), 3] = 1
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)], 4] = 1


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text, all in 0..1; an empty or null text has zeros."""
    data, starts, ends = textbits.text_spans(column)
    out = np.zeros((len(starts), len(FEATURES)))
    for k, words in enumerate(textbits.texts_word_hashes(column)):
        n = len(words)
        if not n:
            continue
        octets = np.bincount(data[starts[k] : ends[k]], minlength=256)
        junk, marks, capitals, digits, letters = octets @ _CLASS
        size = int(ends[k] - starts[k])
        vary = len(np.unique(words)) / n
        pairs = len(np.unique(textbits.mix(words[:-1]) + words[1:])) / (n - 1) if n > 1 else 1.0
        mean = size / n
        out[k] = (
            min(1.0, 8 * junk / size), min(1.0, 8 * marks / size), capitals / max(1.0, letters), min(1.0, 5 * digits / size),
            max(0.0, min(1.0, (6.0 - mean) / 4)), max(0.0, min(1.0, (mean - 6.0) / 8)), 1 - vary, 1 - pairs,
            min(1.0, (junk + marks) / n), min(1.0, 2 * (1 - pairs) + 4 * (junk + marks) / size + 2 * (capitals > letters / 4)), 1 / (1 + np.log1p(n)),
        )
    return out


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = features(batch.column(batch.num_columns - 1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "features"])


def with_features(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(kept: struct of the ``keep`` columns, features) of every row."""
    cols = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("text"))
    return cols.transform(in_tasks, _with_features, StructType([cols.schema["kept"], StructField("features", ArrayType(DoubleType()))]))


@dataclass(frozen=True)
class RankingModel:
    """score = 1 / (1 + exp(-(slope * weights . features + offset)))."""

    weights: tuple[float, ...]
    slope: float
    offset: float

    def strength(self, features: str | Column) -> Column:
        return F.aggregate(F.zip_with(features, F.array(*[F.lit(w) for w in self.weights]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)

    def score(self, features: str | Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(self.strength(features) * self.slope + self.offset)))


def fit(sample: DataFrame, *, rivals: int = 3) -> RankingModel:
    """A model from a bounded labelled sample (doc_id, text, label).

    Each document of the rarer label meets ``rivals`` of the other, by a hash order that wraps around; without pairs
    all weights are 0 and the score is 1/2. Rows that are repeated count again; equal hashes are ordered by id; null and empty texts have no features.
    """
    rows = settle(with_features(sample, ("doc_id", "label")).select("kept.*", "features"), "quality-features")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    good, bad = counts.get(1.0, 0), counts.get(0.0, 0)
    if not good or not bad:
        return RankingModel((0.0,) * len(FEATURES), 0.0, 0.0)
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    placed = rows.withColumn("at", F.row_number().over(order) - 1)
    few, many, n_many = (0.0, 1.0, good) if bad <= good else (1.0, 0.0, bad)
    one = placed.where(F.col("label") == few).select(F.col("features").alias("f"), F.explode(F.array(*[F.pmod(F.col("at") * rivals + k, F.lit(n_many)) for k in range(rivals)])).alias("at"))
    met = one.join(placed.where(F.col("label") == many).select("at", F.col("features").alias("g")), "at")
    better, worse = ("g", "f") if few == 0.0 else ("f", "g")
    gap = F.zip_with(better, worse, lambda x, y: x - y)
    pairs = met.select(F.explode(F.array(F.struct(gap.alias("d"), F.lit(1.0).alias("label")), F.struct(F.transform(gap, lambda x: -x).alias("d"), F.lit(0.0).alias("label")))).alias("p")).select(array_to_vector("p.d").alias("features"), "p.label")
    fitted = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=60, standardization=False).fit(settle_vectors(pairs))
    model = RankingModel(tuple(float(w) for w in fitted.coefficients), 1.0, 0.0)
    strengths = rows.select(array_to_vector(F.array(model.strength("features"))).alias("features"), "label")
    mapped = LogisticRegression(regParam=1e-4, maxIter=60).fit(settle_vectors(strengths))
    return RankingModel(model.weights, float(mapped.coefficients[0]), float(mapped.intercept))


def settle_vectors(df: DataFrame) -> DataFrame:
    """A bounded training set in memory for the iterations of a fit, on disk where it does not fit."""
    return df.persist()


def score(docs: DataFrame, model: RankingModel, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and score for every row; empty and null texts have the score of no features.

    Very long texts are read whole; repeated rows have equal scores; an empty table gives no rows; of the kept columns only ``score`` would clash.
    """
    return with_features(docs, keep, text_col).select("kept.*", model.score("features").alias("score"))


def mark_best(scored: DataFrame, share: float, accuracy: int = 10_000) -> DataFrame:
    """``scored`` with ``kept``: whether the score reaches the quantile that keeps ``share`` of the rows; ties at the threshold are all kept.

    ``scored`` is read twice. The quantile is that of all rows to one part in ``accuracy`` of their number; one row of it is broadcast.
    """
    floor = scored.agg(F.percentile_approx("score", 1.0 - share, accuracy).alias("__floor"))
    return scored.join(F.broadcast(floor), F.lit(True), "left").withColumn("kept", F.col("score") >= F.col("__floor")).drop("__floor")


def keep_best(scored: DataFrame, share: float, accuracy: int = 10_000) -> DataFrame:
    """The rows that ``mark_best`` keeps."""
    return mark_best(scored, share, accuracy).where("kept").drop("kept")
