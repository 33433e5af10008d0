"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a fixed list of insults and of words and word beginnings that the labelled sample marks ("hits"),
second-person words and how close to hits they stand, capitals, punctuation and obfuscated spellings.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import in_tasks, settle

#: Fixed list of insults.
INSULTS = frozenset("asshole bastard bitch clown crap creep damn disgusting dumb fool freak garbage idiot imbecile jerk liar loser lunatic moron morons pathetic pig retard scum shit shut stupid trash ugly useless vermin worthless".split())
#: Fixed list of second-person words.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros".split())
FEATURES = ("insults", "learned", "beginnings", "strongest", "hits", "second_person", "closest", "addressed", "capitals", "exclamations", "punctuation", "obfuscated", "length")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„«»"
_LEET = str.maketrans("013457@$!|", "oieastasii")
_INNER = regex.compile(r"[\p{L}\p{N}][^\p{L}\s,.;:/][\p{L}\p{N}]|\p{L}[0-9@$!|*][\p{L}0-9@$!|*]*\p{L}")


#: A hit counts as addressed with a second-person word at most so many words away.
REACH = 6


def plain(token: str) -> tuple[str, bool]:
    """(word, obfuscated): lower case without edge punctuation, look-alikes put back where letters enclose them."""
    word = token.strip(_EDGE).lower()
    if word.isalpha() or not _INNER.search(word):
        return word, False
    back = word.translate(_LEET)
    return "".join(c for c in back if c.isalpha()), True


@dataclass(frozen=True)
class Lexicon:
    """Log odds of words and of word beginnings, as the labelled sample has them."""

    words: dict[str, float]
    beginnings: dict[str, float]


def learn_lexicon(sample: DataFrame, *, max_entries: int = 2_000, min_docs: int = 5, lengths: tuple[int, ...] = (4, 5, 6)) -> Lexicon:
    """Entries whose log odds between toxic and other documents of the sample stand out; empty for an empty sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = {plain(t)[0] for t in set((text.as_py() or "").split())}
                for w in words:
                    found[0, w, label] += 1
                for start in {w[:n] for w in words for n in lengths if len(w) > n}:
                    found[1, start, label] += 1
        items = [(kind, w, label, c) for (kind, w, label), c in found.items() if w]
        for at in range(0, len(items), 50_000):
            cols = list(zip(*items[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], names=["kind", "entry", "label", "docs"])

    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    bad, good = sizes.get(1.0, 0), sizes.get(0.0, 0)
    counted = sample.select("text", "label").transform(in_tasks, count, "kind int, entry string, label double, docs long")
    both = counted.groupBy("kind", "entry").agg(F.sum(F.when(F.col("label") == 1, F.col("docs")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("docs")).otherwise(0)).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    strong = settle(both.where(F.col("bad") >= min_docs).withColumn("odds", odds).where("odds > 1.5"), "toxic-words")
    kept = [strong.where(F.col("kind") == k).orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "entry").limit(max_entries).collect() for k in (0, 1)]
    return Lexicon(*[{r.entry: float(r.odds) for r in rows} for rows in kept])


def _proximity(tokens: list[str], memory: dict) -> tuple[float, int]:
    """(1 / least distance in words of a hit and a second-person word, hits with one within ``REACH``); 1 and 0 words apart count alike."""
    yous, hits = [], []
    for at, token in enumerate(tokens):
        insult, odds, start, you, _ = memory[token]
        if you:
            yous.append(at)
        if insult or odds or start:
            hits.append(at)
    apart, k = [], 0
    for at in hits:
        while k + 1 < len(yous) and abs(yous[k + 1] - at) <= abs(yous[k] - at):
            k += 1
        apart.append(max(1, abs(yous[k] - at)))
    return 1.0 / min(apart), sum(d <= REACH for d in apart)


def text_features(text: str | None, lexicon: Lexicon, memory: dict) -> tuple[float, ...]:
    """``FEATURES`` of one text; zeros for an empty or null one."""
    tokens = text.split() if text else []
    counts = Counter(tokens)
    if not counts:
        return (0.0,) * len(FEATURES)
    n = insults = learned = begin = second = hidden = hits = 0
    strongest = 0.0
    for token, times in counts.items():
        n += times
        known = memory.get(token)
        if known is None:
            word, veiled = plain(token)
            odds = lexicon.words.get(word, 0.0)
            start = max((lexicon.beginnings.get(word[:k], 0.0) for k in (4, 5, 6)), default=0.0)
            known = memory[token] = (word in INSULTS, odds, start, word in SECOND_PERSON, veiled and (word in INSULTS or odds > 0))
        insult, odds, start, you, veiled = known
        if insult or odds or start:
            insults += insult * times
            learned += odds * times
            begin += start * times
            hits += times
            hidden += veiled * times
            strongest = max(strongest, odds, start, 4.0 * insult)
        second += you * times
    closest, addressed = _proximity(tokens, memory) if hits and second else (0.0, 0)
    size = len(text)
    upper = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    marks = text.count("!") + text.count("?")
    other = sum(map(text.count, ".,;:#$%&*|"))
    return (insults / n, learned / n, begin / n, strongest, math.log1p(hits), second / n, closest, addressed / n, upper / size, marks / size, other / size, hidden / n, math.log1p(n))


def _with_features(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    known, memory = lexicon.value, {}
    for batch in batches:
        rows = []
        for text in batch.column(batch.num_columns - 1):
            if len(memory) > 200_000:
                memory.clear()
            rows.append(text_features(text.as_py(), known, memory))
        values = np.array(rows, float).reshape(len(rows), len(FEATURES))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, len(FEATURES)), pa.int32()), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "features"])


def with_features(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(kept: struct of the ``keep`` columns, features) of every row."""
    cols = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("text"))
    return cols.transform(in_tasks, partial(_with_features, lexicon=docs.sparkSession.sparkContext.broadcast(lexicon)), StructType([cols.schema["kept"], StructField("features", ArrayType(DoubleType()))]))


@dataclass(frozen=True)
class ToxicityModel:
    """Without trees every score is ``constant``."""

    lexicon: Lexicon
    trees: object | None
    calibration: object | None
    constant: float = 0.0


def fit(sample: DataFrame, *, max_iter: int = 15, max_depth: int = 3, folds: int = 4) -> ToxicityModel:
    """A model from a bounded labelled sample (doc_id, text, label).

    Half of the sample teaches the lexicon and the other half the trees, so that entries that only memorise their own documents
    don't count. The calibration learns from rows that trees have not seen: each of ``folds`` parts of the second half is scored by trees of the others,
    or, where those have one label only, by all. With one label only, there are no trees and every score is that label's, 0 for an empty sample.
    Documents are told apart by id; one with both labels counts for both; null and empty texts have no features.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(2 * folds))
    lexicon = learn_lexicon(sample.where(half < folds))
    rows = with_features(sample.where(half >= folds).withColumn("part", half.cast("int")), lexicon, ("doc_id", "label", "part")).select("kept.label", "kept.part", array_to_vector("features").alias("features")).persist()
    labels = {(r.part, r.label) for r in rows.select("part", "label").distinct().collect()}
    known = sorted({label for _, label in labels} or {r.label for r in sample.select("label").distinct().collect()})
    if len({label for _, label in labels}) < 2:
        rows.unpersist()
        return ToxicityModel(lexicon, None, None, known[-1] if known else 0.0)
    learner = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, seed=7, stepSize=0.2)
    trees = learner.fit(rows)

    def unseen(part: int) -> DataFrame:
        others = trees if len({label for p, label in labels if p != part}) < 2 else learner.fit(rows.where(F.col("part") != part))
        return others.transform(rows.where(F.col("part") == part)).select("label", vector_to_array("probability")[1].alias("raw"))

    scored = reduce(DataFrame.unionAll, (unseen(part) for part in range(folds, 2 * folds)))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(scored)
    rows.unpersist()
    return ToxicityModel(lexicon, trees, calibration)


def score(docs: DataFrame, model: ToxicityModel, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and score (0 to 1) for every row; empty and null texts have the score of no features.

    Very long texts are read whole; repeated rows have equal scores; an empty table gives no rows; of the kept columns only ``score`` would clash.
    """
    rows = with_features(docs, model.lexicon, keep, text_col)
    if model.trees is None:
        return rows.select("kept.*", F.lit(float(model.constant)).alias("score"))
    raw = model.trees.transform(rows.withColumn("features", array_to_vector("features"))).select("kept", vector_to_array("probability")[1].alias("raw"))
    return model.calibration.transform(raw).select("kept.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
