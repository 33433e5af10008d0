"""Language identification by words first, then shorter and shorter character n-grams.

The model holds, per language, log frequencies of words and of character n-grams. A word of the model scores by its word
frequency in each language; an unseen word backs off to the longest n-grams of it that the model has, and to the
next shorter ones where it has none. The model is learned from a bounded sample of labelled rows and has a bounded
number of entries, so it can be broadcast; every document is scored over its whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..session import in_tasks, settle

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Entries map a string to one log probability per language; ``grams`` by length, from the longest."""

    languages: tuple[str, ...]
    words: dict[str, tuple[float, ...]]
    grams: tuple[dict[str, tuple[float, ...]], ...]
    orders: tuple[int, ...]


def tokens(text: str | None) -> Iterator[str]:
    """Runs of letters and their marks, in lower case."""
    return (w.lower() for w in _LETTERS.findall(text)) if text else iter(())


def _logs(counts: list[Counter], limit: int, floor: float) -> dict[str, tuple[float, ...]]:
    total = Counter()
    for c in counts:
        total.update(c)
    kept = sorted(total, key=lambda w: (-total[w], w))[:limit]
    sums = [sum(c.values()) for c in counts]
    return {w: tuple(math.log((c[w] + floor) / (s + floor * len(kept))) for c, s in zip(counts, sums, strict=True)) for w in kept}


def fit(labelled: DataFrame, *, max_rows: int = 4_000, max_words: int = 20_000, max_grams: int = 20_000, orders: tuple[int, ...] = (4, 3, 2, 1), min_count: int = 3, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from at most ``max_rows`` different labelled texts, ``max_rows // languages`` a language, at least one each.

    A language's are the ones of least hash; repeated rows count once. Rows whose text or language is null are left out; without any the model knows no language. Words need
    ``min_count`` occurrences in the sample. Counting runs in tasks; only the languages and the sample's most frequent entries reach the driver.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    hashed = rows.withColumn("hash", F.xxhash64("text", F.lit(8)))
    languages = tuple(sorted(r[0] for r in rows.select("lang").distinct().collect()))
    per = max(1, max_rows // max(1, len(languages)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))  # tasks keep their `per` least before the shuffle
    chosen = hashed.select("lang", "hash").distinct().withColumn("place", place).where(F.col("place") <= per).drop("place")
    chosen = settle(chosen, "language-sample")
    sample = hashed.join(F.broadcast(chosen), ["lang", "hash"]).dropDuplicates(["lang", "hash"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen = Counter(tokens(text.as_py()))
                found.setdefault((lang, 0), Counter()).update(seen)
                for n in orders:
                    grams = found.setdefault((lang, n), Counter())
                    for word, times in seen.items():
                        padded = f" {word} "
                        for k in range(len(padded) - n + 1):
                            grams[padded[k : k + n]] += times
        for (lang, n), counts in found.items():
            items = list(counts.items())
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([n] * len(part), pa.int32()), pa.array([w for w, _ in part]), pa.array([c for _, c in part], pa.int64())], names=["lang", "n", "entry", "times"])

    counted = sample.select("text", "lang").transform(in_tasks, count, "lang string, n int, entry string, times long").groupBy("n", "entry", "lang").agg(F.sum("times").alias("times"))
    by_entry = counted.groupBy("n", "entry").agg(F.sum("times").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "times"))).alias("langs"))
    by_entry = settle(by_entry.where(F.col("total") >= min_count), "language-counts")
    kept = []
    for n in (0, *orders):
        kept += [(n, r.entry, r.langs) for r in by_entry.where(F.col("n") == n).orderBy(F.desc("total"), "entry").limit(max_words if n == 0 else max_grams).collect()]

    def table(n: int) -> dict[str, tuple[float, ...]]:
        counts = [Counter({e: langs.get(lang, 0) for m, e, langs in kept if m == n}) for lang in languages]
        return _logs(counts, max_words if n == 0 else max_grams, 0.5)

    return LanguageModel(languages, table(0), tuple(table(n) for n in orders), orders)


def word_score(model: LanguageModel, word: str) -> tuple[float, ...] | None:
    """Log score of a word per language: its own, or the mean over its n-grams of the longest length that has any."""
    if word in model.words:
        return model.words[word]
    padded = f" {word} "
    for n, grams in zip(model.orders, model.grams, strict=True):
        hits = [h for k in range(len(padded) - n + 1) if (h := grams.get(padded[k : k + n]))]
        if hits:
            count = len(hits)
            return tuple([sum(of_language) / count for of_language in zip(*hits, strict=True)])
    return None


def predict(model: LanguageModel, text: str | None, memory: dict | None = None) -> tuple[str, float]:
    """(language, score): the softmax over languages of the mean word score times ``sqrt(words)``; und without letters."""
    counts = Counter(tokens(text))
    if not counts or not model.languages:
        return UNKNOWN, 0.0
    memory = {} if memory is None else memory
    totals, weight = [0.0] * len(model.languages), 0
    for word, times in counts.items():
        if word in memory:
            scores = memory[word]
        else:
            scores = memory[word] = word_score(model, word)
        if scores is not None:
            weight += times
            for j, s in enumerate(scores):
                totals[j] += s * times
    if not weight:
        return model.languages[0], 1.0 / len(model.languages)
    sharp = math.sqrt(weight) / weight
    best = max(range(len(totals)), key=lambda j: (totals[j], -j))
    return model.languages[best], 1.0 / sum(math.exp(max(-60.0, (t - totals[best]) * sharp)) for t in totals)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    known, memory = model.value, {}
    for batch in batches:
        names, scores = [], []
        for text in batch.column(batch.num_columns - 1):
            if len(memory) > 50_000:
                memory.clear()
            name, score = predict(known, text.as_py(), memory)
            names.append(name)
            scores.append(score)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["kept", "language", "score"])


def identify(docs: DataFrame, model: LanguageModel, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns, lang_pred and score (0 to 1) for every row.

    ``und`` with score 0 for null or letterless text. Texts of unseen words without any known n-gram get the first
    language at an even score; ties go to the first language by name; very long texts are read whole; of the kept columns only those called like ``names`` would clash; repeated rows get equal results; an empty table gives no rows.
    """
    cols = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("text"))
    schema = StructType([cols.schema["kept"], StructField("language", StringType()), StructField("score", DoubleType())])
    scored = cols.transform(in_tasks, partial(_score, model=docs.sparkSession.sparkContext.broadcast(model)), schema)
    return scored.select("kept.*", F.col("language").alias(names[0]), F.col("score").alias(names[1]))


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor)) == remainder, F.lit(False))
