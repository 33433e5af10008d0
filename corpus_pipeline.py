"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.llm import bitfilter, decontaminate, langid, linededup, mixing, ngram_join
from bandlake.session import settle, table

#: Below this score a text's language counts as unknown.
MIN_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language known well enough, go; a missing ``lang`` is filled in."""
    model = langid.fit(docs)
    if not model.languages:  # nothing to learn from: only letterless texts can be told
        return docs.where(F.col("text").rlike(r"\p{L}"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found, score = bitfilter.unused(docs.columns, "lang_found", "lang_score")
    scored = langid.identify(docs, model, keep=tuple(columns), names=(found, score))
    kept = scored.where((F.col(found) != langid.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", found)).select(*columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs go but for the first, so that of copied documents one stays whole; n_chars follows."""
    out = linededup.drop_recurring_lines(docs, keep_first=True, counts=False)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8.

    Of what stays, lines of 50 words or more that two documents share go but for the first; before, near copies would lose them and no longer be found.
    """
    kept = settle(ngram_join.drop_near_duplicates(docs), "near-duplicates-dropped")
    out = linededup.drop_long_lines(kept)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with target, repeats and taken."""
    return mixing.apply_mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what each keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language scores and edit distances have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
