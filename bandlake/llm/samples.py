"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, max_rows: int, exclude: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label double) of about ``max_rows`` labelled documents, chosen by a hash of the id.

    Rows without label, id or text and those of ``exclude`` are left out; a document with several labels stands once for each.
    The sampled labels, bounded by ``max_rows``, are broadcast, so no text is shuffled.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).distinct()
    if exclude is not None:
        known = known.where(~exclude)
    share = min(1.0, max_rows / max(1, known.count()))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(unit < share)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return settle(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), "labelled")
