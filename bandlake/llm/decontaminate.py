"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` characters may differ from a document's passage by ``e`` edits, a share of ``m``. Cut into ``e + 1``
pieces, one piece at least stands unedited in any such passage. All pieces are searched at once by an automaton; around
each hit, Myers' bit-parallel algorithm gives the least edit distance of the item to any part of the window.
Hits by chance are told early: if ``k`` pieces in a row have less than ``k`` edits, so has one of their halves, so a hit goes
up from its piece by halves, and is left where a larger part exceeds its budget.
Short items may have no edits; they are one piece, which must stand between word boundaries where its script has them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import in_tasks, settle
from . import bitfilter


def normalise(text: str) -> str:
    """Lower case with single spaces."""
    return " ".join(text.lower().split())


#: Code points of scripts that put no spaces between words: Thai to Tibetan, Myanmar, Khmer, kana, bopomofo and ideographs.
_UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


def _in_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LNM" and not any(a <= ord(c) <= b for a, b in _UNSPACED)


def bounded(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end of ``text[start:end]``."""
    return not any(0 < at < len(text) and _in_word(text[at - 1]) and _in_word(text[at]) for at in (start, end))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` consecutive pieces (offset, piece) whose lengths differ by one at most."""
    n, k = len(item), errors + 1
    bounds = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def best_distance(item: str, text: str, limit: int) -> tuple[int, int] | None:
    """(least edit distance of ``item`` to a part of ``text``, where that part ends), if it is ``limit`` at most."""
    m = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (limit + 1, -1)
    for at, c in enumerate(text):
        same = where.get(c, 0)
        x = same | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp, hn = minus | (full & ~(d0 | plus)), d0 & plus
        if hp & last:
            score += 1
        elif hn & last:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        plus, minus = hn | (full & ~(d0 | hp)), hp & d0
        if score < best[0]:
            best = (score, at + 1)
    return best if best[0] <= limit else None


def ancestors(k: int, n: int) -> list[tuple[int, int]]:
    """Ranges of pieces that hold piece ``k`` of ``n``, from the smallest of two or more to all, by halving."""
    low, high, out = 0, n, []
    while high - low > 1:
        out.append((low, high))
        middle = (low + high) // 2
        low, high = (low, middle) if k < middle else (middle, high)
    return out[::-1]


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], error_share: float, exact_below: int = 0) -> None:
        self.exact_below = exact_below
        self.items = [(key, text, int(len(text) * error_share) if len(text) >= exact_below else 0) for key, text in items]
        owners: dict[str, list[tuple[int, int, tuple]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            cut = pieces(text, errors)
            for j, (offset, piece) in enumerate(cut):
                # ranges of the item, not texts, so that a piece costs the same in an item of any length
                parts = tuple((cut[a][0], cut[b][0] if b < len(cut) else len(text), b - a - 1) for a, b in ancestors(j, len(cut))[:-1])
                owners.setdefault(piece, []).append((k, offset + len(piece), parts))
        self.automaton = ahocorasick.Automaton()
        for piece, at in owners.items():
            self.automaton.add_word(piece, at)
        if owners:
            self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item key, least distance, end of the best passage) for each item that the normalised text holds."""
        if not self.items:
            return
        windows: dict[int, set[int]] = {}
        exact: dict[int, int] = {}
        for end, owners in self.automaton.iter(text):
            for k, offset, parts in owners:
                start = end + 1 - offset
                if len(self.items[k][1]) < self.exact_below:
                    if k not in exact and bounded(text, start, end + 1):
                        exact[k] = end + 1
                    continue
                if start not in windows.get(k, ()) and all(best_distance(self.items[k][1][at:to], text[max(0, start + at - errors) : max(0, start + to + errors)], errors) for at, to, errors in parts):
                    windows.setdefault(k, set()).add(start)
        for k, end in exact.items():
            yield self.items[k][0], 0, end
        for k, starts in windows.items():
            key, item, errors = self.items[k]
            best, reach = None, -1
            for start in sorted(starts):
                if start <= reach:  # within the window just searched
                    continue
                reach = start + 2 * errors
                low = max(0, start - errors)
                found = best_distance(item, text[low : reach + len(item) + errors], errors)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], low + found[1])
                if best and not best[0]:
                    break
            if best:
                yield key, *best


_ROWS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end_char", pa.int32())])


def _match(batches: Iterator[pa.RecordBatch], block, error_share: float, exact_below: int) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(block.value, error_share, exact_below)
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid:
                rows += [(key, *hit) for hit in matcher.hits(normalise(text.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS)], schema=_ROWS)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, error_share: float = 0.08, min_chars: int = 20, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, distance (edits), end_char (in the normalised text).

    Matching ignores case and runs of white space. An item is found where a passage differs by at most ``error_share`` of
    its characters. The items are broadcast in blocks of about ``block_chars`` characters; a larger benchmark takes several passes
    over the documents. Null and empty texts hold nothing; items shorter than ``min_chars`` are found
    without edits only and between word boundaries where the script has them; null and empty items are left out; repeated items and repeated rows give repeated results; a null document id stays null in its rows; columns other than those
    named are ignored; empty tables give no rows. A block holds an item that is longer than ``block_chars`` alone with those that share its hash, and
    equal items always share one; so a benchmark's block is bounded by its longest or most repeated item.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item"))
    size = items.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else items
        held = [(r[0], n) for r in part.collect() if (n := normalise(r[1]))]  # about block_chars
        found = rows.transform(in_tasks, partial(_match, block=spark.sparkContext.broadcast(held), error_share=error_share, exact_below=min_chars), "doc_id long, item_id long, distance int, end_char int")
        out = found if out is None else out.unionAll(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that hold no test item; a null id can't be told from others and stays."""
    hits = settle(benchmark_hits(docs, benchmark, **options).select("doc_id"), "benchmark-hits")
    return bitfilter.without_ids(docs, options.get("id_col", "doc_id"), hits, "doc_id")
