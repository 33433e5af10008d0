"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its token count and its leading tokens, where tokens with digits, ``@`` or ``://`` count as
variable fields. A template keeps literal constants at a share of its places, so with ``v`` places left to vary one of ``v + 1``
pieces of the line has constants only: lines none of whose pieces stands in documents enough can have no template and
leave the tree at once. Among the others a token is constant at its place if enough documents have it there. As values of a field recur,
too, in a large leaf, there is a ladder of numbers that are enough, each ``STEP`` times the one before, and a line has a
template for each in which its constants differ. Templates that recur in enough documents are dropped.

Equal lines are one class from the start, so that a line common to a third of all documents is one row with a count. Documents
that have several classes in one leaf would count once for each; how often they do is counted apart and taken off.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import in_tasks, settle
from . import bitfilter

_FIELD = re.compile(rb"[0-9@]|://")
ANY = b"<*>"
#: Factor between the document counts from which on tokens are constant.
STEP = 4


def line_tokens(line: bytes) -> list[bytes]:
    """Tokens between spaces and 0x09-0x0D, variable fields as ``<*>``."""
    tokens = line.split()
    if _FIELD.search(line):
        tokens = [ANY if _FIELD.search(t) else t for t in tokens]
    return tokens


def _hash(data: bytes, seed: int = 0) -> int:
    value = xxhash.xxh64_intdigest(data, seed)
    return value - (1 << 64) if value >> 63 else value


def place(tokens: list[bytes], depth: int) -> tuple[int, int]:
    """(leaf, line class) as hashes."""
    return _hash(b"%d " % len(tokens) + b" ".join(tokens[:depth]), 1), _hash(b" ".join(tokens), 2)


def _lines(text: pa.Scalar, min_tokens: int, depth: int, percent: int) -> Iterator[tuple[list[bytes], int, int]]:
    """Lines that have literal tokens enough for a template."""
    if text.is_valid:
        for line in text.as_py().encode().split(b"\n"):
            tokens = line_tokens(line)
            if len(tokens) >= min_tokens and 100 * (len(tokens) - tokens.count(ANY)) >= percent * len(tokens):
                yield tokens, *place(tokens, depth)


def piece_keys(tokens: list[bytes], leaf: int, percent: int) -> list[int]:
    """Hashes of a line's consecutive pieces, one more than its places that may vary."""
    n = len(tokens)
    k = n + (-percent * n) // 100 + 1
    bounds = [n * i // k for i in range(k + 1)]
    return [_hash(b" ".join(tokens[a:b]), (leaf + i) & (1 << 64) - 1) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


_PLACES = pa.schema([("doc_id", pa.int64()), ("leaf", pa.int64()), ("line", pa.int64()), ("pieces", pa.list_(pa.int64())), ("fresh", pa.int32())])


def _places(batches: Iterator[pa.RecordBatch], min_tokens: int, depth: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Each class of a row's lines; of its pieces the ``fresh`` first are new in the row."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(_PLACES)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLACES, strict=True)], schema=_PLACES)

    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own, met = set(), set()
            for tokens, leaf, line in _lines(text, min_tokens, depth, percent):
                if line not in own:
                    own.add(line)
                    pieces = piece_keys(tokens, leaf, percent)
                    new = [p for p in pieces if p not in met]
                    met.update(new)
                    rows.append((key, leaf, line, new if len(new) == len(pieces) else new + [p for p in pieces if p not in set(new)], len(new)))
            if len(rows) >= 20_000:
                yield out(rows)
                rows = []
        yield out(rows)


def _at(line: int, doc_id: int) -> int:
    """A class at a document, as a hash."""
    return line ^ (doc_id << 40)


def _wanted(batches: Iterator[pa.RecordBatch], min_tokens: int, depth: int, percent: int, wanted) -> Iterator[pa.RecordBatch]:
    """The lines of the filter's classes and documents with their token counts and hashes of their literal tokens with leaf and place, each once a row."""
    bits = wanted.value
    for batch in batches:
        lines, sizes, spots = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen = set()
            for words, leaf, line in _lines(text, min_tokens, depth, percent):
                if line not in seen and bitfilter.has(bits, _at(line, key)):
                    seen.add(line)
                    lines.append(line)
                    sizes.append(len(words))
                    spots.append([_hash(w, (leaf ^ at) & (1 << 64) - 1) for at, w in enumerate(words) if w is not ANY])
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(sizes, pa.int32()), pa.array(spots, pa.list_(pa.int64()))], names=["line", "n", "spots"])


def recurring_lines(docs: DataFrame, *, min_docs: int = 3, depth: int = 3, percent: int = 80, min_tokens: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, first_doc) for each document and class of its lines whose template recurs in ``min_docs`` (2 or more) documents.

    ``line`` is a class's hash, ``first_doc`` the least id that has the template. A template needs literal constants, fields left out, at ``percent``
    of its places. Documents are told apart by id: repeated rows are one, and lines of rows without an id count for nothing.
    """
    options = {"min_tokens": min_tokens, "depth": depth, "percent": percent}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    placed = settle(rows.transform(in_tasks, partial(_places, **options), "doc_id long, leaf long, line long, pieces array<long>, fresh int"), "lines")
    # a row has each of its pieces once among the fresh ones, so rows count documents, but for documents of several rows
    repeated = settle(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    quiet, loud = bitfilter.split(placed, "doc_id", repeated, "doc_id")
    again = loud.join(repeated, "doc_id", "left_semi").select("doc_id", F.explode("pieces").alias("piece")).distinct().select("piece")
    once = quiet.unionAll(loud.join(repeated, "doc_id", "left_anti")).select(F.explode(F.slice("pieces", F.lit(1), F.col("fresh"))).alias("piece"))
    shared = settle(once.unionAll(again).groupBy("piece").count().where(F.col("count") >= min_docs).select("piece"), "line-pieces")
    maybe = bitfilter.split(placed.select("line", F.explode("pieces").alias("piece")), "piece", shared, "piece")[1]
    able = settle(maybe.join(shared, "piece", "left_semi").select("line").distinct(), "line-able")
    held = bitfilter.split(placed.select("doc_id", "leaf", "line"), "line", able, "line")[1]
    held = settle(held.join(able, "line", "left_semi").distinct(), "line-held")
    classes = settle(held.groupBy("line").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")), "line-classes")
    several = held.groupBy("doc_id", "leaf").count().where("count > 1").select("doc_id", "leaf")
    several = settle(held.join(several, ["doc_id", "leaf"], "left_semi").select("doc_id", "line"), "line-several")
    # a class's tokens are read in its first document only, and other documents are not taken apart again
    wanted = bitfilter.build(classes.select(F.col("line").bitwiseXOR(F.shiftleft("first_doc", 40)).alias("at")), "at")
    firsts = bitfilter.split(rows, "doc_id", classes, "first_doc")[1]
    texts = firsts.transform(in_tasks, partial(_wanted, **options, wanted=wanted), "line long, n int, spots array<long>").dropDuplicates(["line"])
    known = settle(classes.join(texts, "line"), "line-spots")
    spots = known.select("line", "docs", "first_doc", F.explode("spots").alias("spot"))

    def documents(counted: DataFrame, key: str) -> DataFrame:
        """Distinct documents and least id by ``key``; ``counted`` has them for each class and key."""
        again = several.join(counted.select("line", key), "line").groupBy("doc_id", key).count().where("count > 1")
        both = counted.select(key, "docs", "first_doc").unionAll(again.select(key, (1 - F.col("count")).alias("docs"), "doc_id"))
        return both.groupBy(key).agg(F.sum("docs").alias("docs"), F.min("first_doc").alias("first_doc")).where(F.col("docs") >= min_docs)

    # the highest rung of the ladder that a token reaches at its place
    level = F.floor(F.log(F.col("docs") / min_docs) / F.log(F.lit(float(STEP))) + 1e-9).cast("int")
    constant = documents(spots, "spot").select("spot", level.alias("level"))
    kept = spots.select("line", "spot").join(constant, "spot").repartition("line")
    # a template's hash adds up those of its constant places, so that counting them needs no sorting
    rungs = kept.groupBy("line", "level").agg(F.count("*").alias("fixed"), F.bit_xor("spot").alias("template"))
    above = Window.partitionBy("line").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    shape = rungs.select("line", F.sum("fixed").over(above).alias("fixed"), F.bit_xor("template").over(above).alias("template"))
    shape = settle(shape.join(known.drop("spots"), "line").where(100 * F.col("fixed") >= percent * F.col("n")).drop("fixed", "n"), "line-templates")
    found = shape.select("line", "template").join(documents(shape, "template").select("template", "first_doc"), "template").groupBy("line").agg(F.min("first_doc").alias("first_doc"))
    return held.select("doc_id", "line").join(found, "line")


def _class_of(line: bytes, min_tokens: int, depth: int) -> int | None:
    tokens = line_tokens(line)
    return place(tokens, depth)[1] if len(tokens) >= min_tokens else None


def _verbatim(line: bytes, least_words: int) -> int | None:
    words = line.split()
    return _hash(b" ".join(words), 3) if len(words) >= least_words else None


def _long_lines(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lines = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid:
                found = {_verbatim(line, least_words) for line in text.as_py().encode().split(b"\n")} - {None}
                ids += [key] * len(found)
                lines += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64())], names=["doc_id", "line"])


def _without(batches: Iterator[pa.RecordBatch], key_of: Callable[[bytes], int | None]) -> Iterator[pa.RecordBatch]:
    """(kept, text, n_lines, n_dropped) of kept columns, text and the lists of dropped classes and of those kept once."""
    for batch in batches:
        texts, totals, dropped = [], [], []
        for text, drop, once in zip(batch.column(batch.num_columns - 3), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if not text.is_valid:
                texts.append(None)
                totals.append(0)
                dropped.append(0)
                continue
            lines = text.as_py().encode().split(b"\n")
            gone, once = set(drop or ()), set(once or ())
            kept = []
            for line in lines:
                key = key_of(line) if gone or once else None
                if key is not None and key in gone:
                    continue
                if key is not None and key in once:
                    once.discard(key)
                    gone.add(key)
                kept.append(line)
            texts.append(b"\n".join(kept).decode())
            totals.append(len(lines))
            dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=["kept", "text", "n_lines", "n_dropped"])


def drop_recurring_lines(docs: DataFrame, *, keep_first: bool = False, counts: bool = True, min_docs: int = 3, depth: int = 3, percent: int = 80, min_tokens: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the text without recurring lines; with ``counts``, n_lines and n_dropped (own columns so named give way).

    ``keep_first`` leaves a template's first line in the document of least id. Null text stays null with no lines; an empty text is
    one line and stays; a document may be left empty; rows with equal ids lose the same lines; a null id keeps all its lines; an empty table
    gives no rows. Very long lines are lines like others.
    """
    options = {"min_docs": min_docs, "depth": depth, "percent": percent, "min_tokens": min_tokens}
    found = recurring_lines(docs, id_col=id_col, text_col=text_col, **options)
    return _drop(docs, found, partial(_class_of, min_tokens=min_tokens, depth=depth), keep_first, counts, id_col, text_col)


def drop_long_lines(docs: DataFrame, *, least_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the text without lines of ``least_words`` words or more that stand in another document, too.

    Two documents are enough; lines are equal but for white space, and the document of least id keeps its first. Rows with
    equal ids are one document; a null id keeps all its lines; null texts stay null; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = settle(rows.transform(in_tasks, partial(_long_lines, least_words=least_words), "doc_id long, line long"), "long-lines")
    twice = placed.groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc").drop("last_doc")
    return _drop(docs, placed.join(twice, "line"), partial(_verbatim, least_words=least_words), True, False, id_col, text_col)


def _drop(docs: DataFrame, found: DataFrame, key_of: Callable[[bytes], int | None], keep_first: bool, counts: bool, id_col: str, text_col: str) -> DataFrame:
    """The documents without the lines in ``found`` (doc_id, line, first_doc); ``key_of`` gives a line's class."""
    first = F.col("doc_id") == F.col("first_doc") if keep_first else F.lit(False)
    lists = found.groupBy("doc_id").agg(F.collect_set(F.when(~first, F.col("line"))).alias("drop"), F.collect_set(F.when(first, F.col("line"))).alias("once"))
    lists = settle(lists.where("doc_id IS NOT NULL"), "line-lists")
    own = [c for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    rows = docs.select(F.struct(*[c for c in own if c != text_col]).alias("kept"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    quiet, loud = bitfilter.split(rows, "doc_id", lists, "doc_id")
    # rows that lose nothing stay in Spark; the others are always joined by sorting, so that small and large inputs take the same way
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    quiet = quiet.select("kept", "text", lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    loud = loud.join(lists.hint("merge"), "doc_id", "left").select("kept", "text", "drop", "once")
    schema = StructType([rows.schema["kept"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    out = quiet.unionAll(loud.transform(in_tasks, partial(_without, key_of=key_of), schema))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in own], *(["n_lines", "n_dropped"] if counts else []))
