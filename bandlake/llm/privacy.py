"""Personal data by information-theoretic sanitisation.

Mail and network addresses, card and telephone numbers are found by their form; each value is a protected entity. How
strongly a term reveals an entity is estimated from the corpus: with N documents, the entity in n_e of them, the term in
n_t, and the term within ``radius`` words of the entity in n_te, the entity's information is IC = log2(N / n_e), the
term's pointwise mutual information with it PMI = log2(N * n_te / (n_e * n_t)), and the disclosure PMI / IC; 1 means that
the term gives the entity away. Terms of a document that disclose one of its own entities beyond a threshold are
generalised to the class of words with their first letters, unless the class discloses that entity, too: then they are
removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..session import in_tasks, settle
from . import bitfilter, textbits

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalised", "removed")
#: Letters that a generalised term keeps.
PREFIX = 3
_U = np.uint64
_MAIL_NAME, _MAIL_HOST = re.compile(rb"[A-Za-z0-9._%+-]"), re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NAME_TAIL = re.compile(rb"[A-Za-z0-9._%+-]*+\Z")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Limits:
    """``radius`` words on each side of an entity count as near it; a term near it in fewer than ``support`` different surroundings says nothing."""

    radius: int = 10
    support: int = 3
    disclosure: float = 0.9


def _mails(text: bytes) -> Iterator[tuple[int, int]]:
    """From each @ to both sides; a name begins after the match before, so no text is read twice."""
    begin, at = 0, text.find(b"@")
    while at >= 0:
        name = _NAME_TAIL.search(text[begin:at]) if at - begin <= 64 else None
        first = begin + name.start() if name else at
        if not name:
            while first > begin and _MAIL_NAME.match(text, first - 1):
                first -= 1
        host = _MAIL_HOST.match(text, at + 1) if first < at else None
        if host:
            yield first, host.end()
        begin = host.end() if host else at + 1
        at = text.find(b"@", begin)


def _luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind as its place in ``BASE``, start, end, value) in bytes, kind by kind."""
    out = [(0, a, b, text[a:b].lower()) for a, b in _mails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip(b"0") for p in m[0].split(b".")]
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
            out.append((1, m.start(), m.end(), b".".join(p or b"0" for p in parts)))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:  # 19 digits have 18 gaps at most
            digits = m[0].translate(None, b" -")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end(), digits))
    for m in _PHONE.finditer(text) if b"+" in text else ():
        digits = m[0].translate(None, b"+ ().-")
        if 9 <= len(digits) <= 15:
            out.append((3, m.start(), m.end(), digits))
    return out


def _entity(kind: int, value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8, salt=bytes([kind])).digest(), "little", signed=True)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes of the words, hashes of their classes); A-Z count as a-z. Words are runs of ASCII letters, digits and bytes above 127."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(_U), none.astype(_U)
    inside = _LETTER[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    up, down = textbits._power(len(data))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(np.where(inside, textbits._VALUE[data] * up, _U(0)))))
    lead = np.concatenate((np.flatnonzero((data & 0xC0) != 0x80), np.full(PREFIX, len(data))))
    stop = np.minimum(lead[np.searchsorted(lead, first) + PREFIX], last)
    with np.errstate(over="ignore"):
        word = textbits.mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U))
        kind = textbits.mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(_U) + _U(1 << 40))
    return first, last, word, kind


def _text_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_words`` of a text of any length, piece by piece, cut between words."""
    data, parts, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data) or not parts:
        end = min(at + textbits.BLOCK, len(data))
        while end < len(data) and _LETTER[data[end]]:  # on to the end of the word
            rest = np.flatnonzero(~_LETTER[data[end : end + textbits.BLOCK]])
            end = end + int(rest[0]) if len(rest) else min(end + textbits.BLOCK, len(data))
        first, last, word, kind = _words(data[at:end])
        parts.append((first + at, last + at, word, kind))
        at = end
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _column_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, word hash, class hash) of all words of some rows at a time; short texts are hashed together."""
    data, starts, ends = textbits.text_spans(column)
    k, n = 0, len(starts)
    while k < n:
        stop, size = k, 0
        while stop < n and ends[stop] - starts[stop] <= textbits.BLOCK // 2 and size < textbits.BLOCK:
            size += int(ends[stop] - starts[stop]) + 1
            stop += 1
        if stop == k:
            _, _, word, kind = _text_words(data[starts[k] : ends[k]].tobytes())
            yield np.full(len(word), k), word, kind
            k += 1
            continue
        joined, bounds = np.full(size, 0x20, np.uint8), np.zeros(stop - k, np.int64)
        at = 0
        for j in range(k, stop):
            length = int(ends[j] - starts[j])
            joined[at : at + length] = data[starts[j] : ends[j]]
            bounds[j - k] = at
            at += length + 1
        first, _, word, kind = _words(joined)
        yield k + np.searchsorted(bounds, first, "right") - 1, word, kind
        k = stop


def _row_hashes(row: np.ndarray, hashes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of the hashes that the filter lets through."""
    hit = bitfilter.has_each(bits, hashes)
    if not hit.any():
        return np.zeros(0, np.int64), np.zeros(0, _U)
    values, place = np.unique(hashes[hit], return_inverse=True)
    first = int(row[0])
    width = int(row[-1]) - first + 1  # rows come in order
    both = np.unique(place * width + (row[hit] - first))
    return both % width + first, values[both // width]


_ROWS = "doc_id long, entity long, surrounding long, terms array<struct<term: long, class: long>>"


def entity_surroundings(docs: DataFrame, radius: int) -> DataFrame:
    """(doc_id, entity, surrounding, terms): for each row of (doc_id, text) and entity the distinct words near it, and a digest of the two words on either side of it."""

    def near(text: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        spans = base_spans(text)
        if not spans:
            return
        first, last, word, kind = _text_words(text)
        cover = np.zeros(len(first), bool)
        for _, a, b, _ in spans:
            cover[np.searchsorted(last, a, "right") : np.searchsorted(first, b)] = True
        first, last, word, kind = first[~cover], last[~cover], word[~cover], kind[~cover]
        places: dict[int, list[tuple[int, int]]] = {}
        for k, a, b, value in spans:
            places.setdefault(_entity(k, value), []).append((int(np.searchsorted(last, a, "right")), int(np.searchsorted(first, b))))
        for entity, own in places.items():
            digest, spots = 0, []
            for before, after in own:
                sides = [int(h) for h in (*word[max(0, before - 2) : before], *word[after : after + 2])]
                digest ^= int.from_bytes(hashlib.blake2b(repr((min(2, before), sides)).encode(), digest_size=8).digest(), "little", signed=True)
                spots.append(np.arange(max(0, before - radius), min(len(word), after + radius)))
            word_here, at = np.unique(word[(spot := np.concatenate(spots))], return_index=True)
            yield entity, digest, word_here.view(np.int64), kind[spot][at].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = textbits.text_spans(batch.column(1))
            ids, entities, digests, words, kinds = [], [], [], [], []
            for k, doc_id in enumerate(batch.column(0)):
                for entity, digest, word, kind in near(data[starts[k] : ends[k]].tobytes()):
                    ids.append(doc_id.as_py())
                    entities.append(entity)
                    digests.append(digest)
                    words.append(word)
                    kinds.append(kind)
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (words, kinds)]
            terms = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, words)]).astype(np.int32)), pa.StructArray.from_arrays(flat, names=["term", "class"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(entities, pa.int64()), pa.array(digests, pa.int64()), terms], names=["doc_id", "entity", "surrounding", "terms"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_tasks, run, _ROWS)


def _near_counts(surroundings: DataFrame, support: int) -> DataFrame:
    """(entity, hash, class, near): in how many documents a term (``class`` is its class's hash) or a class (null there) is near the entity; surroundings are added up first."""
    both = F.array_union(F.col("terms"), F.transform(F.array_distinct(F.col("terms.class")), lambda c: F.struct(c.alias("term"), F.lit(None).cast("long").alias("class"))))
    items = surroundings.select("entity", "surrounding", F.explode(both).alias("i")).select("entity", "surrounding", F.col("i.term").alias("hash"), F.col("i.class").alias("class"))
    by_surrounding = items.groupBy("entity", "hash", "surrounding").agg(F.max("class").alias("class"), F.count("*").alias("near"))
    found = by_surrounding.groupBy("entity", "hash").agg(F.max("class").alias("class"), F.sum("near").alias("near"), F.count("*").alias("differ"))
    return found.where(F.col("differ") >= support).drop("differ")


def _document_counts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash, docs): how many rows' texts hold each of the distinct ``hashes``; tasks add up the rows of a batch before they emit."""
    wanted = bitfilter.build(hashes, "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_row_hashes(row, h, wanted.value)[1] for row, *both in _column_words(batch.column(0)) for h in both]
            values, counts = np.unique(np.concatenate(found) if found else np.zeros(0, _U), return_counts=True)  # a row is within one part, so its hash comes once
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["hash", "docs"])

    counted = docs.select("text").transform(in_tasks, run, "hash long, docs long").groupBy("hash").agg(F.sum("docs").alias("docs"))
    return counted.join(hashes, "hash", "left_semi")


def revealing_terms(docs: DataFrame, surroundings: DataFrame, limits: Limits) -> DataFrame:
    """(term, entity, removed): terms that disclose an entity; ``removed`` if their class does, too."""
    near = settle(_near_counts(surroundings, limits.support), "near-entities")
    total, entities = docs.count(), surroundings.groupBy("entity").agg(F.count("*").alias("held"))
    frequent = _document_counts(docs, near.select("hash").distinct())
    known = near.join(frequent, "hash").join(entities, "entity")
    information = F.log2(F.lit(float(total)) / F.col("held"))
    disclosure = F.log2(F.lit(float(total)) * F.col("near") / (F.col("held") * F.col("docs"))) / information
    strong = settle(known.where((F.col("held") < total) & (disclosure >= limits.disclosure)).select("entity", "hash", "class"), "revealing")
    classes = strong.where(F.col("class").isNull()).select("entity", F.col("hash").alias("class"), F.lit(True).alias("removed"))
    terms = strong.where(F.col("class").isNotNull()).select("entity", F.col("hash").alias("term"), "class")
    return settle(terms.join(classes, ["entity", "class"], "left").select("term", "entity", F.coalesce("removed", F.lit(False)).alias("removed")), "revealing-terms")


def _document_terms(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc_id, term) of the rows of (doc_id, text) and the terms of the filter that they hold."""
    wanted = bitfilter.build(hashes, "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, word, _ in _column_words(batch.column(1)):
                at, hashes = _row_hashes(row, word, wanted.value)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int64)), pa.array(hashes.view(np.int64))], names=["doc_id", "term"])

    return docs.transform(in_tasks, run, "doc_id long, term long")


def _spans(text: bytes, terms: dict[int, bool]) -> tuple[list[tuple[int, int, int]], str | None]:
    """(kind, start, end) in code points by start, then kind, and the sanitised text, None if it is the same."""
    spans = [(a, k, b) for k, a, b, _ in base_spans(text)]
    if not spans:
        return [], None
    if terms:
        first, last, word, _ = _text_words(text)
        cover = np.zeros(len(first), bool)
        for a, _, b in spans:
            cover[np.searchsorted(last, a, "right") : np.searchsorted(first, b)] = True
        for k in np.flatnonzero(np.isin(word.view(np.int64), np.fromiter(terms, np.int64)) & ~cover):
            spans.append((int(first[k]), len(BASE) + terms[int(word[k : k + 1].view(np.int64)[0])], int(last[k])))
    spans.sort()
    ends = [p for a, _, b in spans for p in (a, b)]
    lead = np.concatenate(([0], ((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).cumsum()))
    points = lead[ends].tolist()
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out.append(text[done:a])
            out.append(text[a:b].decode("utf-8", "replace")[:PREFIX].encode() + b"*" if k == len(BASE) else b"[%s]" % KINDS[k].encode())
        done = max(done, b)
    out.append(text[done:])
    return [(k, points[2 * j], points[2 * j + 1]) for j, (_, k, _) in enumerate(spans)], b"".join(out).decode("utf-8", "replace")


def find_private(docs: DataFrame, *, limits: Limits = Limits(), keep: tuple[Column | str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("spans", "sanitised")) -> DataFrame:
    """The ``keep`` columns with ``spans``, an array of (kind, start, end) by start, then kind, and ``sanitised``, the text with them replaced, null if nothing is.

    Spans are in code points, the end exclusive. Base spans: leftmost matches of each kind that don't overlap others of
    their kind; matches that fail their check are dropped. The method adds ``generalised`` and ``removed`` words outside
    base spans, only in documents with an entity. In the text base spans become their kind in brackets (of overlapping
    ones the first), generalised words their first three letters and a star, removed ones ``[removed]``.

    Null and empty texts have no spans. Rows without an id count in the statistics but only get base spans; rows that share
    an id share their terms. Equal texts count as often as they stand, but as one surrounding. Terms of equal disclosure
    are treated alike. A text is searched whole, in memory that grows with it. An empty table gives no rows. Names
    that clash are the caller's to give (``names``); no other column of ``docs`` is read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    surroundings = settle(entity_surroundings(rows, limits.radius), "surroundings")
    revealing = revealing_terms(rows, surroundings, limits)
    held = surroundings.select("doc_id", "entity").where(F.col("doc_id").isNotNull())
    _, loud = bitfilter.split(rows, "doc_id", held, "doc_id")
    own = _document_terms(loud, revealing.select("term").distinct()).join(revealing, "term").join(held, ["doc_id", "entity"], "left_semi")
    terms = settle(own.groupBy("doc_id").agg(F.collect_set(F.struct("term", "removed")).alias("terms")), "document-terms")  # bounded by the document's words

    kept = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    quiet, some = bitfilter.split(kept, "doc_id", terms.select("doc_id"), "doc_id")
    none = F.array().cast(terms.schema["terms"].dataType)
    given = quiet.select("kept", "text", none.alias("terms")).unionAll(some.join(terms, "doc_id", "left").select("kept", "text", F.coalesce("terms", none)))
    span = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
    schema = StructType([given.schema["kept"], StructField("spans", span), StructField("sanitised", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = textbits.text_spans(batch.column(1))
            flat, counts, texts = [], [0], []
            for k, own in enumerate(batch.column(2)):
                chosen: dict[int, bool] = {}
                for t in own.as_py() if len(own.values) else ():
                    chosen[t["term"]] = chosen.get(t["term"], False) or t["removed"]
                spans, text = _spans(data[starts[k] : ends[k]].tobytes(), chosen)
                flat += spans
                counts.append(len(flat))
                texts.append(text)
            kinds, a, b = zip(*flat, strict=True) if flat else ((), (), ())
            structs = pa.StructArray.from_arrays([pa.array([KINDS[k] for k in kinds], pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), structs), pa.array(texts, pa.string())], names=["kept", "spans", "sanitised"])

    made = given.transform(in_tasks, run, schema)
    return made.select("kept.*", *[F.col(c).alias(n) for c, n in zip(("spans", "sanitised"), names, strict=True)])


def sanitise(docs: DataFrame, *, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns in their order, ``text`` sanitised as in ``find_private``; null texts stay null."""
    spans, text = bitfilter.unused(docs.columns, "spans", "sanitised")
    found = find_private(docs, limits=limits, keep=tuple(F.col(f"`{c}`") for c in docs.columns), id_col=id_col, text_col=text_col, names=(spans, text))
    return found.select(*[F.coalesce(text, F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def span_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_generalised, n_removed) of ``find_private``'s rows."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts[: len(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *counts[len(BASE) :])
