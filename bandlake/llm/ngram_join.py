"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its word n-grams ("tokens", hashed). Equal sets form one class. Tokens are ordered by frequency
class and hash, counted over all documents: first those of one set only, which a filter of fixed size tells from
most others, then rare ones, then the frequent ones (at most ``frequent_limit``) of a broadcast table. A set of ``n`` tokens can lack at most ``miss = n - ceil(threshold * n)`` tokens
of a partner, so each set indexes a prefix of the order that keeps a key whatever ``miss`` tokens are taken
away: rare tokens one by one, frequent tokens in pairs within groups. ``g`` groups need a prefix longer by ``g``; their number follows
the power of two below the set's size, and sets near the next power index for that one too, so any two partners
have a grouping in common.

Sets that share a key are candidates. A key's sets are not compared pair by pair: a few hubs are verified against
those of other components, components are joined, and only what is still apart goes on to the next round
with more hubs, until every two sets of a key are linked through others or were compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import in_tasks, settle
from . import bitfilter, textbits
from .hubs import link_by_hubs

_U = np.uint64
#: Shingles that a task sorts at once.
FLUSH = 1 << 20
#: Cells of the filter of repeated tokens, as a power of two: 16 MB on the driver and in each worker, whatever the input. Where it fills up,
#: tokens of one set only are indexed like other rare ones.
REPEATED_BITS = 27
#: Parity bits of a set: they tell sets of up to some thousand shingles apart, larger ones are always compared.
PARITY = 1024
#: Bytes kept of each hash for verification.
KEEP = 6


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[object, np.ndarray]]:
    for batch in batches:
        for key, words in zip(batch.column(0).to_pylist(), textbits.texts_word_hashes(batch.column(1)), strict=True):
            yield key, textbits.shingle_set(words, size)


def _rows(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_CLASS_ROWS = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("n", pa.int32())])


def _classify(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    ids, sigs, ns = [], [], []
    for key, shingles in _sets(batches, size):
        ids.append(key)
        sigs.append(textbits.signature(shingles) if len(shingles) else None)
        ns.append(len(shingles))
        if len(ids) >= 10_000:
            yield _rows(_CLASS_ROWS, [ids, sigs, ns])
            ids, sigs, ns = [], [], []
    yield _rows(_CLASS_ROWS, [ids, sigs, ns])


def _distinct(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[object, int, np.ndarray]]:
    """The non-empty sets of a task, each once as far as 100,000 signatures remember."""
    seen: set[int] = set()
    for key, shingles in _sets(batches, size):
        if len(shingles):
            sig = textbits.signature(shingles)
            if sig not in seen:
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(sig)
                yield key, sig, shingles


_CHUNKS = pa.schema([("chunk", pa.int32()), ("tokens", pa.binary())])


def _pack(tokens: np.ndarray) -> bytes:
    steps = np.diff(tokens, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _token_chunks(batches: Iterator[pa.RecordBatch], size: int, chunk_bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted 32-bit token prefixes, cut by their leading bits."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.sort(np.concatenate(held))
        chunks = (tokens >> np.uint32(32 - chunk_bits)).astype(np.int64)
        at = np.concatenate((np.flatnonzero(np.diff(chunks, prepend=-1)), [len(tokens)]))
        parts = [(int(chunks[i]), _pack(tokens[i:j] & np.uint32((1 << (32 - chunk_bits)) - 1))) for i, j in zip(at[:-1], at[1:], strict=True)]
        return _rows(_CHUNKS, [[c for c, _ in parts], [t for _, t in parts]])

    held, count = [], 0
    for _, _, shingles in _distinct(batches, size):
        held.append((shingles >> _U(32)).astype(np.uint32))
        count += len(shingles)
        if count >= FLUSH:
            yield out(held)
            held, count = [], 0
    if held:
        yield out(held)


def _count_chunk(key: tuple, group: pa.Table, chunk_bits: int, least: int) -> pa.Table:
    """Tokens of a chunk with their document frequency, and one row (no token) with the chunk's cells of repeated tokens."""
    tokens, counts = np.unique(np.concatenate([_unpack(x) for x in group.column("tokens").to_pylist()]), return_counts=True)
    chunk = int(key[0].as_py())
    cells = np.zeros(1 << (REPEATED_BITS - chunk_bits), np.uint8)
    cells[tokens[counts > 1] >> np.uint32(32 - REPEATED_BITS)] = 1
    keep = counts >= least
    whole = (chunk << (32 - chunk_bits)) + tokens[keep].astype(np.int64)
    n = len(whole)
    return pa.table({
        "chunk": pa.array([chunk] * (n + 1), pa.int32()), "token": pa.array([*whole.tolist(), None], pa.int64()),
        "df": pa.array([*counts[keep].tolist(), None], pa.int64()), "cells": pa.array([None] * n + [zlib.compress(np.packbits(cells).tobytes(), 1)], pa.binary()),
    })


@dataclass(frozen=True)
class TokenOrder:
    """What the global order of tokens rests on: sorted frequent 32-bit tokens, their classes, and cells of repeated tokens."""

    tokens: np.ndarray
    levels: np.ndarray
    repeated: np.ndarray

    def classes(self, shingles: np.ndarray) -> np.ndarray:
        """-1 for tokens that surely stand in one set only, 0 for other rare ones, else the frequency class."""
        short = (shingles >> _U(32)).astype(np.uint32)
        cell = short >> np.uint32(32 - REPEATED_BITS)
        out = ((self.repeated[cell >> np.uint32(3)] >> (np.uint32(7) - (cell & np.uint32(7))).astype(np.uint8)) & 1).astype(np.int8) - 1
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, short), len(self.tokens) - 1)
            out = np.where(self.tokens[at] == short, self.levels[at], out)
        return out


def token_order(docs: DataFrame, size: int, limit: int, least: int) -> TokenOrder:
    """Counts every token of every document. At most ``limit`` tokens are frequent: whole classes (powers of two) from the top."""
    parts = docs.rdd.getNumPartitions()
    chunk_bits = min(20, max(8, (8 * parts - 1).bit_length()))
    chunks = docs.transform(in_tasks, partial(_token_chunks, size=size, chunk_bits=chunk_bits), "chunk int, tokens binary")

    def count(key: tuple, group: pa.Table) -> pa.Table:
        return _count_chunk(key, group, chunk_bits, least)

    counted = chunks.groupBy("chunk").applyInArrow(count, "chunk int, token long, df long, cells binary")
    counted = settle(counted.withColumn("level", F.floor(F.log2("df")).cast("int")), "token-df")
    room, floor = limit, 64
    for level, n in sorted(((r[0], r[1]) for r in counted.where("token IS NOT NULL").groupBy("level").count().collect()), reverse=True):
        if n > room:
            break
        room, floor = room - n, level
    found = counted.where(F.col("level") >= floor).select("token", "level").toPandas().sort_values("token")  # at most `limit` rows
    repeated = np.zeros(1 << (REPEATED_BITS - 3), np.uint8)  # the filter's size, whatever the input
    width = 1 << (REPEATED_BITS - 3 - chunk_bits)
    for row in counted.where("token IS NULL").select("chunk", "cells").toLocalIterator():
        repeated[row[0] * width : (row[0] + 1) * width] = np.frombuffer(zlib.decompress(row[1]), np.uint8)
    return TokenOrder(found.token.to_numpy(np.uint32), found.level.to_numpy(np.int8), repeated)


def prefix_keys(shingles: np.ndarray, order: TokenOrder, percent: int) -> np.ndarray:
    """Index keys of one set (sorted distinct hashes). Tokens of one set only fill the prefix but are no keys."""
    n = len(shingles)
    miss = n + (-percent * n) // 100
    level = order.classes(shingles)
    alone = int((level < 0).sum())
    if alone > miss:
        return shingles[:0]
    rare = shingles[level == 0]
    if alone + len(rare) > miss:
        return rare[: miss + 1 - alone]
    need = miss + 1 - alone - len(rare)
    often = shingles[level > 0]
    often = often[np.argsort(level[level > 0], kind="stable")]
    band = n.bit_length() - 1
    keys = [rare]
    for b in (band, band + 1) if 100 * n >= percent << (band + 1) else (band,):
        groups = (1 << b) >> 4
        if not groups:
            keys.append(often[:need])
            continue
        group = (textbits.mix(often) % _U(groups)).astype(np.int64)
        by_group = np.argsort(group, kind="stable")
        first = np.zeros(len(often), bool)
        first[by_group] = np.diff(group[by_group], prepend=-1) != 0
        enough = np.searchsorted(np.cumsum(~first), need) + 1
        group, taken = group[:enough], often[:enough]
        by_group = np.argsort(group, kind="stable")
        group, taken = group[by_group], taken[by_group]
        for apart in range(1, len(taken)):
            same = group[apart:] == group[:-apart]
            if not same.any():
                break
            x, y = taken[apart:][same], taken[:-apart][same]
            keys.append(textbits.mix(np.minimum(x, y) * _U(0xA0761D6478BD642F) + np.maximum(x, y)))
    return np.unique(np.concatenate(keys))


_KEYS = pa.schema([("key", pa.int64()), ("sig", pa.int64()), ("n", pa.int32())])


def _index(batches: Iterator[pa.RecordBatch], size: int, percent: int, order) -> Iterator[pa.RecordBatch]:
    """The keys of each set."""
    known, held, count = order.value, [], 0

    def out() -> pa.RecordBatch:
        keys = np.concatenate([k for k, _, _ in held]).view(np.int64)
        sizes = [len(k) for k, _, _ in held]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(np.array([s for _, s, _ in held], np.int64), sizes)), pa.array(np.repeat(np.array([n for _, _, n in held], np.int32), sizes))], schema=_KEYS)

    for _, sig, shingles in _distinct(batches, size):
        keys = prefix_keys(shingles, known, percent)
        if len(keys):
            held.append((keys, sig, len(shingles)))
            count += len(keys)
            if count >= 200_000:
                yield out()
                held, count = [], 0
    if held:
        yield out()


_SET_ROWS = pa.schema([("sig", pa.int64()), ("bits", pa.list_(pa.int64())), ("shingles", pa.binary())])


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """``PARITY`` bits of a set, bit i the parity of its members that hash to i: a member of one of two sets only flips one bit."""
    return np.packbits(np.bincount((shingles & _U(PARITY - 1)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).view(np.int64)


def _chosen(batches: Iterator[pa.RecordBatch], size: int, wanted) -> Iterator[pa.RecordBatch]:
    """Sets of the documents that stand for a class, told by a bit filter over class and document."""
    bits, held, weight = wanted.value, [], 0

    def out() -> pa.RecordBatch:
        return _rows(_SET_ROWS, [[s for s, _, _ in held], [b for _, b, _ in held], [x for _, _, x in held]])

    for key, shingles in _sets(batches, size):
        if len(shingles) and bitfilter.has(bits, (sig := textbits.signature(shingles)) ^ ((key or 0) << 40)):
            packed = (shingles >> _U(64 - 8 * KEEP)).view(np.uint8).reshape(-1, 8)[:, :KEEP].tobytes()
            held.append((sig, parity_bits(shingles), packed))
            weight += len(packed)
            if weight >= 1 << 22:
                yield out()
                held, weight = [], 0
    yield out()


def _members_of(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // KEEP, 8), np.uint8)
    wide[:, :KEEP] = np.frombuffer(packed, np.uint8).reshape(-1, KEEP)
    return wide.view(_U).ravel()


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, set of a, set of b), those with 100 * intersection >= percent * union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            one, two = _members_of(x.as_py()), _members_of(y.as_py())
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(100 * both >= percent * (len(one) + len(two) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=_LINKS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b); of the sets only those that a bit filter can't rule out are shuffled."""

    def side(name: str) -> DataFrame:
        needed = bitfilter.split(sets.select("sig", "shingles"), "sig", pairs, name)[1].dropDuplicates(["sig"])
        return needed.select(F.col("sig").alias(name), F.col("shingles").alias(f"s{name}"))

    full = pairs.join(side("a"), "a").join(side("b"), "b")
    return settle(full.select("a", "b", "sa", "sb").transform(in_tasks, partial(_verify, percent=percent), "a long, b long"), "ngram-links")


def _set_bits(sets: DataFrame, rows: DataFrame) -> DataFrame:
    return bitfilter.split(sets.select("sig", "bits"), "sig", rows, "sig")[1].dropDuplicates(["sig"])


def _fits(own: str, hub: str, percent: int) -> Column:
    return 100 * F.least(f"{own}.n", f"{hub}.n") >= percent * F.greatest(f"{own}.n", f"{hub}.n")


def _room(own: str, hub: str, percent: int) -> Column:
    apart = sum((F.bit_count(F.get(f"{own}.bits", F.lit(i)).bitwiseXOR(F.get(f"{hub}.bits", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    size = F.col(f"{own}.n") + F.col(f"{hub}.n")
    return 100 * (size - apart) >= percent * (size + apart)


def link_sets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Labels (node, component) of the sets in ``members`` (key, sig, n); ``sets`` has (sig, bits, shingles)."""

    fits, room = partial(_fits, percent=percent), partial(_room, percent=percent)
    return link_by_hubs(members, partial(_verified, sets=sets, percent=percent), fits=fits, room=room, more=partial(_set_bits, sets), label="ngram")


def _indexed(docs: DataFrame, size: int, percent: int, frequent_limit: int, least: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their class (doc_id, sig, n), classes by shared keys (key, sig, n) and the sets of those (sig, bits, shingles)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = settle(rows.transform(in_tasks, partial(_classify, size=size), "doc_id long, sig long, n int"), "ngram-classes")
    order = spark.sparkContext.broadcast(token_order(rows, size, frequent_limit, least))
    index = settle(rows.transform(in_tasks, partial(_index, size=size, percent=percent, order=order), "key long, sig long, n int"), "ngram-index")
    shared = index.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("key")
    members = settle(index.join(shared, "key").distinct(), "ngram-members")
    stands = known.where("n > 0").groupBy("sig").agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("doc_id")).join(members.select("sig").distinct(), "sig")
    wanted = bitfilter.build(stands.select(F.col("sig").bitwiseXOR(F.shiftleft("doc_id", 40)).alias("at")), "at")
    sets = settle(rows.transform(in_tasks, partial(_chosen, size=size, wanted=wanted), "sig long, bits array<long>, shingles binary"), "ngram-sets")
    return known, members, sets


def ngram_links(docs: DataFrame, *, size: int = 5, percent: int = 80, frequent_limit: int = 1 << 18, least: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, membership): every pair of different sets that link, as (a, b: class), and each document's class (doc_id, class).

    Unlike ``ngram_components``, pairs inside a component are verified, too. A class is a set's signature; it is null, without links, for a
    document without words. The rows grow with the links, which in a group of different near texts are as many as its pairs.
    """
    known, members, sets = _indexed(docs, size, percent, frequent_limit, least, id_col, text_col)
    met = (F.col("m.key") == F.col("h.key")) & (F.col("m.sig") < F.col("h.sig")) & _fits("m", "h", percent)
    pairs = members.alias("m").join(members.alias("h"), met).select(F.col("m.sig").alias("a"), F.col("h.sig").alias("b"), F.col("m.n").alias("na"), F.col("h.n").alias("nb")).distinct()
    bits = settle(_set_bits(sets, members), "ngram-bits")
    wide = pairs.join(bits.select(F.col("sig").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("sig").alias("b"), F.col("bits").alias("y")), "b")
    wide = wide.select(F.struct(F.col("a").alias("sig"), F.col("na").alias("n"), F.col("x").alias("bits")).alias("m"), F.struct(F.col("b").alias("sig"), F.col("nb").alias("n"), F.col("y").alias("bits")).alias("h"))
    near = settle(wide.where(_room("m", "h", percent)).select(F.col("m.sig").alias("a"), F.col("h.sig").alias("b")), "ngram-pairs")
    return _verified(near, sets, percent), known.select("doc_id", F.col("sig").alias("class"))


def ngram_components(docs: DataFrame, *, size: int = 5, percent: int = 80, frequent_limit: int = 1 << 18, least: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable over links, itself included).

    Two documents link when 100 * intersection >= percent * union of their sets of ``size``-word shingles; shorter
    texts count as one shingle. Empty and null texts have no shingles and link with nothing. Repeated rows and
    exact copies share a class and are never expanded into pairs. A null id stays null and gets its component's least id.
    Further columns are ignored; an empty table gives no rows. Sets are told apart by 64-bit signatures and
    compared by 48-bit hashes of their shingles.
    """
    known, members, sets = _indexed(docs, size, percent, frequent_limit, least, id_col, text_col)
    labels = link_sets(members, sets, percent)
    placed = known.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    heads = settle(placed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("head")), "ngram-heads")  # as a table of its own, so that the join can split a large component
    return placed.join(heads, "component", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("head", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one document (of least id) of each group of linked ones.

    Documents without words and rows with a null id stay; rows that repeat an id and a text count once.
    """
    named = ngram_components(docs, size=size, percent=percent, id_col=id_col, text_col=text_col)
    named = settle(named.where("doc_id IS NOT NULL"), "ngram-named")
    heads = named.where("doc_id = component_id OR n_shingles = 0").select("doc_id").distinct()
    gone = named.join(heads, "doc_id", "left_anti").select("doc_id")
    repeated = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = bitfilter.without_ids(docs, id_col, gone, "doc_id")
    once, again = bitfilter.split(kept, id_col, repeated, "doc_id")
    return once.unionAll(again.dropDuplicates([id_col, text_col]))
