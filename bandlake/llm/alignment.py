"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are shuffled whole, so that copies become one row with their number before anything is tokenised. Byte offsets at
which tokens of both kinds end cut a text's tokens into groups; within a group every token of one kind is linked with
every one of the other. Pairs of ids are counted in documents by adding up those numbers, and what is measured of a
text is joined back to the documents by its digest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import in_tasks, settle

#: Fixed value: how the byte-level vocabulary's texts are parted before pairs of tokens are merged.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: An id pair is one number: ids are below 2**24.
SHIFT = 24
#: Links that are spread out at once, tokens handed on at once, and pairs that a task holds before it gives its sums away.
LINKS, TOKENS, HELD = 1 << 17, 1 << 16, 1 << 18
#: Rows of a part, and how many spelled ids are added to a task's table at once (as a power of two, times four).
ROWS, SPELLED = 1 << 14, 16
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_ALIGNED = "text_key binary, n_docs long, n_a long, n_b long, a_ids binary, b_ids binary, a_cuts binary, b_cuts binary"


@dataclass(frozen=True)
class Tokenizers:
    """Contents of the two vocabulary files (2 MB together); they are read on the driver and go to the tasks by broadcast."""

    a: bytes
    b: bytes


def load(folder: str = "/opt/tokenizers", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Tokenizers:
    """``a`` is a byte-level BPE with its merges in the order of its ids, ``b`` a sentence piece model."""
    return Tokenizers((Path(folder) / a).read_bytes(), (Path(folder) / b).read_bytes())


class Engines:
    """Both tokenizers of a task, with each id's bytes."""

    def __init__(self, files: Tokenizers) -> None:
        import sentencepiece
        import tiktoken

        model = json.loads(files.a)
        special = {t["content"] for t in model["added_tokens"]}
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes are their own letters, the others get 256, 257, ...
        letters = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(seen))}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        at = [model["model"]["vocab"][m] for m in merged]
        if at != sorted(at):
            raise ValueError("the merges must stand in the order of their ids")
        self.a = tiktoken.Encoding("a", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        self.a_bytes = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))

    def align(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(A ids, B ids, which A tokens end a group, which B tokens do) of each text; nothing if one doesn't spell space + text."""
        a_ids, b_ids = [], []
        for text in texts:
            b = self.b.encode(text, num_threads=1) if text else []
            spelled = bool(b) and b"".join(map(self.b_bytes.__getitem__, b)) == f" {text}".encode()
            a_ids.append(self.a.encode_ordinary(f" {text}") if spelled else [])  # byte-level tokens spell any text
            b_ids.append(b if spelled else [])
        a, b = (np.fromiter((i for own in ids for i in own), np.int64) for ids in (a_ids, b_ids))
        a_ends, b_ends = self.a_lengths[a].cumsum(), self.b_lengths[b].cumsum()  # both kinds have as many bytes a text, so offsets agree across texts
        found = [np.zeros(1 + int(a_ends[-1]) if len(a) else 1, bool) for _ in range(2)]
        found[0][a_ends] = found[1][b_ends] = True
        a_cuts, b_cuts = found[1][a_ends], found[0][b_ends]
        cut = lambda flat, ids: np.split(flat, np.cumsum([len(x) for x in ids])[:-1]) if ids else []
        return list(zip(cut(a, a_ids), cut(b, b_ids), cut(a_cuts, a_ids), cut(b_cuts, b_ids), strict=True))


@lru_cache(maxsize=2)
def engines(files: Tokenizers) -> Engines:
    return Engines(files)


def align(docs: DataFrame, *, tokenizers: Tokenizers | None = None, text_col: str = "text") -> DataFrame:
    """(text_key, n_docs, n_a, n_b, a_ids, b_ids, a_cuts, b_cuts) of each distinct text that is neither null nor empty.

    ``text_key`` is the text's sha-256, ``n_docs`` how many rows hold it. Ids are packed as little-endian numbers of two
    bytes (four for a vocabulary of more than 65,536), cuts as a bit for each token that ends a group; ``unpacked`` gives
    arrays. Texts that one of the tokenizers doesn't spell as space + text have no tokens. A text is tokenised whole, in
    memory that grows with it; equal texts are added up before the shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizers or load())
    texts = docs.select(F.col(text_col).alias("text")).where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("n_docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = engines(shared.value)
        widths = ["<u2" if len(t) <= 1 << 16 else "<u4" for t in (own.a_bytes, own.b_bytes)]
        for batch in batches:
            column, at = batch.column(0), 0
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]).astype(np.int64)
            while at < len(column):
                stop = max(at + 1, at + int(np.searchsorted(sizes[at:].cumsum(), 2 * TOKENS, "right")))
                texts = column.slice(at, stop - at)
                found = own.align(texts.to_pylist())
                columns = [
                    pa.array([hashlib.sha256(t.as_buffer()).digest() for t in texts], pa.binary()), batch.column(1).slice(at, stop - at),
                    *[pa.array([len(f[k]) for f in found], pa.int64()) for k in (0, 1)], *[pa.array([f[k].astype(widths[k]).tobytes() for f in found], pa.binary()) for k in (0, 1)],
                    *[pa.array([np.packbits(f[k]).tobytes() for f in found], pa.binary()) for k in (2, 3)],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["text_key", "n_docs", "n_a", "n_b", "a_ids", "b_ids", "a_cuts", "b_cuts"])
                at = stop

    return texts.transform(in_tasks, run, _ALIGNED)


def unpacked(aligned: DataFrame) -> DataFrame:
    """(text_key, n_docs, a_ids, b_ids, a_sizes, b_sizes) of aligned texts, as arrays; the sizes say how many tokens of each kind a group has."""

    def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], lengths.cumsum())).astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                columns = [part.keys, pa.array(part.weights), lists(part.a, part.n_a), lists(part.b, part.n_b), lists(part.a_sizes, part.n_groups), lists(part.b_sizes, part.n_groups)]
                yield pa.RecordBatch.from_arrays(columns, names=["text_key", "n_docs", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    return aligned.transform(in_tasks, run, "text_key binary, n_docs long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column's rows, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)


def _ids(column: pa.Array, total: int) -> np.ndarray:
    data = _bytes(column)
    return data.view("<u2" if len(data) == 2 * total else "<u4").astype(np.int64)


def _bits(column: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """The first ``lengths`` bits of each row, each of which is filled up to whole bytes."""
    held = (lengths + 7) // 8
    begin = np.repeat(8 * (held.cumsum() - held), lengths)
    return np.unpackbits(_bytes(column))[begin + np.arange(len(begin)) - np.repeat(lengths.cumsum() - lengths, lengths)].astype(bool)


class _Part:
    """Some rows of aligned texts, flat: tokens, group sizes, and the row of each group."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        self.rows, self.keys, self.weights = batch.num_rows, column["text_key"], column["n_docs"].to_numpy()
        self.n_a, self.n_b = column["n_a"].to_numpy(), column["n_b"].to_numpy()
        self.a, self.b = (_ids(column[c], int(n.sum())) for c, n in (("a_ids", self.n_a), ("b_ids", self.n_b)))
        ends = np.flatnonzero(_bits(column["a_cuts"], self.n_a))
        self.a_sizes = np.diff(ends, prepend=-1)
        self.b_sizes = np.diff(np.flatnonzero(_bits(column["b_cuts"], self.n_b)), prepend=-1)
        self.owner = np.repeat(np.arange(self.rows), self.n_a)[ends]
        self.n_groups = np.bincount(self.owner, minlength=self.rows).astype(np.int64)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, pair, times) of the links; a pair may come several times. Groups too large to be spread out go by their distinct ids, some at a time."""
        na, nb = self.a_sizes, self.b_sizes
        a_from, b_from, sizes = na.cumsum() - na, nb.cumsum() - nb, na * nb
        for g in np.flatnonzero(sizes > LINKS):
            ids, a_times = np.unique(self.a[a_from[g] : a_from[g] + na[g]], return_counts=True)
            others, b_times = np.unique(self.b[b_from[g] : b_from[g] + nb[g]], return_counts=True)
            step = max(1, LINKS // len(others))
            for at in range(0, len(ids), step):
                pairs = ((ids[at : at + step, None] << SHIFT) | others).ravel()
                yield np.full(len(pairs), self.owner[g]), pairs, (a_times[at : at + step, None] * b_times).ravel()
        plain = np.flatnonzero(sizes <= LINKS)
        ends = sizes[plain].cumsum()
        at = 0
        while at < len(plain):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINKS, "right")))
            some = plain[at:stop]
            group = np.repeat(some, sizes[some])
            within = np.arange(len(group)) - np.repeat(sizes[some].cumsum() - sizes[some], sizes[some])
            pairs = (self.a[a_from[group] + within // nb[group]] << SHIFT) | self.b[b_from[group] + within % nb[group]]
            yield self.owner[group], pairs, np.ones(len(pairs), np.int64)
            at = stop

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, times), each pair of a row once."""
        found = [_added(*x) for x in self.links()]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return found[0] if len(found) == 1 else _added(*map(np.concatenate, zip(*found, strict=True)))

    def digests(self) -> list[str]:
        """sha-256 of each row's groups: A ids, bar, B ids; groups parted by semicolons, ids by commas."""
        na, nb = self.a_sizes, self.b_sizes
        a_ends, b_ends = na.cumsum(), nb.cumsum()
        a_spot = np.arange(len(self.a)) + np.repeat(b_ends - nb, na)  # after the B tokens of earlier groups
        b_spot = np.arange(len(self.b)) + np.repeat(a_ends, nb)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[a_spot], codes[b_spot] = self.a << 2, self.b << 2
        codes[a_spot[a_ends - 1]] |= 1
        codes[b_spot[b_ends - 1]] |= 2
        out, at, spelled = [], 0, _spelled(1 + int(codes.max(initial=0) >> SPELLED))
        for size in (self.n_a + self.n_b).tolist():
            text = b"".join(map(spelled.__getitem__, codes[at : at + size].tolist()))
            out.append(hashlib.sha256(text[:-1]).hexdigest() if size else "")
            at += size
        return out


@lru_cache(maxsize=8)
def _spelled(blocks: int) -> list[bytes]:
    """Each id with a comma, a bar, a semicolon or nothing behind it."""
    return [b"%d%s" % (code >> 2, (b",", b"|", b";", b"")[code & 3]) for code in range(blocks << SPELLED)]


def _added(row: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows are below 2**15 and pairs below 2**48, so both are one number to sort by."""
    key = (row << 2 * SHIFT) | pair
    order = np.argsort(key)
    key, times = key[order], times[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key = key[first]
    return key >> 2 * SHIFT, key & ((1 << 2 * SHIFT) - 1), np.add.reduceat(times, first) if len(first) else times


def _parts(batch: pa.RecordBatch) -> Iterator[_Part]:
    """Cuts a batch so that rows and tokens of a part are bounded, but for a single text's tokens."""
    sizes, at = batch.column(batch.schema.get_field_index("n_a")).to_numpy(), 0
    while at < batch.num_rows:
        stop = max(at + 1, at + int(np.searchsorted(sizes[at : at + ROWS].cumsum(), TOKENS, "right")))
        yield _Part(batch.slice(at, stop - at))
        at = stop


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count): how many documents hold a pair of ids linked, as a_id * 2**24 + b_id. Tasks add up before they emit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, counts = map(np.concatenate, held)
            return _added(np.zeros(len(pairs), np.int64), pairs, counts)[1:]

        for batch in batches:
            for part in _parts(batch):
                row, pair, _ = part.distinct()
                held[0].append(pair)
                held[1].append(part.weights[row])
                if sum(map(len, held[0])) > 2 * HELD:
                    pairs, counts = merged()
                    if len(pairs) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "count"])
                        pairs = counts = np.zeros(0, np.int64)
                    held = [pairs], [counts]
        pairs, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "count"])

    return aligned.transform(in_tasks, run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def pair_table(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): ``best`` says that no pair of the same A id has a higher count."""
    counts = settle(pair_counts(aligned), "pair-counts")
    most = counts.groupBy(F.shiftright("pair", SHIFT).alias("a_id")).agg(F.max("count").alias("most"))  # a row an A id: its vocabulary bounds it
    joined = counts.join(F.broadcast(most), F.shiftright("pair", SHIFT) == F.col("a_id"))
    return settle(joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def _frequent(pairs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(the most frequent pairs, ``limit`` at most; the others, if there are any)."""
    total = pairs.count()
    if total <= limit:
        return pairs, None
    level = F.floor(F.log2("count") * 8).cast("int")
    kept, least = 0, None
    for r in sorted(pairs.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # at most 512 levels
        kept += r["count"]
        if kept > limit:
            break
        least = r.level
    chosen = level >= least if least is not None else F.lit(False)
    return pairs.where(chosen), pairs.where(~chosen)


def text_measures(aligned: DataFrame, pairs: DataFrame, *, limit: int = 1 << 20) -> DataFrame:
    """(text_key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each aligned text.

    Counts of the most frequent pairs, ``limit`` at most, go to every worker (17 bytes each); links of other pairs are
    added up by text, shuffled to their pairs and added to their texts again.
    """
    common, rare = _frequent(pairs, limit)
    known = common.toPandas().sort_values("pair")  # at most ``limit`` rows
    shared = aligned.sparkSession.sparkContext.broadcast((known["pair"].to_numpy(np.int64), known["count"].to_numpy(np.int64), known["best"].to_numpy(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared.value
        for batch in batches:
            for part in _parts(batch):
                row, pair, times = part.distinct()
                at = np.minimum(np.searchsorted(codes, pair), max(0, len(codes) - 1))
                hit = codes[at] == pair if len(codes) else np.zeros(len(pair), bool)
                n = part.rows

                def added(where: np.ndarray, values: np.ndarray, n: int = n) -> np.ndarray:
                    out = np.zeros(n, np.int64)
                    np.add.at(out, where, values)
                    return out

                row_hit, at_hit, times_hit = row[hit], at[hit], times[hit]
                left = pa.StructArray.from_arrays([pa.array(pair[~hit]), pa.array(times[~hit])], names=["pair", "times"])
                ends = np.concatenate(([0], np.bincount(row[~hit], minlength=n).cumsum())).astype(np.int32)
                columns = [
                    part.keys, pa.array(part.n_a), pa.array(part.n_b), pa.array(part.n_groups), pa.array(added(part.owner, part.a_sizes * part.b_sizes)),
                    pa.array(added(row_hit, np.where(best[at_hit], times_hit, 0))), pa.array(added(row_hit, times_hit * counts[at_hit])), pa.array(part.digests(), pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends), left),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["text_key", *MEASURES, "left"])

    schema = "text_key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, left array<struct<pair: long, times: long>>"
    made = aligned.transform(in_tasks, run, schema)
    if rare is None:
        return made.drop("left")
    made = settle(made, "measures")
    links = made.select("text_key", F.explode("left").alias("l")).select("text_key", "l.pair", "l.times").join(rare, "pair")
    more = links.groupBy("text_key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum"))
    plus = lambda name, more: (F.col(name) + F.coalesce(F.col(more), F.lit(0))).alias(name)
    return made.join(more, "text_key", "left").select("text_key", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")


def alignment_measures(docs: DataFrame, *, tokenizers: Tokenizers | None = None, limit: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``docs``.

    Null, empty and unspellable texts have zeros and an empty digest. Repeated rows count each time and get the same
    measures, null ids are kept, ties for an A id's best pair all count as best; an empty table gives no rows. Columns
    other than the two are not read, so their names can't clash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    aligned = settle(align(rows, tokenizers=tokenizers), "aligned")
    measured = text_measures(aligned, pair_table(aligned), limit=limit)
    some = rows.where(F.length("text") > 0).select("doc_id", F.unhex(F.sha2("text", 256)).alias("text_key"))
    none = rows.where(F.coalesce(F.length("text"), F.lit(0)) == 0)
    zeros = none.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in MEASURES[:-1]], F.lit("").alias(MEASURES[-1]))
    return some.join(measured, "text_key").select("doc_id", *MEASURES).unionByName(zeros)
