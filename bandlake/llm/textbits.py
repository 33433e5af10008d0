"""Byte-level helpers for tasks: Arrow text columns to word and shingle hashes without a Python object per word.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's hash is a polynomial over random
byte values modulo 2**64, taken from prefix sums, and mixed at the end; it is the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is cut between words.
BLOCK = 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=_U) * _BASE)
    upper = np.arange(ord("A"), ord("Z") + 1)
    values[upper] = values[upper + 32]
    return values


_VALUE = _byte_values()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def text_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string column; null texts are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    starts, ends = offsets[:-1].copy(), offsets[1:].copy()
    if column.null_count:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        ends[gone] = starts[gone]
    return data, starts, ends


def _hash_block(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, _U)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    up, down = _power(len(data))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(np.where(gap, _U(0), _VALUE[data] * up))))
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, in order."""
    if len(data) <= BLOCK:
        return _hash_block(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data):  # go on to the end of the word
            gaps = np.flatnonzero(_SPACE[data[end : end + BLOCK]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + BLOCK, len(data))
        parts.append(_hash_block(data[at:end]))
        at = end
    return np.concatenate(parts)


def texts_word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text of a column; short neighbours are hashed together, with a space between them."""
    data, starts, ends = text_spans(column)
    k, n = 0, len(starts)
    while k < n:
        if ends[k] - starts[k] > BLOCK // 2:
            yield word_hashes(data[starts[k] : ends[k]])
            k += 1
            continue
        stop, size = k, 0
        while stop < n and ends[stop] - starts[stop] <= BLOCK // 2 and size < BLOCK:
            size += int(ends[stop] - starts[stop]) + 1
            stop += 1
        joined = np.full(size, 0x20, np.uint8)
        counts, at = np.zeros(stop - k + 1, np.int64), 0
        for j in range(k, stop):
            length = int(ends[j] - starts[j])
            joined[at : at + length] = data[starts[j] : ends[j]]
            at += length + 1
            counts[j - k + 1] = at
        hashes = _hash_block(joined)
        gap = _SPACE[joined]
        begun = np.concatenate(([0], np.cumsum(~gap & np.concatenate(([True], gap[:-1])))))
        bounds = begun[counts]
        for j in range(stop - k):
            yield hashes[bounds[j] : bounds[j + 1]]
        k = stop


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; all words as one run if there are fewer, none for no words."""
    if not len(words):
        return words
    size_here = min(size, len(words))
    n = len(words) - size_here + 1
    total = np.full(n, size_here * 0x9E6C63D0676A9A99 & (1 << 64) - 1, _U)
    for k in range(size_here):
        total = mix(total * _U(0xA0761D6478BD642F | 1) + words[k : k + n])
    return np.unique(total)


def signature(shingles: np.ndarray) -> int:
    """Hash of a set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = mix(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(len(shingles))
    return int(mix(np.array([total], _U)).view(np.int64)[0])
