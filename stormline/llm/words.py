"""Words of whole Arrow batches as numpy arrays; no Python per word.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased, nothing else. Word hashes are
64-bit polynomials of the bytes, mixed; operators that must be exact compare the bytes afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
SLICE_BYTES = 256 << 10  # where memory counts: the arrays of words and shingles take some hundred times as much
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


@dataclass
class Words:
    raw: np.ndarray  # bytes of all documents, one behind another
    text: np.ndarray  # the same, lower-cased
    start: np.ndarray  # of each word, in text
    end: np.ndarray
    doc: np.ndarray  # row of each word
    first: np.ndarray  # for each document the place of its first word, with the number of words at the end


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `limit` bytes of text; a longer text stands alone."""
    for batch in batches:
        ends = offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (one entry more than rows); null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def lowered(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)


def words(column: pa.Array) -> Words:
    data, ends = text_bytes(column)
    solid = ~_SPACE[data]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    if len(data):
        before[ends[:-1][ends[:-1] < len(data)]] = False
        after[ends[1:][ends[1:] > 0] - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    doc = np.searchsorted(ends[1:], start, side="right")
    first = np.searchsorted(start, ends)
    return Words(data, lowered(data), start, end, doc, first)


def joined(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space behind each, and where each begins and ends in it."""
    size = w.end - w.start
    start = np.cumsum(size + 1) - size - 1
    total = int((size + 1).sum())
    place = np.repeat(w.start - start, size + 1) + np.arange(total)
    out = w.text[np.minimum(place, max(len(w.text) - 1, 0))] if total else np.zeros(0, np.uint8)
    out[start + size] = 32
    return out.tobytes(), start, start + size


def power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), np.uint64)
        have[0], have[1:] = 1, np.uint64(base)
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(w: Words) -> np.ndarray:
    n = len(w.text)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((w.text.astype(np.uint64) + np.uint64(1)) * power(BASE, n), out=total[1:])
    return mixed((total[w.end] - total[w.start]) * power(INVERSE, n + 1)[w.start])


def shingle_rows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each shingle of k words: its first word, its last word, its document. A document of fewer words
    is one shingle; one without words has none."""
    count = np.diff(w.first)
    per = np.where(count == 0, 0, np.maximum(count - k + 1, 1))
    doc = np.repeat(np.arange(len(count)), per)
    begin = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(w.first[:-1], per)
    last = np.minimum(begin + k, w.first[1:][doc]) - 1
    return begin, last, doc
