"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A document's shingles (k words) that occur in no item cannot add to a similarity, so only windows with enough shared
shingles for the threshold are looked at (a bound that loses nothing). Each window of an item's length gets a SimHash
from prefix sums of the shingles' bits. The 64 bits are cut into blocks; two fingerprints within the radius differ by
at most radius // blocks bits in one block, so an index that maps every block value to the items within that many
bits finds them all. What the fingerprints let through is verified exactly: the Jaccard similarity of the two
multisets of shingles (weighted by their counts), compared as words.

Items are taken in blocks of at most `block_items`, which bounds what is sent to the tasks; all documents are read
for each block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .words import BASE, SLICE_BYTES, Words, mixed, slices, word_hashes, words

K, SIMILARITY, RADIUS, BLOCKS, BLOCK_ITEMS = 5, 0.8, 23, 8, 20_000


def shingle_hashes(w: Words, hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each place where k words of one document begin; the last places of a document hold rubbish."""
    n, out = len(hashes), np.zeros(len(hashes), np.uint64)
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h = h * np.uint64(BASE) + hashes[i : n - k + 1 + i]
        out[: n - k + 1] = mixed(h)
    return out


def bits_of(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


class Blocks:
    """Multi-index over fingerprints: for each block and each of its values the fingerprints nearby."""

    def __init__(self, fps: np.ndarray, radius: int, blocks: int):
        self.fps, self.radius, self.width = fps, radius, 64 // blocks
        values = np.arange(1 << self.width)
        near = [int(x) for x in values if int(x).bit_count() <= radius // blocks]
        self.begin, self.items = [], []
        for b in range(blocks):
            own = self._value(fps, b)
            value = (own[:, None] ^ np.array(near)).ravel()
            order = np.argsort(value, kind="stable")
            self.items.append(np.repeat(np.arange(len(fps)), len(near))[order])
            self.begin.append(np.searchsorted(value[order], np.arange(len(values) + 1)))

    def _value(self, fps: np.ndarray, block: int) -> np.ndarray:
        return (fps >> np.uint64(block * self.width) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def search(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of all pairs within the radius, once each."""
        found = []
        for b, (begin, items) in enumerate(zip(self.begin, self.items)):
            value = self._value(fps, b)
            count = begin[value + 1] - begin[value]
            query = np.repeat(np.arange(len(fps)), count)
            item = items[np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[value], count)]
            close = np.bitwise_count(fps[query] ^ self.fps[item]) <= self.radius
            found.append(np.stack([query[close], item[close]]))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


class Items:
    """One block of items, ready to be searched for in a slice of documents."""

    def __init__(self, texts: list[str], k: int, similarity: float, radius: int, blocks: int):
        w = words(pa.array(texts, pa.string()))
        hashes = word_hashes(w)
        size = np.diff(w.first)
        self.similarity, self.groups, self.weights, known = similarity, [], {}, {}
        for length in sorted(set(size.tolist()) - {0}):
            which, width = np.flatnonzero(size == length), min(k, length)
            count = length - width + 1
            h = shingle_hashes(w, hashes, width)
            rows = np.concatenate([h[w.first[i] : w.first[i] + count] for i in which])
            known.setdefault(width, []).append(rows)
            sums = bits_of(rows).reshape(len(which), count, 64).sum(axis=1, dtype=np.int64)
            fps = packed(2 * sums > count)
            least = max(1, math.ceil(2 * similarity * count / (1 + similarity) - 1e-9))
            self.groups.append((length, width, count, least, which, Blocks(fps, radius, blocks)))
            for i in which:
                self.weights[int(i)] = shingle_counts(w, int(w.first[i]), length, width)
        self.known = {}
        for width, rows in known.items():
            rows = np.unique(np.concatenate(rows))
            table = np.zeros(1 << 16, bool)
            table[rows & np.uint64(0xFFFF)] = True
            self.known[width] = (rows, table)

    def search(self, w: Words) -> list[tuple[int, int, int, int, float]]:
        """(document row, item, first word, words, similarity): the best window of each pair, the first of equals."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        hashes = word_hashes(w)
        for width, (rows, table) in self.known.items():
            h = shingle_hashes(w, hashes, width)
            fits = np.arange(len(h)) + width <= w.first[1:][w.doc]
            maybe = np.flatnonzero(fits & table[h & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(rows, h[maybe]), len(rows) - 1)
            hit = np.zeros(len(h) + 1, np.int64)
            hit[maybe[rows[at] == h[maybe]] + 1] = 1
            if not hit.any():
                continue
            hits = np.cumsum(hit)
            for length, own, count, least, which, index in self.groups:
                if own != width or len(h) < count:
                    continue
                enough = np.flatnonzero(hits[count:] - hits[:-count] >= least)
                enough = enough[enough + length <= w.first[1:][w.doc[enough]]]
                for part in np.array_split(enough, max(1, len(enough) * count // 200_000)):
                    if not len(part):
                        continue
                    bits = bits_of(h[part[:, None] + np.arange(count)].ravel()).reshape(len(part), count, 64)
                    query, item = index.search(packed(2 * bits.sum(axis=1, dtype=np.int64) > count))
                    for q, i in zip(query.tolist(), item.tolist()):
                        start, number = int(part[q]), int(which[i])
                        same = weighted_similarity(shingle_counts(w, start, length, width), self.weights[number])
                        if same >= self.similarity:
                            doc = int(w.doc[start])
                            first = start - int(w.first[doc])
                            old = best.get((doc, number))
                            if old is None or (-same, first) < (-old[0], old[1]):
                                best[doc, number] = (same, first, length)
        return [(doc, item, first, length, same) for (doc, item), (same, first, length) in sorted(best.items())]


def shingle_counts(w: Words, start: int, length: int, width: int) -> Counter:
    own = [w.text[a:b].tobytes() for a, b in zip(w.start[start : start + length].tolist(), w.end[start : start + length].tolist())]
    return Counter(tuple(own[i : i + width]) for i in range(length - width + 1))


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def item_blocks(items: DataFrame, item_col: str, text_col: str, k: int, similarity: float, radius: int, blocks: int, block_items: int) -> Iterator[tuple[pa.Array, Items]]:
    """The items in blocks of about `block_items` that are sent to the tasks one after another."""
    held = materialise(items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("body")))
    parts = max(1, -(-held.count() // block_items))
    for part in range(parts):
        block = held.filter(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == part).orderBy("item", "body").toArrow()
        yield block.column("item").combine_chunks(), Items(block.column("body").to_pylist(), k, similarity, radius, blocks)


def contaminated(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    k: int = K, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(id_col, item_col, start_word, n_words, similarity): every document and item with a similar window.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A window has as many words as the item;
    items of fewer than k words are one shingle. Of a pair's windows the most similar one is given, the first of
    equals. Null and wordless texts match nothing. Repeated rows are each reported; other columns are ignored.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, start_word bigint, n_words bigint, similarity double"
    texts = docs.select(id_col, F.col(text_col).alias("text"))
    found = []
    for names, index in item_blocks(items, item_col, item_text_col, k, similarity, radius, blocks, block_items):

        def run(batches: Iterator[pa.RecordBatch], names=names, index=index) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                rows = index.search(words(b.column(1)))
                if rows:
                    cols = list(zip(*rows))
                    ids = b.column(0).take(pa.array(cols[0], pa.int64()))
                    hits = names.take(pa.array(cols[1], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, hits, pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())],
                        names=[id_col, item_col, "start_word", "n_words", "similarity"],
                    )

        found.append(texts.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found)


def clean(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    k: int = K, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The rows of `docs`, unchanged, that have no window similar to an item; no shuffle."""
    for _, index in item_blocks(items, item_col, item_text_col, k, similarity, radius, blocks, block_items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col, SLICE_BYTES):
                fine = np.ones(b.num_rows, bool)
                fine[[row[0] for row in index.search(words(b.column(text_col)))]] = False
                yield b.filter(pa.array(fine))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
