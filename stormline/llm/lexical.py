"""Ranked lexical search: an automaton of all item terms reads the documents themselves; there is no document index.

Texts are scanned as bytes in which every separator is one space and A-Z are lower-cased, so that an occurrence of a
term is a match of the term between two spaces (the guards; neighbouring matches share one). One Aho-Corasick automaton
of all guarded terms reports them in one pass. Its outputs are term numbers, which a sparse table maps to items.

Two scans are made. The first adds up the collection's figures: documents, terms in all, and for each item term the
documents that hold it (sums, combined before the shuffle). The second scores: a block of documents times a slice of
items is a product of two small matrices, and a task keeps the best k documents of each item. What is shuffled is at
most k rows for each item and task; no pair of a document and an item leaves its task otherwise.

Items are taken in blocks of about `block_bytes` of text, one after another, which bounds the automaton, the tables and
what the driver holds; every block reads all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .words import slices

TOP, BLOCK_BYTES, SLICE_ITEMS, CELLS = 10, 4 << 20, 64, 1 << 22
SCALE, K1_MILLI, B_PERCENT = 1_000_000_000, 1000, 90  # fixed values: scale of a term's share, weight of tf, share of the length
_GUARDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def spaced(text: str) -> bytes:
    """The text as UTF-8 with A-Z lower-cased and every separator turned into a space."""
    return text.encode().translate(_GUARDED)


def guarded(term: bytes) -> str:
    return f" {term.decode('latin-1')} "


class Terms:
    """The distinct terms of a block of items, the automaton, and the items of each term."""

    def __init__(self, items: list[list[bytes]]):
        self.names = sorted({t for own in items for t in own})
        at = {t: i for i, t in enumerate(self.names)}
        self.n_items = len(items)
        self.slices = []
        for low in range(0, len(items), SLICE_ITEMS):
            part = [[at[t] for t in own] for own in items[low : low + SLICE_ITEMS]]
            used = np.unique(np.array([t for own in part for t in own], np.int64))
            holds = np.zeros((len(used), len(part)), np.uint8)
            for i, own in enumerate(part):
                holds[np.searchsorted(used, np.array(own, np.int64)), i] = 1
            self.slices.append((low, used, holds))

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(self.names):
            out.add_word(guarded(t), i)
        out.make_automaton()
        return out


def scanned(column: pa.Array, automaton) -> Iterator[tuple[int, int, Counter]]:
    """(row, number of terms, counts by term number) of each text with terms."""
    for row, text in enumerate(column):
        if text.is_valid:
            line = spaced(text.as_py())
            n = len(line.split())
            if n:
                found = automaton.iter(f" {line.decode('latin-1')} ") if len(automaton) else ()
                yield row, n, Counter(map(itemgetter(1), found))


def statistics(texts: DataFrame, terms: Terms) -> tuple[int, int, np.ndarray]:
    """(documents with terms, terms in all, documents by term) over all texts."""
    size = len(terms.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, df, docs, total = terms.automaton(), np.zeros(size, np.int64), 0, 0
        for b in slices(batches, "text"):
            for _, n, counts in scanned(b.column("text"), automaton):
                docs, total = docs + 1, total + n
                df[list(counts)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, held]), pa.array(np.r_[docs, df[held]]), pa.array(np.r_[total, np.zeros(len(held), np.int64)])], names=["term", "n", "total"])

    rows = texts.select("text").mapInArrow(run, "term bigint, n bigint, total bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    df, docs, total = np.zeros(size, np.int64), 0, 0
    for term, n, longs in rows.collect():  # a row for each term of the items
        if term < 0:
            docs, total = n, longs
        else:
            df[term] = n
    return docs, total, df


def weights(docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)


class Best:
    """The best k documents of each item so far: larger score first, then the smaller id, a null id last."""

    def __init__(self, n_items: int, k: int, kind: pa.DataType):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], kind)
        self.waiting: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.count = 0

    def add(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.waiting.append((item, score, ids))
        self.count += len(item)
        if self.count > 4 * self.k * len(self.least) + 10_000:
            self.settle()

    def settle(self) -> None:
        item, score = (np.concatenate([own, *[w[i] for w in self.waiting]]) for i, own in enumerate((self.item, self.score)))
        ids = pa.concat_arrays([self.ids, *[w[2] for w in self.waiting]])
        rank = pc.rank(ids, null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False)
        order = np.lexsort((rank, -score, item))
        item, score = item[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.k
        self.item, self.score, self.ids = item[kept], score[kept], ids.take(pa.array(order[kept]))
        full = place == self.k - 1
        self.least[item[full]] = score[full]
        self.waiting, self.count = [], 0


def best_documents(texts: DataFrame, terms: Terms, docs: int, total: int, df: np.ndarray, k: int) -> DataFrame:
    """(item, score, id): per task the best k documents of each item number with a score above 0."""
    kind = texts.schema["id"].dataType.simpleString()
    weight = weights(docs, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, best = terms.automaton(), None
        for batch in slices(batches, "text"):
            best = best or Best(terms.n_items, k, batch.column("id").type)
            rows, sizes, found = [], [], []
            for row, n, counts in scanned(batch.column("text"), automaton):
                if counts:
                    rows.append(row), sizes.append(n), found.append(counts)
            step = max(1, CELLS // max(1, len(terms.names)))
            for at in range(0, len(rows), step):
                part = found[at : at + step]
                doc = np.repeat(np.arange(len(part)), [len(c) for c in part])
                term = np.fromiter((t for c in part for t in c), np.int64, len(doc))
                tf = np.fromiter((x for c in part for x in c.values()), np.int64, len(doc))
                long = 100 - B_PERCENT + (B_PERCENT * np.array(sizes[at : at + step], np.int64) * docs) // total
                share = weight[term] * ((SCALE * tf) // (K1_MILLI * tf + 8 * long[doc]))
                exact = float(share.max()) * max(len(used) for _, used, _ in terms.slices) < 2**53  # sums of doubles are then exact
                cells = np.zeros((len(part), len(terms.names)), np.float64 if exact else np.int64)
                cells[doc, term] = share
                ids = batch.column("id").take(pa.array(rows[at : at + step], pa.int64()))
                for low, used, holds in terms.slices:
                    score = (cells[:, used] @ holds.astype(cells.dtype)).astype(np.int64)
                    which, item = np.nonzero(score >= best.least[low : low + holds.shape[1]])
                    if len(which):
                        best.add(item + low, score[which, item], ids.take(pa.array(which)))
        if best is not None:
            best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.score), best.ids], names=["item", "score", "id"])

    return texts.mapInArrow(run, f"item bigint, score bigint, id {kind}")


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[pa.Array, Terms]]:
    """The items with terms in blocks of about `block_bytes` of text."""
    held = materialise(items.select(F.col(item_col).alias("item"), F.col(text_col).alias("body")).filter("body IS NOT NULL"))
    size = held.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    for part in range(parts):
        block = held.filter(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == part).orderBy("item", "body").toArrow()
        own = [sorted(set(spaced(x).split())) for x in block.column("body").to_pylist()]
        some = [i for i, x in enumerate(own) if x]
        if some:
            yield block.column("item").combine_chunks().take(pa.array(some)), Terms([own[i] for i in some])


def ranked(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    k: int = TOP, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents of each item, in integer BM25.

    Terms are the longest runs of digits, letters and characters beyond ASCII, A-Z lower-cased. Null texts and texts
    without a term are no documents; items without a term have no rows. A term counts once for an item, however often the
    item repeats it. Equal scores are ordered by id, null ids last; repeated rows of documents are documents of their
    own, repeated rows of items are ranked each. Without documents there are no rows. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    schema = f"`{item_col}` {item_kind}, rank int, `{id_col}` {kind}, score bigint"
    out = []
    for names, terms in item_blocks(items, item_col, item_text_col, block_bytes):
        n_docs, total, df = statistics(texts, terms)
        if not n_docs:
            break
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        found = best_documents(texts, terms, n_docs, total, df, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        def named(batches: Iterator[pa.RecordBatch], names=names) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([names.take(b.column(0)), b.column(1), b.column(2), b.column(3)], names=[item_col, "rank", id_col, "score"])

        out.append(materialise(found.select("item", "rank", "id", "score").mapInArrow(named, schema)))  # k rows an item; the block's tables can go
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)
