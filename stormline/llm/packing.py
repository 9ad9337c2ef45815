"""Packing of token sequences by best-fit decreasing.

Documents longer than the window are first cut into full windows, each a sequence of its own; the remainders are
packed by best fit in decreasing order. Open windows are kept in a segment tree over remaining capacities 0..limit,
whose nodes count the open windows below them; the tightest one that takes a piece is the first non-empty leaf at or
right of the piece's length, found in O(log limit). Remainders are dealt over tasks by a hash of the document, and
each task packs in runs of `run_pieces` pieces, which bounds its memory; only the last windows of a run stay loose.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

LIMIT, END_ID = 1024, 0
RUN_PIECES = 200_000
RUN_IDS = 1 << 22
CACHE_WORDS = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")


class Capacities:
    """Open windows by remaining capacity; a segment tree of counts over 0..limit."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(limit + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._bump(capacity, 1)

    def _bump(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with at least `need`, removed from the tree."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._bump(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces of equal length keep their order."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, made = Capacities(limit), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        capacity, at = found or (limit, made)
        made += found is None
        window[i], offset[i] = at, limit - capacity
        if capacity > need:
            tree.add(capacity - need, at)
    return window, offset


class Encoder:
    """Token ids of whole texts by a byte-level BPE.

    The pattern of such a tokenizer cuts before a space between two other characters and behind a run of letters. So
    where no two white-space characters meet, a text is encoded by its space-separated parts and each part by its
    leading word and its tail; words are remembered. Other texts go through the tokenizer as a whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer, self.model = tokenizer, tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, fixed values
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.cache_words = cache_words

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and a run of letters."""
        spelt = (" " + word).encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if len(self.words) >= self.cache_words:
            self.words.clear()
        if len(word) <= 40:
            self.words[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """Ids of a space and a part without one."""
        if part.isalpha():
            return self._word(part)
        word, last = part[:-1], part[-1:]
        if not last or last.isspace() or part[0].isspace():
            raise _Meeting
        if word.isalpha():
            return (self.words.get(word) or self._word(word)) + (self.tails.get(last) or self._tail(last))
        run = _LETTERS.match(part)
        if run is None or not (word := run.group()).isalpha():
            return self._tail(" " + part)
        return (self.words.get(word) or self._word(word)) + self._tail(part[len(word) :])

    def _tail(self, tail: str) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            ids = self.whole(tail)
            if len(tail) <= 40:
                if len(self.tails) >= self.cache_words // 4:
                    self.tails.clear()
                self.tails[tail] = ids
        return ids

    def __call__(self, text: str) -> np.ndarray:
        head, *rest = text.split(" ")
        get, part = self.words.get, self._part
        try:
            if rest and head[-1:].isspace():
                raise _Meeting
            ids = self._tail(head) + b"".join([get(x) or part(x) for x in rest])
        except _Meeting:
            ids = self.whole(text)
        return np.frombuffer(ids, dtype="<u4")


class _Meeting(Exception):
    """Two white-space characters meet, or one ends the text."""


def cut(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length): full windows, then the remainder."""
    return [(at, min(limit, n - at)) for at in range(0, n, limit)]


def _pieces(path: str, id_col: str, limit: int, end_id: int | None, ids: bool):
    """From batches (id, row, text) to batches of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for i, text in enumerate(part.column(2)):
                    own = np.concatenate([encode(text.as_py() or ""), tail])
                    for start, size in cut(len(own), limit):
                        piece = own[start : start + size]
                        rows.append((i, start, size, zlib.crc32(piece), len(own), *([piece] if ids else [])))
                if rows:
                    cols = list(zip(*rows))
                    which = pa.array(cols[0], pa.int64())
                    more = [pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32()))] if ids else []
                    arrays = [part.column(0).take(which), part.column(1).take(which), *[pa.array(c, pa.int64()) for c in cols[1:5]], *more]
                    yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "row", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids)

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str, ids: bool) -> tuple[DataFrame, str]:
    """(id, row, text), and the schema of their pieces."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * ids
    return docs.select(id_col, F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")), schema


def pieces(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int | None = END_ID, ids: bool = False) -> DataFrame:
    """(id_col, row, start, length, ids_crc32, doc_tokens[, ids]): the pieces of every document, before packing.

    `row` tells rows apart that share an id. The tokenizer's files are read where the tasks run, from `path`.
    """
    rows, schema = _rows(docs, id_col, text_col, ids)
    return rows.mapInArrow(_pieces(path, id_col, limit, end_id, ids), schema)


def _placed(limit: int, run_pieces: int):
    """From batches of pieces to the same with sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 40
        held, count = [], 0

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, count
            table = pa.Table.from_batches(held).combine_chunks()
            window, offset = best_fit_decreasing(table["length"].to_numpy(), limit)
            for column, value in (("sequence_id", window + made), ("offset", offset)):
                table = table.append_column(column, pa.array(value, pa.int64()))
            made += int(window.max(initial=-1)) + 1
            held, count = [], 0
            yield from table.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= run_pieces:
                yield from pack()
        if held:
            yield from pack()

    return run


def place(parts: DataFrame, *, limit: int = LIMIT, run_pieces: int = RUN_PIECES) -> DataFrame:
    """Adds sequence_id and offset to written pieces. A full window is a sequence of its own."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + ", sequence_id bigint, offset bigint"
    return parts.repartition("row").sortWithinPartitions("row", "start").mapInArrow(_placed(limit, run_pieces), schema)


def pack(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int | None = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Null texts are empty; with an end id they still hold that one token. Rows that share an id are packed each on
    its own. Other columns are ignored. Sequences hold at most `limit` tokens, their offsets leave no gap.
    """
    if ids:  # ids are not shuffled: each task packs its own pieces, of at most `limit` ids, in runs of bounded size
        rows, schema = _rows(docs, id_col, text_col, ids)
        cut_up, placed = _pieces(path, id_col, limit, end_id, ids), _placed(limit, max(1, RUN_IDS // limit))
        return rows.mapInArrow(lambda batches: placed(cut_up(batches)), schema + ", sequence_id bigint, offset bigint").drop("row")
    parts = materialise(pieces(docs, path=path, id_col=id_col, text_col=text_col, limit=limit, end_id=end_id))
    return place(parts, limit=limit).drop("row")
