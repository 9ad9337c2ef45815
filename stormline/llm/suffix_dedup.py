"""Repeated byte strings across documents, by suffix sorting of shards.

A byte goes if it lies in a string of `size` bytes that also starts in a document with a smaller id. To compare all
documents with suffix arrays of bounded shards, equal strings must meet in one shard:

1. Documents are written in chunks of about `chunk_bytes` (compressed). Every window of `size` bytes is labelled with
   the least hash of the `gram`-byte strings in it. The label depends on the window's bytes alone, so equal windows have
   equal labels; consecutive windows with one label form a run, about 15 windows long.
2. Each chunk sends its distinct labels, 8 bytes each, to the shards by their top bits and gets back one bit for each:
   whether any other chunk has it. (Labels at two places of one chunk count as shared at once.)
3. Runs with a shared label are cut out with the bytes of their windows; equal runs of a chunk are sent once, with the
   least id. So a passage in a third of all documents costs one row per chunk.
4. A shard merges equal runs again, sorts the suffixes of those that differ under one label by external induced
   sorting (see induced.py), takes the least id over each group of suffixes that agree in `size` bytes, and answers
   each chunk with one bit per window.
5. Each chunk marks the covered bytes of its documents.

All exchanges are blocks of packed bits, hashes or compressed bytes; nothing grows with a group's square. A run's
bytes are compared as such, hashes only decide where they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .induced import match_groups, suffix_order
from .words import BASE, mixed, offsets, slices, text_bytes

SIZE, GRAM, CHUNK_BYTES, SHARD_BYTES = 50, 22, 2 << 20, 8 << 20
NO_ID = np.iinfo(np.int64).max


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(chunk, ids, ends, data): documents behind one another, their bytes compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, packer = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        for b in slices(batches, "body", chunk_bytes):
            data, ends = text_bytes(b.column(1))
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            row = ([number], [ids.tolist()], [ends[1:].tolist()], [packer.compress(data.tobytes())])
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["chunk", "ids", "ends", "data"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body"))
    return rows.mapInArrow(run, "chunk bigint, ids array<bigint>, ends array<bigint>, data binary")


class Chunk:
    """One chunk with the labelled runs of its windows."""

    def __init__(self, ids, ends, data, size: int, gram: int):
        self.ids, self.ends = np.asarray(ids, np.int64), np.asarray(ends, np.int64)
        plain = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(self.ends[-1])))
        self.text = np.frombuffer(plain, np.uint8)
        label = window_minima(gram_hashes(self.text, gram), size - gram + 1)
        begins = np.r_[0, self.ends[:-1]]
        count = np.maximum(np.diff(np.r_[0, self.ends]) - size + 1, 0)
        window = np.arange(int(count.sum())) + np.repeat(begins - np.cumsum(count) + count, count)
        owner = np.repeat(np.arange(len(self.ids)), count)
        label = label[window]
        new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])]) if len(window) else np.zeros(0, np.int64)
        self.start, self.windows = window[new], np.diff(np.r_[new, len(window)])
        self.doc, self.size = owner[new], size
        self.labels, self.which, times = np.unique(label[new], return_inverse=True, return_counts=True)
        self.local = times > 1

    def shared_runs(self, shared: np.ndarray) -> None:
        """Keeps the runs with a shared label; equal ones become one string with the least id of its documents."""
        live = np.flatnonzero((self.local | shared)[self.which])
        self.run_start, self.run_windows, self.run_doc = self.start[live], self.windows[live], self.doc[live]
        length = self.run_windows + self.size - 1
        at = np.r_[0, np.cumsum(length)]
        place = np.repeat(self.run_start - at[:-1], length) + np.arange(at[-1])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(live), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(self.text[place])]).dictionary_encode()
        self.string = coded.indices.to_numpy()
        self.strings = coded.dictionary
        self.label_of = np.zeros(len(self.strings), np.uint64)
        self.label_of[self.string] = self.labels[self.which[live]]
        self.least = np.full(len(self.strings), NO_ID)
        np.minimum.at(self.least, self.string, self.ids[self.run_doc])

    def by_shard(self, labels: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """An order by shard that keeps ties, and where each shard begins in it."""
        shard = shard_of(labels, shards)
        return np.argsort(shard, kind="stable"), np.cumsum(np.r_[0, np.bincount(shard, minlength=shards)])


def shard_of(labels: np.ndarray, shards: int) -> np.ndarray:
    """Labels are minima, so they are small numbers: they are mixed again before they deal out the work."""
    return (mixed(labels) % np.uint64(shards)).astype(np.int64)


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hash of the `gram` bytes from each place on, by doubling."""
    power, h, width = BASE, text.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    left = gram
    while left and len(h):
        if left & 1:
            if out is None:
                out, done = h, width
            else:
                n = max(len(text) - done - width + 1, 0)
                out, done = out[:n] * np.uint64(power) + h[done : done + n], done + width
        left >>= 1
        if left:
            n = max(len(h) - width, 0)
            h = h[:n] * np.uint64(power) + h[width : width + n]
            power, width = power * power % (1 << 64), 2 * width
    return mixed(out) if out is not None and done == gram else np.zeros(0, np.uint64)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least of the `width` hashes from each place on."""
    have = 1
    while 2 * have <= width and len(h):
        h, have = np.minimum(h[:-have], h[have:]), 2 * have
    rest = width - have
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest and len(h) > rest else h if not rest else h[:0]


def packed_blocks(values: np.ndarray, begin: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def label_blocks(source: DataFrame, shards: int, size: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                number, ids, ends, data = (c[i].as_py() for c in b.columns)
                c = Chunk(ids, ends, data, size, gram)
                order, begin = c.by_shard(c.labels, shards)
                blocks = packed_blocks(c.labels[order], begin)
                yield batch([(number, s, x) for s, x in enumerate(blocks) if x], ["chunk", "shard", "labels"], [pa.int64(), pa.int32(), pa.binary()])

    return source.mapInArrow(run, "chunk bigint, shard int, labels binary")


def shared_labels(blocks: DataFrame) -> DataFrame:
    """One bit for each label of a block: whether another chunk has it."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        parts = [np.frombuffer(x, np.uint64) for x in t["labels"].to_pylist()]
        _, which, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = (times > 1)[which]
        at = np.cumsum([0, *map(len, parts)])
        bits = [np.packbits(shared[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
        return pa.table({"chunk": t["chunk"], "shard": t["shard"], "bits": pa.array(bits, pa.binary())})

    return blocks.groupBy("shard").applyInArrow(run, "chunk bigint, shard int, bits binary")


def spread(c: Chunk, labels: np.ndarray, shards: int, answers: list[dict], sizes: np.ndarray | None = None) -> np.ndarray:
    """The bits that the shards have answered, back in the order of the labels (or of their `sizes` bits each)."""
    order, begin = c.by_shard(labels, shards)
    sizes = np.ones(len(labels), np.int64) if sizes is None else sizes
    at = np.r_[0, np.cumsum(sizes[order])]
    out = np.zeros(int(at[-1]), bool)
    for x in answers:
        a, b = at[begin[x["shard"]]], at[begin[x["shard"] + 1]]
        out[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=int(b - a)).astype(bool)
    back = np.zeros(len(out), bool)
    to = np.cumsum(sizes) - sizes
    back[np.repeat(to[order] - at[:-1], sizes[order]) + np.arange(len(out))] = out
    return back


def run_blocks(joined: DataFrame, shards: int, size: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for i in range(b.num_rows):
                number, ids, ends, data, shared = (c[i].as_py() for c in b.columns)
                c = Chunk(ids, ends, data, size, gram)
                c.shared_runs(spread(c, c.labels, shards, shared))
                order, begin = c.by_shard(c.label_of, shards)
                strings = c.strings.take(pa.array(order))
                at, whole = offsets(strings), np.frombuffer(strings.buffers()[2] or b"", np.uint8)
                rows = []
                for s in np.flatnonzero(np.diff(begin)).tolist():
                    a, z = begin[s], begin[s + 1]
                    rows.append((
                        number, s, c.label_of[order[a:z]].tobytes(), c.least[order[a:z]].tobytes(), np.diff(at[a : z + 1]).astype(np.int32).tobytes(),
                        packer.compress(whole[at[a] : at[z]].tobytes()),
                    ))
                yield batch(rows, ["chunk", "shard", "labels", "ids", "lengths", "data"], [pa.int64(), pa.int32(), *[pa.binary()] * 4])

    return joined.mapInArrow(run, "chunk bigint, shard int, labels binary, ids binary, lengths binary, data binary")


def covered_windows(blocks: DataFrame, size: int, memory_bytes: int) -> DataFrame:
    """One bit for each window of a block's strings: whether a document with a smaller id has it too."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        number = [np.frombuffer(b"".join(t[x].to_pylist()), k) for x, k in (("labels", np.uint64), ("ids", np.int64), ("lengths", np.int32))]
        label, own, length = number[0], number[1], number[2].astype(np.int64)
        unpack = zstandard.ZstdDecompressor()
        per = [len(x) // 4 for x in t["lengths"].to_pylist()]
        whole = b"".join(unpack.decompress(x) for x in t["data"].to_pylist())
        at = np.r_[0, np.cumsum(length)]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(whole)]).dictionary_encode()
        string, strings = coded.indices.to_numpy(), coded.dictionary
        least, label_of, size_of = np.full(len(strings), NO_ID), np.zeros(len(strings), np.uint64), np.zeros(len(strings), np.int64)
        np.minimum.at(least, string, own)
        label_of[string], size_of[string] = label, length
        first = np.cumsum(size_of - size + 1) - (size_of - size + 1)  # of each string's windows
        earliest = np.repeat(least, size_of - size + 1)
        # a string that is alone under its label shares windows with no other one
        _, group, times = np.unique(label_of, return_inverse=True, return_counts=True)
        sort = np.flatnonzero((times > 1)[group])
        if len(sort):
            picked = strings.take(pa.array(sort))
            n, ends = size_of[sort], offsets(picked)
            text = np.zeros(int(n.sum()) + len(n), np.uint16)
            place = np.repeat(np.arange(len(n)), n) + np.arange(int(n.sum()))
            text[place] = np.frombuffer(picked.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint16) + np.uint16(1)
            start = np.cumsum(n + 1) - (n + 1)
            window_of = np.full(len(text), -1)
            count = n - size + 1
            window_of[np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)] = (
                np.repeat(first[sort], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            )
            order, words = suffix_order(text, size, memory_bytes)
            order = order[window_of[order] >= 0]
            group = match_groups(order, words, text, size)
            lowest = np.minimum.reduceat(earliest[window_of[order]], np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
            earliest[window_of[order]] = lowest[group]
        count = length - size + 1
        where = np.repeat(first[string] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        bits = earliest[where] < np.repeat(own, count)
        edges = np.r_[0, np.cumsum(count)][np.cumsum([0, *per])]
        out = [np.packbits(bits[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({"chunk": t["chunk"], "shard": t["shard"], "bits": pa.array(out, pa.binary())})

    return blocks.groupBy("shard").applyInArrow(run, "chunk bigint, shard int, bits binary")


def marked(joined: DataFrame, shards: int, size: int, gram: int) -> DataFrame:
    schema = "id bigint, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, ids, ends, data, shared, windows = (c[i].as_py() for c in b.columns)
                c = Chunk(ids, ends, data, size, gram)
                c.shared_runs(spread(c, c.labels, shards, shared))
                per = offsets(c.strings)
                per = np.diff(per) - size + 1
                own = spread(c, c.label_of, shards, windows, per)
                # windows of the string's first document as answered; of any later document all are covered
                count = c.run_windows
                where = np.repeat((np.cumsum(per) - per)[c.string] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                hit = own[where] | np.repeat(c.ids[c.run_doc] > c.least[c.string], count)
                place = (np.repeat(c.run_start - np.cumsum(count) + count, count) + np.arange(int(count.sum())))[hit]
                step = np.zeros(len(c.text) + 1, np.int64)
                step[place] += 1
                step[place + size] -= 1
                gone = np.r_[False, np.cumsum(step[:-1]) > 0, False]
                begins = np.r_[0, c.ends[:-1]]
                edge = gone[1:] & ~gone[:-1]
                edge[begins[begins < len(c.text)]] |= gone[1:][begins[begins < len(c.text)]]
                stop = gone[:-1] & ~gone[1:]
                stop[c.ends] |= gone[c.ends]
                begin, end = np.flatnonzero(edge), np.flatnonzero(stop)
                per_doc = np.searchsorted(begin, np.r_[begins, len(c.text) + 1])
                rows = []
                for k, (a, z) in enumerate(zip(begins.tolist(), c.ends.tolist())):
                    cuts = slice(per_doc[k], np.searchsorted(begin, z)) if z > a else slice(0, 0)
                    spans = [{"begin": x, "end": y} for x, y in zip((begin[cuts] - a).tolist(), (end[cuts] - a).tolist())]
                    kept = c.text[a:z][~gone[a + 1 : z + 1]].tobytes() if spans else c.text[a:z].tobytes()
                    rows.append((None if ids[k] == NO_ID else ids[k], z - a, spans, kept))
                yield batch(rows, ["id", "n_bytes", "spans", "kept"], [pa.int64(), pa.int64(), kind, pa.binary()])

    return joined.mapInArrow(run, schema)


def repeated_bytes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES,
    shard_bytes: int = SHARD_BYTES, memory_bytes: int = 256 << 20,
) -> DataFrame:
    """(id, n_bytes, spans, kept), one row per input row: the maximal covered spans and the bytes that remain.

    Texts are their UTF-8 bytes, null is empty; matches never cross documents and are judged on the input. Ids are
    whole numbers. Rows that share an id do not cover each other. A null id counts as larger than all others. Texts
    under `size` bytes keep everything. Other columns are ignored.
    """
    if not 1 < gram < size:
        raise ValueError("gram must be between 2 and size - 1")
    source = materialise(chunks(docs, id_col, text_col, chunk_bytes))
    total = source.select(F.sum(F.element_at("ends", -1))).first()[0] or 0
    shards = max(8, -(-total // shard_bytes))

    def answers(blocks: DataFrame) -> DataFrame:
        return materialise(blocks.groupBy("chunk").agg(F.collect_list(F.struct("shard", "bits")).alias("answers")))

    none = F.array().cast("array<struct<shard:int,bits:binary>>")
    shared = answers(shared_labels(label_blocks(source, shards, size, gram))).withColumnRenamed("answers", "shared")
    first = source.join(shared.hint("merge"), "chunk", "left").select("chunk", "ids", "ends", "data", F.coalesce("shared", none).alias("shared"))
    windows = answers(covered_windows(run_blocks(first, shards, size, gram), size, memory_bytes)).withColumnRenamed("answers", "windows")
    both = first.join(windows.hint("merge"), "chunk", "left").select("chunk", "ids", "ends", "data", "shared", F.coalesce("windows", none).alias("windows"))
    return marked(both, shards, size, gram).withColumnRenamed("id", id_col)
