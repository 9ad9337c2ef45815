"""Near-duplicates by wide SimHash sketches, compared bit-sliced and verified by the exact similarity of shingle sets.

A document's sketch is `PRINTS` independent SimHash fingerprints of its set of k-word shingles, 512 bits. Documents with
equal sets are one node. Nodes meet in `TABLES` tables, each keyed by `KEY_BITS` bits of the sketch that no other
table uses. In a bucket the first `SLICED` bits stand vertically, one bit plane per bit; the distances of all rows to the
rows s places further are summed at once by carry-save counters, for s = 1, 2, ..., and a block of rows is abandoned as
soon as all its counters exceed the radius. Rows that stay are compared in all 512 bits and by the sizes of
their sets, so that few pairs that are not similar ever reach the texts.

Nothing is united before the texts have been compared. A bucket reports links between nodes of different groups, some
per row in each round, and goes on behind the last one in the next round; links that turn out true unite groups. The first
round reads `FIRST` tables only: it joins large groups of copies, which the others then need not compare again.
Buckets of more than `cell_rows` rows are dealt to a grid of cells, so no task holds a whole hot one. The table of buckets
has at most TABLES * 2**KEY_BITS rows, whatever the data.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .graph import components
from .simhash import _by_group, _shared, _under, ahead, similar
from .words import BASE, SLICE_BYTES, mixed, shingle_rows, slices, word_hashes, words

PRINTS, TABLES, KEY_BITS, FIRST, SLICED = 8, 36, 13, 4, 128
CELL_ROWS, BLOCK_WORDS, PARTS, LINKS_PER_ROW, SLICED_DEVIATIONS, DEVIATIONS = 32768, 4096, 1 << 20, 1, 4, 2.5
SKETCH = [f"s{i}" for i in range(PRINTS)]


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's distinct shingles, sorted by row."""
    w = words(column)
    first, last, doc = shingle_rows(w, k)
    own, h = word_hashes(w), np.zeros(len(first), np.uint64)
    for j in range(k):
        at = first + j
        h = np.where(at <= last, mixed(h * np.uint64(BASE) + own[np.minimum(at, max(len(own) - 1, 0))]) if len(own) else h, h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def sketches(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the size of its set, two sums that name the set, and its sketch; zeros for a text without words."""
    doc, h = shingle_sets(column, k)
    n = len(column)
    size, name, out = np.bincount(doc, minlength=n), np.zeros((n, 2), np.uint64), np.zeros((n, PRINTS), np.uint64)
    if not len(h):
        return size, name, out
    begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    at, total = doc[begins], np.diff(np.r_[begins, len(doc)])
    for i in range(2):
        name[at, i] = np.add.reduceat(mixed(h ^ np.uint64(BASE >> i)), begins)
    for i in range(PRINTS):
        bits = np.unpackbits(mixed(h + np.uint64((i + 1) * BASE & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        major = 2 * np.add.reduceat(bits, begins, axis=0, dtype=np.int32) > total[:, None]
        out[at, i] = np.packbits(major.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
    return size, name, out


def radius(similarity: float, bits: int, deviations: float) -> int:
    """The expected number of differing bits at this Jaccard similarity, and so many standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def planes(bits: np.ndarray) -> np.ndarray:
    """(bits, words) planes of (rows, 64-bit words); row i is bit i % 64 of word i // 64."""
    rows = np.pad(bits, ((0, -len(bits) % 64), (0, 0)))
    flat = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(flat.T), axis=1, bitorder="little").view(np.uint64)


def within(sliced: np.ndarray, shifts: np.ndarray, live: np.ndarray, most: int) -> np.ndarray:
    """(shifts, width): of the rows in `live` (bits, of the same shape) those whose row so far ahead differs in at most `most` planes."""
    width, over = live.shape[1], ~live
    counter = [np.zeros_like(live) for _ in range(most.bit_length())]
    for at in range(0, len(sliced), 16):
        for carry in sliced[at : at + 16, None, :width] ^ ahead(sliced[at : at + 16], shifts, width):
            for i, digit in enumerate(counter):
                counter[i], carry = digit ^ carry, digit & carry
            over |= carry  # a counter that wraps has exceeded
        more, same = np.zeros_like(live), ~np.zeros_like(live)
        for i in reversed(range(len(counter))):  # counter > most, digit by digit from the top
            if most >> i & 1:
                same = same & counter[i]
            else:
                more, same = more | same & counter[i], same & ~counter[i]
        over |= more
        if not (~over).any():
            break
    return ~over


def first_table(apart: np.ndarray) -> np.ndarray:
    """The first table whose key has none of the differing bits (of pairs that meet somewhere)."""
    bits = np.unpackbits(np.ascontiguousarray(apart).view(np.uint8), axis=1, bitorder="little", count=TABLES * KEY_BITS)
    return (~bits.reshape(-1, TABLES, KEY_BITS).any(axis=2)).argmax(axis=1)


def meetings(
    sketch: np.ndarray, size: np.ndarray, group: np.ndarray, table: np.ndarray, label: np.ndarray, side: np.ndarray, start: np.ndarray, limit: int, similarity: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, go): candidates among rows of equal group (sorted) with different labels, whose places in the group are at least `start` apart.

    Rows with the same side other than 0 are not compared, and a pair counts only in the first table in which it meets, so that
    the tables report it once. A group that has reported `limit` links per row stops behind the
    distance of places reached; `go` is the distance from which it goes on, 0 for a group that is through.
    """
    n = len(group)
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    count = np.diff(np.r_[begins, n])
    order = np.argsort(-np.repeat(count, count), kind="stable")  # large groups first, so that few words stay for long shifts
    left = (np.repeat(begins + count, count) - 1 - np.arange(n))[order]
    falling, most, s = np.sort(count)[::-1], int(count.max(initial=1)), int(start.min(initial=1 << 30))
    sketch, size, table, label, side, start, group = (x[order] for x in (sketch, size, table, label, side, start, group))
    sliced = np.pad(planes(sketch[:, : SLICED // 64]), ((0, 0), (0, most // 64 + 2)))
    part, whole = radius(similarity, SLICED, SLICED_DEVIATIONS), radius(similarity, 64 * PRINTS, DEVIATIONS)
    sent, go = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while s < most:
        width = -(-int(falling[falling > s].sum()) // 64)
        shifts = np.arange(s, min(most, s + max(1, BLOCK_WORDS // width)))
        has, rows = np.zeros((len(shifts), width * 64), bool), min(n, width * 64)
        has[:, :rows] = (left[None, :rows] >= shifts[:, None]) & (start[None, :rows] <= shifts[:, None])
        s += len(shifts)
        if not has.any():
            continue
        near = within(sliced, shifts, np.packbits(has, axis=1, bitorder="little").view(np.uint64), part)
        which, i = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
        j = i + shifts[which]
        new = (label[i] != label[j]) & ((side[i] == 0) | (side[i] != side[j]))
        which, i, j = which[new], i[new], j[new]
        new = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
        new[new] = np.bitwise_count(sketch[i[new]] ^ sketch[j[new]]).sum(axis=1, dtype=np.int64) <= whole
        new[new] = first_table(sketch[i[new]] ^ sketch[j[new]]) == table[i[new]]
        which, i, j = which[new], i[new], j[new]
        if not len(i):
            continue
        at, times = np.unique(group[i] * len(shifts) + which, return_counts=True)
        of, upto = at // len(shifts), np.cumsum(times)
        full = sent[of] + upto - np.r_[0, upto][np.searchsorted(of, of)] >= limit * count[of]
        stopped, where = np.unique(of[full], return_index=True)
        last = np.full(len(count), len(shifts))
        last[stopped] = at[full][where] % len(shifts)
        kept = which <= last[group[i]]
        out.append((order[i[kept]], order[j[kept]]))
        sent += np.bincount(group[i[kept]], minlength=len(count))
        further = shifts[last[stopped]] + 1
        go[stopped] = np.where(further < count[stopped], further, 0)
        left[np.isin(group, stopped)] = 0
    i, j = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return i, j, go


def key(t: int) -> Column:
    """Bucket of a table: its number and its bits of the sketch."""
    word, bit = divmod(t * KEY_BITS, 64)
    bits = F.shiftrightunsigned(SKETCH[word], bit)
    if bit + KEY_BITS > 64:
        bits = bits.bitwiseOR(F.shiftleft(SKETCH[word + 1], 64 - bit))
    return bits.bitwiseAND(F.lit((1 << KEY_BITS) - 1)) + F.lit(t << KEY_BITS)


def met(nodes: DataFrame, *, first: int, similarity: float, cell_rows: int, limit: int, going: DataFrame | None = None) -> DataFrame:
    """(a, b, bucket, cell, start): candidates among nodes (node, label, size, sketch) in the first so many tables; and with a
    and b null the cells that stopped at `limit` links per row. `going` has those cells of the round before; only they are
    read again, each from its `start` on."""
    rows = nodes.select("node", "label", "size", *SKETCH, F.explode(F.array(*[key(t) for t in range(first)])).alias("bucket"))
    if going is not None:
        rows = rows.join(F.broadcast(going.select("bucket").distinct()), "bucket", "left_semi")  # bounded by the number of buckets
    # one node in sixteen is counted, which is enough to see a hot bucket; cells only deal out the work
    seen = rows.filter(F.pmod(F.xxhash64("node"), F.lit(16)) == 0).groupBy("bucket").agg((16 * F.count(F.lit(1))).alias("n")).filter(F.col("n") > cell_rows)
    hot = materialise(seen.select("bucket", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(1), "node"), parts)
    cells = rows.join(F.broadcast(hot), "bucket", "left").select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    cells = cells.withColumn("cell", F.least("own", "other") * PARTS + F.greatest("own", "other")).withColumn("side", F.signum(F.col("own") - F.col("other")).cast("int"))
    cells = cells.withColumn("start", F.lit(1)) if going is None else cells.join(F.broadcast(going), ["bucket", "cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, group in _by_group(batches, 2):
            (bucket, cell, node, label, size, side, start, *sketch), group = _shared(cols, group)
            if not len(node):
                continue
            i, j, go = meetings(np.stack(sketch, axis=1).view(np.uint64), size, group, bucket >> KEY_BITS, label, side, start, limit, similarity)
            at = np.searchsorted(group, np.flatnonzero(go))
            none, some = pa.nulls(len(i), pa.int64()), pa.nulls(len(at), pa.int64())
            names = ["a", "b", "bucket", "cell", "start"]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), none, none, none.cast(pa.int32())], names=names)
            if len(at):
                yield pa.RecordBatch.from_arrays([some, some, pa.array(bucket[at]), pa.array(cell[at]), pa.array(go[go > 0].astype(np.int32))], names=names)

    dealt = cells.select("bucket", "cell", "node", "label", "size", "side", "start", *SKETCH).repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint, bucket bigint, cell bigint, start int")


@contextlib.contextmanager
def _bloom_filters(spark: SparkSession) -> Iterator[None]:
    """Joins by sorting, with a Bloom filter of the selective side's keys in front of the large side's exchange."""
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    }
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, cell_rows: int = CELL_ROWS, limit: int = LINKS_PER_ROW
) -> DataFrame:
    """(id_col, component): the least id reachable over links of documents whose sets of k-word shingles are that similar (exact
    Jaccard). The sketches choose which pairs are compared; see the README for the measured recall.

    One row per input row. Null, empty and wordless texts have the same empty set and are linked. Rows that share an id keep
    one row each. Rows with a null id keep a component, but never name one unless no row of theirs has an id. Other
    columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), text_col).alias("h2"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            size, name, sketch = sketches(b.column(3), k)
            numbers = [np.ascontiguousarray(x).view(np.int64) for x in (*name.T, size.astype(np.int64), *sketch.T)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, numbers)], names=["id", "h1", "h2", "g1", "g2", "size", *SKETCH])

    longs = ", ".join(f"{c} bigint" for c in ("h1", "h2", "g1", "g2", "size", *SKETCH))
    own = materialise(text.mapInArrow(run, f"id {kind}, {longs}"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")).alias("least")
    nodes = own.groupBy("g1", "g2").agg(least, *[F.min(c).alias(c) for c in ("size", *SKETCH)])  # equal sets
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))

    def joined_by(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """Labels after the true ones of the distinct pairs (a, b) have joined their groups."""
        for side in "ab":
            pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")).hint("merge"), side)
        pairs = materialise(pairs.filter("la <> lb").select("la", "lb", F.col("a").alias("id_a"), F.col("b").alias("id_b")).withColumn("p", F.monotonically_increasing_id()))
        if pairs.isEmpty():
            return labels
        ends = pairs.select(F.col("id_a").alias("node")).unionByName(pairs.select(F.col("id_b").alias("node"))).distinct()
        ends = materialise(ends.join(nodes.select("node", "least").hint("merge"), "node").select("node", F.col("least.id").alias("_id"), F.col("least.h1").alias("_1"), F.col("least.h2").alias("_2")))
        same = (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")) & F.col("id").eqNullSafe(F.col("_id"))
        with _bloom_filters(spark):
            read = materialise(text.join(ends.filter("node >= 0").hint("merge"), same).select(F.col("node").alias("id"), "text").dropDuplicates(["id"]))
        true = pairs.join(materialise(similar(read, pairs.select("p", "id_a", "id_b"), k, similarity)).hint("merge"), "p")
        return materialise(_under(labels, components(true.select(F.col("la").alias("a"), F.col("lb").alias("b"))), "label", "root").select("node", F.col("root").alias("label")))

    labels = materialise(nodes.select("node", F.col("node").alias("label")))
    sketched = nodes.select("node", "size", *SKETCH)
    found = materialise(met(sketched.withColumn("label", F.col("node")), first=FIRST, similarity=similarity, cell_rows=cell_rows, limit=limit))
    labels, going = joined_by(labels, found.filter("a IS NOT NULL").select("a", "b").distinct()), None
    while True:
        labelled = sketched.join(labels.hint("merge"), "node")
        found = materialise(met(labelled, first=TABLES, similarity=similarity, cell_rows=cell_rows, limit=limit, going=going))
        labels = joined_by(labels, found.filter("a IS NOT NULL").select("a", "b").distinct())
        going, limit = found.filter("a IS NULL").select("bucket", "cell", "start"), 4 * limit
        if going.isEmpty():
            break
    roots = nodes.join(labels.hint("merge"), "node").select("g1", "g2", "least", "label")
    named = roots.groupBy("label").agg(F.min("least").getField("id").alias("component"))
    final = materialise(roots.join(named.hint("merge"), "label").select("g1", "g2", "component"))
    return own.join(final.hint("merge"), ["g1", "g2"]).select(F.col("id").alias(id_col), "component")
