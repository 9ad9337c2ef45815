"""Runs of repeated words, found with a recompressed grammar.

Candidates stand on a harmonic grid: a run with period q and at least e periods covers e - 1 places x on the grid
0, q, 2q, ... with equal words at x and x + q, one behind another. For each q these are read off by comparing the grid with
itself, over all texts of a batch at once; the texts are in falling order of length, so that long periods look only
at texts that can hold them. The grids together have n/1 + n/2 + ... places.

How far a candidate reaches to both sides is answered by a grammar. The texts are recompressed: alternately every
block of equal symbols becomes one symbol (symbol, count), and every pair with its left symbol on one side and its right
symbol on the other side of a partition of the alphabet becomes one symbol, until each text is one symbol. Equal stretches
are parsed alike up to their ends, so a common extension is found by climbing: at each level at most one step until both
places begin a symbol of the next level; then down again to the first difference. Fences, symbols that occur once, keep
texts apart and end every extension. Queries are answered many at a time by arrays.

Only texts with a candidate get a grammar. Of equal stretches the least period counts; a multiple of it reaches equally
far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mixed, slices

MIN_LENGTH, MIN_PERIODS, QUERIES, SEEDS = 6, 4, 1 << 18, 4


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """Words as numbers, equal for equal words, of all texts one behind another."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for own in texts for w in own), np.int64, sum(map(len, texts)))


def fenced(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, fence flags, first place of each text): a fence in front of every text and one at the end."""
    begin = np.cumsum(size + 1) - size
    fence = np.zeros(len(words) + len(size) + 1, bool)
    fence[np.r_[begin - 1, len(fence) - 1]] = True
    out = np.empty(len(fence), np.int64)
    out[~fence] = words
    out[fence] = np.arange(fence.sum()) + (int(words.max(initial=-1)) + 1)
    return out, fence, begin


class Level:
    """Symbols of one level, and how they are grouped to those of the next one."""

    def __init__(self, symbol: np.ndarray):
        self.symbol = symbol
        self.begin = self.up = np.zeros(0, np.int64)  # first place of each group and its end; the group of each place
        self.blocks = False  # groups of equal symbols, rather than pairs


class Grammar:
    """Levels of symbols over a sequence of words with fences."""

    def __init__(self, symbol: np.ndarray, fence: np.ndarray):
        self.levels = [Level(symbol)]
        self.word = [np.arange(len(symbol) + 1)]  # first word of each symbol, by level
        while True:
            level = self.levels[-1]
            same = level.symbol[1:] == level.symbol[:-1]
            inner = ~(fence[1:] | fence[:-1])
            if not inner.any():
                break
            level.blocks = bool(same.any())
            glued = same if level.blocks else self._paired(level.symbol, inner)
            first = np.flatnonzero(np.r_[True, ~glued])
            size = np.diff(np.r_[first, len(level.symbol)])
            other = size if level.blocks else np.where(size == 2, level.symbol[np.minimum(first + 1, len(level.symbol) - 1)] + 1, 0)
            key = level.symbol[first] * (int(other.max()) + 1) + other
            level.begin, level.up = np.r_[first, len(level.symbol)], np.cumsum(np.r_[0, ~glued].astype(np.int64))
            self.levels.append(Level(np.unique(key, return_inverse=True)[1].astype(np.int64)))
            self.word.append(self.word[-1][level.begin])
            fence = fence[first]

    def _paired(self, symbol: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Places glued to the next one; of a few partitions of the alphabet by hashes, the one that pairs most."""
        best, most = np.zeros(len(inner), bool), 0
        seed = len(self.levels) * SEEDS
        while not most:
            for seed in range(seed, seed + SEEDS):
                side = (mixed(symbol.astype(np.uint64) + np.uint64((seed + 1) << 40)) >> np.uint64(63)).astype(bool)
                for left in (side, ~side):
                    glued = left[:-1] & ~left[1:] & inner
                    n = int(glued.sum())
                    if n > most:
                        best, most = glued, n
            seed += 1
        return best

    def extension(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """Number of equal words from places a and b on (forward), or up to and including them (backward); a < b."""
        a, b = a.copy(), b.copy()
        start, step = a.copy(), 1 if forward else -1
        stop = np.full(len(a), -1)  # the level at which the symbols first differed
        live = np.arange(len(a))
        for n, level in enumerate(self.levels):
            more = live
            while len(more):
                more = more[~self._aligned(level, a[more], b[more], forward)]
                equal = level.symbol[a[more]] == level.symbol[b[more]]
                stop[more[~equal]] = n
                more = more[equal]
                move = step * self._steps(level, a[more], b[more], forward)
                a[more] += move
                b[more] += move
            live = live[stop[live] < 0]
            if n + 1 < len(self.levels):
                a[live], b[live] = level.up[a[live]], level.up[b[live]]
        for n in range(len(self.levels) - 1, 0, -1):
            level, down = self.levels[n - 1], np.flatnonzero(stop >= n)
            for x in (a, b):
                x[down] = level.begin[x[down]] if forward else level.begin[x[down] + 1] - 1
            more = down
            while len(more):
                more = more[level.symbol[a[more]] == level.symbol[b[more]]]
                move = step * self._steps(level, a[more], b[more], forward)
                a[more] += move
                b[more] += move
        return (a - start) * step

    @staticmethod
    def _aligned(level: Level, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """Whether both places are at the near ends of their groups, so that the next level can go on from there."""
        if not len(level.up):
            return np.zeros(len(a), bool)
        if forward:
            return (level.begin[level.up[a]] == a) & (level.begin[level.up[b]] == b)
        return (level.begin[level.up[a] + 1] == a + 1) & (level.begin[level.up[b] + 1] == b + 1)

    @staticmethod
    def _steps(level: Level, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray | int:
        """How many equal symbols can be passed at once: in blocks, as many as both still have."""
        if not level.blocks:
            return 1
        if forward:
            return np.minimum(level.begin[level.up[a] + 1] - a, level.begin[level.up[b] + 1] - b)
        return np.minimum(a - level.begin[level.up[a]], b - level.begin[level.up[b]]) + 1


def candidates(symbol: np.ndarray, begin: np.ndarray, size: np.ndarray, periods: int) -> Iterator[tuple[np.ndarray, int]]:
    """(grid places, period): places x, x + q, ... with equal words, `periods` of them. Texts are in falling order of size."""
    longest, reach = int(size[0]) if len(size) else 0, len(size)
    for q in range(1, longest // periods + 1):
        while size[reach - 1] < periods * q:
            reach -= 1
        grid = symbol[: begin[reach - 1] + size[reach - 1] : q]
        hits = np.flatnonzero(grid[1:] == grid[:-1])
        if len(hits) > periods - 2:
            ahead = periods - 2  # so many hits in a row behind the first one
            place = hits[: len(hits) - ahead][hits[ahead:] - hits[: len(hits) - ahead] == ahead] * q
            text = np.searchsorted(begin, place, side="right") - 1
            yield place[place + (periods - 1) * q < begin[text] + size[text]], q


def runs_of(symbol: np.ndarray, fence: np.ndarray, begin: np.ndarray, size: np.ndarray, min_length: int, periods: int) -> np.ndarray:
    """(start, end, period) rows of all runs, by start and period; places count fences."""
    found = [(x, np.full(len(x), q)) for x, q in candidates(symbol, begin, size, periods) if len(x)]
    if not found:
        return np.zeros((0, 3), np.int64)
    place, period = (np.concatenate(x) for x in zip(*found))
    wanted = np.unique(np.searchsorted(begin, place, side="right") - 1)  # texts with a candidate; only they get a grammar
    kept = np.zeros(len(begin), bool)
    kept[wanted] = True
    mask = np.repeat(np.r_[kept, True], np.r_[size + 1, 1])  # each fence goes with the text behind it
    old = np.flatnonzero(mask)
    grammar = Grammar(np.unique(symbol[old], return_inverse=True)[1].astype(np.int64), fence[old])
    place = np.searchsorted(old, place)
    out = np.zeros((0, 3), np.int64)
    for at in range(0, len(place), QUERIES):
        x, q = place[at : at + QUERIES], period[at : at + QUERIES]
        start = x - grammar.extension(x - 1, x - 1 + q, forward=False)
        end = x + q + grammar.extension(x, x + q)
        long = end - start >= np.maximum(min_length, periods * q)
        out = np.concatenate([out, np.stack([start, end, q], axis=1)[long]])
        out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
        out = out[np.r_[True, np.any(out[1:, :2] != out[:-1, :2], axis=1)][: len(out)]]  # the least period of a stretch
    out[:, 0], out[:, 1] = old[out[:, 0]], old[out[:, 1] - 1] + 1
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """(id_col, n_words, runs array<struct<start,length,period>>, collapsed): the maximal runs of every text, and the text
    with each run cut to its first period.

    Words are runs of bytes other than space and 0x09-0x0D, as they stand. A run is a stretch of words with least period q,
    at least `min_periods` q and `min_length` long, that no neighbouring word continues; runs are ordered by start, then
    period. `collapsed` has the words that no run holds behind its first period, joined by one space. Null, empty and
    wordless texts have no runs and an empty `collapsed`. Rows that share an id are read each; other columns are ignored.
    """
    if min_periods < 2:
        raise ValueError("a run has at least two periods")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = [(x.as_py() or "").encode().split() for x in b.column("text")]
            count = np.fromiter(map(len, texts), np.int64, len(texts))
            order = np.argsort(-count, kind="stable")
            symbol, fence, begin = fenced(numbered([texts[i] for i in order]), count[order])
            found = runs_of(symbol, fence, begin, count[order], min_length, min_periods)
            text = np.searchsorted(begin, found[:, 0], side="right") - 1
            found[:, :2] -= begin[text][:, None]
            lines: list[list[dict]] = [[] for _ in texts]
            for t in np.unique(text).tolist():
                i, own = int(order[t]), found[text == t]
                gone = np.zeros(count[i] + 1, np.int64)
                np.add.at(gone, own[:, 0] + own[:, 2], 1)
                np.add.at(gone, own[:, 1], -1)
                texts[i] = [texts[i][k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                lines[i] = [{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()]
            collapsed = [b" ".join(own).decode() for own in texts]
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), pa.array(lines, kinds), pa.array(collapsed, pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, schema)


def runs_text(runs: Column) -> Column:
    """One line `start,length,period` per run, each with its line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_tail_repeated(text: Column, number: Column) -> Column:
    """The text's words, where `number` is divisible by ten, with those from a place on replaced by repeats of the first few.

    With g = number div 10 and n words, the place is a = g mod n and the repeated stretch 1 + (n - a) div (3 + g mod 8) words.
    Other texts, and those without words or with a null number, stay as they are.
    """
    words, g = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)")), F.floor(number / 10)

    def repeated(own: Column) -> Column:
        n = F.size(own)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(own, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    changed = F.element_at(F.transform(F.array(words), lambda own: F.when(F.size(own) > 0, repeated(own)).otherwise(text)), 1)
    return F.when(F.pmod(number, F.lit(10)) == 0, changed).otherwise(text)
