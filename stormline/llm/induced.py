"""Suffix sorting of one shard by induced sorting with bucket queues, in memory or on disk.

The priority queue of an induced sort hands out suffixes in the order of (first character, rank of what follows). As
ranks only grow while the queue is read, it is a queue per first character: suffix tuples are appended to the queue of
the character before them and leave in the order in which they came. The queues are read and written in whole blocks
with numpy; with a memory bound they, the text and its packed words live in an unlinked scratch file of the task.

Sorting goes as deep as `depth` characters at least, which is all that a match of fixed length needs: the string of
substring names is ordered by pairs of names of doubling length until they cover the depth.
"""

from __future__ import annotations

import tempfile

import numpy as np

BLOCK = 1 << 20
ALPHABET, PER_WORD = 257, 7  # 0 separates strings, a byte b is b + 1; characters of 9 bits in a word of 63


class Store:
    """Blocks and arrays in memory, or beyond `memory_bytes` of text in a scratch file that goes with the task."""

    def __init__(self, size: int, memory_bytes: int):
        self.file = tempfile.TemporaryFile(prefix="suffix-") if size > memory_bytes else None

    def put(self, block: np.ndarray):
        if self.file is None:
            return block
        at = self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(block).data)
        return at, len(block), block.dtype

    def get(self, held) -> np.ndarray:
        if self.file is None:
            return held
        at, n, kind = held
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind)

    def mapped(self, array: np.ndarray) -> np.ndarray:
        if self.file is None or not len(array):
            return array
        self.file.seek(0, 2)
        pad = -self.file.tell() % 4096
        self.file.write(b"\0" * pad)
        at = self.file.tell()
        self.file.write(np.ascontiguousarray(array).data)
        self.file.flush()
        return np.memmap(self.file, array.dtype, "r", at, array.shape)


def packed_words(text: np.ndarray) -> np.ndarray:
    """Seven characters from each place on as one number; beyond the end there are zeros."""
    long = np.r_[text, np.zeros(PER_WORD, text.dtype)].astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(PER_WORD):
        out = (out << np.uint64(9)) | long[k : k + len(text)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next one; the last is not."""
    n = len(text)
    where = np.where(np.r_[text[:-1] != text[1:], True], np.arange(n), n)
    settled = np.minimum.accumulate(where[::-1])[::-1]
    rises = np.r_[text[:-1] < text[1:], False]
    return rises[settled]


def induced(text: np.ndarray, seeds: np.ndarray, store: Store) -> np.ndarray:
    """All suffixes in order, induced from the sorted places where a rise begins."""
    n = len(text)
    first = np.searchsorted(text[seeds], np.arange(ALPHABET + 1)) if len(seeds) else np.zeros(ALPHABET + 1, np.int64)
    falling: list[list] = [[] for _ in range(ALPHABET)]
    rising: list[list] = [[] for _ in range(ALPHABET)]

    def push(queues: list[list], block: np.ndarray, least: int, most: int) -> None:
        before = block[block > 0] - 1
        char = text[before]
        fits = (char >= least) & (char <= most)
        before, char = before[fits], char[fits]
        order = np.argsort(char, kind="stable")
        before, ends = before[order], np.cumsum(np.bincount(char, minlength=ALPHABET))
        for c in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            queues[c].append(store.put(before[ends[c - 1] if c else 0 : ends[c]]))

    def waiting(queue: list, at: int) -> tuple[np.ndarray, int]:
        """The next blocks of a queue as one, up to about BLOCK suffixes."""
        taken, n = [], 0
        while at < len(queue) and n < BLOCK:
            taken.append(store.get(queue[at]))
            n += len(taken[-1])
            at += 1
        return (taken[0] if len(taken) == 1 else np.concatenate(taken)), at

    falling[int(text[-1])].append(store.put(np.array([n - 1], seeds.dtype)))
    for c in range(ALPHABET):
        at = 0
        while at < len(falling[c]):  # grows while it is read
            block, at = waiting(falling[c], at)
            push(falling, block, c, ALPHABET)
        if first[c] < first[c + 1]:
            push(falling, seeds[first[c] : first[c + 1]], c + 1, ALPHABET)
    parts = []
    for c in reversed(range(ALPHABET)):
        at = 0
        while at < len(rising[c]):
            block, at = waiting(rising[c], at)
            push(rising, block, 0, c)
        own = [store.get(x) for x in falling[c]]
        for block in reversed(own):
            push(rising, block[::-1], 0, c - 1)
        parts += [store.get(x) for x in rising[c]] + [x[::-1] for x in reversed(own)]
    return np.concatenate(parts)[::-1] if parts else np.zeros(0, seeds.dtype)


def names(words: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For sorted substrings (places and lengths) a number each, equal for equal substrings."""
    same = length[1:] == length[:-1]
    i, at = np.flatnonzero(same), 0
    while len(i):
        left = length[i] - at
        drop = np.maximum(PER_WORD - left, 0).astype(np.uint64) * np.uint64(9)
        equal = words[order[i] + at] >> drop == words[order[i + 1] + at] >> drop
        same[i[~equal]] = False
        at += PER_WORD
        i = i[equal & (left > PER_WORD)]
    return np.cumsum(np.r_[0, ~same])


def ordered_names(name: np.ndarray, units: int) -> np.ndarray:
    """Places of a string of names, sorted by at least `units` names from each place on."""
    n = len(name)
    order = np.argsort(name, kind="stable")
    begin = np.r_[True, name[order][1:] != name[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(begin)[np.cumsum(begin) - 1]
    k = 1
    while k < units:
        size = np.bincount(rank, minlength=n)
        open_places = np.flatnonzero(size[rank] > 1)
        if not len(open_places):
            break
        a = rank[open_places]
        beyond = open_places + k
        b = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        by = np.lexsort((b, a))
        a, b, at = a[by], b[by], open_places[by]
        group = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        inside = np.arange(len(a)) - np.repeat(group, np.diff(np.r_[group, len(a)]))
        fresh = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        rank[at] = np.repeat((a + inside)[fresh], np.diff(np.r_[fresh, len(a)]))
        k *= 2
    return np.argsort(rank, kind="stable")


def suffix_order(text: np.ndarray, depth: int, memory_bytes: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first `depth` characters at least, packed words) of a text that ends with 0."""
    kind = np.int32 if len(text) < 2**31 - 1 else np.int64
    store = Store(text.nbytes, memory_bytes)
    text = store.mapped(text)
    words = store.mapped(packed_words(text))
    smaller = smaller_than_next(text)
    seeds = np.flatnonzero(smaller & ~np.r_[True, smaller[:-1]]).astype(kind)
    if len(seeds) > 1:
        rough = induced(text, seeds[np.argsort(text[seeds], kind="stable")], store)
        number = np.full(len(text), -1, kind)
        number[seeds] = np.arange(len(seeds))
        rank = number[rough]
        by_substring = rank[rank >= 0]
        length = np.diff(np.r_[seeds, len(text) - 1]) + 1
        name = np.empty(len(seeds), np.int64)
        name[by_substring] = names(words, seeds[by_substring].astype(np.int64), length[by_substring].astype(np.int64))
        seeds = seeds[ordered_names(name, -(-depth // 2) + 1)]
    return induced(text, seeds, store), words


def match_groups(order: np.ndarray, words: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """A number for each of the sorted suffixes, equal for those that begin with the same `size` characters."""
    same = np.ones(max(len(order) - 1, 0), bool)
    for at in [*range(0, size - PER_WORD + 1, PER_WORD), max(size - PER_WORD, 0)]:
        own = words[order + at]
        if size < PER_WORD:
            own = own >> np.uint64(9 * (PER_WORD - size))
        same &= own[1:] == own[:-1]
    return np.cumsum(np.r_[0, ~same]) if len(order) else np.zeros(0, np.int64)
