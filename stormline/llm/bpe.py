"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton of all tokens gives, in one pass over a word, the longest token from each place. The encoder
takes them from left to right. A token may follow another one only if merging the two pieces' symbols would have left
the border between them alone, which a table of token pairs remembers; otherwise the next shorter token that begins
alike is tried, and when there is none, the token before is taken back and the place marked as closed. Each place is
closed at most once, so a word costs linear time, and the one segmentation whose neighbours all agree is that of the
merges in order of rank.

Symbols are bytes; a word's last symbol carries the end mark of the vocabulary. Texts are cut at ASCII white space, over
which neither normalisation nor the pattern of words reaches; a part is normalised and cut into words by the tokenizer's
own rules, and its ids are remembered. Ids become text by slices of one table of bytes: where each token begins, and how
long it is.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

CACHE_PARTS, CACHE_BYTES, CACHE_PAIRS = 250_000, 64, 1 << 20
PLAIN = "\u0250"  # characters before this one are normalised as they are, and of one kind in every version of Unicode
END = 256  # a byte b that ends a word is the symbol b + END


def byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable ones stand for themselves, the others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Tokens with their symbols, parts and ranks, and the segmentation of words into them."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end_mark: str = ""):
        letters, size = byte_letters(), max(vocabulary.values(), default=-1) + 1
        self.symbols: list[str] = [""] * size
        self.left, self.right, self.rank = list(range(size)), list(range(size)), [0] * size
        for letter, byte in letters.items():
            if letter in vocabulary:
                self.symbols[vocabulary[letter]] = chr(byte)
            if end_mark and letter + end_mark in vocabulary:
                self.symbols[vocabulary[letter + end_mark]] = chr(byte + END)
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges, 1):
            x, y, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.symbols[made] = self.symbols[x] + self.symbols[y]
            self.left[made], self.right[made], self.rank[made] = x, y, rank
            self.pairs[x, y] = rank
        self.size = list(map(len, self.symbols))
        self.alphabet = {s: i for i, s in enumerate(self.symbols) if len(s) == 1}
        known = {s: i for i, s in enumerate(self.symbols) if s}
        self.shorter = [next((known[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in known), -1) for s in self.symbols]
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in known.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.agree: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens a and b alone."""
        key = a * len(self.symbols) + b
        known = self.agree.get(key)
        if known is None:
            if len(self.agree) >= CACHE_PAIRS:
                self.agree.clear()
            known = self.agree[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Undo merges next to the border, latest first: a pair across it must never have come before both its parts went.

        The part on the left goes by a merge of `until_a`, the one on the right by a merge of `until_b`; of equal merges
        the leftmost comes first, so a tie is won by the left part's and lost by the right part's.
        """
        never = len(self.pairs) + 1
        until_a = until_b = never
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < until_a and across <= until_b:
                return False
            if self.size[a] == 1 and self.size[b] == 1:
                return True
            if self.rank[a] > self.rank[b]:
                a, until_a = self.right[a], self.rank[a]
            else:
                b, until_b = self.left[b], self.rank[b]

    def encode(self, word: str) -> list[int]:
        """Ids of one word, given as symbols that all are in the alphabet."""
        size, shorter, fits, agree, base = self.size, self.shorter, self.fits, self.agree, len(self.symbols)
        chain = [token for _, token in self.automaton.iter_long(word)]  # longest matches, one behind another
        for a, b in zip(chain, chain[1:]):
            if not (agree.get(a * base + b) or fits(a, b)):
                break
        else:
            if sum([size[token] for token in chain]) == len(word):
                return chain
        longest = [0] * (len(word) + 1)
        for end, token in self.automaton.iter(word):  # of matches from one place the longest comes last
            longest[end - size[token] + 1] = token
        closed = bytearray(len(word) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(word):
            end = at + size[token]
            if not closed[end] and (not out or agree.get(key := out[-1] * base + token) or key not in agree and fits(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:
                closed[at] = 1
                last = out.pop()
                at -= size[last]
                token = shorter[last]
        return out


class Recent:
    """At most twice `size` remembered values; when `new` is full it becomes `old`, from which what is used again comes back."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new.copy(), self.new
            self.new.clear()
        self.new[key] = value


def simple_words(rules: dict):
    """A function from lower-cased text of plain characters to its words, where the file's rules are known to come to that; else None."""
    steps = {x: [(r["type"], r.get("pattern", {}).get("Regex"), r.get("content"), r.get("behavior"), r.get("invert"), r.get("add_prefix_space"), r.get("use_regex"))
                 for r in (rules.get(x) or {}).get(y, [])] for x, y in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))}
    blank = (None, None, None, None)
    kept = [("NFC", None, None, *blank), ("Replace", r"\s+", " ", *blank), ("Lowercase", None, None, *blank)]
    match steps["pre_tokenizer"]:
        case [("Split", str(pattern), None, "Removed", True, None, None), ("ByteLevel", None, None, None, None, False, False)] if steps["normalizer"] == kept:
            import regex

            return regex.compile(pattern).findall
    return None


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them for the file at `path`."""

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, added = rules["model"], rules["added_tokens"]
        if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError(f"{path} has added tokens with rules of their own")
        self.mark = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, self.mark)
        self.letters = byte_letters()
        if len(self.merges.alphabet) < 256 * (1 + bool(self.mark)):
            raise ValueError(f"{path} has no token for some byte")
        self.normalise = own.normalizer.normalize_str if own.normalizer else str
        self.cut = own.pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.simple = simple_words(rules)
        self.parts, self.words = Recent(cache_parts), Recent(cache_parts)

    def word(self, symbols: str) -> bytes:
        """Ids of a word, one symbol per byte, still without the end mark; as 32-bit numbers."""
        ids = self.words.old.get(symbols)
        if ids is None:
            marked = symbols[:-1] + chr(ord(symbols[-1]) + END) if self.mark else symbols
            ids = array("I", self.merges.encode(marked)).tobytes()
        if len(symbols) <= CACHE_BYTES:
            self.words.put(symbols, ids)
        return ids

    def plain(self, text: str) -> bytes:
        if self.simple and (text.isascii() or max(text) < PLAIN):
            pieces = [x.encode().decode("latin-1") for x in self.simple(text.lower())]
        else:
            pieces = ["".join([chr(self.letters[c]) for c in piece]) for piece, _ in self.cut(self.normalise(text))]
        get, word = self.words.new.get, self.word
        return b"".join([get(piece) or word(piece) for piece in pieces])

    def part(self, raw: bytes) -> bytes:
        """Ids of a part without ASCII white space, as 32-bit numbers."""
        out = self.parts.old.get(raw)
        if out is None:
            text = raw.decode()
            pieces = self.split.split(text) if self.split and self.split.search(text) else [text]
            out = b"".join([array("I", [self.added[x]]).tobytes() if at % 2 else self.plain(x) for at, x in enumerate(pieces) if x])
        if len(raw) <= CACHE_BYTES:
            self.parts.put(raw, out)
        return out

    def __call__(self, text: str) -> np.ndarray:
        get, part = self.parts.new.get, self.part
        return np.frombuffer(b"".join([x if (x := get(p)) is not None else part(p) for p in text.encode().split()]), "<u4")


class Table:
    """One byte string per id, in one buffer with offsets; ids become the strings with a space between two."""

    def __init__(self, strings: list[bytes]):
        size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        self.size, self.begin = size, np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(s + b" " for s in strings), np.uint8)

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each row ends in them) for rows of ids one behind another; each row has a space behind its last string."""
        size = self.size[ids]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        place = np.repeat(self.begin[ids] - (upto - size), size)
        place += np.arange(total)
        return self.data[place], np.r_[0, upto][ends]


def token_strings(path: str) -> list[bytes]:
    """The string of each id, as decoding shows it; ids without a token are empty."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    if rules.get("decoder") is not None:
        raise ValueError(f"{path} has a decoder; only plain joining is known")
    named = rules["model"]["vocab"] | {t["content"]: t["id"] for t in rules["added_tokens"]}
    out = [b""] * (max(named.values()) + 1)
    for token, i in named.items():
        out[i] = token.encode()
    return out


def texts_of(table: Table, rows: list[np.ndarray]) -> pa.Array:
    """One string per row of ids."""
    ends = np.cumsum([len(r) for r in rows])
    data, stops = table.joined(np.concatenate(rows) if rows else np.zeros(0, np.uint32), ends)
    raw, starts = data.tobytes(), [0, *stops.tolist()]
    return pa.array([raw[a : max(a, b - 1)] for a, b in zip(starts, stops.tolist())], pa.large_binary()).cast(pa.large_string()).cast(pa.string())


def encode(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the token ids of every text as array<int>.

    Null and empty texts have no ids. Strings of added tokens in a text are those tokens, as in the library. Rows
    that share an id are encoded each; other columns are ignored. The file at `path` is read where the tasks run.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Encoder(path)
        for b in slices(batches, "text"):
            rows = [code(x.as_py() or "").view(np.int32) for x in b.column("text")]
            ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(rows: DataFrame, *, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, decimal, text): the ids in decimal and their tokens' strings, each joined by one space.

    Null and empty lists of ids give empty strings. Added tokens are shown. An id beyond the vocabulary is an error.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = token_strings(path)
        tokens, numbers = Table(strings), Table([b"%d" % i for i in range(len(strings))])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [np.zeros(0, np.int32) if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts_of(numbers, own), texts_of(tokens, own)], names=[id_col, "ids", "decimal", "text"])

    return rows.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decimal string, text string")
