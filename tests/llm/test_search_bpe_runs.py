"""Ranked search, byte-pair encoding and periodic runs against brute force, the tokenizers library and small cases."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from stormline.llm import bpe, lexical, periodic
from stormline.llm.queries import QUERIES, table, tokenizer

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = tokenizer("word_bpe_49k.json")["path"]


def search(docs, items, k):
    """Rows (item, rank, id, score), documents and items given as (id, text) pairs."""
    texts = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n_docs, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in texts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(TERM.findall((text or "").translate(LOW))) & c.keys()
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_search_of_the_tables(spark):
    docs, items = ([tuple(r) for r in table(spark, SF, t).select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert found(QUERIES["op11_lexical_search"](spark, SF)) == search(docs, items, 10)


def test_search_cases(spark):
    docs = [(1, "Cat cat-dog"), (2, "cat, CAT dog"), (2, "cat, CAT dog"), (3, None), (4, ""), (5, " .,;"), (6, "caté cat2 日本 x"), (None, "cat dog"), (7, "cat\x00dog\x7fcat"), (8, "z " * 5000 + "cat")]
    items = [(1, "cat cat dog"), (2, "CAT!"), (2, "CAT!"), (3, None), (4, "…"), (5, "unknown"), (6, "日本 caté"), (7, "-")]
    given = frame(spark, docs, "doc_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS item", "4 AS item_id")
    asked = frame(spark, items, "item_id int, text string").selectExpr("*", "1 AS doc_id")
    for k in (1, 3, 10):
        for block in (1, 1 << 20):
            assert found(lexical.ranked(given, asked, k=k, block_bytes=block)) == search(docs, items, k)
    assert not lexical.ranked(given.limit(0), asked).collect() and not lexical.ranked(given, asked.limit(0)).collect()
    assert lexical.ranked(given, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_keeps_the_best_over_many_batches(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))) for i in range(400)]
    items = [(i, " ".join(rng.choice("abcdefghi") for _ in range(3))) for i in range(150)]
    monkeypatch.setattr(lexical, "CELLS", 30)
    monkeypatch.setattr(lexical, "SLICE_ITEMS", 7)
    got = lexical.ranked(frame(spark, docs, "doc_id long, text string").repartition(3), frame(spark, items, "item_id long, text string"), k=4)
    assert found(got) == search(docs, items, 4)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoding_of_the_tables(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_bpe"](spark, SF).collect()}
    want = {}
    for r in table(spark, SF, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest())
    assert got == want


def test_encoding_of_odd_texts(spark, library):
    rng = random.Random(1)
    alphabets = ["ab", "a", "thein r", "abcdefghijklmnopqrstuvwxyz' ", "éüßñİΣς日本語́\x1c\x85\xa0　 \t\n\x0b", "'sre<>|/w-_.,!😀ﬁA̧ 0123456789"]
    rows = [(i, "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "x<|endoftext|>y <|startoftext|>"), (304, "</w> w</w>"), (305, "ab" * 60_000), (306, "the " * 60_000), (306, "again"), (None, "x")]
    given = frame(spark, rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decimal")
    encoded = bpe.encode(given, path=PATH)
    got = sorted(((r.doc_id or -1, r.ids, r.decimal, r.text) for r in bpe.decode(encoded, path=PATH).collect()), key=str)
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i or -1, ids, " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert not bpe.decode(bpe.encode(given.limit(0), path=PATH), path=PATH).collect()
    assert [tuple(r) for r in bpe.decode(frame(spark, [(1, None)], "doc_id long, ids array<int>"), path=PATH).select("decimal", "text").collect()] == [("", "")]


def merged(word, pairs):
    """Merges in order of rank, the leftmost of equals first."""
    own = list(word)
    while True:
        best = min(((pairs[a, b], i) for i, (a, b) in enumerate(zip(own, own[1:])) if (a, b) in pairs), default=None)
        if best is None:
            return own
        own[best[1] : best[1] + 2] = [own[best[1]] + own[best[1] + 1]]


def test_backtracking_with_random_merges():
    rng = random.Random(2)
    for _ in range(60):
        vocabulary, merges = {c: i for i, c in enumerate("abc")}, []
        for _ in range(12):  # learn from merged words, as a training would
            own = [merged("".join(rng.choice("abc") for _ in range(8)), {m: i for i, m in enumerate(merges)}) for _ in range(4)]
            seen = Counter(p for w in own for p in zip(w, w[1:]) if p[0] + p[1] not in vocabulary)
            if seen:
                a, b = max(seen, key=lambda p: (seen[p], p))
                merges.append((a, b))
                vocabulary[a + b] = len(vocabulary)
        encoder, ranks, names = bpe.Merges(vocabulary, merges), {m: i for i, m in enumerate(merges)}, {i: t for t, i in vocabulary.items()}
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
            assert [names[i] for i in encoder.encode(word)] == merged(word, ranks)


def runs(words, min_length=6, periods=4):
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(min_length, periods * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, own):
    gone = {i for s, n, q in own for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_the_tables(spark):
    want = {}
    for r in table(spark, SF, "documents").collect():
        words, h = WORD.findall(r.text or ""), crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        own = runs(words)
        s, length, q = min(own, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in own)
        digests = [sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, own))]
        want[r.doc_id] = (len(own), s, length, q, 1000 * length // q if q else None, *digests)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert got == want and sum(x[0] for x in want.values()) > 0


@pytest.mark.parametrize("periods,min_length", [(2, 2), (3, 3), (4, 6)])
def test_runs_of_random_words(spark, periods, min_length):
    rng, rows = random.Random(periods), []
    for i in range(200):
        letters = "abcde"[: rng.choice([1, 2, 3, 5])]
        words = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 120]))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = [rng.choice(letters) for _ in range(rng.randint(1, 8))] * rng.randint(2, 8)
        rows.append((i, words))
    given = frame(spark, [(i, rng.choice([" ", "\n", " \t"]).join(w)) for i, w in rows], "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS collapsed")
    got = {r.doc_id: r for r in periodic.periodic_runs(given, min_length=min_length, min_periods=periods).collect()}
    for i, words in rows:
        own = runs(words, min_length, periods)
        assert [tuple(x) for x in got[i].runs] == own and got[i].collapsed == collapsed(words, own) and got[i].n_words == len(words)


def test_runs_cases(spark):
    long = " ".join(str(i) for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a"), (5, "a a a a a a"), (6, "a b " * 40_000), (7, long), (7, long + " x" * 9), (None, "é é é é é é é z"), (9, "A a A a A a A a")]
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed[-9:]) for r in periodic.periodic_runs(frame(spark, rows, "doc_id long, text string")).collect())
    want = [(0, 8, [(0, 7, 1)], "é z"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 5, [], "a a a a a"), (5, 6, [(0, 6, 1)], "a"), (6, 80_000, [(0, 80_000, 2)], "a b"),
            (7, 50_000, [], long[-9:]), (7, 50_009, [(50_000, 9, 1)], (long + " x")[-9:]), (9, 8, [(0, 8, 2)], "A a")]
    assert got == sorted(want)
    assert not periodic.periodic_runs(frame(spark, [], "doc_id long, text string")).collect()
    with pytest.raises(ValueError):
        periodic.periodic_runs(frame(spark, [], "doc_id long, text string"), min_periods=1)


def test_extensions_of_a_grammar():
    rng = np.random.default_rng(4)
    for letters, n in ((1, 30), (2, 90), (3, 300)):
        words = rng.integers(0, letters, n)
        symbol, fence, begin = periodic.fenced(words, np.array([n]))
        grammar = periodic.Grammar(symbol, fence)
        a, b = np.triu_indices(n, 1)
        ahead, back = grammar.extension(a + 1, b + 1), grammar.extension(a + 1, b + 1, forward=False)
        for i, j, x, y in zip(a, b, ahead, back):
            want = next((k for k in range(n - j) if words[i + k] != words[j + k]), n - j)
            assert x == want
            assert y == next((k for k in range(i + 1) if words[i - k] != words[j - k]), i + 1)
