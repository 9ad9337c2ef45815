"""Queries with a SQL text agree with it; the others are compared with brute force or held-out labels."""

import re
from collections import Counter
from zlib import crc32

import pytest
import xxhash

from queries.compare import compare, connect
from stormline.llm import simhash
from stormline.llm.queries import QUERIES, SQL, table, tokenizer

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], SQL[name], SF) == ""


def fingerprint(text, k):
    own = WORDS.findall((text or "").translate(LOW))
    shingles = [" ".join(own[i : i + k]) for i in range(max(1, len(own) - k + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_query(spark):
    docs = documents(spark)
    fp = {i: fingerprint(r.text, 4) for i, r in docs.items()}
    want = least_reachable(sorted(docs), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, SF).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in docs}


def test_suffix_query(spark):
    from hashlib import sha256

    docs, first = documents(spark), {}
    for i in sorted(docs):
        body = docs[i].text.encode()
        for k in range(len(body) - 49):
            first.setdefault(body[k : k + 50], i)
    want = {}
    for i, r in docs.items():
        body = r.text.encode()
        gone = bytearray(len(body))
        for k in range(len(body) - 49):
            if first[body[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(body, gone) if not g)
        want[i] = (len(body), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op5_suffix_dedup"](spark, SF).collect()}
    assert got == want


def test_packing_query(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer()["path"])
    t.encode_special_tokens = True
    rows = QUERIES["op9_packing"](spark, SF).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    import numpy as np

    for i, doc in documents(spark).items():
        ids = np.array([*t.encode(doc.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += at
    assert total >= 0.97 * 1024 * len(sequences)


def test_language_query(spark):
    docs = documents(spark)
    got = QUERIES["op4_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(held) >= 0.97 * len(held)


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    got = QUERIES["op6_quality"](spark, SF).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in got)
    held = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert sum(held) >= 0.9 * len(held)


def shingles(own, k):
    k = min(k, len(own))
    return Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1))


def best_window(text, item):
    own, wanted = WORDS.findall((text or "").translate(LOW)), WORDS.findall((item or "").translate(LOW))
    want, best = shingles(wanted, 5), (0.0, 0)
    for i in range(len(own) - len(wanted) + 1 if wanted else 0):
        have = shingles(own[i : i + len(wanted)], 5)
        if have.keys() & want.keys():
            both = sum((have & want).values())
            best = max(best, (both / (sum(have.values()) + sum(want.values()) - both), -i))
    return best


def test_decontamination_query(spark):
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    want = {}
    for i, doc in documents(spark).items():
        for j, item in items.items():
            same, at = best_window(doc.text, item)
            if same >= 0.8:
                want[i, j] = (-at, pytest.approx(same))
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    assert got == want and got


def test_pipeline(spark):
    """Stage by stage against brute force; the classifier's decisions are taken as they are."""
    import corpus_pipeline as c

    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    kept = {}
    for name, stage in c.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = c.materialise(stage(spark, docs, SF))
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            break
        assert docs.columns == c.COLUMNS
        kept = {r.doc_id: r for r in docs.collect()}
        gone = set(before) - set(kept)
        if name == "quality":
            assert all(labels.get(i) != 1 for i in gone) and gone >= {i for i, q in labels.items() if q == 0}
        elif name == "line_dedup":
            assert not gone and all(r.n_chars == len(r.text) for r in kept.values())
            lines = Counter(x for r in kept.values() for x in r.text.split("\n") if len(re.split(" +", x.strip())) >= 30)
            assert max(lines.values()) == 1
        elif name == "near_dedup":
            have = {i: frozenset(shingles(WORDS.findall(r.text.translate(LOW)), 5)) for i, r in before.items()}

            def near(a, b):
                both = len(have[a] & have[b])
                return both >= 0.8 * (len(have[a]) + len(have[b]) - both)

            assert set(kept) == set(least_reachable(sorted(before), near).values())
        else:
            assert gone == {i for i, r in before.items() if any(best_window(r.text, x)[0] >= 0.8 for x in items)}
    assert kept
