"""Wide sketches: bit-sliced comparison and the groups of near-duplicates against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from stormline.llm import simhash, sketches


def edited(rng, words, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"new{rng.integers(1 << 40)}"
    return out


def brute(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and simhash.jaccard(texts[i], texts[j], 5) >= 0.8:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    return root


@pytest.mark.parametrize("cell", [32768, 17])
def test_groups_equal_brute_force(spark, cell):
    """Half-similar texts stand between copies; links come in rounds and in cells."""
    rng, texts = np.random.default_rng(5), []
    for family in range(3):
        base = [f"w{family}x{i}" for i in range(200)]
        for _ in range(8):
            like = edited(rng, base, 5)
            texts += [" ".join(like), " ".join(like).upper(), *(" ".join(edited(rng, like, 2)) for _ in range(2))]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r.component for r in sketches.near_duplicates(df, cell_rows=cell).collect()}
    want = dict(enumerate(brute(texts)))
    assert got == want and 3 < len(set(want.values())) < len(texts)


def test_odd_rows(spark, tmp_path):
    """Null, empty and wordless texts are one group; null ids name none beside others; repeated rows stay; other columns are ignored."""
    long = " ".join(f"v{i}" for i in range(50_000))
    rows = [(5, None), (4, ""), (6, " \t"), (None, "alone here"), (None, "one two three"), (3, "One two  three"), (3, "One two  three"), (8, long), (7, long + " more"), (9, "x")]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id int, text string, label int, component string")
    got = sorted(map(tuple, sketches.near_duplicates(df).collect()), key=repr)
    want = [(5, 4), (4, 4), (6, 4), (None, None), (None, 3), (3, 3), (3, 3), (8, 7), (7, 7), (9, 9)]
    assert got == sorted(want, key=repr)
    assert sketches.near_duplicates(df.limit(0)).count() == 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    bits[1::3] = bits[0::3] ^ (np.uint64(1) << rng.integers(0, 64, (100, 2)).astype(np.uint64))
    sliced = np.pad(sketches.planes(bits), ((0, 0), (0, 8)))
    shifts = np.arange(1, 200)
    live = np.arange(320)[None, :] + shifts[:, None] < 300
    near = sketches.within(sliced, shifts, np.packbits(live, axis=1, bitorder="little").view(np.uint64), 53)
    got = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little").astype(bool)
    for s in shifts.tolist():
        apart = np.bitwise_count(bits[:-s] ^ bits[s:]).sum(axis=1)
        assert (got[s - 1, : 300 - s] == (apart <= 53)).all() and not got[s - 1, 300 - s :].any()


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall(similarity):
    """Of pairs just at the similarity at least 0.95 share a bucket and lie within both radii."""
    rng, texts = np.random.default_rng(11), []
    for i in range(1500):
        n = int(rng.integers(9, 400))
        both = int(np.ceil(2 * similarity * n / (1 + similarity)))
        own = [f"a{i}x{j}" for j in range(both)]
        texts += [[*own, *(f"b{i}x{j}" for j in range(n - both))], [*own, *(f"c{i}x{j}" for j in range(n - both))]]
    _, _, s = sketches.sketches(pa.array([" ".join(x) for x in texts]), 1)
    bits = np.unpackbits(s.view(np.uint8), axis=1, bitorder="little").reshape(1500, 2, 512)
    apart = bits[:, 0] != bits[:, 1]
    width = sketches.KEY_BITS * sketches.TABLES
    shared = (~apart[:, :width].reshape(1500, sketches.TABLES, sketches.KEY_BITS).any(axis=2)).any(axis=1)
    part, whole = sketches.radius(0.8, sketches.SLICED, sketches.SLICED_DEVIATIONS), sketches.radius(0.8, 512, sketches.DEVIATIONS)
    near = (apart.sum(axis=1) <= whole) & (apart[:, : sketches.SLICED].sum(axis=1) <= part)
    print(similarity, shared.mean(), (shared & near).mean())
    assert (shared & near).mean() >= 0.95
