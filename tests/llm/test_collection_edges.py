"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from stormline.llm import decontam, exact_dedup, graph, langid, line_dedup, packing, quality, simhash, suffix_dedup, url_filter, warc
from stormline.llm.queries import tokenizer

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ROWS = [
    (1, "", "en"), (2, None, None), (3, "Alone here.", "en"), (3, "Alone here.", "en"), (4, "ALONE HERE.", "de"), (None, "No id at all", "fr"), (None, None, None),
    (5, LONG, "en"), (6, LONG, None), (7, PASSAGE + "\nA line of its own", "en"), (8, "Before it\n\n" + PASSAGE, "en"), (9, "Other text", "en"), (9, "With the same id", "de"),
    (10, " \t\n ", "en"), (11, "12 34 !?", "en"), (12, "é" * 70, "fr"),
]
CLASHING = ["fp", "id", "text_sha256", "row", "th", "score", "n_lines", "key", "chunk"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    return df.selectExpr("*", "'src' AS source", "CAST(length(text) AS BIGINT) AS n_chars", *[f"'x' AS {c}" for c in CLASHING]).repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "other text"), (4, "Other TEXT")], "item_id bigint, text string")


def test_exact_duplicates(docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, first=4, wider=3).collect()}
    assert {(3, 4, 3, False), (4, 4, 3, True), (1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (5, 6, 2, False), (6, 6, 2, True), (None, None, 1, False)} <= got
    assert exact_dedup.exact_duplicates(docs).count() == len(ROWS)


def test_exact_duplicates_of_one_hot_text(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('Same ', 50) ELSE repeat('same ', 50) || id END AS text")
    hot = exact_dedup.exact_duplicates(df).filter("group_size > 1")
    assert hot.count() == 1000 and hot.filter("kept").collect()[0].doc_id == 2997


def test_simhash(docs):
    got = {(r.doc_id, r.component) for r in simhash.near_duplicates(docs).collect()}
    assert {(3, 3), (4, 3), (5, 5), (6, 5), (1, 1), (2, 1), (10, 1)} <= got
    assert simhash.near_duplicates(docs).count() == len(ROWS)


@pytest.mark.parametrize("radius, blocks, cell", [(4, 6, 8192), (4, 6, 7), (10, 12, 50), (0, 2, 8192)])
def test_links_are_complete(spark, radius, blocks, cell):
    rng = np.random.default_rng(radius + cell)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    fp = base[rng.integers(0, 12, 150)]
    for _ in range(7):
        fp = fp ^ np.where(rng.random(150) < 0.5, np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64), np.uint64(0))
    fp = sorted(set(fp.view(np.int64).tolist()))
    df = spark.createDataFrame([(x,) for x in fp], "fp bigint")
    got = {r.node: r.root for r in graph.components(simhash.links(df, radius=radius, blocks=blocks, cell_rows=cell)).collect()}
    root = {x: x for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fp):
        for b in fp[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {x: got.get(x, x) for x in fp} == {x: find(x) for x in fp}


def grouped(spark, texts, **kw):
    """Component by id, and the same from all pairs that some fingerprint and the exact similarity link."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    args = dict(k=5, radius=12, blocks=14, similarity=0.8) | kw
    got = {r.doc_id: r.component for r in simhash.near_duplicates(df, **args).collect()}
    fp = simhash.batch_fingerprints(pa.array(texts), 5, args.get("many", 1)).reshape(len(texts), -1)
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            near = min(int(x).bit_count() for x in fp[i] ^ fp[j]) <= 12
            if want[i] != want[j] and near and simhash.jaccard(texts[i], texts[j], 5) >= 0.8:
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    return got, dict(enumerate(want)), fp


def edited(rng, words, n):
    """The words with n places changed."""
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"new{rng.integers(1 << 40)}"
    return out


@pytest.mark.parametrize("cell, per_row", [(8192, 4), (7, 1)])
def test_false_links_hide_no_true_one(spark, monkeypatch, cell, per_row):
    """Half-similar texts within the radius stand between copies; links are found in rounds and in cells."""
    monkeypatch.setattr(simhash, "LINKS_PER_ROW", per_row)
    rng, texts = np.random.default_rng(5), []
    for family in range(3):
        base = [f"w{family}x{i}" for i in range(200)]
        for _ in range(6):
            like = edited(rng, base, 5)
            texts += [" ".join(like), *(" ".join(edited(rng, like, 3)) for _ in range(2))]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    got, want, fp = grouped(spark, texts, cell_rows=cell)
    false = [1 for i in range(len(texts)) for j in range(i) if int(fp[i, 0] ^ fp[j, 0]).bit_count() <= 12 and want[i] != want[j]]
    assert got == want and len(set(want.values())) < len(texts) and len(false) > 20


def test_equal_fingerprints_are_no_similarity(spark):
    """A phrase repeated more often than all else makes the fingerprint; the texts are not alike. Equal texts are."""
    phrase = "the same few words come again and again " * 40
    texts = [phrase + " ".join(f"own{i}x{j}" for j in range(60)) for i in range(4)]
    texts += [texts[2], phrase + "one", phrase + "one more"]
    got, want, fp = grouped(spark, texts)
    assert len(set(fp[:4, 0].tolist())) < 4 or min(int(fp[i, 0] ^ fp[j, 0]).bit_count() for i in range(4) for j in range(i)) <= 5
    assert got == want and want == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2, 5: 5, 6: want[6]}


def test_more_fingerprints_find_more(spark):
    rng, texts = np.random.default_rng(8), []
    for i in range(120):
        base = [f"w{i}x{j}" for j in range(200)]
        texts += [" ".join(base), " ".join(edited(rng, base, 4))]
    fp = simhash.batch_fingerprints(pa.array(texts), 5, 3)
    assert (fp[:, 0] == simhash.batch_fingerprints(pa.array(texts), 5)).all()
    (one, *_), (got, want, _) = grouped(spark, texts), grouped(spark, texts, many=3)
    assert got == want and len(set(got.values())) < len(set(one.values()))


def test_components_of_a_long_chain(spark):
    order = list(range(400))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:])) + [(None, 3), (900, 900), (901, 902), (901, 902)], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {**dict.fromkeys(range(400), 0), 901: 901, 902: 901}


def test_line_dedup(docs):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got[7] == (2, 0, PASSAGE + "\nA line of its own") and got[8] == (3, 1, "Before it\n") and got[2] == (0, 0, None) and got[1] == (1, 0, "")
    assert got[5] == (1, 0, LONG) and got[6] == (1, 1, "") and got[3] == (1, 0, "Alone here.")
    out = line_dedup.remove_repeated_lines(docs)
    assert out.count() == len(ROWS) and set(CLASHING) <= set(out.columns)


def brute_lines(texts, min_words):
    """Lines of every run of lines with at least so many words that stands at an earlier place too, whatever its length."""
    runs, first = [], {}
    for i, text in enumerate(texts):
        lines = [(p, x, len(re.split(" +", x.strip(" ")))) for p, x in enumerate(text.split("\n")) if x.strip(" ")]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(n for _, _, n in lines[a : b + 1]) >= min_words:
                    key = tuple(x for _, x, _ in lines[a : b + 1])
                    first.setdefault(key, (i, a))
                    runs.append((i, a, lines[a][0], lines[b][0], key))
    gone = {(i, p) for i, a, lo, hi, key in runs if first[key] != (i, a) for p in range(lo, hi + 1)}
    return ["\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sizes", [(12, 12, 12, 12, 3), (40, 8, 8), (60, 10, 10), (8, 8, 40), (3, 29, 1, 29, 3), (30,), (1,) * 40])
def test_a_repeated_run_goes_to_its_last_line(spark, sizes):
    run = ["\n" * (n % 2) + " ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate(sizes)]
    texts = ["\n".join(["before", *run, "after"]), "\n".join(["own", *run, "rest"]), "\n".join(run), "\n".join(run[:-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r.text for r in line_dedup.remove_repeated_lines(df).orderBy("doc_id").collect()]
    assert got == brute_lines(texts, line_dedup.MIN_WORDS) and got[0] == texts[0] and not {w for x in got[1:3] for w in x.split()} - {"own", "rest"}


def test_the_ends_of_a_run_may_stand_at_different_earlier_places(spark):
    a, b, c, d = (" ".join(f"{x}{j}" for j in range(n)) for x, n in (("a", 12), ("b", 10), ("c", 10), ("d", 9)))
    texts = ["\n".join(x) for x in ([a, b, c, "one"], ["two", b, c, d], [a, b, c, d], [b, c, d], [d, a, b])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r.text for r in line_dedup.remove_repeated_lines(df, min_words=25).orderBy("doc_id").collect()]
    assert got == brute_lines(texts, 25) == [texts[0], texts[1], "", "", texts[4]]


def test_line_runs_against_brute_force(spark):
    rnd = random.Random(5)
    texts = ["\n".join(rnd.choice(["a b", "c", "d e f g", "", "h i", " j"]) for _ in range(rnd.randint(0, 25))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(df, min_words=6).collect()}
    assert [got[i] for i in range(60)] == brute_lines(texts, 6)


def test_line_runs_of_uneven_lines_against_brute_force(spark):
    rnd = random.Random(6)
    pool = [" ".join(f"{i}w{j}" for j in range(n)) for i, n in enumerate([1, 2, 3, 5, 8, 13, 1, 30])]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(df, min_words=12).collect()}
    assert [got[i] for i in range(80)] == brute_lines(texts, 12)


def test_suffixes(docs):
    got = {(r.doc_id, r.n_bytes, tuple((s.begin, s.end) for s in r.spans)) for r in suffix_dedup.repeated_bytes(docs, chunk_bytes=5000).collect()}
    whole, cut = len(LONG), len(PASSAGE)
    assert {(5, whole, ()), (6, whole, ((0, whole),)), (7, cut + 18, ()), (1, 0, ()), (2, 0, ()), (None, 0, ()), (12, 140, ())} <= got
    assert (8, cut + 11, ((11, cut + 11),)) in got
    assert len(suffix_dedup.repeated_bytes(docs).collect()) == len(ROWS)


def test_packing(docs):
    out = packing.pack(docs, **tokenizer(), ids=True).collect()
    empty = [r for r in out if r.doc_id in (1, 2)]
    assert all((r.start, r.length, r.doc_tokens, r.ids) == (0, 1, 1, [0]) for r in empty) and len(empty) == 2
    assert sum(r.length for r in out if r.doc_id == 5) == next(r.doc_tokens for r in out if r.doc_id == 5)
    assert sum(r.start == 0 for r in out) == len(ROWS)


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(2)
    for limit in (1, 7, 64, 100):
        lengths = rng.integers(1, limit + 1, 80)
        window, offset = packing.best_fit_decreasing(lengths, limit)
        room = []
        for i in sorted(range(80), key=lambda i: -lengths[i]):
            fitting = [r for r in room if r >= lengths[i]]
            if fitting:
                room.remove(min(fitting))
            room.append((min(fitting) if fitting else limit) - lengths[i])
        used = np.bincount(window, weights=lengths)
        assert sorted(limit - used) == sorted(room)
        for w in set(window.tolist()):
            own = sorted((int(o), int(n)) for o, n, x in zip(offset, lengths, window) if x == w)
            assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist()


def test_encoder_equals_the_tokenizer():
    rnd, encode = random.Random(0), packing.Encoder(**tokenizer(), cache_words=50)
    parts = ["a", "B", "é", "'s", "'", " ", "  ", "\n", "\t", "12", "_", "!", ".", "ß", "²", "中", "\u0301", "😀", "<|endoftext|>", "\x0b", "\x1c", "don't", "\xa0"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_decontamination(docs, items):
    got = {(r.doc_id, r.item_id, r.start_word, r.similarity) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(7, 1, 0, 1.0), (8, 1, 2, 1.0), (9, 4, 0, 1.0)}
    assert rows(decontam.contaminated(docs, items, block_items=2)) == rows(decontam.contaminated(docs, items))
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3


def test_changed_passages_are_found(spark, items):
    own = PASSAGE.split()
    near = [" ".join(own[:30] + ["new"] + own[31:]), " ".join(own[:20] + ["new"] + own[21:40] + ["more"] + own[41:]), " ".join(reversed(own))]
    df = spark.createDataFrame([(i, f"x y z {t} end") for i, t in enumerate(near)], "doc_id bigint, text string")
    got = {r.doc_id: r.similarity for r in decontam.contaminated(df, items).collect()}
    assert got == {0: pytest.approx(51 / 61)}


@pytest.mark.parametrize("n", [1, 7, 64])
def test_multi_index_finds_all(n):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 2**63, n).astype(np.uint64)
    asked = np.r_[fps, fps ^ np.uint64(0xFFFFF), rng.integers(0, 2**63, 50).astype(np.uint64)]
    query, item = decontam.Blocks(fps, 23, 8).search(asked)
    near = np.bitwise_count(asked[:, None] ^ fps[None, :]) <= 23
    assert set(zip(query.tolist(), item.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_languages(docs):
    model = langid.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[1] == got[2] == got[10] == got[11] == ("und", 0.0) and got[12][0] == "fr" and got[5][0] == "en"
    assert langid.identify(docs, model).count() == len(ROWS)
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(docs.filter("lang IS NULL"))).collect()} == {"und"}


def test_unseen_words_fall_back_to_shorter_grams():
    model = langid.Model({"aa": 1, "bb": 1}, [("aa", "known", 5)], [("aa", "kno", 3), ("aa", "x", 4), ("bb", "z", 4)])
    assert model.predict("known")[0] == "aa" and model.predict("knot")[0] == "aa" and model.predict("zzz")[0] == "bb" and model.predict("123") == ("und", 0.0)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(3, 1, 0), (9, 1, 0), (7, 0, 0), (8, 0, None), (None, 1, 0), (5, None, 0), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    one = quality.learn(docs, labels.filter("quality = 0"))
    assert {r.predicted for r in quality.score(docs, one).collect()} == {0}
    none = quality.learn(docs, labels.filter("quality > 5"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert rows(quality.keep(docs, none)) == rows(docs)


def test_urls(spark):
    rules = [url_filter.host_rule("net/", "block"), url_filter.host_rule("example.net/en/", "allow"), url_filter.Rule("img", "block", "*/**/?*.png")]
    urls = [
        None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://example.net", "https://example.net/EN/", "http://anet/x", "x://y://b.net/q", "ftp://h/a/b.png",
        "http://h/.png", "http://h/é.png", "http://b.net:80/", "http://deep.b.net/x/" + "y" * 5000, "http://b.net/\nx",
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path[:20], r.rule, r.verdict) for r in url_filter.judge(df, rules, rows=3).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4] == ("example.net", "", None, "allow")
    assert [got[i][2] for i in (5, 6, 7, 8, 9, 10, 11, 12, 13)] == ["net/", None, None, "img", None, None, None, "net/", "net/"]


def test_automaton_equals_regular_expressions():
    rnd = random.Random(3)
    globs = ["".join(rnd.choice(["a", "b", "/", "*", "**", "?", ".", "é"]) for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    texts = ["".join(rnd.choice("ab/.é") for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    shape = lambda g: "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", g))
    want = [next((i for i, g in enumerate(globs) if re.fullmatch(shape(g), t, re.S)), -1) for t in texts]
    assert url_filter.Automaton(globs).first_match(texts).tolist() == want


PAGES = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nx: y", "same"), (3, "http://c", "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 3000), (None, "u", "same"), (7, "u", "big" * 700_000)]


def test_archives(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 AS sha", "2 AS refers_to").repartition(2)
    index = warc.write(df, str(tmp_path), frame_bytes=4000, archive_bytes=6000)
    back = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to, bytes(r.payload).decode() if r.payload is not None else None) for r in warc.read(index, str(tmp_path)).collect()}
    assert back == {
        (1, 4, "revisit", 3, None), (2, 4, "revisit", 3, None), (3, 4, "response", None, "same"), (None, 4, "revisit", 3, None), (4, 0, "revisit", 5, None), (5, 0, "response", None, ""),
        (6, 6000, "response", None, "é" * 3000), (7, 2_100_000, "response", None, "big" * 700_000),
    }
    assert index.count() == len(PAGES)
    found = warc.fetch(index, str(tmp_path), spark.createDataFrame([(6,), (1,), (77,)], "page_id bigint")).collect()
    assert {(r.page_id, r.record_type) for r in found} == {(6, "response"), (1, "revisit")}
    small = warc.write(df, str(tmp_path / "small"), min_bytes=5)
    assert {r.record_type for r in warc.read(small, str(tmp_path / "small")).collect()} == {"response"}


def test_archives_are_plain_zstandard(spark, tmp_path):
    import io

    import zstandard

    df = spark.createDataFrame(PAGES[:3], "page_id bigint, url string, html string").coalesce(1)
    path = warc.write(df, str(tmp_path)).first().archive
    with open(path, "rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 3 and b"WARC-Target-URI: http://c%0D%0Ax:%20y\r\n" in plain


def test_empty_tables(spark, docs, items, tmp_path):
    none, pages = docs.filter("false"), spark.createDataFrame([], "page_id bigint, url string, html string")
    for out in (
        exact_dedup.exact_duplicates(none), simhash.near_duplicates(none), line_dedup.remove_repeated_lines(none), suffix_dedup.repeated_bytes(none), packing.pack(none, **tokenizer()),
        decontam.contaminated(none, items), decontam.clean(none, items), langid.identify(none, langid.learn(none)), url_filter.judge(pages, []), warc.read(warc.write(pages, str(tmp_path)), str(tmp_path)),
        quality.score(none, quality.learn(none, docs.selectExpr("doc_id", "1 AS quality"))), decontam.contaminated(docs, items.filter("false")),
    ):
        assert out.count() == 0
    assert decontam.clean(docs, items.filter("false")).count() == len(ROWS)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, docs, tmp_path, empty):
    spark.createDataFrame([(3, 1, 0), (9, 1, 0), (10, 0, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        own = docs.filter("false") if empty else docs
        out = stage(spark, own, str(tmp_path))
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        assert (out.count() == 0) == empty
    kept = corpus_pipeline.keep_one(spark, docs, str(tmp_path)).collect()
    assert sum(r.doc_id == 3 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 2 and not any(r.doc_id in (2, 4, 6) for r in kept)
    assert not any(r.doc_id in (7, 8) for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect())


def test_warc_damaged_payload_is_an_error():
    body = b"<p>payload</p>"
    good = warc.record(7, "http://a/", body, warc.digest_of(body), None, False)
    assert warc.entry(*warc.parse(good)[:2], payloads=False) == (7, "http://a/", len(body), warc.digest_of(body), "response", None, None)
    with pytest.raises(ValueError, match="urn:page:7"):
        warc.entry(*warc.parse(good.replace(b"payload</p>", b"payl0ad</p>"))[:2])
    with pytest.raises(ValueError, match="13 bytes"):
        warc.entry(*warc.parse(good.replace(b"\r\nContent-Length: 14", b"\r\nContent-Length: 13"))[:2])
