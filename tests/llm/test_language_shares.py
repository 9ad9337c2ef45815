"""The model's bounds are shared among languages; predictions against a model counted by hand."""

import math
from collections import Counter

import pytest

from stormline.llm import langid


def test_small_language_keeps_its_words(spark):
    rows = [(i, " ".join(f"big{chr(97 + (i + j) % 26)}{chr(97 + j % 26)}" for j in range(40)), "aa") for i in range(400)]
    rows += [(1000 + i, " ".join(f"small{chr(97 + j)}" for j in range(20)) + " bigaa", "bb") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = langid.learn(df, max_words=60, max_grams=60)
    assert len(model.words) <= 60 and sum(w.startswith("small") for w in model.words) == 20
    test = spark.createDataFrame([(1, "smalla smallb"), (2, "bigaa bigbb"), (3, None), (4, "12 34")], "doc_id int, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(test, model).collect()} == {1: "bb", 2: "aa", 3: "und", 4: "und"}


def test_counts_by_hand(spark):
    """Known words by their frequency, an unseen one by its longest known n-grams, with the languages' shares."""
    rows = [(1, "ab ab cd", "x"), (2, "ab ef", "y"), (3, "ef ef", "y")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    words = {"x": Counter(ab=2, cd=1), "y": Counter(ab=1, ef=3)}
    log = lambda found, keys, key: math.log((found[key] + 0.5) / (sum(found[k] for k in keys) + 0.5 * len(keys)))

    def score(lang, known, unseen):
        total = math.log({"x": 1, "y": 2}[lang] / 3) + sum(log(words[lang], ["ab", "cd", "ef"], w) for w in known)
        if unseen:
            pieces = {k: Counter() for k in words}
            for k, own in words.items():
                for w, n in own.items():
                    for g in langid.grams(w, 3):
                        pieces[k][g] += n
            keys = {g for own in pieces.values() for g in own}
            shared = [g for g in langid.grams(unseen, 3) if g in keys]
            total += sum(log(pieces[lang], keys, g) for g in shared) / len(shared)
        return total

    for text, known, unseen in (("AB cd", ["ab", "cd"], None), ("ab efg", ["ab"], "efg")):
        x, y = score("x", known, unseen), score("y", known, unseen)
        lang, share = model.predict(text)
        assert lang == ("x" if x > y else "y") and share == pytest.approx(1 / (1 + math.exp(-abs(x - y))))
