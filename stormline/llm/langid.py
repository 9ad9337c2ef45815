"""Language identification: known words first, shorter and shorter character n-grams for the others.

A word of the model adds its log frequency in each language. An unseen word is padded and read as character 5-grams;
if the model knows none of them, as 4-grams, and so on; the mean of the known ones is added. The language with the
largest sum, counting the languages' shares of the training texts, is the answer, its posterior the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

MAX_DOCS, MAX_WORDS, MAX_GRAMS, ORDER, MAX_LANGUAGES = 10_000, 60_000, 60_000, 5, 1000
UNKNOWN, SMOOTHING, CACHE = "und", 0.5, 200_000
_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str) -> Counter:
    """Words with their counts: runs of letters, lower-cased."""
    found = Counter(_WORD.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n, kept = found.pop(w), "".join(filter(str.isalpha, w))
        if kept:
            found[kept] += n
    return found


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1) if n > 1 or padded[i] != " "]


class Model:
    """Log frequencies by language; rows of `table` are words, then n-grams."""

    def __init__(self, languages: dict[str, int], words: list[tuple[str, str, int]], pieces: list[tuple[str, str, int]]):
        self.names = sorted(languages)
        at = {x: i for i, x in enumerate(self.names)}
        total = np.array([languages[x] for x in self.names], float)
        self.prior = np.log(total / total.sum()) if len(total) else total
        self.words, self.grams = {}, {}
        self.word_table = self._table(words, self.words, at)
        self.gram_table = self._table(pieces, self.grams, at)
        self.cache: dict[str, np.ndarray] = {}

    def _table(self, rows: list[tuple[str, str, int]], index: dict[str, int], at: dict[str, int]) -> np.ndarray:
        for _, key, _ in rows:
            index.setdefault(key, len(index))
        count = np.zeros((len(index), len(at)))
        for language, key, n in rows:
            count[index[key], at[language]] += n
        size = np.fromiter(map(len, index), int, len(index)) if index is self.grams else np.zeros(len(index), int)
        for n in np.unique(size):  # frequencies among n-grams of one length
            own = size == n
            count[own] = np.log((count[own] + SMOOTHING) / (count[own].sum(axis=0) + SMOOTHING * own.sum()))
        return count

    def unseen(self, word: str) -> np.ndarray:
        held = self.cache.get(word)
        if held is None:
            held = np.zeros(len(self.names))
            for n in range(ORDER, 0, -1):
                known = [self.grams[g] for g in grams(word, n) if g in self.grams]
                if known:
                    held = self.gram_table[known].mean(axis=0)
                    break
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = held
        return held

    def predict(self, text: str | None) -> tuple[str, float]:
        found = letters(text or "")
        if not found or not self.names:
            return UNKNOWN, 0.0
        total, rows, times = self.prior.copy(), [], []
        for w, n in found.items():
            at = self.words.get(w)
            if at is None:
                total += n * self.unseen(w)
            else:
                rows.append(at)
                times.append(n)
        if rows:
            total += np.array(times) @ self.word_table[rows]
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.names[best], float(share[best] / share.sum())


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """A model from rows with a text and a language.

    At most about `max_docs` documents per language are read, chosen by a hash of their ids. The model holds at most
    `max_words` words and `max_grams` n-grams, shared equally: of each language's keys the most frequent stay, with
    their counts in all languages, so a language with few documents keeps its own. Ties go to the lesser key.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    languages = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: `{lang_col}` does not hold language codes")
    if not languages:
        return Model({}, [], [])
    share = F.create_map(*[x for k, n in languages.items() for x in (F.lit(k), F.lit(int(1e6 * min(1.0, max_docs / n)) + 1))])
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")]).select("lang", "text")
    schema = "lang string, key string, n bigint"

    def emit(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "key", "n"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                counts: dict[str, Counter] = {}
                for lang, text in zip(b.column(0).slice(at, 1000).to_pylist(), b.column(1).slice(at, 1000).to_pylist()):
                    counts.setdefault(lang, Counter()).update(letters(text))
                yield from emit(counts)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, Counter] = {}
            for lang, word, n in zip(*[c.to_pylist() for c in b.columns]):
                own = counts.setdefault(lang, Counter())
                for size in range(1, ORDER + 1):
                    for g in grams(word, size):
                        own[g] += n
            yield from emit(counts)

    def most(found: DataFrame, limit: int) -> list[tuple[str, str, int]]:
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))  # a language's keys are bounded by max_docs
        kept = found.withColumn("place", place).filter(F.col("place") <= max(1, limit // len(languages))).select("key").distinct()
        top = found.join(kept.hint("merge"), "key").orderBy("key", "lang").toArrow()
        return list(zip(*[top.column(c).to_pylist() for c in ("lang", "key", "n")]))

    words = materialise(picked.mapInArrow(count_words, schema).groupBy("lang", "key").agg(F.sum("n").alias("n")))
    pieces = materialise(words.mapInArrow(count_grams, schema).groupBy("lang", "key").agg(F.sum("n").alias("n")))
    return Model(languages, most(words, max_words), most(pieces, max_grams))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), one row per input row; only the text is read.

    A null text, or one without letters, is `und` with score 0, as is every text if the model has no language.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
