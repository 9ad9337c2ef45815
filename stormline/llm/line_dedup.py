"""Maximal repeated runs of lines, found by winnowing over line hashes; native DataFrame functions only.

A run of lines is repeated if it has at least `min_words` words and its lines also stand, in the same order, at an
earlier place (smaller id, then position). All lines of all repeated runs are deleted, up to the runs' first and last lines.

Windows are the shortest runs with `min_words` words: one starts at each line, one ends at each line. The least line hash in
a window (the leftmost of equal ones) is its fingerprint. Windows with the same lines choose the same fingerprint, so any
repeated run has fingerprints in common with its earlier place: nothing is missed. Only fingerprints that occur at two
places go on. From each of these positions the match is extended both ways, a line at a time: back over the windows that
start at each line before it, ahead over the windows that end at each line behind it, as long as they stand at an earlier
place too. That reaches both ends of every maximal run: a line of it is held by the window from that line on, or, if that
one leaves the run, by the window that ends at the run's last line. The earlier places of a run's parts need not lie
in one document, so a match extended along a single earlier place would stop too soon.

Lines and windows are compared by two 64-bit hashes with different seeds. Blank lines are no part of a run, but go
with the run around them. Hot fingerprints and windows are counted and minimised before the shuffle, written, and
joined as plain tables, so that adaptive execution can split them; always by sorting, so that the plan and its shuffle
keep their shape as the data grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

MIN_WORDS = 30


def windows(rows: DataFrame, min_words: int) -> DataFrame:
    """From (id, th, text): (id, th, pos, last, at, a1, a2, k1, k2) for each window; `at` is its fingerprint's place."""
    lines = rows.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    lines = lines.select(
        "id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.size(F.split(F.trim("line"), " +")).cast("bigint").alias("words")
    )
    lines = lines.repartition("id", "th").dropDuplicates(["id", "th", "pos"])
    document = Window.partitionBy("id", "th")
    upto = F.sum("words").over(document.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    starting = document.orderBy("before").rangeBetween(0, min_words - 1)
    ending = document.orderBy("upto").rangeBetween(1 - min_words, 0)

    def over(run):
        return F.struct(
            F.min("pos").over(run).alias("pos"), F.max("pos").over(run).alias("last"), F.sum("words").over(run).alias("total"),
            F.min(F.struct("h1", "h2", "pos")).over(run).alias("chosen"), F.collect_list(F.struct("h1", "h2")).over(run).alias("run"),
        )

    # a window that reaches min_words only with its last line starts at its first one too: it is taken once
    found = lines.select("id", "th", "words", over(starting).alias("a"), over(ending).alias("b")).select(
        "id", "th",
        F.inline(F.filter(F.array("a", "b"), lambda w, i: w.getField("total") - F.when(i == 0, F.lit(0)).otherwise(F.col("words")) >= min_words)),
    )
    return found.select(
        "id", "th", "pos", "last", F.col("chosen.pos").alias("at"), F.col("chosen.h1").alias("a1"), F.col("chosen.h2").alias("a2"),
        F.xxhash64("run").alias("k1"), F.xxhash64(F.lit(1), "run").alias("k2"),
    )


def repeated_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, th, pos, last) of the windows that stand at an earlier place too."""
    every = materialise(windows(rows, min_words))
    places = every.select("id", "th", "at", "a1", "a2").distinct()
    shared = materialise(places.groupBy("a1", "a2").count().filter("count > 1").select("a1", "a2"))
    live = materialise(every.join(shared.hint("merge"), ["a1", "a2"]).select("id", "th", "pos", "last", "k1", "k2"))
    here = F.struct("id", "th", "pos")
    firsts = materialise(live.groupBy("k1", "k2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return live.join(firsts.hint("merge"), ["k1", "k2"]).filter(~here.eqNullSafe(F.col("first"))).select("id", "th", "pos", "last")


def remove_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` with the text cut, and (n_lines, n_removed) in front of its own columns of those names.

    A line goes if it lies in a run of at least `min_words` words whose lines also stand at an earlier place of the same or
    another document (the places may overlap). Null ids come first; rows with equal id and text count as one document and have the same result; rows
    with an equal id and different texts are ordered by the texts' MD5. A null text stays null and has no lines, an
    empty text has one. A document can become empty. Other columns pass unchanged.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.md5(text).alias("th"), text.alias("text"))
    gone = repeated_runs(rows.select("id", "th", "text"), min_words)
    gone = gone.select("id", "th", F.explode(F.sequence("pos", "last")).alias("p")).groupBy("id", "th").agg(F.array_sort(F.collect_set("p")).alias("p"))

    def marks(d):
        gap = lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(d, i - 1) + 1)
        return F.flatten(F.transform(d, lambda x, i: F.concat(F.array_repeat(F.lit(False), gap(x, i)), F.array(F.lit(True)))))

    gone = materialise(gone.select(F.col("id").alias("i"), F.col("th").alias("t"), F.size("p").alias("n"), F.get(F.transform(F.array("p"), marks), F.lit(0)).alias("flags")))
    out = rows.drop("text").join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    own = F.col("row").getField(text_col)
    left = F.array_join(F.filter(F.split(own, "\n"), lambda x, i: ~F.coalesce(F.get(F.col("flags"), i), F.lit(False))), "\n")
    kept = F.when(F.col("flags").isNull(), own).otherwise(left)
    return out.select(
        F.when(own.isNull(), F.lit(0)).otherwise(F.size(F.split(own, "\n"))).cast("bigint").alias("n_lines"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_removed"),
        *[(kept if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
    )
