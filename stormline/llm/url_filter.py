"""URL filters: many glob rules at once with a bit-parallel Shift-And automaton.

A rule is a glob over the canonical URL `.host/path`: `*` stands for any run without `/`, `**` for any run, `?`
for one character other than `/`. All rules are packed one behind another into one bit string of as many 64-bit
words as they need, one bit per literal character. For each character c a mask B[c] has the places that accept it
and S[c] the places (the bit before a star) that may stay. One step for all rules and all URLs of a batch is
D = ((D << 1 | starts) & B[c]) | (D & S[c]), with the carry of the shift handed from word to word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    glob: str


def host_rule(rule: str, verdict: str) -> Rule:
    """`example.net/en/`: the host and all its subdomains, and every path that starts with /en/."""
    return Rule(rule, verdict, f"*.{rule}**")


class Automaton:
    """Globs compiled to masks; `first_match` gives for each text the first rule that fits, or -1."""

    def __init__(self, globs: Sequence[str]):
        tokens = [self._tokens(g) for g in globs]
        chars = sorted({c for t in tokens for kind, c in t if kind == "lit"} | {"/"})
        self.classes = {c: i + 1 for i, c in enumerate(chars)}  # 0: any other character
        # one bit for "before the first character" of each rule, one for each character or `?`
        self.bits = sum(1 + sum(kind != "star" for kind, _ in t) for t in tokens)
        self.width = max(1, -(-self.bits // 64))
        accept = np.zeros((len(chars) + 1, self.width), np.uint64)
        stay = np.zeros_like(accept)
        self.start, self.final = np.zeros(self.width, np.uint64), []
        at = 0

        def put(mask: np.ndarray, bit: int) -> None:
            mask[..., bit // 64] |= np.uint64(1 << bit % 64)

        for rule in tokens:
            put(self.start, at)
            for kind, c in rule:
                if kind == "star":
                    for k in range(len(chars) + 1):
                        if c == "**" or k != self.classes["/"]:
                            put(stay[k], at)
                    continue
                at += 1
                for k in range(len(chars) + 1):
                    if (kind == "lit" and k == self.classes[c]) or (kind == "one" and k != self.classes["/"]):
                        put(accept[k], at)
            self.final.append(at)
            at += 1
        self.accept, self.stay = accept, stay

    @staticmethod
    def _tokens(glob: str) -> list[tuple[str, str]]:
        out, i = [], 0
        while i < len(glob):
            if glob.startswith("**", i):
                out.append(("star", "**"))
                i += 2
                continue
            out.append({"*": ("star", "*"), "?": ("one", "?")}.get(glob[i], ("lit", glob[i])))
            i += 1
        return out

    def first_match(self, texts: Sequence[str]) -> np.ndarray:
        n = len(texts)
        size = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-size, kind="stable")  # longest first: step j runs over a prefix of the rows
        codes = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros(0x110000, np.uint16)
        for c, k in self.classes.items():
            table[ord(c)] = k
        kinds, size = table[codes], size[order]
        begin = np.cumsum(size) - size
        state = np.repeat(self.start[None, :], n, axis=0)
        live = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        for j, rows in enumerate(live.tolist()):
            k, d = kinds[begin[:rows] + j], state[:rows]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:rows] = (moved & self.accept[k]) | (d & self.stay[k])
        out = np.full(n, -1)
        for rule in reversed(range(len(self.final))):
            bit = self.final[rule]
            out[order[(state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(bool)]] = rule
        return out


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def judge(pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rows: int = 4096) -> DataFrame:
    """(id_col, host, path, rule, verdict), one row per input row.

    The longest rule name that fits decides, the smallest of equally long ones; without any, rule is null and the
    verdict is `default`. A null URL, or one without `://`, has an empty host and path. An empty path starts with
    no rule's path. Repeated rows and ids are judged each on their own; other columns are ignored.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    automaton = Automaton([r.glob for r in ranked])

    @F.pandas_udf("int")
    def fits(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in urls:
            found = [automaton.first_match(part.iloc[i : i + rows].tolist()) for i in range(0, len(part), rows)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0, int), dtype="int32")

    url = F.col(url_col)
    out = pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path"))
    out = out.withColumn("at", fits(F.concat(F.lit("."), "host", "path")) + 1)
    names = F.array(F.lit(None).cast("string"), *[F.lit(r.name) for r in ranked])
    verdicts = F.array(F.lit(default), *[F.lit(r.verdict) for r in ranked])
    return out.select(id_col, "host", "path", F.get(names, F.col("at")).alias("rule"), F.get(verdicts, F.col("at")).alias("verdict"))
