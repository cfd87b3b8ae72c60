"""Word segmentation by a caller's table of words: a trie, and the most probable path through the lattice of words in a run of characters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a table at most: it travels to every task.
MOST = 1_000_000
#: What is segmented by default, runs of Han characters; other runs of letters and digits stay whole.
HAN, OTHER = r"\p{Han}+", r"[\p{L}\p{N}--\p{Han}]+"


class Words:
    """A trie of words with their log-probabilities; a character that begins no word counts as a word seen once."""

    def __init__(self, counts: Mapping[str, float]):
        total = sum(counts.values()) or 1
        self.root: dict = {}
        self.unknown = -math.log(max(total, 2))
        for word, n in counts.items():
            if word and n > 0:
                node = self.root
                for c in word:
                    node = node.setdefault(c, {})
                node[""] = math.log(n) - math.log(total)

    def split(self, run: str) -> list[str]:
        """The words of the path with the largest sum of log-probabilities; of equal ones that whose first word is longest, then the second, and so on.

        Words are looked up at each place as far as the trie goes, so time is the run's length times that of the longest word.
        """
        n = len(run)
        best, step = [0.0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            top, width = self.unknown + best[i + 1], 1
            node = self.root
            for j in range(i, n):
                node = node.get(run[j])
                if node is None:
                    break
                p = node.get("")
                if p is not None:
                    found = (max(p, self.unknown) if j == i else p) + best[j + 1]
                    if found >= top - 1e-12:
                        top, width = found, j + 1 - i
            best[i], step[i] = top, width
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out


def segmenter(words: Mapping[str, float] | DataFrame, runs: str = HAN, others: str = OTHER) -> Callable[[Column], Column]:
    """A column function from text to array<string>, to be passed as ``tokens`` to indexes and searches alike.

    ``words`` are counts by word, or a table (word, n) of ``MOST`` rows at most; repeated words add up. Matches of ``runs`` are segmented, those of ``others`` are one
    token each, and anything else separates. Null and empty texts have no tokens. Each task builds the trie once.
    """
    if isinstance(words, DataFrame):
        rows = words.filter("word is not null and n > 0").groupBy("word").agg(F.sum("n").alias("n")).limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"a table of more than {MOST} words")
        words = {r.word: float(r.n) for r in rows}
    counts = dict(words)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie, pattern = Words(counts), regex.compile(f"(?V1)({runs})|({others})")
        for texts in batches:
            yield pd.Series([[w for m in pattern.finditer(t or "") for w in (trie.split(m[1]) if m[1] else [m[2]])] for t in texts], dtype=object)

    return run
