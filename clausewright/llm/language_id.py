"""Hierarchical language identification (operator 8).

Squared-hinge linear support vector machines over hashed n-grams: one-versus-rest among language families, then
one-versus-one between the languages of the chosen family. Learned from at most about ``TRAIN_ROWS`` documents per language,
chosen by a hash of doc_id, with no held-out document; a prediction sees the text alone.

Cases: a null text, and one without a letter, is ``und`` with score 0; with nothing to learn from every text is ``und``; a
language outside ``FAMILIES`` is a family by itself; repeated rows stay repeated rows; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._features import HashedGrams, Rows, fit_linear, sigmoid
from clausewright.llm._shared import LOWER_AZ, blocks, held_out

TRAIN_ROWS = 800
GRAMS = HashedGrams(words=(1,), chars=(2, 3, 4), bits=12)
#: A prediction that scores less (more likely wrong than right) is no identified language.
LEAST_SCORE = 0.5
#: ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"only {lang}")


class LanguageModel:
    """Stacked weight rows: families first, then the pairs of languages within each family."""

    def __init__(self, langs: list[str], machines: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.langs = langs
        self.families = sorted({family_of(x) for x in langs})
        self.keys = list(machines)
        self.tables = np.array([machines[k][0] for k in self.keys], np.float32).reshape(len(self.keys), GRAMS.size)
        self.bias = np.array([machines[k][1] for k in self.keys])

    def decide(self, values: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores from decision values, one row per text."""
        n, col = len(values), {k: i for i, k in enumerate(self.keys)}
        if len(self.families) > 1:
            fam = np.stack([values[:, col["family", f]] for f in self.families], axis=1)
            best = fam.argmax(axis=1)
            second = np.partition(fam, -2, axis=1)[:, -2]
            score = sigmoid(2 * (fam.max(axis=1) - second))
        else:
            best, score = np.zeros(n, int), np.ones(n)
        out = np.empty(n, object)
        for f, family in enumerate(self.families):
            rows, langs = np.flatnonzero(best == f), [x for x in self.langs if family_of(x) == family]
            votes = np.zeros((len(rows), len(langs)))
            for i, j in combinations(range(len(langs)), 2):
                p = sigmoid(2 * values[rows, col[langs[i], langs[j]]])
                votes[:, i] += p
                votes[:, j] += 1 - p
            won = votes.argmax(axis=1)
            out[rows] = np.array(langs, object)[won]
            score[rows] *= votes.max(axis=1) / (len(langs) - 1) if len(langs) > 1 else 1
        return list(out), np.clip(score, 0, 1)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Fit on about ``rows`` documents of each language; None if there is nothing to learn from."""
    known = docs.select("doc_id", "lang", "text").filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    sizes = known.groupBy("lang").count()
    few = {r["lang"]: r["count"] for r in sizes.collect()}  # one row per language
    if not few:
        return None
    spread = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[F.lit(x) for k, n in few.items() for x in (k, min(1.0, rows / n))])
    sample = known.filter(spread < share[F.col("lang")])
    data = GRAMS.sparse(sample.withColumn("text", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), ["doc_id", "lang"]).collect()
    data.sort(key=lambda r: (r.lang, r.doc_id))
    lang = np.array([r.lang for r in data], object)
    family = np.array([family_of(x) for x in lang], object)
    x, langs, machines = Rows([(r.idx, r.val) for r in data], GRAMS.size), sorted(set(lang)), {}
    del data

    def machine(at: np.ndarray, positive: np.ndarray):
        y = np.where(positive, 1.0, -1.0)
        weight = np.where(positive, 1 / max(positive.sum(), 1), 1 / max((~positive).sum(), 1))
        return fit_linear(x.take(at), y, "hinge", weight, steps=50)

    for f in sorted(set(family)) if len(set(family)) > 1 else []:
        machines["family", f] = machine(np.arange(len(lang)), family == f)
    for a, b in combinations(langs, 2):
        if family_of(a) == family_of(b):
            at = np.flatnonzero((lang == a) | (lang == b))
            machines[a, b] = machine(at, lang[at] == a)
    return LanguageModel(langs, machines)


def _decided(texts: pa.Array, model: LanguageModel | None) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """First row, number of rows, languages and scores, block by block."""
    for block in blocks(texts, lambda t: t.translate(LOWER_AZ)):
        lang, score = model.decide(GRAMS.means(block, model.tables) + model.bias) if model else (["und"] * len(block), np.zeros(len(block)))
        yield block.lo, len(block), lang, score


def _has_letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, lang, score in _decided(batch.column(1), model):
                rest = [batch.column(i).slice(lo, n) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "letters", "lang", "score"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _has_letter().alias("letters"))
    found = ready.mapInArrow(run, "doc_id long, letters boolean, lang string, score double")
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        F.when(F.col("letters"), F.col("lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
    )


def keep_identified(docs: DataFrame, model: LanguageModel | None = None, least: float = LEAST_SCORE, langs: list[str] | None = None) -> DataFrame:
    """Rows that have a language, with all columns.

    Texts without a letter go, and those whose prediction scores less than ``least`` or, if ``langs`` are given, is none of them. Without anything to
    learn from nothing can be predicted: then all texts with a letter stay. Each row is judged by its own text as it
    passes, so nothing is shuffled, and rows without doc_id or with a repeated one are judged alike.
    """
    model, at, names = model or train(docs), docs.columns.index("text"), docs.columns
    if model is None:
        return docs.filter(_has_letter())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, lang, score in _decided(batch.column(at), model):
                part = batch.slice(lo, n)
                known = pa.array(score >= least if langs is None else (score >= least) & np.isin(lang, langs), pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(known) for c in part.columns], names=names)

    # A text without a letter is ``und`` whatever the machines say.
    return docs.filter(_has_letter()).mapInArrow(run, docs.schema)
