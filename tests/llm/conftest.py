from __future__ import annotations

import pytest

#: Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own.
CASES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "!!! ... 123"), (5, "one"), (6, "the quick brown fox jumps over the lazy dog"),
    (7, "the quick brown fox jumps over the lazy dog"), (7, "the quick brown fox jumps over the lazy dog"),
    (8, "der schnelle braune Fuchs springt über den faulen Hund und läuft dann weiter " * 3),
    (9, "wörter " * 20_000), (10, "a" * 50_000), (11, "日本語のテキスト 🙂 é̀"), (12, "\x00 control \x1f bytes"),
]


@pytest.fixture(scope="session")
def cases(spark):
    rows = [(i, t, "en" if i % 2 else "de", 0.5, "x", i) for i, t in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, fp string, n long").repartition(3)


@pytest.fixture(scope="session")
def empty(spark, cases):
    return spark.createDataFrame([], cases.schema)
