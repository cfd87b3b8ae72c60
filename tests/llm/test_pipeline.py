"""The stages of the pipeline: their order, columns and effects."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    same = "A shared passage that repeats, word for word, in two different documents and is much longer than one hundred bytes in all. "
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (1, "the first document speaks about the weather in the north and " + same, "en"), (2, "123 456", "en"), (3, None, "en"),
        (4, "the first document speaks about the weather in the north and " + same, "en"),
        (5, "eine andere Geschichte von dem Haus und der Straße, die lang ist. " + same, "de"), (6, f"noch ein Text der {item} enthält und sonst nichts", "de"),
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        kept.append(sorted(r.doc_id for r in now.collect()))
    assert kept == [[1, 4, 5, 6], [1, 5, 6], [1, 5, 6], [1, 5]]
    assert {r.doc_id: r.text for r in now.collect()}[5] == rows[4][1][: -len(same) - 1]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(r.doc_id for r in out.collect()) == [1, 5]


def test_stages_keep_repeated_and_unnamed_rows(spark, tmp_path):
    """Repeated rows, null doc_ids and extra columns whose names clash with the operators' own."""
    same = "A passage that stands in more than one of these documents, word for word, and that is longer than one hundred bytes. "
    rows = [(1, "the house by the lake is old and " + same, "x"), (2, "a garden with red and white flowers " + same, "y"), (2, "a garden with red and white flowers " + same, "y"), (None, "someone walks along the quiet street at night", "z")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), k, k, k) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, d string, kept string, mark string")
    spark.createDataFrame([(1, "unrelated words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns and sorted(r.kept for r in now.collect()) == ["x", "y", "y", "z"]
    assert {r.kept: r.text for r in now.collect()} == {"x": rows[0][1], "y": rows[1][1][:35], "z": rows[3][1]}


def test_stages_on_edge_cases_and_empty_tables(spark, tmp_path, cases, empty):
    """Nulls, empty, very long and repeated texts, ties, rows without doc_id: what each stage keeps; and tables without rows."""
    spark.createDataFrame([(1, "the quick brown fox"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"word{i} goes on" for i in range(60_000))
    unnamed = [(None, "someone without a number writes about the sea"), (None, "someone without a number writes about the sea")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(r.doc_id, r.text, r.lang, "s", None) for r in cases.collect()] + [(i, t, "en", "s", len(t)) for i, t in [(50, long), (51, long), *unnamed]]
    made = spark.createDataFrame(rows, columns)
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name: sorted((r.doc_id for r in stages[name](spark, made, str(tmp_path)).collect()), key=str)
    assert set(kept("language_id")) <= {5, 6, 7, 8, 9, 10, 11, 12, 50, 51, None} and kept("language_id").count(7) in (0, 2)
    near = kept("simhash_near_dedup")
    assert near.count(50) == 1 and 51 not in near and near.count(None) == 1 and 1 in near and 7 not in near
    cut = {r.doc_id: r.text for r in stages["suffix_array_dedup"](spark, made, str(tmp_path)).collect()}
    assert cut[50] == long and 51 not in cut and cut[1] is None and cut[2] == "" and cut[7] == "the quick brown fox jumps over the lazy dog"
    clean = kept("benchmark_decontamination")
    assert 6 not in clean and 7 not in clean and clean.count(None) == 2 and {1, 2, 3, 50, 51} <= set(clean)
    assert len(stages["byte_bpe"](spark, made, str(tmp_path)).collect()) == len(rows)
    none = spark.createDataFrame([], columns)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == none.columns)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
