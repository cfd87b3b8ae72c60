"""Hand-derived expectations of the clause operators."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.functions import lexicon, text as T
from clausewright.operators import chat, flat, outline, search


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first().y


def test_clean_page_numbers(spark):
    page = "12\n文件。 38\n共：100 元\n共：1000 元\n。38個"
    assert one(spark, page, T.clean_page_numbers) == "文件。\n共： 元\n共：1000 元\n。38個"
    assert one(spark, "a  7 \nb c\n", T.clean_page_numbers) == "a\nb c"


def test_clean_text(spark):
    assert one(spark, "一、 (二) 甲\n 乙", T.clean_text) == "甲 乙"
    assert one(spark, "甲\n 12 \n\n\n乙\n", T.clean_flat_text) == "甲\n乙"


def test_references(spark):
    found = one(spark, "本條依前項及第二十七條第一項第二款、前項", T.detect_references)
    assert found == ["本條", "前項", "第二十七條第一項第二款"]
    rows = [("前項", "第二條", "三"), ("前項", "第二條", None), ("本條", "第二條", None), ("前條", "第二條", None), ("前款", "第二條", None)]
    df = spark.createDataFrame(rows, "r string, c string, i string").select(T.resolve_reference(F.col("r"), F.col("c"), F.col("i")).alias("t"))
    assert [r.t for r in df.collect()] == ["第二條第二項", "第二條前項", "第二條條", "前條", "第二條前款"]


def test_entities(spark):
    found = one(spark, "延誤4小時或二十四小時，給付二次，新臺幣 三千元，4小時", T.extract_entities)
    assert found == {"時間": ["4小時", "二十四小時"], "金額": ["新臺幣 三千元"], "次數": ["給付二次"], "地點": []}


@pytest.mark.parametrize(
    ("query", "tags", "k"),
    [
        ("什麼情況下可以申請旅遊延誤賠償？", ["延誤"], (10, 5)),
        ("行李遺失後應該如何申請理賠？", ["遺失"], (5, 3)),
        ("哪些原因屬於不可理賠範圍？", ["不保"], (10, 5)),
        ("班機延誤多久可以理賠？", ["延誤"], (3, 2)),
    ],
)
def test_query_tags(spark, query, tags, k):
    assert one(spark, query, lambda c: lexicon.label_all(c, lexicon.QUERY_TAGS)) == tags
    assert tuple(one(spark, query, lambda c: F.struct(*lexicon.smart_top_k(c)))) == k


def test_clauses_and_chapters(spark):
    docs = spark.createDataFrame([(1, "第一條 甲\n第一章 乙\n第二條 丙\n丁"), (2, "第一條\n第二條 名詞\n定義"), (3, None), (4, "")], "doc_id long, text string")
    rows = outline.split_clauses(docs).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.clause_no, r.clause_title, r.chapter_no, r.body) for r in rows] == [
        (1, "第一條", "甲", None, "第一章 乙"), (1, "第二條", "丙", "第一章", "丁"), (2, "第一條", "第二條 名詞", None, "定義"),
    ]


def test_items_and_subitems(spark):
    docs = spark.createDataFrame([(1, "第一條 甲\n前言\n一、乙依前項\n（一） A\n(b) B\n1) C\n二、丁")], "doc_id long, text string")
    chunks = outline.generate_chunks(docs)
    items = chunks.first().clause.items_ if hasattr(chunks.first().clause, "items_") else chunks.first()["clause"]["items"]
    assert [i.item_no for i in items] == ["一", "二"]
    assert [(s.subitem_no, s.context) for s in items[0].sub_items] == [("一", "A"), ("b", "B\n1) C")]
    edges = {tuple(r) for r in outline.reference_edges(chunks).collect()}
    assert edges == {(1, "第一條_甲", None, None, "前項", "第一條前項"), (1, "第一條_甲", "一", None, "前項", "第一條前項")}
    assert [x.count() for x in outline.flatten_outline(chunks)] == [1, 2, 2]


def test_split_long(spark):
    parts = [c * (n - 1) + "。" for c, n in zip("甲乙丙丁", (300, 250, 600, 10), strict=True)]
    assert one(spark, "".join(parts), outline.split_long) == parts
    assert one(spark, "短", outline.split_long) == ["短"]


def test_dedupe_keeps_the_first(spark):
    rows = [(1, 1, "mother", "c", None, None), (1, 2, "referenced", "c", None, None), (1, 3, "item", "c", "一", None)]
    df = spark.createDataFrame(rows, "query_id long, rank int, source_type string, clause_id string, item_no string, subitem_no string")
    assert sorted(r.source_type for r in search.dedupe_candidates(df).collect()) == ["item", "mother"]


def test_history(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(24)]
    last = chat.conversation_history(chat.conversation_sessions(spark.createDataFrame(rows, "conv_id long, seq long, role string, content string"))).orderBy(F.desc("seq")).first()
    assert len(last.history) == 20 and last.history[0].content == "m3" and last.conversation_length == 10


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_topk_in_many_cells(spark, monkeypatch, metric):
    """Blocks of queries meet parts of vectors: equal to brute force, with ties, null vectors and no queries."""
    monkeypatch.setattr(search, "BLOCK", 5)
    x = np.random.default_rng(3).integers(-2, 3, (37, 3)).astype(float)
    rows = [(i, None if i == 9 else v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = vectors.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    norm = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    near = -((x[:, None] - x) ** 2).sum(2) if metric == "l2" else x @ x.T / norm[:, None] / norm
    want = {(q, n): int(v) for q in range(0, 37, 3) if q != 9 for n, v in enumerate(sorted((v for v in range(37) if v != 9), key=lambda v: (-near[q, v].round(9), v))[:4], 1)}
    assert {(r.query_id, r["rank"]): r.vec_id for r in search.block_topk(asked, vectors, 4, metric).collect()} == want
    assert search.block_topk(asked.limit(0), vectors, 4, metric).count() == 0 == search.block_topk(asked, vectors.limit(0), 4, metric).count()


def test_topk_ties_and_zero_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    asked = vectors.filter("vec_id = 1").withColumnRenamed("vec_id", "query_id")
    assert [(r.vec_id, r.score) for r in search.block_topk(asked, vectors, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]


def test_half_written_steps_are_written_again(spark, tmp_path):
    from clausewright.sources import tables

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    (tmp_path / "x" / "chunks").mkdir(parents=True)  # a write that was cut off has no mark of success
    tables.write_chunks(rows, f"file://{tmp_path}/x", "1.0")
    assert tables.read_chunks(spark, f"file://{tmp_path}/x").count() == 2
    tables.write_chunks(rows.limit(1), f"file://{tmp_path}/x", "1.0")
    assert tables.read_chunks(spark, f"file://{tmp_path}/x").count() == 2  # a whole one stays
    tables.write_chunks(rows.limit(1), f"file://{tmp_path}/x", "1.0", regenerate=True)
    assert tables.read_chunks(spark, f"file://{tmp_path}/x").count() == 1


def test_questions_in_order_of_files_and_lines(spark, tmp_path):
    from clausewright.sources import tables

    (tmp_path / "b.txt").write_text("third\n\n fourth \n")
    (tmp_path / "a.txt").write_text("first\n" + "x" * 5000 + "\n")
    got = sorted((r.query_id, r.text[:6]) for r in tables.read_questions(spark, f"file://{tmp_path}").collect())
    assert got == [(0, "first"), (1, "xxxxxx"), (2, "third"), (3, "fourth")]


def test_replies_are_asked_for_again(spark):
    from clausewright.functions import hooks
    from clausewright.operators import intents

    state = {"n": 0}

    def generate(said):
        state["n"] += 1
        if state["n"] == 1:
            raise RuntimeError("busy")
        return ("{broken", {}) if state["n"] == 2 else ('```json\n{"intents": []}\n```', {"total_tokens": 3})

    rows = spark.createDataFrame([(1, [("user", "x")])], "id long, messages array<struct<role string, content string>>")
    third = hooks.generate_replies(rows, generate, accept=intents.well_formed).first()
    assert third.error is None and third.usage.total_tokens == 3
    assert hooks.generate_replies(rows, lambda said: ("{broken", {}), accept=intents.well_formed).first().error == "malformed reply"
    assert [intents.well_formed(x) for x in (None, "", "[]", "{}", "```\n{}\n```")] == [False, False, False, True, True]


def plain_outline(text, spec):
    """Clauses with the chapter before them, by match positions."""
    text = re.sub("[\x01-\x04]", "", text or "").strip()
    chapters = [(m.start(), m[1], m[2].strip()) for m in re.finditer(f"(?m){spec.chapter}", text)]
    found = list(re.finditer(f"(?m){spec.clause}", text))
    rows = []
    for i, m in enumerate(found):
        before = [c for c in chapters if c[0] < m.start()]
        end = found[i + 1].start() if i + 1 < len(found) else len(text)
        rows.append((i, m[1], m[2].strip(), text[m.end() : end].strip(), *(before[-1][1:] if before else (None, None))))
    return rows


@pytest.mark.parametrize("spec", [outline.OutlineSpec(), outline.OutlineSpec(chapter=r"^(第[一二三]+[章條])\s*(.+?)$")])
def test_outline_equals_match_positions(spark, spec):
    """Random texts of headings, broken lines and marks; with the second pattern chapters and clauses start at the same places."""
    rng = random.Random(4)
    parts = ["第一章", "第二條", "第三條", "\n", "\n", "\n", " ", "　", "名", "一、", "\x01", "\x03", "第一章 總則\n", "\n第二條 題\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in outline.split_clauses(docs, spec).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.clause_no, r.clause_title, r.body, r.chapter_no, r.chapter_title))
    assert got == {i: rows for i, t in enumerate(texts) if (rows := plain_outline(t, spec))} and len(got) > 100


def plain_pieces(text, most=500):
    if len(text) <= most:
        return [text]
    out, buf = [], ""
    for s in re.split("(?<=[。；])", text):
        if len(buf) + len(s) <= most:
            buf += s
        else:
            out, buf = out + [buf], s
    return [p.strip() for p in [*out, buf] if p.strip()]


def test_long_texts_take_linear_time(spark):
    """Eight times the headings, or sentences, take at most eight times as long, and give the rows of the plain way."""
    took = {}
    for n in (4_000, 4_000, 32_000):  # the first run compiles
        heads = "\n".join(f"第一章 部{i}\n第二條 題{i}\n內容{i}。" for i in range(n // 2))
        text = "".join(f"第{i}句的內容。" for i in range(n))
        docs = spark.createDataFrame([(1, heads, text)], "doc_id long, text string, long string").repartition(1)
        for name, run in {
            "outline": lambda d: outline.split_clauses(d).select("pos", "chapter_title", "clause_title"),
            "flat": lambda d: flat.flat_chunks(d).select("chapter_pos", "chapter.title", "text"),
            "pieces": lambda d: d.select(F.posexplode(outline.split_long(F.col("long")))),
        }.items():
            began = time.time()
            rows = run(docs).collect()
            took[name, n] = time.time() - began
            if name == "pieces":
                assert [r.col for r in sorted(rows)] == plain_pieces(text)
            else:
                assert len(rows) == n // 2 and all(r[1].endswith(str(r[0])) for r in rows)
    for name in ("outline", "flat", "pieces"):
        assert took[name, 32_000] <= 8 * max(took[name, 4_000], 0.5)
