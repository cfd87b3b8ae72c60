"""Flat chunks, intents, retrieval, sources, jobs and streams, against hand-derived results and brute force."""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from clausewright.functions import hooks, segment
from clausewright.operators import cells, chat, flat, intents as I, numbering, outline, postings, retrieve as R, search, stats
from clausewright.plans import jobs, queries, retrieval_queries
from clausewright.sources import tables
from clausewright.streaming import live

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests' folder

TEXT = "第一章 總則\n第一條 延誤\n班機延誤四小時。\n一、甲依前項\n(一) 細目\n二、乙\n第二條 不保事項\n行李遺失不負理賠責任"


def encode(texts):
    """Deterministic stand-in: counts of hashed characters."""
    rows = np.zeros((len(texts), 16))
    for i, t in enumerate(texts):
        for c in t:
            rows[i, zlib.crc32(c.encode()) % 16] += 1
    return rows


def generate(messages):
    said = messages[-1]["content"]
    if "Question:" in said:
        return "answer", {"prompt_tokens": 2, "completion_tokens": 1, "total_tokens": 3}
    tags = ["延誤"] if "延誤" in said else []
    kind = "item" if "Item:" in said else "clause"
    return "```json\n" + json.dumps({"intents": [{"user_query": f"{kind}的問題是什麼", "excerpt": "摘要", "semantic_tags": tags, "referenced_clauses": ["第二條_不保事項"]}]}) + "\n```", {}


def test_flat_chunks(spark):
    docs = spark.createDataFrame([(1, "第零條 失\n" + TEXT), (2, None), (3, "第一章 甲\n第一條 乙\n一、丙")], "doc_id long, text string")
    rows = flat.flat_chunks(docs).orderBy("doc_id", "clause_pos", "item_pos").collect()
    assert [(r.doc_id, r.clause.no, r.item.no if r.item else None, r.text) for r in rows] == [
        (1, "第一條", "一", "班機延誤四小時。\n一、甲依前項\n(一) 細目"), (1, "第一條", "二", "班機延誤四小時。\n二、乙"),
        (1, "第二條", None, "行李遺失不負理賠責任"), (3, "第一條", None, "一、丙"),
    ]
    assert rows[0].semantic_scope == ["flight"] and rows[2].chunk_type == "procedure"


VALID = "semantic_tags array<string>, query_type string, user_query string, clause_keywords array<string>, clause_function string"


@pytest.mark.parametrize(
    ("row", "tags", "score"),
    [
        ((["遺失"], "直接查詢", "六個字以上了", ["延誤"], "一般規定"), ["遺失", "延誤"], 0.8),
        ((["延誤", "遺失"], "直接查詢", "六個字以上了", [], "一般規定"), ["延誤", "遺失"], 0.4),
        ((["遺失"], "對比查詢", "六個字以上了", [], "不保事項"), ["遺失", "不保"], 0.85),
        ((["遺失"], "對比查詢", "六個字以上了", ["竊盜"], "不保事項"), ["遺失", "竊盜", "不保"], 0.45),
        ((None, None, None, None, None), [], 0.9),
    ],
)
def test_validation(spark, row, tags, score):
    got = I.validate_intents(spark.createDataFrame([row], VALID)).first()
    assert got.semantic_tags == tags and got.quality_score == pytest.approx(score, abs=1e-9)


def test_replies(spark):
    said = ['```json\n{"intents": [{"user_query": "q"}]}\n```', '{"intents": [{"user_query": "q", "semantic_tags": ["a"]}]}', '{"intents": [', None, '{"x": 1}']
    rows = spark.createDataFrame(list(enumerate(said)), "i int, c string").select("i", I.parse_intent_response(F.col("c")).alias("r")).orderBy("i").collect()
    assert [len(r.r) for r in rows] == [1, 1, 0, 0, 0]
    assert rows[0].r[0].category == "其他" and rows[0].r[0].conditions == [] and rows[1].r[0].semantic_tags == ["a"]


def test_intents_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXT), (2, "沒有條文")], "doc_id long, text string")
    chunks, made = jobs.build_index(docs, generate, str(tmp_path / "index"))
    rows = made.orderBy("intent_id").collect()
    assert [(r.intent_id, r.item_no) for r in rows[:4]] == [("intent_0001", None), ("intent_0002", "一"), ("intent_0003", "二"), ("intent_0004", None)]
    assert len(rows) == 8 and {r.clause_id for r in rows[4:]} == {"第一條_延誤"}
    first = chunks.orderBy("pos").first().clause
    assert first.intent_ids == ["intent_0001"] and [i.intent_ids for i in first["items"]] == [["intent_0002"], ["intent_0003"]]
    jobs.build_index(docs.limit(0), generate, str(tmp_path / "index"))
    assert tables.read_intents(spark, str(tmp_path / "index")).count() == 8  # what exists stays

    vectors = jobs.intent_vectors(made, encode)
    asked = spark.createDataFrame([(7, "班機延誤多久可以理賠？"), (8, None)], "query_id long, text string")
    out = jobs.answer_batch(asked, vectors, chunks, encode, generate, k_intents=8, k_clauses=3).orderBy("query_id").collect()
    assert [r.answer for r in out] == ["answer"] * 2 and len(out[0].sources) == 3 and len(out[0].top_intents) == 8
    assert {s.clause_id for s in out[0].sources} <= {"第一條_延誤", "第二條_不保事項"}
    usage = spark.createDataFrame([(r.usage,) for r in out], "usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>")
    one = stats.token_usage_summary(usage).first()
    assert (one.n_questions, one.total_tokens, one.avg_tokens) == (2, 6, 3.0)
    assert {k: v.count() for k, v in jobs.index_stats(chunks, made).items()}["outline"] == 1


def test_a_failing_generator_keeps_its_rows(spark):
    from clausewright.functions import hooks, segment

    def broken(messages):
        raise ValueError("down")

    said = spark.createDataFrame([(1, [("user", "x")])], "query_id long, messages array<struct<role:string,content:string>>")
    row = hooks.generate_replies(said, broken).first()
    assert row.content is None and row.usage is None and row.error == "down"


@pytest.mark.parametrize(("use_bm25", "block"), [(True, 4096), (True, 2), (False, 7)])
def test_hybrid_equals_brute_force(spark, monkeypatch, use_bm25, block):
    """Also where queries and intents meet in many cells."""
    monkeypatch.setattr(search, "BLOCK", block)
    rng = np.random.default_rng(5)
    words = ["ab", "cd", "ef", "gh"]
    docs = [(f"i{n:02d}", " ".join(rng.choice(words, 5)), [["x"], ["y"], None][n % 3], None if n == 4 else [float(v) for v in rng.integers(-2, 3, 3)]) for n in range(40)]
    asked = [(1, "ab cd", ["x"], 5, [1.0, 0.0, 1.0]), (2, "zz", [], 3, [0.0, 1.0, 0.0]), (3, "ef ef", ["q"], 4, None)]
    intents = spark.createDataFrame(docs, "intent_id string, text string, semantic_tags array<string>, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, text string, tags array<string>, k_intents int, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.intent_id, r.hybrid_score) for r in R.hybrid_search(queries, intents, use_bm25=use_bm25).collect()}
    sparse = {}
    for r in search.max_normalise(search.bm25_scores(queries, search.bm25_index(intents, "intent_id"), "intent_id", "query_id"), "query_id").collect():
        sparse[r.query_id, r.intent_id] = r.score
    want = {}
    for q, _, tags, k, e in asked:
        rows = []
        for i, _, own, v in docs:
            norm = np.linalg.norm(e or [0]) * np.linalg.norm(v or [0])
            s = 0.85 * (np.dot(e, v) / norm if norm else 0.0) + (0.15 * sparse.get((q, i), 0.0) if use_bm25 else 0)
            rows.append((-round(s * (0.5 if tags and not set(tags) & set(own or []) else 1), 9), i))
        for n, (s, i) in enumerate(sorted(rows)[:k], 1):
            want[q, n] = (i, pytest.approx(-s, abs=2e-9))
    assert got == want


@pytest.mark.parametrize("use_bm25", [True, False])
def test_text_keys_find_what_numbers_find(spark, use_bm25):
    rng = np.random.default_rng(5)
    rows = [(i, f"w{i % 7} w{i % 3}", ["t"], rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(40)]
    intents = spark.createDataFrame(rows, "intent_id long, text string, semantic_tags array<string>, embedding array<double>")
    queries = intents.filter("intent_id % 4 = 1").selectExpr("intent_id AS query_id", "text", "array('t') AS tags", "4 AS k_intents", "embedding")
    named = lambda df, key: df.withColumn(key, F.format_string("k%04d", F.col(key)))
    number = lambda rows, key: sorted((int(str(r.query_id).strip("k")), r["rank"], int(str(r[key]).strip("k")), r[2]) for r in rows.collect())
    texts = named(queries, "query_id"), named(intents, "intent_id")
    assert number(R.hybrid_search(*texts, use_bm25=use_bm25), "intent_id") == number(R.hybrid_search(queries, intents, use_bm25=use_bm25), "intent_id")
    for metric in ("cosine", "l2"):
        assert number(search.block_topk(*texts, 3, metric, key="intent_id"), "intent_id") == number(search.block_topk(queries, intents, 3, metric, key="intent_id"), "intent_id")


def test_expansion_and_context(spark):
    chunks = outline.generate_chunks(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"))
    rows = [(1, 1, 1, "第一條_延誤", "一", "一", ["第二條_不保事項"]), (1, 2, 1, "第二條_不保事項", None, None, None)]
    found = spark.createDataFrame(rows, "query_id long, rank int, doc_id long, clause_id string, item_no string, subitem_no string, referenced_clauses array<string>")
    candidates = R.expand_intents(found, chunks)
    assert [r.source_type for r in candidates.orderBy("rank").collect()] == ["mother", "item", "subitem", "referenced"]
    queries = spark.createDataFrame([(1, "問", 2, [1.0] * 16)], "query_id long, text string, k_clauses int, embedding array<double>")
    kept = R.rerank_pairs(candidates, queries, None)
    assert R.build_context(kept, "answer").first().context == "【母條文】 第一條_延誤\n班機延誤四小時。\n一、甲依前項\n(一) 細目\n二、乙\n\n【子項目】 第一條_延誤 第一項\n甲依前項\n(一) 細目\n"
    assert R.build_context(kept).first().context.endswith("相關度: 1.000\n")
    scored = R.rerank_pairs(candidates, queries, lambda q, d: [-len(x) for x in d]).orderBy("rank").collect()
    assert [r.source_type for r in scored] == ["subitem", "referenced"]  # raw texts of 2 and 10 characters, the item's has 12
    assert R.rerank_cosine(candidates, queries, encode).count() == 2


def test_blocks_and_questions(spark, tmp_path):
    rows = [(1, 2, 100.0, 0, 10.0, "乙"), (1, 1, 100.0, 1, 50.0, "文。 38"), (1, 1, 100.0, 0, 10.0, "甲"), (1, 1, 100.0, 2, 96.0, "頁尾"), (1, 1, 100.0, 3, 90.0, "12")]
    blocks = spark.createDataFrame(rows, "doc_id long, page_no int, page_height double, block_no int, y0 double, text string")
    assert tables.assemble_documents(tables.drop_footer_blocks(blocks)).first().text == "甲\n文。\n乙"
    (tmp_path / "q.txt").write_text("一 \n\n　二\n \n三", "utf-8")
    assert [(r.query_id, r.text) for r in tables.read_questions(spark, f"file://{tmp_path}/q.txt").orderBy("query_id").collect()] == [(0, "一"), (1, "二"), (2, "三")]
    made = jobs.build_flat_index(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"), encode, str(tmp_path / "flat"), "v1", "n", "2026-01-01", "m").first()
    assert (made.num_chunks, made.version) == (3, "v1") and jobs.read_flat_index(spark, str(tmp_path / "flat"), "v1").count() == 3


def test_streamed_history_equals_batch(spark, tmp_path):
    said = ["a", "b", " ", "clear", "c", "d", "quit", "e"]
    rows = [(c, i, "user" if i % 2 == 0 or w in ("clear", "quit") else "assistant", w) for c in (1, 2) for i, w in enumerate(said)]
    for n, part in enumerate((rows[:5], rows[5:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        file = tmp_path / "in" / f"{n}.json"
        file.write_text("\n".join(json.dumps(dict(zip(("conv_id", "seq", "role", "content"), r, strict=True))) for r in part))
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # files stream in order of their times
    schema = "conv_id long, seq long, role string, content string"
    stream = live.stream_history(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = chat.conversation_history(chat.conversation_sessions(spark.createDataFrame(rows, schema)))
    shown = lambda df: sorted((r.conv_id, r.seq, [x.content for x in r.history]) for r in df.collect())
    assert shown(spark.table("seen")) == shown(batch)


def test_streamed_retrieval(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.json").write_text('{"query_id": 1, "text": "延誤"}')
    stream = spark.readStream.schema("query_id long, text string").json(str(tmp_path / "q"))
    live.stream_retrieve(stream, lambda b: R.prepare_queries(b, encode), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.tags for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [["延誤"]]


def test_intent_quality_asks_whole_texts(spark, monkeypatch):
    seen, validate = [], I.validate_intents
    monkeypatch.setattr(I, "validate_intents", lambda rows: seen.append(rows) or validate(rows))
    retrieval_queries.intent_quality(spark, "/root/testdata/sf0.001")
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert seen[0].join(texts, "doc_id").filter("user_query <> text").count() == 0


@pytest.mark.parametrize(("size", "light", "k"), [(64, 0.35, 3), (2, 0.35, 3), (1, 0.8, 2), (3, 0.0, 5), (2, 0.35, 50)])
def test_block_search_equals_brute_force(spark, monkeypatch, size, light, k):
    """Ties, repeated terms, terms of nearly all documents (negative idf), documents and queries without terms; and blocks that are not read."""
    monkeypatch.setattr(postings, "RANGE", size)
    monkeypatch.setattr(postings, "LIGHT", light)
    rng = np.random.default_rng(size)
    rare = [f"rare{i}" for i in range(40)]
    docs = [(i, " ".join([*rng.choice(["of", "the", "and"], 6), *rng.choice(["mid", "low", "far"], 2), *rng.choice(rare, 1)])) for i in range(60)]
    docs += [(60 + i, docs[3][1]) for i in range(4)] + [(70, ""), (71, None), (72, "rare1 rare1 rare1 rare2")]
    asked = [(1, "the rare1 rare2 mid"), (2, "of of the"), (3, ""), (4, None), (5, "unknown"), (6, docs[3][1]), (7, "rare1 unknown")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    corpus = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = postings.block_index(corpus, "doc_id")
    words = {i: (t or "").split() for i, t in docs}
    df = Counter(w for t in words.values() for w in set(t))
    n, avgdl = len(docs), np.mean([len(t) for t in words.values()])
    raw = {w: np.log(n - c + 0.5) - np.log(c + 0.5) for w, c in df.items()}
    mean = np.mean(list(raw.values()))
    want = {}
    for q, text in asked:
        scores = {}
        for i, t in words.items():
            if set(t) & set((text or "").split()):
                terms = [(raw[w] if raw[w] >= 0 else 0.25 * mean, t.count(w)) for w in (text or "").split() if w in df]
                scores[i] = sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for idf, tf in terms)
        top = max([0.0, *scores.values()])
        best = sorted((-round(s / top if top > 0 else s, 6), i) for i, s in scores.items())[:k]
        want |= {(q, r): (i, pytest.approx(-s, abs=2e-6)) for r, (s, i) in enumerate(best, 1)}
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in postings.bm25_topk(queries, index, k).collect()}
    assert got == want and min(raw.values()) < 0
    reads = {r.query_id: (r.n_blocks, r.n_read) for r in postings.block_reads(queries, index, k).collect()}
    assert all(read <= blocks for blocks, read in reads.values())
    if (size, light) == (2, 0.35) and k == 3:
        assert sum(read for _, read in reads.values()) < sum(blocks for blocks, _ in reads.values())


def test_a_written_index_keeps_texts_without_tokens_in_its_totals(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id long, text string")
    _, totals = search.bm25_counts(docs, "doc_id")
    assert tuple(totals.first()) == (3, pytest.approx(2 / 3))


def test_rounds_know_the_answers_before_them(spark):
    """Rounds in order of seq, sessions apart, failed rounds left out, 20 messages at most."""

    def answer(messages):
        if "fail" in messages[-1]["content"]:
            raise ValueError("down")
        return "|".join(m["content"] for m in messages[1:]), {"total_tokens": len(messages)}

    rows = [(1, 0, n, f"q{n}", f"p{n}") for n in range(13)] + [(1, 1, 20, "new", "P")] + [(2, 0, 5, "last", "L"), (2, 0, 1, "first", "F"), (2, 0, 3, "bad", "fail"), (None, None, 1, "alone", "A")]
    rounds = spark.createDataFrame(rows, "conv_id long, session long, seq long, query string, prompt string").repartition(3)
    got = {(r.conv_id, r.seq): r for r in chat.answer_rounds(rounds, answer, "sys").collect()}
    assert got[2, 1].content == "F" and got[2, 5].content == "first|F|L" and got[2, 3].content is None and got[2, 3].error == "down"
    assert (got[2, 3].n_history, got[2, 3].conversation_length, got[2, 5].n_history, got[2, 5].conversation_length) == (2, 1, 2, 2)
    assert got[1, 12].usage.total_tokens == 22 and got[1, 12].content.startswith("q2|") and got[1, 12].conversation_length == 10
    assert got[1, 20].content == "P" and got[None, 1].content == "A" and len(got) == len(rows)
    assert chat.answer_rounds(rounds.limit(0), answer, "sys").count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_rows_are_numbered_over_the_whole_table(spark, partitions):
    rows = [(n % 7, n) for n in range(200)] + [(None, 1000), (3, 1001)] + [(5, 5)] * 60
    made = spark.createDataFrame(rows, "a int, b int").repartition(4)
    got = numbering.number_rows(made, [F.col("a").desc_nulls_last(), F.col("b").asc()], "n", partitions).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(1, len(rows) + 1))
    assert numbering.number_rows(made.limit(0), [F.col("a")], "n").count() == 0


def test_replies_are_kept_over_broken_runs(spark, tmp_path):
    """A run that breaks in its second half has its first waves' replies; no prompt of theirs, and no prompt twice, is asked for again."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def generate(messages):
        said = messages[0]["content"]
        (calls / f"{said}-{os.urandom(4).hex()}").touch()
        if (tmp_path / "broken").exists() and len(list(calls.iterdir())) > 6:
            os._exit(1)  # the worker dies
        return "" if said == "odd" else said.upper(), {}

    texts = [f"text{i}" for i in range(12)] + ["odd", "text3", "text3"]
    rows = spark.createDataFrame([(i, [("user", t)]) for i, t in enumerate(texts)], "i int, messages array<struct<role:string,content:string>>").repartition(2)
    asked = lambda: Counter(p.name.rpartition("-")[0] for p in calls.iterdir())
    run = lambda: hooks.durable_replies(rows, generate, f"file://{tmp_path}/replies", accept=bool, waves=6)
    (tmp_path / "broken").touch()
    with pytest.raises(Exception):  # noqa: B017, PT011
        run()
    kept = {r.content.lower() for r in spark.read.parquet(f"file://{tmp_path}/replies").collect()}
    before = asked()
    (tmp_path / "broken").unlink()
    found = run()
    got = {r.i: (r.content, r.error) for r in found.collect()}
    assert got == {i: (t.upper(), None) if t != "odd" else (None, hooks.REFUSED) for i, t in enumerate(texts)}
    assert kept and all(asked()[t] == before[t] for t in kept)
    assert all(n - before[t] <= 1 for t, n in asked().items() if t != "odd") and asked()["odd"] - before["odd"] == 3
    assert tuple(hooks.malformed(found).first()) == (len(texts), 1, 0)
    again = asked()
    assert {r.i: (r.content, r.error) for r in run().collect()} == got
    assert {t: n - again[t] for t, n in asked().items() if n != again[t]} == {"odd": 3}  # only what was refused


def test_versions_are_seen_whole_or_not_at_all(spark, tmp_path):
    base, frame = f"file://{tmp_path}/base", lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    tables.commit_version(base, "1", {"a": frame(1, 2), "b": frame(3)}, notes="n")
    opened = tables.read_version(spark, base, "1", "a")
    broken = frame(7).withColumn("x", F.raise_error(F.lit("killed")).cast("int"))
    with pytest.raises(Exception, match="killed"):
        tables.commit_version(base, "1", {"a": frame(9), "b": broken})
    assert sorted(r.x for r in tables.read_version(spark, base, "1", "a").collect()) == [1, 2]
    row = tables.commit_version(base, "1", {"a": frame(4)}).first()
    assert row.counts == {"a": 1} and [r.x for r in tables.read_version(spark, base, "1", "a").collect()] == [4]
    assert sorted(r.x for r in opened.collect()) == [1, 2]  # who has opened the old one keeps it
    with pytest.raises(ValueError, match="no version 2"):
        tables.read_version(spark, base, "2", "a")


def test_a_repeated_batch_answers_once(spark, tmp_path):
    """The second run repeats the last batch, as after a failure between its output and its commit."""
    (tmp_path / "q").mkdir()
    seen = []

    def retrieve(batch):
        seen.append(sorted(r.query_id for r in batch.collect()))
        return R.prepare_queries(batch, encode)

    def run():
        stream = spark.readStream.schema("query_id long, text string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/q")
        live.stream_retrieve(stream, retrieve, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()

    for n in range(2):
        (tmp_path / "q" / f"{n}.json").write_text(json.dumps({"query_id": n, "text": "延誤"}))
        run()
    os.remove(tmp_path / "cp" / "commits" / "1")
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert seen == [[0], [1], [1]]
    assert sorted(r.query_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1]


@pytest.mark.parametrize(("metric", "n", "k", "block"), [("cosine", 8, 3, 4096), ("l2", 8, 3, 4096), ("cosine", 3, 40, 5), ("l2", 1, 2, 7), ("l2", 64, 300, 50)])
def test_cell_search_equals_all_rows(spark, monkeypatch, metric, n, k, block):
    """Ties, equal and zero and null vectors, cells of one hot vector, and cells that are cut into parts."""
    monkeypatch.setattr(search, "BLOCK", block)
    rng = np.random.default_rng(n)
    groups = rng.normal(0, 8, (6, 5))
    rows = [(i, [float(round(x, 2)) for x in groups[i % 6] + rng.normal(0, 0.5, 5)]) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(40)] + [(300, [0.0] * 5), (301, [0.0] * 5), (302, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = [(i, v) for i, v in rows if i % 20 == 0 or i in (302,)] + [(900, [50.0, -50.0, 0.0, 0.0, 1.0])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    index = cells.fit_cells(vectors, metric, cells=n)
    found, visits = cells.search_cells(queries, index, k)
    shown = lambda df: {(r.query_id, r["rank"]): (r.vec_id, pytest.approx(r.score, abs=1e-7)) for r in df.collect()}
    assert shown(found) == shown(search.block_topk(queries, vectors, k, metric))
    read = {r.query_id: r for r in cells.rows_read(visits, index).collect()}
    assert len(read) == len(asked) - 1 and all(r.n_rows <= r.n_rows_all == 192 for r in read.values())
    if n == 8 and k == 3:
        assert sum(r.n_rows for r in read.values()) < 0.7 * 192 * len(read)
    assert cells.search_cells(queries.limit(0), index, k)[0].count() == 0
    assert cells.search_cells(queries, cells.fit_cells(vectors.limit(0), metric, cells=n), k)[0].count() == 0


def all_splits(run):
    if not run:
        yield []
    for n in range(1, len(run) + 1):
        for rest in all_splits(run[n:]):
            yield [run[:n], *rest]


def test_segmentation_equals_all_paths(spark):
    """Every way to cut a run, unknown characters as words seen once; of equally probable ones the first words are longest."""
    rng = np.random.default_rng(8)
    letters = "甲乙丙丁"
    for case in range(60):
        counts = {"".join(rng.choice(list(letters[:3]), rng.integers(1, 4))): float(rng.integers(1, 6)) for _ in range(case % 9)}
        words, total = segment.Words(counts), sum(counts.values()) or 1
        unknown = -np.log(max(total, 2))

        def score(path):
            if any(len(w) > 1 and w not in counts for w in path):
                return -np.inf
            return sum(max(np.log(counts[w] / total), unknown) if len(w) == 1 and w in counts else np.log(counts[w] / total) if w in counts else unknown for w in path)

        for _ in range(5):
            run = "".join(rng.choice(list(letters), rng.integers(0, 8)))
            paths = [(score(p), p) for p in all_splits(run)]
            top = max(s for s, _ in paths)
            assert words.split(run) == max((p for s, p in paths if s >= top - 1e-9), key=lambda p: [len(w) for w in p])
    assert segment.Words({"甲" * 3: 1}).split("甲" * 50_000)[:2] == ["甲甲甲"] * 2


def test_segmented_words_in_an_index(spark):
    docs = spark.createDataFrame([(1, "旅遊延誤理賠 abc12"), (2, "延誤"), (3, None)], "doc_id long, text string")
    table = spark.createDataFrame([("旅遊", 3), ("延誤", 2), ("延誤", 3), (None, 4), ("誤理", 1)], "word string, n long")
    cut = segment.segmenter(table)
    assert [r.t for r in docs.select("doc_id", cut(F.col("text")).alias("t")).orderBy("doc_id").collect()] == [["旅遊", "延誤", "理", "賠", "abc12"], ["延誤"], []]
    asked = spark.createDataFrame([(1, "延誤")], "query_id long, text string")
    index = postings.block_index(docs, "doc_id", cut)
    assert {r.doc_id for r in postings.bm25_topk(asked, index, 5, tokens=cut).collect()} == {1, 2}


@pytest.mark.parametrize(("block", "k"), [(4096, 3), (2, 2), (1, 50)])
def test_best_search_equals_all_pairs(spark, monkeypatch, block, k):
    """Several blocks of queries, equal texts, rows that share a key or have none, terms of nearly all texts, texts and queries without terms."""
    monkeypatch.setattr(search, "BLOCK", block)
    rng = np.random.default_rng(block)
    docs = [(i, " ".join([*rng.choice(["of", "the", "and"], 5), *rng.choice([f"rare{i}" for i in range(20)], 2)])) for i in range(50)]
    docs += [(60 + i, docs[3][1]) for i in range(6)] + [(70, ""), (71, None), (None, "rare1 of"), (80, "rare1 the"), (80, "rare1 rare2"), (80, ""), (None, "rare3")]
    asked = [(1, "the rare1 rare2 rare1"), (2, "of of the"), (3, ""), (4, None), (5, "unknown"), (6, docs[3][1]), (7, "rare3 rare1 unknown")]
    queries, corpus = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    pairs = search.bm25_scores(queries, search.bm25_index(corpus, "doc_id"), "doc_id", "query_id")
    want = search.top_k(search.max_normalise(pairs, "query_id").withColumn("score", F.round("score", 6)), "query_id", "doc_id", k)
    rows = lambda found: {(r.query_id, r["rank"]): (r.doc_id, pytest.approx(r.score, abs=2e-6)) for r in found.collect()}
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in search.bm25_best(queries, corpus, "doc_id", k).collect()}
    assert got == rows(want) and len(got) > k


def test_best_search_writes_no_pairs(spark, monkeypatch):
    written, keep = {}, tables.stored
    for module in (search, tables):
        monkeypatch.setattr(module, "stored", lambda df, label: written.setdefault(label, keep(df, label)))
    found = queries.bm25_search(spark, "/root/testdata/sf0.01")
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").count()
    asked = found.select("query_id").distinct().count()
    assert found.count() == 10 * asked
    assert all(t.count() < docs * asked / 3 for t in written.values() if "query_id" in t.columns)
    assert all("doc_id" not in t.columns or "term" not in t.columns for t in written.values())


def test_retrieval_writes_no_pairs_and_few_chunks(spark, monkeypatch):
    """Sparse scores meet their intents in the cell, and only the chunks of found documents are made with their details."""
    written, keep = {}, tables.stored
    for module in (search, tables, R):
        monkeypatch.setattr(module, "stored", lambda df, label: written.setdefault(label, keep(df, label)))
    whole = queries.stored_statutes
    monkeypatch.setattr(queries, "stored_statutes", lambda *a: written.setdefault("statutes", whole(*a)))
    assert retrieval_queries.retrieve_clauses(spark, "/root/testdata/sf0.001").count() > 0
    found = {r.doc_id for r in written["found-intents"].select("doc_id").collect()}
    assert {r.doc_id for r in written["found-chunks"].select("doc_id").collect()} == found
    assert "statutes" not in written and "bm25-hits" not in written and "clause" not in written["heading-intents"].columns
    assert all("term" not in t.columns or not {"_intent", "intent_id"} & set(t.columns) for t in written.values())


def test_block_search_writes_no_pairs_or_postings(spark, monkeypatch):
    """Ranges are searched where they lie: what is written is one row a range, and a task's best of a query."""
    written, keep = {}, tables.stored
    for module in (search, postings):
        monkeypatch.setattr(module, "stored", lambda df, label: written.setdefault(label, keep(df, label)))
    docs, asked = (queries.table(spark, "/root/testdata/sf0.01", t).count() for t in ("documents", "benchmark"))
    reads = queries.bm25_block_reads(spark, "/root/testdata/sf0.01").count()
    assert 0 < reads <= asked and 0 < written["bm25-blocks"].count() <= -(-docs // postings.RANGE)
    assert all("doc_id" not in t.columns or "term" not in t.columns for t in written.values())
    assert all(t.count() < docs * asked / 4 for t in written.values() if {"doc_id", "query_id"} <= set(t.columns))


def test_searches_without_known_terms_find_nothing(spark):
    docs, asked = spark.createDataFrame([(1, "a"), (2, "b b")], "doc_id long, text string"), spark.createDataFrame([(1, "zz")], "query_id long, text string")
    index = postings.block_index(docs, "doc_id")
    for queries_ in (asked, asked.limit(0)):
        assert search.bm25_best(queries_, docs, "doc_id", 2).count() == 0
        assert postings.bm25_topk(queries_, index, 2).count() == postings.block_reads(queries_, index, 2).count() == 0
