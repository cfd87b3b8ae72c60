"""Registered queries of cleaning, references, prompts, replies, expansion, reranking, contexts, numbering and statistics, with their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.functions import lexicon, text as T
from clausewright.operators import intents as I, outline, retrieve as R, stats
from clausewright.plans import queries as Q
from clausewright.plans.retrieval_queries import LINES, _lines, letter_counts, letters_sql
from clausewright.sources import nested, tables

#: Documents in a group that stands for one query.
GROUP = 20


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.table(spark, sf_dir, "documents")


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, dressed with page numbers and an item number, then cleaned in the three ways."""
    lines = _lines()
    paged = F.transform(lines, lambda x, i: F.when(i % 3 == 1, F.concat(x, F.lit("\n12"))).when(i % 3 == 2, F.concat(x, F.lit("。 7"))).otherwise(x))
    spaced = F.transform(lines, lambda x: F.concat(x, F.lit("\n12\n")))
    return _documents(spark, sf_dir).select(
        "doc_id", T.clean_page_numbers(F.array_join(paged, "\n")).alias("cleaned"), T.clean_text(F.concat(F.lit("一、 (二) "), F.array_join(lines, "\n"))).alias("one_line"),
        T.clean_flat_text(F.array_join(spaced, "\n")).alias("flat"),
    ).na.fill("", ["cleaned", "one_line", "flat"])


CLEAN_TEXTS = (
    LINES
    + """
SELECT d.doc_id, coalesce(cleaned, '') AS cleaned, coalesce(one_line, '') AS one_line, coalesce(flat, '') AS flat FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line || CASE WHEN i % 3 = 2 THEN '。' ELSE '' END, chr(10) ORDER BY i) AS cleaned,
    string_agg(line, ' ' ORDER BY i) AS one_line, string_agg(line, chr(10) ORDER BY i) AS flat
  FROM lines GROUP BY doc_id) USING (doc_id)
"""
)


def clause_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of texts whose numbers are hours, and the labels of what is put behind them."""
    text = F.coalesce("text", F.lit(""))
    k = F.col("doc_id") % 3
    body = F.concat(text, F.when(k == 0, F.lit("延遲")).when(k == 1, F.lit("保險金額 強盜")).otherwise(""))
    return _documents(spark, sf_dir).select(
        "doc_id", F.array_join(T.extract_entities(F.regexp_replace(text, "[0-9]+", "$0小時"))["時間"], ",").alias("hours"),
        F.array_join(lexicon.label_all(body, lexicon.ACTIONS), ",").alias("actions"), lexicon.clause_function(F.lit("x"), body).alias("clause_function"),
        F.array_join(lexicon.insurance_types(F.when(k == 2, F.lit("信用卡")), body), ",").alias("insurance_types"),
    )


CLAUSE_LABELS = """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda x: x || '小時'))), ',') AS hours,
  CASE doc_id % 3 WHEN 0 THEN '延誤' WHEN 1 THEN '搶奪' ELSE '' END AS actions,
  CASE doc_id % 3 WHEN 1 THEN '理賠金額' ELSE '一般規定' END AS clause_function,
  CASE doc_id % 3 WHEN 0 THEN '其他' WHEN 1 THEN '行李損失,現金竊盜' ELSE '信用卡盜用' END AS insurance_types
FROM documents
"""


def _statutes_with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``statutes``, but items are numbered two and refer to a paragraph and a clause, and sub-items to their clause."""
    text = F.regexp_replace("text", "(?m)^一、(.*)$", "二、$1 依前項及第二條")
    return Q.statutes(spark, sf_dir).select("doc_id", F.regexp_replace(text, r"(?m)^\(一\)(.*)$", "(一)$1 見本條").alias("text"))


def clause_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = outline.reference_edges(outline.generate_chunks(_statutes_with_references(spark, sf_dir)))
    return edges.select("doc_id", "clause_id", F.coalesce("item_no", F.lit("")).alias("item_no"), F.coalesce("subitem_no", F.lit("")).alias("subitem_no"), "ref", "target")


_CLAUSES = (
    Q._LINES
    + """,
clauses AS (
  SELECT h.doc_id, h.i // 4 AS pos, '第' || translate((h.i // 4 + 1)::VARCHAR, '0123456789', '百一二三四五六七八九') || '條' AS clause_no, h.line AS title,
    clause_no || '_' || h.line AS clause_id, a.line AS item, b.line AS subitem
  FROM lines h LEFT JOIN lines a ON a.doc_id = h.doc_id AND a.i = h.i + 2 LEFT JOIN lines b ON b.doc_id = h.doc_id AND b.i = h.i + 3
  WHERE h.i % 4 = 0)
"""
)
CLAUSE_REFERENCES = (
    _CLAUSES
    + """
SELECT doc_id, clause_id, item_no, subitem_no, ref, target FROM (
  SELECT *, '' AS item_no, '' AS subitem_no, '前項' AS ref, clause_no || '前項' AS target FROM clauses WHERE item IS NOT NULL
  UNION ALL SELECT *, '', '', '第二條', '第二條' FROM clauses WHERE item IS NOT NULL
  UNION ALL SELECT *, '', '', '本條', clause_no || '條' FROM clauses WHERE subitem IS NOT NULL
  UNION ALL SELECT *, '二', '', '前項', clause_no || '第一項' FROM clauses WHERE item IS NOT NULL
  UNION ALL SELECT *, '二', '', '第二條', '第二條' FROM clauses WHERE item IS NOT NULL
  UNION ALL SELECT *, '二', '', '本條', clause_no || '條' FROM clauses WHERE subitem IS NOT NULL
  UNION ALL SELECT *, '二', '一', '本條', clause_no || '條' FROM clauses WHERE subitem IS NOT NULL)
"""
)


def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and numbers of intents and clauses of documents with a question behind them; a given number of 0 counts as not given."""
    k = F.col("doc_id") % 5
    asked = F.when(k == 0, F.lit("延誤了 哪些")).when(k == 1, F.lit("弄丟 多久")).when(k == 2, F.lit("取消")).when(k == 4, F.lit("不")).otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), asked)
    k_intents, k_clauses = lexicon.smart_top_k(text, F.col("doc_id") % 7)
    fixed = lexicon.smart_top_k(text, auto=False)
    tags = F.array_join(lexicon.label_all(text, lexicon.QUERY_TAGS), ",")
    return _documents(spark, sf_dir).select("doc_id", tags.alias("tags"), k_intents.cast("long").alias("k_intents"), k_clauses.cast("long").alias("k_clauses"), fixed[0].cast("long").alias("k_fixed"))


QUESTION_PLANS = """
SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 1 THEN '遺失' END, CASE WHEN doc_id % 5 = 0 OR contains(text, 'delay') THEN '延誤' END,
    CASE WHEN doc_id % 5 = 2 THEN '取消' END, CASE WHEN doc_id % 5 IN (0, 4) THEN '不保' END) AS tags,
  CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 ELSE CASE doc_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 3 ELSE 5 END END::BIGINT AS k_intents,
  CASE doc_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 3 END::BIGINT AS k_clauses, 5::BIGINT AS k_fixed
FROM documents
"""


def intent_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of clauses and items made of documents, each with the text that an intent of it is indexed by."""
    text, source = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    item = F.struct(F.lit("一").alias("item_no"), F.array(F.lit("遺失"), F.lit("損失")).alias("action_keywords"), source.alias("context"))
    clause = F.struct(
        F.lit("第一條").alias("clause_no"), source.alias("clause_title"), F.lit("第一條_x").alias("clause_id"), F.col("lang").alias("clause_function"),
        F.array(F.lit("a"), F.lit("b")).alias("insurance_types"), F.array(F.lit("延誤")).alias("action_keywords"), text.alias("context"), F.array(item).alias("items"),
    )
    conditions = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    indexed = I.intent_corpus_text(F.col("text"), F.col("source"), conditions, F.when(F.col("doc_id") % 3 == 0, F.lit("理賠")).otherwise(""))
    chunks = _documents(spark, sf_dir).select("doc_id", F.lit(0).alias("pos"), clause.alias("clause"), indexed.alias("indexed"))
    asked = I.clause_intent_prompts(chunks).unionByName(I.item_intent_prompts(chunks))
    return asked.join(chunks.select("doc_id", "indexed"), "doc_id").select("doc_id", F.col("item_pos").cast("long").alias("item_pos"), "prompt", "indexed")


def _filled(template: str, **values: str) -> str:
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return " || ".join(values[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts))


def _prompts_sql() -> str:
    common = {"clause_no": "'第一條'", "clause_title": "coalesce(source, '')", "clause_function": "coalesce(lang, '')"}
    clause = _filled(I.CLAUSE_PROMPT, **common, insurance_types="'a, b'", action_keywords="'延誤'", context="coalesce(text, '')")
    item = _filled(I.ITEM_PROMPT, **common, item_no="'一'", action_keywords="'遺失, 損失'", item_context="coalesce(source, '')")
    indexed = "'問題: ' || coalesce(text, '') || ' | 內容: ' || coalesce(source, '') || CASE WHEN doc_id % 2 = 0 THEN ' | 條件: x; y' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' | 類別: 理賠' ELSE '' END AS indexed"
    return f"SELECT doc_id, -1::BIGINT AS item_pos, {clause} AS prompt, {indexed} FROM documents UNION ALL SELECT doc_id, 0, {item}, {indexed} FROM documents"


def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of replies that are fenced, bare, broken or short of fields, by turns."""
    made = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("user_query"), F.col("lang").alias("category"), F.array("source").alias("semantic_tags"))).alias("intents")))
    k = F.col("doc_id") % 4
    short = F.lit('```\n{"intents": [{"query_type": "對比查詢"}, null]}\n```')
    content = F.when(k == 0, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).when(k == 1, made).when(k == 2, F.substring_index(made, "]", 1)).otherwise(short)
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(I.parse_intent_response(content)).alias("i"))
    return rows.select("doc_id", "i.user_query", "i.category", "i.query_type", "i.difficulty", F.array_join("i.semantic_tags", ",").alias("tags"), F.size("i.conditions").cast("long").alias("n_conditions"))


PARSED_REPLIES = """
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN coalesce(text, '') ELSE '' END AS user_query, CASE WHEN doc_id % 4 < 2 THEN coalesce(lang, '其他') ELSE '其他' END AS category,
  CASE WHEN doc_id % 4 < 2 THEN '直接查詢' ELSE '對比查詢' END AS query_type, '簡單' AS difficulty, CASE WHEN doc_id % 4 < 2 THEN coalesce(source, '') ELSE '' END AS tags,
  0::BIGINT AS n_conditions
FROM documents WHERE doc_id % 4 <> 2
"""


def expanded_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document an intent at its first clause's sub-item that refers to the second clause and to the first: the places it leads to, in order."""
    chunks = Q.stored_statutes(spark, sf_dir)
    ids = chunks.groupBy("doc_id").agg(F.min_by("clause.clause_id", "pos").alias("first"), F.max(F.when(F.col("pos") == 1, F.col("clause.clause_id"))).alias("second"))
    found = ids.select(
        F.col("doc_id").alias("query_id"), "doc_id", F.lit(1).alias("rank"), F.col("first").alias("clause_id"), F.lit("一").alias("item_no"), F.lit("一").alias("subitem_no"),
        F.array(F.coalesce("second", F.lit("none")), "first").alias("referenced_clauses"),
    )
    rows = R.expand_intents(found, chunks)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return rows.select("query_id", place.cast("long").alias("place"), "source_type", "clause_id", F.coalesce("item_no", F.lit("")).alias("item_no"), F.coalesce("subitem_no", F.lit("")).alias("subitem_no"))


EXPANDED_CLAUSES = (
    _CLAUSES
    + """
SELECT doc_id AS query_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS place, source_type, clause_id, item_no, subitem_no FROM (
  SELECT doc_id, 0 AS k, 'mother' AS source_type, clause_id, '' AS item_no, '' AS subitem_no FROM clauses WHERE pos = 0
  UNION ALL SELECT doc_id, 1, 'item', clause_id, '一', '' FROM clauses WHERE pos = 0 AND item IS NOT NULL
  UNION ALL SELECT doc_id, 2, 'subitem', clause_id, '一', '一' FROM clauses WHERE pos = 0 AND subitem IS NOT NULL
  UNION ALL SELECT doc_id, 3, 'referenced', clause_id, '', '' FROM clauses WHERE pos = 1)
"""
)


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Groups of documents as candidates of a query, whose text is the group's first."""
    docs = _documents(spark, sf_dir).select(F.floor(F.col("doc_id") / GROUP).alias("query_id"), "doc_id", F.col("doc_id").alias("rank"), F.coalesce("text", F.lit("")).alias("raw_text"))
    queries = docs.groupBy("query_id").agg(F.min_by("raw_text", "doc_id").alias("text"), F.lit(3).alias("k_clauses"))
    return docs, queries


def _picked(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("similarity_score", 6).alias("similarity_score"), F.round("rerank_score", 6).alias("rerank_score"))


def pair_reranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries = _candidates(spark, sf_dir)
    scored = R.rerank_pairs(docs, queries, lambda asked, found: [len(q) % 7 + len(d) % 11 for q, d in zip(asked, found, strict=True)])
    return _picked(scored).withColumn("style", F.lit("scored")).unionByName(_picked(R.rerank_pairs(docs, queries, None)).withColumn("style", F.lit("off")))


def cosine_reranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries = _candidates(spark, sf_dir)
    asked = queries.withColumn("embedding", F.transform(F.array(*map(F.lit, ("e", "a", "t"))), lambda c: (F.length("text") - F.length(F.replace("text", c))).cast("double")))
    return _picked(R.rerank_cosine(docs, asked.withColumn("embedding", F.concat("embedding", F.array(F.lit(1.0)))), letter_counts))


_CANDIDATES = f"""
WITH d AS (SELECT doc_id // {GROUP} AS query_id, doc_id, coalesce(text, '') AS t FROM documents),
q AS (SELECT query_id, arg_min(t, doc_id) AS q FROM d GROUP BY query_id),
"""
PAIR_RERANKING = (
    _CANDIDATES
    + """
s AS (SELECT query_id, doc_id, (length(q) % 7 + length(t) % 11)::DOUBLE AS score FROM d JOIN q USING (query_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, 0.0::DOUBLE AS similarity_score, score AS rerank_score, 'scored' AS style
FROM s QUALIFY rank <= 3
UNION ALL SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank, doc_id, 0.0::DOUBLE, 1.0::DOUBLE, 'off' FROM s QUALIFY rank <= 3
"""
)


COSINE_RERANKING = (
    _CANDIDATES
    + f"""
s AS (SELECT query_id, doc_id, round(list_cosine_similarity({letters_sql("q")}, {letters_sql("t")}), 9) AS score FROM d JOIN q USING (query_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 6) AS similarity_score, round(score, 6) AS rerank_score
FROM s QUALIFY rank <= 3
"""
)


def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer is made of, for groups of documents as ranked clauses and intents: contexts in three styles, prompts, sources, intents, results."""
    k = F.col("doc_id")
    kinds = F.create_map(*[F.lit(x) for pair in (("en", "mother"), ("fr", "item"), ("de", "subitem"), ("es", "referenced")) for x in pair])
    clauses = _documents(spark, sf_dir).select(
        F.floor(k / GROUP).alias("query_id"), (k % GROUP + 1).cast("int").alias("rank"), F.coalesce(kinds[F.col("lang")], F.lit("x")).alias("source_type"), F.coalesce("source", F.lit("")).alias("clause_id"),
        F.when(k % 2 == 0, F.lit("二")).alias("item_no"), F.when(k % 4 == 0, F.lit("三")).otherwise("").alias("subitem_no"), F.coalesce("text", F.lit("")).alias("content"),
        F.lit("").alias("raw_text"), F.lit(0.0).alias("similarity_score"), (k % 1000 / 1000).alias("rerank_score"),
    )
    found = clauses.select("query_id", "rank", F.col("clause_id").alias("intent_id"), F.col("source_type").alias("user_query"), F.lit("c").alias("category"), F.col("rerank_score").alias("hybrid_score"))
    queries = clauses.groupBy("query_id").agg(F.lit("q").alias("text"), F.array(F.lit("延誤")).alias("tags"), F.lit(5).alias("k_intents"), F.count("*").alias("k_clauses"))
    contexts = R.build_context(clauses)
    prompts = R.answer_prompts(queries, contexts, "s", "{context}|{query}").select("query_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("prompt"))
    sources = R.extract_sources(clauses).select("query_id", F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["clause_id"], s["source_type"], F.format_string("%.3f", s["similarity_score"]), s["item_no"])), ",").alias("sources"))
    whole = R.results(queries, found, clauses).select(
        "query_id", F.array_join("detected_semantic_tags", ",").alias("tags"), F.col("top_k_intents").cast("long").alias("k"), F.size("top_clauses").cast("long").alias("n_clauses"),
        F.array_join(F.transform(F.slice("top_intents", 1, 3), lambda i: F.concat(i["intent_id"], F.lit(":"), i["user_query"])), ",").alias("intents"),
    )
    out = contexts.withColumnRenamed("context", "llm")
    for style in ("answer", "similarity"):
        out = out.join(R.build_context(clauses, style).withColumnRenamed("context", style), "query_id")
    return out.join(prompts, "query_id").join(sources, "query_id").join(whole, "query_id")


ANSWER_CONTEXTS = f"""
WITH c AS (
  SELECT doc_id // {GROUP} AS query_id, doc_id % {GROUP} + 1 AS rank, coalesce(source, '') AS clause_id, coalesce(text, '') AS content, printf('%.3f', doc_id % 1000 / 1000.0) AS score,
    CASE lang WHEN 'en' THEN 'mother' WHEN 'fr' THEN 'item' WHEN 'de' THEN 'subitem' WHEN 'es' THEN 'referenced' ELSE 'x' END AS kind,
    CASE lang WHEN 'en' THEN '母條文' WHEN 'fr' THEN '子項目' WHEN 'de' THEN '子款項' WHEN 'es' THEN '引用條文' ELSE '其他' END AS label,
    CASE WHEN doc_id % 2 = 0 THEN ' 第二項' ELSE '' END AS item, doc_id % 2 = 0 AS even, doc_id % 4 = 0 AS sub
  FROM documents),
b AS (
  SELECT query_id, string_agg('【條文 ' || rank || '】' || label || ' - ' || clause_id || item || CASE WHEN sub THEN ' 第三款' ELSE '' END || chr(10) || '內容: ' || content || chr(10)
      || '相關度: ' || score || chr(10), chr(10) ORDER BY rank) AS llm,
    string_agg('【' || label || '】 ' || clause_id || item || CASE WHEN sub THEN ' (三)' ELSE '' END || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS answer,
    string_agg('【條文 ' || rank || '】' || label || ' - ' || clause_id || item || CASE WHEN sub THEN ' 第三款' ELSE '' END || chr(10) || '內容: ' || content || chr(10)
      || '相似度: ' || score || chr(10), chr(10) ORDER BY rank) AS similarity,
    string_agg(clause_id || '/' || kind || '/' || score || CASE WHEN even THEN '/二' ELSE '' END, ',' ORDER BY rank) AS sources, count(*) AS n_clauses,
    array_to_string(list(clause_id || ':' || kind ORDER BY rank)[1:3], ',') AS intents
  FROM c GROUP BY query_id)
SELECT *, 'system:s|user:' || llm || '|q' AS prompt, '延誤' AS tags, 5::BIGINT AS k FROM b
"""


def numbered_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause and item intents of dressed documents, numbered, and given back to the clauses and items they belong to."""
    chunks = outline.generate_chunks(Q.statutes(spark, sf_dir), details=False)
    of_clauses = chunks.select("doc_id", "pos", F.lit(-1).alias("item_pos"), F.lit(0).alias("n"))
    of_items = chunks.select("doc_id", "pos", F.posexplode("clause.items").alias("item_pos", "i")).select("doc_id", "pos", "item_pos", F.lit(0).alias("n"))
    intents = I.number_intents(of_items.unionByName(of_clauses))
    attached = I.attach_intent_ids(chunks, intents)
    first = F.try_element_at("clause.items", F.lit(1))["intent_ids"]
    return attached.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("clause.intent_ids", ",").alias("clause_intents"), F.coalesce(F.array_join(first, ","), F.lit("")).alias("item_intents"))


NUMBERED_INTENTS = (
    Q._LINES
    + """,
n AS (SELECT doc_id, i, 'intent_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY i))::VARCHAR, 4, '0') AS id FROM lines WHERE i % 2 = 0)
SELECT c.doc_id, c.i // 4 AS pos, c.id AS clause_intents, coalesce(x.id, '') AS item_intents FROM n c LEFT JOIN n x ON x.doc_id = c.doc_id AND x.i = c.i + 2 WHERE c.i % 4 = 0
"""
)


def comparison_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons at the second clause, where there is one, and ones whose clause is missing."""
    fixed = {"excerpt": "", "category": "", "semantic_tags": (), "difficulty": ""}
    templates = [fixed | {"user_query": "a", "related": ("第二條", "第三條")}, fixed | {"user_query": "b", "related": ("第零條",)}]
    found = I.comparison_intents(outline.generate_chunks(Q.statutes(spark, sf_dir), details=False), templates)
    return found.select("doc_id", F.col("n").cast("long").alias("n"), "user_query", "clause_id", F.array_join("referenced_clauses", ",").alias("related"))


COMPARISON_QUESTIONS = (
    _CLAUSES
    + """
SELECT doc_id, 0::BIGINT AS n, 'a' AS user_query, coalesce(max(clause_id) FILTER (pos = 1), max(clause_id) FILTER (pos = 0)) AS clause_id, '第二條,第三條' AS related
FROM clauses GROUP BY doc_id
UNION ALL SELECT doc_id, 1, 'b', clause_id, '第零條' FROM clauses WHERE pos = 0
"""
)


def intent_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality, intents per clause and tokens, with documents as intents, their languages as clauses, and their lengths as tokens."""
    docs = _documents(spark, sf_dir)
    k = F.col("doc_id")
    intents = docs.select((k % 11 / 10).alias("quality_score"), F.when(k % 2 == 0, F.lit("一")).alias("item_no"))
    usage = F.struct(F.when(k % 9 > 0, F.length("text").cast("long")).alias("total_tokens"))
    answers = docs.select(usage.alias("usage"))
    average = stats.avg_intents_per_clause(docs.select("lang").distinct(), intents)
    return stats.quality_summary(intents).crossJoin(F.broadcast(average)).crossJoin(F.broadcast(stats.token_usage_summary(answers)))  # one row each


INTENT_STATISTICS = """
WITH i AS (SELECT doc_id % 11 / 10.0 AS q, doc_id % 2 = 0 AS item, CASE WHEN doc_id % 9 > 0 THEN coalesce(length(text), 0) ELSE 0 END AS tokens, lang FROM documents)
SELECT round(avg(q), 9)::DOUBLE AS mean_score, count(*) FILTER (q < 0.8 AND NOT item) AS n_low, count(*) FILTER (q > 0.9) AS n_high, count(*) FILTER (q BETWEEN 0.8 AND 0.9) AS n_middle,
  count(*) FILTER (q < 0.8) AS n_below, round(count(*)::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents)), 9) AS avg_intents,
  count(*) AS n_questions, sum(tokens)::BIGINT AS total_tokens, round(avg(tokens), 6) AS avg_tokens
FROM i
"""


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose full stops are Han ones, cut into pieces of at most 500 characters."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("。"))
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(outline.split_long(text)).alias("piece", "text"))
    return rows.select("doc_id", F.col("piece").cast("long").alias("piece"), "text")


_SPACE = "chr(9), chr(10), chr(11), chr(12), chr(13), ' ', chr(133), chr(160)"
PACKED_PIECES = f"""
WITH RECURSIVE d AS (SELECT doc_id, replace(coalesce(text, ''), '. ', '。') AS t FROM documents),
s AS (SELECT doc_id, string_split(t, '。') AS l FROM d WHERE length(t) > 500),
p AS (SELECT doc_id, list_transform(l, lambda x, i: CASE WHEN i < len(l) THEN x || '。' ELSE x END) AS l FROM s),
f(doc_id, i, buf, done) AS (
  SELECT doc_id, 0, '', NULL::VARCHAR FROM p
  UNION ALL
  SELECT f.doc_id, i + 1, CASE WHEN length(buf) + length(l[i + 1]) <= 500 THEN buf || l[i + 1] ELSE l[i + 1] END,
    CASE WHEN length(buf) + length(l[i + 1]) <= 500 THEN NULL ELSE buf END
  FROM f JOIN p ON p.doc_id = f.doc_id AND i < len(l)),
o AS (
  SELECT doc_id, i, trim(done, concat({_SPACE})) AS text FROM f WHERE done IS NOT NULL
  UNION ALL SELECT f.doc_id, i + 1, trim(buf, concat({_SPACE})) FROM f JOIN p ON p.doc_id = f.doc_id AND i = len(l))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS piece, text FROM o WHERE text <> ''
UNION ALL SELECT doc_id, 0, t FROM d WHERE length(t) <= 500
"""

def stored_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a version of a flat index: its manifest."""
    manifest = tables.write_versioned(_documents(spark, sf_dir), tables.scratch(spark, "version"), "v1", "all", "2026-01-28", "none")
    return manifest.select("version", "date", "notes", F.col("num_chunks").cast("long").alias("num_chunks"), "embedding_model")


STORED_VERSION = "SELECT 'v1' AS version, '2026-01-28' AS date, 'all' AS notes, count(*) AS num_chunks, 'none' AS embedding_model FROM documents"


def stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as answers and read back from JSON."""
    k = F.col("doc_id")
    source = F.struct(F.col("source").alias("clause_id"), F.lit("mother").alias("source_type"), (k % 1000 / 1000).alias("similarity_score"))
    usage = F.struct(*[(k + n).alias(name) for n, name in enumerate(("prompt_tokens", "completion_tokens", "total_tokens"))])
    answers = _documents(spark, sf_dir).select(k.cast("string").alias("query"), F.coalesce("text", F.lit("")).alias("answer"), F.when(k % 3 > 0, F.array(source)).alias("sources"), usage.alias("usage"))
    path = tables.scratch(spark, "answers")
    tables.write_answers(answers, path)
    schema = "question string, answer string, sources array<struct<clause_id string, score double>>, token_usage struct<total_tokens long>"
    rows = spark.read.schema(schema).json(path)
    first = F.try_element_at("sources", F.lit(1))
    return rows.select("question", "answer", F.size("sources").cast("long").alias("n_sources"), F.coalesce(first["clause_id"], F.lit("")).alias("clause_id"), F.coalesce(first["score"], F.lit(-1.0)).alias("score"), "token_usage.total_tokens")


STORED_ANSWERS = """
SELECT doc_id::VARCHAR AS question, coalesce(text, '') AS answer, (doc_id % 3 > 0)::BIGINT AS n_sources, CASE WHEN doc_id % 3 > 0 THEN coalesce(source, '') ELSE '' END AS clause_id,
  CASE WHEN doc_id % 3 > 0 THEN doc_id % 1000 / 1000.0 ELSE -1 END::DOUBLE AS score, doc_id + 2 AS total_tokens
FROM documents
"""


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and intents of dressed documents written, read back, and joined with their manifests."""
    path = tables.scratch(spark, "index")
    tables.write_chunks(outline.generate_chunks(Q.statutes(spark, sf_dir), details=False), path, "1.0", ("outline",))
    chunks = tables.read_chunks(spark, path)
    intents = chunks.select("doc_id", "pos", F.lit(-1).alias("item_pos"), F.lit(0).alias("n"), (F.col("pos") % 5 / 4).alias("quality_score"))
    tables.write_intents(I.number_intents(intents), path, "1.0")
    tables.write_chunks_with_intents(I.attach_intent_ids(chunks, tables.read_intents(spark, path)), path)
    both = spark.read.parquet(f"{path}/chunks_with_intents").groupBy("doc_id").agg(F.count("*").alias("n_clauses"), F.max(F.element_at("clause.intent_ids", 1)).alias("last_intent"))
    said = spark.read.json(f"{path}/metadata").select("total_chunks", F.array_join("enhancements", ",").alias("enhancements"))
    counted = spark.read.json(f"{path}/intents_manifest/metadata").select("total_intents", F.round("average_quality_score", 6).alias("average_quality"))
    return both.crossJoin(F.broadcast(said)).crossJoin(F.broadcast(counted))  # one row each


STORED_INDEX = (
    _CLAUSES
    + """
SELECT doc_id, count(*) AS n_clauses, 'intent_' || lpad(count(*)::VARCHAR, 4, '0') AS last_intent, (SELECT count(*) FROM clauses) AS total_chunks, 'outline' AS enhancements,
  (SELECT count(*) FROM clauses) AS total_intents, (SELECT round(avg(pos % 5 / 4.0), 6) FROM clauses)::DOUBLE AS average_quality
FROM clauses GROUP BY doc_id
"""
)


def nested_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of dressed documents with all details written as nested JSON documents, read back by ranges, and their clauses."""
    path, chunks = tables.scratch(spark, "nested"), outline.generate_chunks(Q.statutes(spark, sf_dir))
    nested.write_nested(chunks, path, version="1.0")
    return Q.clause_rows(nested.read_nested(spark, path, chunks.schema))


QUERIES = {
    f.__name__: f
    for f in (
        clean_texts, clause_labels, clause_references, question_plans, intent_prompts, parsed_replies, expanded_clauses, pair_reranking, cosine_reranking,
        answer_contexts, numbered_intents, comparison_questions, intent_statistics, packed_pieces, stored_version, stored_answers, stored_index, nested_index,
    )
}


def oracle_sql() -> dict[str, str]:
    return {
        "clean_texts": CLEAN_TEXTS, "clause_labels": CLAUSE_LABELS, "clause_references": CLAUSE_REFERENCES, "question_plans": QUESTION_PLANS, "intent_prompts": _prompts_sql(),
        "parsed_replies": PARSED_REPLIES, "expanded_clauses": EXPANDED_CLAUSES, "pair_reranking": PAIR_RERANKING, "cosine_reranking": COSINE_RERANKING,
        "answer_contexts": ANSWER_CONTEXTS, "numbered_intents": NUMBERED_INTENTS, "comparison_questions": COMPARISON_QUESTIONS, "intent_statistics": INTENT_STATISTICS,
        "packed_pieces": PACKED_PIECES, "stored_version": STORED_VERSION, "stored_answers": STORED_ANSWERS, "stored_index": STORED_INDEX,
        "nested_index": Q.OUTLINE_CLAUSES,
    }
