"""Clause retrieval for batches of queries: hybrid scores, expansion to clauses, reranking, contexts and sources."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.functions import hooks, lexicon
from clausewright.operators import outline, search
from clausewright.operators.intents import fill
from clausewright.sources.tables import stored

# Weights of the two scores, factor for queries whose tags an intent lacks, and labels of sources.
W_DENSE, W_BM25, PENALTY = 0.85, 0.15, 0.5
SOURCE_LABELS = {"mother": "母條文", "item": "子項目", "subitem": "子款項", "referenced": "引用條文"}
OTHER_LABEL = "其他"


def prepare_queries(questions: DataFrame, encode: hooks.Encode, k_intents: int | None = None, k_clauses: int | None = None, auto: bool = True) -> DataFrame:
    """(query_id, text, tags, k_intents, k_clauses, embedding) of (query_id, text)."""
    given = [None if k is None else F.lit(k) for k in (k_intents, k_clauses)]
    k = lexicon.smart_top_k(F.col("text"), *given, auto=auto)
    return questions.select(
        "query_id", F.coalesce("text", F.lit("")).alias("text"), lexicon.label_all(F.col("text"), lexicon.QUERY_TAGS).alias("tags"),
        k[0].alias("k_intents"), k[1].alias("k_clauses"), hooks.encoder(encode)(F.col("text")).alias("embedding"),
    )


def _membership(tag_lists, vocabulary: dict[str, int]) -> np.ndarray:
    m = np.zeros((len(tag_lists), max(1, len(vocabulary))), np.float32)
    for i, tags in enumerate(tag_lists):
        for t in tags or ():
            if t in vocabulary:
                m[i, vocabulary[t]] = 1
    return m


def hybrid_search(queries: DataFrame, intents: DataFrame, key: str = "intent_id", w_dense: float = W_DENSE, w_bm25: float = W_BM25, use_bm25: bool = True) -> DataFrame:
    """(query_id, key, similarity_score, bm25_score, hybrid_score, rank), exact over all pairs.

    ``queries`` are (query_id, text, tags, k_intents, embedding), ``intents`` (key, text, semantic_tags, embedding). Blocks of
    queries meet parts of the intents, twice: first each cell finds its queries' largest sparse scores, then it computes both scores
    of a piece of intents at once and passes on its best rows only. So no score of a pair is shuffled or written. A query with
    tags halves the score of intents that share none. Negative scores need no special case. Null embeddings and zero vectors
    have similarity 0; ties go to the smaller key.
    """
    key_type = dict(intents.dtypes)[key]
    query_type = search.key_type(queries, "query_id")
    names = ["query_id", key, "similarity_score", "bm25_score", "hybrid_score"]
    schema = f"query_id {query_type}, {key} {key_type}, similarity_score double, bm25_score double, hybrid_score double"
    id_type = pa.string() if query_type == "string" else pa.int64()

    def weights(asked: pa.Table) -> search.Weights:
        lists = asked["words"].combine_chunks()
        place, flat = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()), lists.flatten()  # null lists have none
        return search.Weights(place, flat.field("term"), flat.field("factor").to_numpy(zero_copy_only=False), asked["avgdl"][0].as_py() or 1.0, len(lists))

    def largest(asked: pa.Table, rows: pa.Table) -> pa.Table:
        top = np.full(len(asked), -np.inf)
        if len(asked):
            own = weights(asked)
            for start in range(0, len(rows), own.step):
                _, at, score = own.hits(rows.slice(start, own.step))
                np.maximum.at(top, at, score)
        seen = np.isfinite(top)
        return pa.table({"query_id": asked["query_id"].filter(pa.array(seen)).cast(id_type) if len(asked) else pa.array([], id_type), "top": top[seen]})

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if len(asked) and len(rows):
            rows = rows.combine_chunks()
            size = search.vector_size(asked["embedding"], rows["embedding"])
            ids, q = asked["query_id"].to_numpy(), search.unit(search.matrix(asked["embedding"], size))
            wanted = asked["tags"].to_pylist()
            vocabulary = {t: i for i, t in enumerate(sorted({t for tags in wanted for t in tags or ()}))}
            marks, most = _membership(wanted, vocabulary), max(asked["k_intents"].to_pylist())
            tagged, top = marks.any(1), asked["top"].to_numpy()[:, None]
            own = weights(asked) if use_bm25 else None
            step = own.step if own else search.PIECE
            for start in range(0, len(rows), step):
                piece = rows.slice(start, step)
                keys = piece[key].to_numpy()
                dense, sparse = q @ search.unit(search.matrix(piece["embedding"], size)).T, np.zeros((len(ids), len(keys)))
                if own:
                    cols, at, score = own.hits(piece)
                    sparse[at, cols] = score
                    sparse = np.divide(sparse, top, out=sparse, where=top > 0)
                lacks = tagged[:, None] & (marks @ _membership(piece["semantic_tags"].to_pylist(), vocabulary).T == 0)
                both = (w_dense * dense + (w_bm25 * sparse if use_bm25 else 0.0)) * np.where(lacks, PENALTY, 1.0)
                at, cols, score = search.local_top(both, keys, most)
                found.append((ids[at], keys[cols], dense[at, cols].round(9), sparse[at, cols].round(9), score))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[]] * 5
        if found:
            kept = search.best_rows(columns[0], columns[1], columns[4], most)
            columns = [c[kept] for c in columns]
        types = [id_type, rows.schema.field(key).type if key in rows.schema.names else pa.null(), *[pa.float64()] * 3]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    asked = queries.select("query_id", "text", "tags", "k_intents", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = intents.select(key, "text", F.col("embedding").cast("array<double>").alias("embedding"), "semantic_tags")
    (block, blocks), (part, parts) = search.pieces(asked, ["query_id"]), search.pieces(rows, [key])
    dealt = {"part": part, "block": search.every(blocks)}
    if use_bm25:
        words = search.bm25_words(rows, key)
        of_terms = search.bm25_asked(asked, words, "query_id")
        listed = of_terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "factor"))).alias("words"))
        average = of_terms.agg(F.max("avgdl").alias("avgdl"))
        asked = asked.join(listed, "query_id", "left").crossJoin(F.broadcast(average))  # one row
        sides = asked.select("query_id", "words", "avgdl", block.alias("block"), search.every(parts).alias("part")), words.select(key, "dl", "t", "counts").withColumns(dealt)
        tops = stored(search.in_cells(*sides, largest, f"query_id {query_type}, top double"), "bm25-tops").groupBy("query_id").agg(F.max("top").alias("top"))
        asked = asked.join(tops, "query_id", "left").withColumn("top", F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0)))
        rows = search.bm25_words(rows, key, kept=("embedding", "semantic_tags")).drop("n", "total")
    else:
        asked, rows = asked.withColumn("top", F.lit(0.0)), rows.drop("text")
    found = search.in_cells(asked.drop("text").withColumns({"block": block, "part": search.every(parts)}), rows.withColumns(dealt), run, schema)
    limits = queries.select("query_id", "k_intents")
    ranked = search.ranked(found, "query_id", key, "hybrid_score").join(limits, "query_id")
    return ranked.filter(F.col("rank") <= F.col("k_intents")).drop("k_intents")


def expand_intents(found: DataFrame, chunks: DataFrame, match_on: str = "clause_id") -> DataFrame:
    """Candidates of retrieved intents: (query_id, doc_id, source_type, clause_id, item_no, subitem_no, content, raw_text, rank).

    ``found`` are (query_id, rank, doc_id, clause_id, item_no, subitem_no, referenced_clauses). Each intent gives its clause,
    its item, its sub-item and the clauses it refers to, in this order; of one place the first stays. ``rank`` is the order.
    ``match_on`` clause_no finds references by clause number.
    """
    clauses, items, subs = outline.flatten_outline(chunks)
    place = ["query_id", "doc_id"]
    null = F.lit(None).cast("string")

    def made(rows: DataFrame, kind: str, step: int, ref: Column, item: Column, sub: Column) -> DataFrame:
        order = F.struct(F.col("rank").cast("int").alias("rank"), F.lit(step).alias("step"), ref.alias("ref"))
        return rows.select(*place, F.lit(kind).alias("source_type"), "clause_id", item.alias("item_no"), sub.alias("subitem_no"), F.col("context").alias("content"), "raw_text", order.alias("rank"))

    base = found.select(*place, "rank", "clause_id", F.nullif("item_no", F.lit("")).alias("item_no"), F.nullif("subitem_no", F.lit("")).alias("subitem_no"))
    refs = found.select(*place, "rank", F.posexplode("referenced_clauses").alias("ref", "target"))
    if match_on == "clause_id":
        named = clauses.select("doc_id", F.col("clause_id").alias("target"), "clause_id", "context", "raw_text")
    else:
        numbered = chunks.select("doc_id", F.col("clause.clause_no").alias("target"), F.struct("clause.clause_id", "clause.context", "clause.raw_text").alias("c"), "pos")
        named = numbered.groupBy("doc_id", "target").agg(F.max_by("c", "pos").alias("c")).select("doc_id", "target", "c.*")
    zero, item, sub = F.lit(0), F.col("item_no"), F.col("subitem_no")
    rows = made(base.join(clauses, ["doc_id", "clause_id"]), "mother", 0, zero, null, null)
    rows = rows.unionByName(made(base.join(items, ["doc_id", "clause_id", "item_no"]), "item", 1, zero, item, null))
    rows = rows.unionByName(made(base.join(subs, ["doc_id", "clause_id", "item_no", "subitem_no"]), "subitem", 2, zero, item, sub))
    rows = rows.unionByName(made(refs.join(named, ["doc_id", "target"]), "referenced", 3, F.col("ref"), null, null))
    return search.dedupe_candidates(rows)


def _best(scored: DataFrame, queries: DataFrame, order: list[Column]) -> DataFrame:
    limits = queries.select("query_id", "k_clauses")
    placed = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return placed.join(limits, "query_id").filter(F.col("rank") <= F.col("k_clauses")).drop("k_clauses")


def rerank_pairs(candidates: DataFrame, queries: DataFrame, score: hooks.ScorePairs | None) -> DataFrame:
    """The best candidates by a scorer of (query, raw_text) in rerank_score; without one the order stays and all score 1."""
    zero = F.lit(0.0).alias("similarity_score")
    if score is None:
        return _best(candidates.select("*", zero, F.lit(1.0).alias("rerank_score")), queries, [F.col("rank")])
    asked = candidates.join(queries.select("query_id", "text"), "query_id")
    scored = asked.withColumn("rerank_score", hooks.pair_scorer(score)(F.col("text"), F.col("raw_text"))).drop("text")
    return _best(scored.select("*", zero), queries, [F.desc("rerank_score"), F.col("rank")])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is zero or null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def rerank_cosine(candidates: DataFrame, queries: DataFrame, encode: hooks.Encode) -> DataFrame:
    """The best candidates by cosine of query and raw_text, each distinct text encoded once; ties keep their order."""
    texts = candidates.select("raw_text").distinct().withColumn("vector", hooks.encoder(encode)(F.col("raw_text")))
    rows = candidates.join(texts, "raw_text").join(queries.select("query_id", "embedding"), "query_id")
    scored = rows.withColumn("rerank_score", F.round(cosine(F.col("embedding"), F.col("vector")), 9)).drop("embedding", "vector")
    return _best(scored.withColumn("similarity_score", F.col("rerank_score")), queries, [F.desc("rerank_score"), F.col("rank")])


def source_label(source_type: Column) -> Column:
    return F.coalesce(*[F.when(source_type == k, F.lit(v)) for k, v in SOURCE_LABELS.items()], F.lit(OTHER_LABEL))


def format_location(clause_id: Column, item_no: Column, subitem_no: Column, style: str = "answer") -> Column:
    """Where a source stands; style answer puts a sub-item in brackets, llm writes it out."""
    opened, closed = (" (", ")") if style == "answer" else (" 第", "款")
    item = F.when(item_no != "", F.concat(F.lit(" 第"), item_no, F.lit("項")))
    sub = F.when(subitem_no != "", F.concat(F.lit(opened), subitem_no, F.lit(closed)))
    return F.concat(clause_id, F.coalesce(item, F.lit("")), F.coalesce(sub, F.lit("")))


def build_context(clauses: DataFrame, style: str = "llm") -> DataFrame:
    """(query_id, context): the ranked clauses of a query as blocks of text. Styles: llm, answer, similarity (llm with the older score label)."""
    label, lead = source_label(F.col("source_type")), F.lit("【")
    where = format_location(F.col("clause_id"), F.col("item_no"), F.col("subitem_no"), "answer" if style == "answer" else "llm")
    if style == "answer":
        block = F.concat(lead, label, F.lit("】 "), where, F.lit("\n"), F.col("content"), F.lit("\n"))
    else:
        said = "相似度" if style == "similarity" else "相關度"
        block = F.concat(
            lead, F.lit("條文 "), F.col("rank").cast("string"), F.lit("】"), label, F.lit(" - "), where, F.lit("\n內容: "), F.col("content"),
            F.lit(f"\n{said}: "), F.format_string("%.3f", "rerank_score"), F.lit("\n"),
        )
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("t"))))
    return clauses.groupBy("query_id").agg(ordered.alias("b")).select("query_id", F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("context"))


def _listed(rows: DataFrame, name: str, *fields: Column) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.struct(*fields).alias("v"))))
    return rows.groupBy("query_id").agg(pairs.alias("p")).select("query_id", F.transform("p", lambda x: x["v"]).alias(name))


def extract_sources(clauses: DataFrame) -> DataFrame:
    """(query_id, sources), whose similarity_score is the rerank score."""
    return _listed(clauses, "sources", *map(F.col, ("clause_id", "source_type")), F.col("rerank_score").alias("similarity_score"), F.col("item_no"), F.col("subitem_no"))


def top_intents(found: DataFrame) -> DataFrame:
    """(query_id, top_intents) of retrieved intents with their user_query and category."""
    return _listed(found, "top_intents", *map(F.col, ("intent_id", "user_query", "category")), F.col("hybrid_score").alias("similarity"))


def retrieve_intents(queries: DataFrame, intents: DataFrame, use_bm25: bool = True) -> DataFrame:
    """Retrieved intents with their fields. ``intents`` need (doc_id, intent_id, text, semantic_tags, embedding) and the fields of an intent."""
    keyed = intents.withColumn("_intent", F.struct("doc_id", "intent_id").cast("string"))
    found = hybrid_search(queries, keyed, "_intent", use_bm25=use_bm25)
    fields = ["_intent", "doc_id", "intent_id", "clause_id", "item_no", "subitem_no", "user_query", "category", "referenced_clauses"]
    return found.join(keyed.select(*fields), "_intent").drop("_intent")


def retrieve(
    queries: DataFrame, intents: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame], encode: hooks.Encode | None = None, score: hooks.ScorePairs | None = None, use_bm25: bool = True, match_on: str = "clause_id"
) -> tuple[DataFrame, DataFrame]:
    """(retrieved intents, ranked clauses) of prepared queries; clauses are reranked by ``encode`` if given, else by ``score``.

    Retrieved intents are written, and so are the chunks of their documents, which alone are expanded. Instead of a table, ``chunks`` may be what makes the chunks of
    the documents it is given (doc_id).
    """
    found = stored(retrieve_intents(queries, intents, use_bm25), "found-intents")
    ids = found.select("doc_id").distinct()
    own = stored(chunks.join(ids, "doc_id", "left_semi") if isinstance(chunks, DataFrame) else chunks(ids), "found-chunks")
    candidates = expand_intents(found, own, match_on)
    return found, rerank_cosine(candidates, queries, encode) if encode else rerank_pairs(candidates, queries, score)


def results(queries: DataFrame, found: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row per query: query_id, query, detected_semantic_tags, top_k_intents, top_k_clauses, top_intents, top_clauses."""
    listed = _listed(clauses, "top_clauses", *map(F.col, ("source_type", "clause_id", "item_no", "subitem_no", "content", "raw_text", "similarity_score", "rerank_score")))
    base = queries.select("query_id", F.col("text").alias("query"), F.col("tags").alias("detected_semantic_tags"), F.col("k_intents").alias("top_k_intents"), F.col("k_clauses").alias("top_k_clauses"))
    return base.join(top_intents(found), "query_id", "left").join(listed, "query_id", "left")


SYSTEM_PROMPT = "Answer questions about insurance clauses from the given clauses only, and name the clauses that you rely on."
USER_PROMPT = "Clauses:\n{context}\n\nQuestion: {query}\n"


def answer_prompts(queries: DataFrame, contexts: DataFrame, system: str = SYSTEM_PROMPT, user: str = USER_PROMPT) -> DataFrame:
    """(query_id, query, messages): a system and a user message per query; without clauses the context is empty."""
    rows = queries.select("query_id", F.col("text").alias("query")).join(contexts, "query_id", "left")
    said = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), fill(user, context=F.col("context"), query=F.col("query")).alias("content")),
    )
    return rows.select("query_id", "query", said.alias("messages"))
