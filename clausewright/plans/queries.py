"""Registered queries of the clause operators, on the given tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import lexicon
from clausewright.operators import cells, chat, outline, postings, search, stats
from clausewright.sources import tables

# Latin stand-ins for the lexicons: the given tables hold no Han text.
LATIN = (("article", ("the ", "der ", "la ")), ("mail", ("@",)), ("table", (" | ",)), ("shout", ("!!",)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines dressed as a statute: in turns of four a clause heading, a sentence, an item, a sub-item."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t\r\f]+", " "))), lambda x: x != "")
    numeral = lambda n: F.translate(n.cast("int").cast("string"), "0123456789", "百一二三四五六七八九")

    def dress(x, i):
        n = F.floor(i / 4)
        chapter = F.when((n % 3 == 0), F.concat(F.lit("第"), numeral(n / 3 + 1), F.lit("章 部\n"))).otherwise("")
        head = F.concat(chapter, F.lit("第"), numeral(n + 1), F.lit("條 "), x)
        return F.when(i % 4 == 0, head).when(i % 4 == 1, x).when(i % 4 == 2, F.concat(F.lit("一、"), x)).otherwise(F.concat(F.lit("(一) "), x))

    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(lines, dress), "\n").alias("text"))


_LINES = """
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
clean AS (SELECT doc_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '[ \\t\\r\\f]+', ' ', 'g'))), lambda x: x <> '') AS l FROM raw),
lines AS (SELECT doc_id, i, l[i + 1] AS line FROM clean, unnest(range(len(l))) AS t(i))
"""


def outline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.outline_counts(outline.generate_chunks(statutes(spark, sf_dir), details=False))


def outline_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clause_rows(outline.generate_chunks(statutes(spark, sf_dir), details=False))


def clause_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.col("clause.clause_no").alias("clause_no"), F.col("clause.clause_title").alias("clause_title"), "chapter_no",
        F.size("clause.items").cast("long").alias("n_items"),
        F.coalesce(F.try_element_at(F.col("clause.items"), F.lit(1))["context"], F.lit("")).alias("item_text"),
    )


OUTLINE_CLAUSES = (
    _LINES
    + """
SELECT h.doc_id, h.i // 4 AS pos, '第' || translate((h.i // 4 + 1)::VARCHAR, '0123456789', '百一二三四五六七八九') || '條' AS clause_no, h.line AS clause_title,
  '第' || translate((h.i // 12 + 1)::VARCHAR, '0123456789', '百一二三四五六七八九') || '章' AS chapter_no,
  CASE WHEN a.line IS NULL THEN 0 ELSE 1 END::BIGINT AS n_items,
  coalesce(a.line || coalesce(chr(10) || '(一) ' || b.line, '') || CASE WHEN b.line IS NOT NULL AND n.line IS NOT NULL AND (h.i // 4 + 1) % 3 = 0
    THEN chr(10) || '第' || translate(((h.i + 4) // 12 + 1)::VARCHAR, '0123456789', '百一二三四五六七八九') || '章 部' ELSE '' END, '') AS item_text
FROM lines h LEFT JOIN lines a ON a.doc_id = h.doc_id AND a.i = h.i + 2 LEFT JOIN lines b ON b.doc_id = h.doc_id AND b.i = h.i + 3
LEFT JOIN lines n ON n.doc_id = h.doc_id AND n.i = h.i + 4
WHERE h.i % 4 = 0
"""
)


def stored_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all statutes, written once, for queries that use them more than once."""
    path = tables.scratch(spark, "statutes")
    outline.generate_chunks(statutes(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(lexicon.label_all(text, LATIN, ["other"]), ",").alias("labels"), lexicon.label_first(text, LATIN[1:], "plain").alias("first_label")
    )


def _labels_sql() -> str:
    has = {label: " OR ".join(f"contains(text, '{k}')" for k in keys) for label, keys in LATIN}
    every = ", ".join(f"CASE WHEN {c} THEN '{label}' END" for label, c in has.items())
    first = " ".join(f"WHEN {c} THEN '{label}'" for label, c in list(has.items())[1:])
    return f"SELECT doc_id, coalesce(nullif(concat_ws(',', {every}), ''), 'other') AS labels, CASE {first} ELSE 'plain' END AS first_label FROM documents"


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(lexicon.label_all(F.col("text"), LATIN, ["other"]).alias("labels"))
    return stats.label_counts(docs, "labels")


def language_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.share_counts(table(spark, sf_dir, "documents"), "lang", "und")


def source_shares_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.share_counts(table(spark, sf_dir, "documents"), "source", "none", top=10)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item the ten best documents by max-normalised BM25."""
    found = search.bm25_best(_items(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", 10)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by blocks of postings and their bounds."""
    index = postings.block_index(table(spark, sf_dir, "documents"), "doc_id")
    return postings.bm25_topk(_items(spark, sf_dir), index, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_block_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item how many blocks of postings its terms have, and how many its search for the ten best documents reads."""
    return postings.block_reads(_items(spark, sf_dir), postings.block_index(table(spark, sf_dir, "documents"), "doc_id"), 10)


BM25 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\p{Han}|[\p{L}\p{N}]+') AS t FROM documents),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM w),
postings AS (SELECT doc_id, term, count(*) AS tf, first(dl) AS dl FROM p GROUP BY doc_id, term),
total AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM w),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings, total GROUP BY term, n),
terms AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(coalesce(text, ''), '\p{Han}|[\p{L}\p{N}]+')) AS term FROM benchmark),
s AS (
  SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN terms USING (term) JOIN postings USING (term), total GROUP BY query_id, doc_id),
m AS (SELECT query_id, greatest(max(score), 0) AS top FROM s GROUP BY query_id),
r AS (SELECT query_id, doc_id, round(CASE WHEN top > 0 THEN score / top ELSE score END, 6) AS score FROM s JOIN m USING (query_id))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM r QUALIFY rank <= 10
"""


def _dense(spark: SparkSession, sf_dir: str, metric: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the stated query set
    found = search.block_topk(asked, vectors, k, metric)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "cosine", 5)


def l2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "l2", 3)


def _in_cells(spark: SparkSession, sf_dir: str, metric: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the stated query set
    found, _ = cells.search_cells(asked, cells.fit_cells(vectors, metric), k)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def dense_cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors by cosine, from cells that bounds don't rule out."""
    return _in_cells(spark, sf_dir, "cosine", 5)


def l2_cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_cells(spark, sf_dir, "l2", 3)


def _dense_sql(score: str, order: str, k: int) -> str:
    return f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round({score}, 9) AS score FROM e q, e WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank
FROM s QUALIFY rank <= {k}
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each turn's history is, with its oldest and newest role."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    rows = chat.conversation_history(chat.conversation_sessions(turns))
    return rows.select(
        "conv_id", "seq", F.size("history").cast("long").alias("n_history"), F.try_element_at("history", F.lit(1))["role"].alias("oldest"),
        F.try_element_at("history", F.lit(-1))["role"].alias("newest"),
    )


HISTORY = """
WITH m AS (SELECT conv_id, turn AS seq, role, lower(trim(text)) AS word FROM conversations WHERE trim(text) <> ''),
s AS (SELECT *, sum((role = 'user' AND word = 'clear')::INT) OVER w AS session,
    max((role = 'user' AND word IN ('quit', 'exit', 'q'))::INT) OVER w AS ended
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * FROM s WHERE ended = 0 AND NOT (role = 'user' AND word = 'clear'))
SELECT conv_id, seq, count(*) OVER h AS n_history, first_value(role) OVER h AS oldest, last_value(role) OVER h AS newest
FROM k WINDOW h AS (PARTITION BY conv_id, session ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
"""

QUERIES = {
    f.__name__: f
    for f in (outline_counts, outline_clauses, document_labels, label_counts, language_shares, source_shares_top, bm25_search, bm25_block_search, bm25_block_reads, dense_search, l2_search, dense_cell_search, l2_cell_search, history)
}


def oracle_sql() -> dict[str, str]:
    share = "SELECT {c}, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (SELECT coalesce({c}, '{d}') AS {c}, count(*) AS n FROM documents GROUP BY 1)"
    labels = _labels_sql()
    return {
        "outline_counts": _LINES + "SELECT count(*) FILTER (i % 4 = 0) AS n_clauses, count(*) FILTER (i % 4 = 2) AS n_items, count(*) FILTER (i % 4 = 3) AS n_subitems FROM lines",
        "outline_clauses": OUTLINE_CLAUSES,
        "document_labels": labels,
        "label_counts": f"SELECT label, count(*) AS n FROM (SELECT unnest(string_split(labels, ',')) AS label FROM ({labels})) GROUP BY 1",
        "language_shares": share.format(c="lang", d="und"),
        "source_shares_top": share.format(c="source", d="none") + " ORDER BY n DESC, source LIMIT 10",
        "bm25_search": BM25,
        "bm25_block_search": BM25,
        "dense_search": _dense_sql("list_cosine_similarity(q.v, e.v)", "DESC", 5),
        "l2_search": _dense_sql("list_distance(q.v, e.v) ** 2", "ASC", 3),
        "dense_cell_search": _dense_sql("list_cosine_similarity(q.v, e.v)", "DESC", 5),
        "l2_cell_search": _dense_sql("list_distance(q.v, e.v) ** 2", "ASC", 3),
        "history": HISTORY,
    }
