"""Registered queries of conversations, streams, numbering, generated replies and committed versions, with their DuckDB SQL.

Models are deterministic stand-ins, so that SQL can follow them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import hooks, segment
from clausewright.operators import chat, intents as I, outline, retrieve as R
from clausewright.plans import jobs, queries as Q, retrieval_queries as RQ
from clausewright.sources import tables
from clausewright.streaming import live


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def streamed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of every message as state of a stream that is stopped and started again from its checkpoint for each of four micro-batches."""
    path = tables.scratch(spark, "streamed-history")
    messages = _messages(spark, sf_dir)
    for n in range(4):
        part = F.least(F.floor(F.col("seq") / 2), F.lit(3))
        messages.filter(part == n).write.parquet(f"{path}/in/part={n}")
        stream = live.stream_history(spark.readStream.schema(messages.schema).parquet(f"{path}/in/part=*"))
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    return rows.select(
        "conv_id", "seq", F.size("history").cast("long").alias("n_history"), F.try_element_at("history", F.lit(1))["role"].alias("oldest"),
        F.try_element_at("history", F.lit(-1))["role"].alias("newest"),
    )


def streamed_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that arrive as a stream in two micro-batches, each through the whole retrieval against the written index."""
    path = tables.scratch(spark, "streamed-retrieval")
    vectors, chunks = RQ.heading_intents(spark, sf_dir)
    asked = Q.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked.filter("query_id % 2 = 0").coalesce(1).write.parquet(f"{path}/in/part=0")
    asked.filter("query_id % 2 <> 0").coalesce(1).write.parquet(f"{path}/in/part=1")

    def retrieve(batch: DataFrame) -> DataFrame:
        return RQ.ranked_clauses(R.prepare_queries(batch, RQ.letter_counts), vectors, chunks)

    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/part=*")
    live.stream_retrieve(stream, retrieve, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


SYSTEM = "Answer shortly."


def _answer(messages: list[dict]) -> tuple[str, dict]:
    """A stand-in whose answer is the length of the prompt, and whose usage tells what it was sent; it fails at every seventh length."""
    n = len(messages[-1]["content"])
    if n % 7 == 0:
        raise ValueError("no answer")
    return str(n), {"prompt_tokens": len(messages), "total_tokens": sum(len(m["content"]) for m in messages)}


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of a user in its conversation, answered with the history of questions and answers before it."""
    kept = chat.conversation_sessions(_messages(spark, sf_dir)).filter("role = 'user'")
    rounds = kept.select("conv_id", "session", "seq", F.col("content").alias("query"), F.concat(F.lit("Question: "), "content").alias("prompt"))
    rows = chat.answer_rounds(rounds, _answer, SYSTEM)
    usage = [F.coalesce(F.col(f"usage.{c}"), F.lit(0)).alias(c) for c in ("prompt_tokens", "total_tokens")]
    return rows.select("conv_id", "seq", F.coalesce("content", F.lit("")).alias("answer"), F.coalesce("error", F.lit("")).alias("error"), *usage, "n_history", "conversation_length")


CONVERSATION_ANSWERS = f"""
WITH m AS (SELECT conv_id, turn AS seq, role, text AS query, lower(trim(text)) AS word FROM conversations WHERE trim(text) <> ''),
s AS (SELECT *, sum((role = 'user' AND word = 'clear')::INT) OVER w AS session,
    max((role = 'user' AND word IN ('quit', 'exit', 'q'))::INT) OVER w AS ended
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
u AS (SELECT conv_id, session, seq, length(query) AS n, length(query) + 10 AS p FROM s WHERE ended = 0 AND role = 'user' AND word <> 'clear'),
r AS (SELECT *, p % 7 <> 0 AS fine, coalesce(sum((p % 7 <> 0)::INT) OVER w, 0) AS before
  FROM u WINDOW w AS (PARTITION BY conv_id, session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (
  SELECT a.conv_id, a.session, a.seq, sum(b.n + length(b.p::VARCHAR)) AS chars FROM r a JOIN r b ON b.conv_id = a.conv_id AND b.session = a.session
    AND b.fine AND b.before < a.before AND b.before >= a.before - 10 GROUP BY ALL)
SELECT r.conv_id, r.seq, CASE WHEN fine THEN p::VARCHAR ELSE '' END AS answer, CASE WHEN fine THEN '' ELSE 'no answer' END AS error,
  CASE WHEN fine THEN 2 + least(20, 2 * before) ELSE 0 END::BIGINT AS prompt_tokens,
  CASE WHEN fine THEN {len(SYSTEM)} + coalesce(chars, 0) + p ELSE 0 END::BIGINT AS total_tokens,
  least(20, 2 * before)::BIGINT AS n_history, least(10, before + fine::INT)::BIGINT AS conversation_length
FROM r LEFT JOIN h USING (conv_id, session, seq)
"""


def corpus_intent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause, item and comparison intents of all dressed documents with ids that are unique in the corpus."""
    chunks = Q.stored_statutes(spark, sf_dir)
    of_clauses = chunks.select("doc_id", "pos", F.lit(-1).alias("item_pos"), F.lit(0).alias("n"))
    of_items = chunks.select("doc_id", "pos", F.posexplode("clause.items").alias("item_pos", "i")).select("doc_id", "pos", "item_pos", F.lit(0).alias("n"))
    compared = I.comparison_intents(chunks).select("doc_id", "pos", "item_pos", "n")
    rows = I.number_corpus_intents(of_clauses.unionByName(of_items).unionByName(compared))
    compares = F.col("pos") == 2**31 - 1
    return rows.select("doc_id", F.when(compares, -1).otherwise(F.col("pos")).cast("long").alias("pos"), F.when(compares, -1).otherwise(F.col("item_pos")).cast("long").alias("item_pos"), F.col("n").cast("long").alias("n"), "intent_id")


CORPUS_INTENT_IDS = (
    Q._LINES
    + f""",
intents AS (
  SELECT 0 AS last, doc_id, i // 4 AS pos, CASE WHEN i % 4 = 0 THEN -1 ELSE 0 END AS item_pos, 0 AS n FROM lines WHERE i % 2 = 0
  UNION ALL SELECT 1, doc_id, -1, -1, n FROM (SELECT DISTINCT doc_id FROM lines), range({len(I.COMPARISONS)}) AS t(n)),
numbered AS (SELECT *, row_number() OVER (ORDER BY last, doc_id, pos, item_pos, n) AS k FROM intents)
SELECT doc_id, pos::BIGINT AS pos, item_pos::BIGINT AS item_pos, n::BIGINT AS n, 'intent_' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS intent_id
FROM numbered
"""
)


def _intents(messages: list[dict]) -> tuple[str, dict]:
    return json.dumps({"intents": [{"user_query": "what does this clause say", "semantic_tags": []}, {"user_query": "why", "semantic_tags": ["x"]}]}), {}


def generated_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of all clauses and items of dressed documents: prompts, replies, parsing, checking against their clause, comparisons and ids."""
    made = tables.stored(I.generate_intents(tables.stored(outline.generate_chunks(Q.statutes(spark, sf_dir)), "chunks"), _intents), "generated")
    compared = F.col("query_type") == I.COMPARISON
    return made.groupBy("doc_id").agg(
        F.count("*").alias("n_intents"), F.count(F.when(compared, 1)).alias("n_comparisons"), F.max("intent_id").alias("last_id"), F.round(F.avg(F.when(~compared, F.col("quality_score"))), 6).alias("quality")
    )


GENERATED_INTENTS = (
    Q._LINES
    + f"""
SELECT doc_id, 2 * count(*) + {len(I.COMPARISONS)} AS n_intents, {len(I.COMPARISONS)}::BIGINT AS n_comparisons,
  'intent_' || lpad((2 * count(*) + {len(I.COMPARISONS)})::VARCHAR, 4, '0') AS last_id, 0.95::DOUBLE AS quality
FROM lines WHERE i % 2 = 0 GROUP BY doc_id
"""
)


def _measured(messages: list[dict]) -> tuple[str, dict]:
    return f"{len(messages[0]['content'])} characters", {"total_tokens": len(messages[0]["content"])}


def _accepted(content: str) -> bool:
    return int(content.split()[0]) % 5 > 0


def durable_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to all documents kept by prompt: a first run answers those of even length, a second one asks for the others only."""
    path = tables.scratch(spark, "replies")
    rows = Q.table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"))).alias("messages"))
    even = F.char_length(F.col("messages")[0]["content"]) % 2 == 0
    hooks.durable_replies(rows.filter(even), _measured, path, accept=_accepted, waves=2)
    found = hooks.durable_replies(rows, _measured, path, accept=_accepted, waves=2)
    return found.select("doc_id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("usage.total_tokens", F.lit(0)).alias("total_tokens"), F.coalesce("error", F.lit("")).alias("error"))


DURABLE_REPLIES = f"""
SELECT doc_id, CASE WHEN n % 5 > 0 THEN n || ' characters' ELSE '' END AS content, CASE WHEN n % 5 > 0 THEN n ELSE 0 END::BIGINT AS total_tokens,
  CASE WHEN n % 5 > 0 THEN '' ELSE '{hooks.REFUSED}' END AS error
FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)
"""


def committed_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents committed twice as one version, then a commit that breaks off; read back with the counts of its manifest."""
    base = tables.scratch(spark, "committed")
    docs = Q.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tables.commit_version(base, "1.0", {"texts": docs.select("doc_id", F.lit("old").alias("text"))}, notes="first")
    tables.commit_version(base, "1.0", {"texts": docs, "lengths": docs.select("doc_id", F.char_length("text").cast("long").alias("n"))}, notes="second")
    docs.limit(0).write.parquet(f"{base}/data/1.0-broken/texts")  # what a killed commit leaves: a table, but no manifest
    said = tables.current_version(spark, base, "1.0").select("notes", F.col("counts")["lengths"].alias("n_lengths"))
    both = tables.read_version(spark, base, "1.0", "texts").join(tables.read_version(spark, base, "1.0", "lengths"), "doc_id")
    return both.crossJoin(F.broadcast(said)).select("doc_id", "text", "n", "notes", "n_lengths")  # one row of a manifest


COMMITTED_VERSION = "SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, 'second' AS notes, (SELECT count(*) FROM documents) AS n_lengths FROM documents"


def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items written as lines of one file, some of them blank, and read as numbered questions."""
    path = tables.scratch(spark, "questions")
    line = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    items = Q.table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), line)).alias("value"))
    items.coalesce(1).sortWithinPartitions("item_id").select("value").write.text(path)
    return tables.read_questions(spark, path)


QUESTION_LINES = r"""
SELECT row_number() OVER (ORDER BY item_id) - 1 AS query_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark WHERE item_id % 5 <> 0 AND trim(text) <> ''
"""

def flat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat chunks of dressed documents with vectors, written as a version and read back: chunks and letters of each document, with the manifest."""
    base = tables.scratch(spark, "flat-index")
    said = jobs.build_flat_index(RQ.one_chapter(spark, sf_dir), RQ.letter_counts, base, "1.0", "flat", "2026-01-01", "letters")
    rows = jobs.read_flat_index(spark, base, "1.0").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("letters"))
    return rows.crossJoin(F.broadcast(said.select("num_chunks", "version", "notes", "embedding_model")))  # one row of a manifest


FLAT_INDEX = f"""
WITH f AS ({RQ.FLAT_CHUNKS})
SELECT doc_id, count(*) AS n_chunks, sum(list_sum({RQ.letters_sql("text")}))::DOUBLE AS letters, (SELECT count(*) FROM f) AS num_chunks, '1.0' AS version, 'flat' AS notes, 'letters' AS embedding_model
FROM f GROUP BY doc_id
"""


def built_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on dressed documents: chunks, intents by the stand-in, and chunks that list their intents, read back from what was written."""
    path = tables.scratch(spark, "built-index")
    chunks, made = jobs.build_index(Q.statutes(spark, sf_dir), _intents, path)
    chunks, made = jobs.build_index(Q.statutes(spark, sf_dir).limit(0), _intents, path)  # what is whole is not built again
    own = F.size("clause.intent_ids") + F.aggregate("clause.items", F.lit(0), lambda n, i: n + F.size(i["intent_ids"]))
    listed = chunks.groupBy("doc_id").agg(F.count("*").alias("n_clauses"), F.sum(own).alias("n_listed"))
    return listed.join(made.groupBy("doc_id").agg(F.count("*").alias("n_intents")), "doc_id")


BUILT_INDEX = (
    Q._LINES
    + f"""
SELECT doc_id, count(*) FILTER (i % 4 = 0) AS n_clauses, 2 * count(*) AS n_listed, 2 * count(*) + {len(I.COMPARISONS)} AS n_intents FROM lines WHERE i % 2 = 0 GROUP BY doc_id
"""
)


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of an index of dressed documents, as rows; an intent of each clause has its kind, tags and score from the clause's heading."""
    chunks = Q.stored_statutes(spark, sf_dir)
    title = F.col("clause.clause_title")
    n, has = F.char_length(title), lambda x: title.contains(x)
    made = chunks.select(
        F.when(has("e"), F.lit(I.COMPARISON)).alias("query_type"), F.when(n % 7 > 0, F.concat(F.lit("length "), (n % 13).cast("string"))).alias("category"),
        F.array_compact(F.array(*[F.when(has(x), F.lit(x)) for x in "aost"])).alias("semantic_tags"),
        F.when(has("a"), 0.95).when(has("o"), 0.85).otherwise(0.5).alias("quality_score"), F.when(has("s"), F.lit("一")).alias("item_no"),
    )
    found = jobs.index_stats(chunks, made)

    def rows(kind: str, *values: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])
        return found[kind].select(F.lit(kind).alias("statistic"), F.inline(pairs))

    def counts(kind: str, label: str) -> DataFrame:
        return found[kind].select(F.lit(kind).alias("statistic"), F.col(label).alias("name"), F.col("n").cast("double").alias("value"))

    listed = rows("outline", "n_clauses", "n_items", "n_subitems").unionByName(rows("average", "avg_intents")).unionByName(rows("quality", "mean_score", "n_low", "n_high", "n_middle", "n_below"))
    return listed.unionByName(counts("query_types", "query_type")).unionByName(counts("categories", "category")).unionByName(counts("tags", "label"))


INDEX_STATISTICS = (
    Q._LINES
    + f""",
t AS (
  SELECT line, CASE WHEN contains(line, 'e') THEN '{I.COMPARISON}' ELSE '其他' END AS kind, CASE WHEN length(line) % 7 > 0 THEN 'length ' || length(line) % 13 ELSE '未分類' END AS category,
    CASE WHEN contains(line, 'a') THEN 0.95::DOUBLE WHEN contains(line, 'o') THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS q, contains(line, 's') AS of_item
  FROM lines WHERE i % 4 = 0),
ten AS (SELECT category, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, category LIMIT 10)
SELECT 'outline' AS statistic, unnest(['n_clauses', 'n_items', 'n_subitems']) AS name,
  unnest([count(*) FILTER (i % 4 = 0), count(*) FILTER (i % 4 = 2), count(*) FILTER (i % 4 = 3)])::DOUBLE AS value FROM lines
UNION ALL SELECT 'average', 'avg_intents', 1.0::DOUBLE
UNION ALL SELECT 'quality', unnest(['mean_score', 'n_low', 'n_high', 'n_middle', 'n_below']),
  unnest([round(avg(q), 9), count(*) FILTER (q < 0.8 AND NOT of_item), count(*) FILTER (q > 0.9), count(*) FILTER (q BETWEEN 0.8 AND 0.9), count(*) FILTER (q < 0.8)]) FROM t
UNION ALL SELECT 'query_types', kind, count(*)::DOUBLE FROM t GROUP BY kind
UNION ALL SELECT 'categories', category, n::DOUBLE FROM ten
UNION ALL SELECT 'tags', x, count(*)::DOUBLE FROM t, unnest(['a', 'o', 's', 't']) AS l(x) WHERE contains(line, x) GROUP BY x
"""
)


def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into words of the benchmark, wherever these stand within longer ones; how many tokens, and how many of them are words of the table."""
    letters = F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")
    words = Q.table(spark, sf_dir, "benchmark").select(letters).groupBy("word").agg(F.count("*").alias("n"))
    cut = segment.segmenter(words, runs=r"\p{L}+", others=r"\p{N}+")
    rows = Q.table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(cut(F.lower(F.coalesce("text", F.lit(""))))).alias("pos", "word"))
    known = rows.join(F.broadcast(words.limit(segment.MOST).select("word", F.lit(1).alias("known"))), "word", "left")  # the segmenter refuses larger tables
    return known.groupBy("doc_id").agg(F.count("word").alias("n_tokens"), F.count("known").alias("n_known"))


QUERIES = {f.__name__: f for f in (streamed_history, streamed_retrieval, conversation_answers, corpus_intent_ids, generated_intents, durable_replies, committed_version, question_lines, segmented_words, flat_index, built_index, index_statistics)}


def oracle_sql() -> dict[str, str]:
    return {
        "streamed_history": Q.HISTORY, "streamed_retrieval": RQ.RETRIEVE_CLAUSES, "conversation_answers": CONVERSATION_ANSWERS, "corpus_intent_ids": CORPUS_INTENT_IDS,
        "generated_intents": GENERATED_INTENTS, "durable_replies": DURABLE_REPLIES, "committed_version": COMMITTED_VERSION, "question_lines": QUESTION_LINES,
        "flat_index": FLAT_INDEX, "built_index": BUILT_INDEX, "index_statistics": INDEX_STATISTICS,
    }
