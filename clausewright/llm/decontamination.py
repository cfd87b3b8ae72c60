"""Benchmark decontamination as a prefix-filtered join, with SQL functions only (operator 7).

Each benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one window). Containment of a whole
window needs all its tokens, so one prefix token suffices: its rarest word by the number of occurrences in the documents. Document words
equal to a prefix token give candidates; the window must fit around that place (positional and length bounds), and
is then compared word by word. The index holds windows alone; the items that have a window are joined to the windows that were found.

Cases: a null text has no words; an item without words has no windows; repeated windows of an item, and items that share windows,
count once per item; overlapping occurrences hit a word once; repeated documents stay repeated; empty tables give no hits; extra columns are
ignored; a null doc_id keeps its row; items without id are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import materialise

WINDOW = 10
#: Positions at which a window may start in one block of document words.
BLOCK = 64
#: Up to this number of windows, and of bytes of their words, the index is broadcast; beyond either the join is shuffled.
BROADCAST_WINDOWS, BROADCAST_BYTES = 100_000, 16 << 20
#: Parts into which the occurrences of one token are dealt when the join is shuffled.
PARTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    """Runs of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, wid, win): the windows of each item, its id as a string; wid is the SHA-256 of the window's words, which hold no spaces."""
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    wins = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("win"))
    return wins.select("item", F.unhex(F.sha2(F.array_join("win", " "), 256)).alias("wid"), "win").distinct()


def prefix_index(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """(token, offset, n, wid, win): each distinct window under its rarest word in the documents, first place if tied."""
    near = F.broadcast if small else (lambda df: df)
    tokens = windows.select(F.explode("win").alias("token")).distinct()
    occurs = docs.select(F.explode(words(F.col("text"))).alias("token")).join(near(tokens), "token", "left_semi").groupBy("token").count()
    placed = windows.select("wid", "win", F.posexplode("win").alias("offset", "token")).join(occurs, "token", "left")
    rare = placed.groupBy("wid", "win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "token")).alias("r"))
    # A token that occurs nowhere rules its window out.
    return rare.filter("r.count > 0").select("r.token", "r.offset", F.size("win").alias("n"), "wid", "win")


def occurrences(docs: DataFrame, owned: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, start, n, wid): every occurrence of a window of ``owned`` (see item_windows); mark is a hash of the text."""
    windows = materialise(owned.select("wid", "win").distinct(), "windows")
    held = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("win", " "))), F.lit(0)).alias("bytes")).first()
    small = held.n <= BROADCAST_WINDOWS and held.bytes <= BROADCAST_BYTES
    index = materialise(prefix_index(docs, windows, small), "prefixes")
    index = F.broadcast(index) if small else index
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    return (_found_in_blocks if small else _found_by_place)(rows, index, window)


def _found_in_blocks(rows: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """Occurrences by a small index: blocks of words meet it where they are, so that nothing is shuffled."""
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(BLOCK)), lambda s: F.struct(s.alias("base"), F.slice("w", s + 1, BLOCK + window - 1).alias("words")))
    pieces = rows.select("doc_id", "mark", F.explode(cut).alias("b")).select("doc_id", "mark", "b.base", "b.words")
    placed = pieces.select("doc_id", "mark", "base", "words", F.posexplode("words").alias("at", "token"))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start < BLOCK) & (start + F.col("n") <= F.size("words"))
    found = placed.join(index, "token").filter(fits & (F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("n")) == F.col("win")))
    return found.select("doc_id", "mark", (F.col("base") + start).alias("start"), "n", "wid")


def _found_by_place(rows: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """Occurrences by a large index: only words and their places are shuffled to it; what fits goes back to its document and is compared there.

    A token's places are dealt into parts, and the index is sent to each, so that a word that is frequent and yet the rarest of its windows meets them in many tasks.
    """
    placed = rows.select("doc_id", "mark", F.size("w").alias("size"), F.posexplode("w").alias("at", "token"))
    placed = placed.withColumn("part", F.pmod(F.hash("doc_id", "mark", "at"), F.lit(PARTS)))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    start = F.col("at") - F.col("offset")
    fits = placed.join(index, ["token", "part"]).filter((start >= 0) & (start + F.col("n") <= F.col("size"))).select("doc_id", "mark", start.alias("start"), "n", "wid", "win")
    texts = rows.withColumnsRenamed({"doc_id": "d", "mark": "m"}).dropDuplicates(["d", "m"])  # repeated rows have the same hits
    both = fits.join(texts, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")))
    return both.filter(F.slice("w", F.col("start") + 1, F.col("n")) == F.col("win")).select("doc_id", "mark", "start", "n", "wid")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items themselves."""
    owned = materialise(item_windows(benchmark, window), "owned")
    hits = materialise(occurrences(docs, owned, window), "hits")
    key = ["doc_id", "mark"]
    covered = hits.select(*key, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct()
    n_hit = covered.groupBy(*key).agg(F.count("*").alias("n_hit"))
    items = hits.select(*key, "wid").distinct().join(owned.select("wid", "item"), "wid").select(*key, "item").distinct().groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = n_hit.withColumnsRenamed({"doc_id": "d", "mark": "m"}).join(items, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark"))).select("d", "m", "n_hit", "items")
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        listed.alias("items"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any benchmark window, with all their columns."""
    hits = occurrences(docs, item_windows(benchmark, window), window).select("doc_id", "mark").distinct()
    hits = hits.withColumnsRenamed({"doc_id": "d", "mark": "m"})
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["d"]) & (F.xxhash64(docs["text"]) == hits["m"]), "left_anti")
