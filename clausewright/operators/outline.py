"""Outlines: documents to clauses, items and sub-items, without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import lexicon, text as T

MARKS = "\x01\x02\x03\x04"


# The heading patterns of a spec.
@dataclass(frozen=True)
class OutlineSpec:
    """Heading patterns: two groups (number, title) for chapters and clauses, one (number) for items and sub-items."""

    chapter: str = rf"^(第{T.NUMERAL}+章)\s*(.+?)$"
    clause: str = rf"^(第{T.NUMERAL}+條)\s*(.+?)\s*$"
    item: str = rf"^\s*({T.NUMERAL}+)、"
    subitem: str = rf"^\s*[(（]({T.NUMERAL}+|[0-9]+|[a-zA-Z])[)）]\s*"


def _parts(text: Column, pattern: str) -> Column:
    """What stands before the first heading, then number, title, the heading and what stands below it, for each heading."""
    return F.split(F.regexp_replace(text, f"(?mdU){pattern}", "\x01$1\x02$2\x03$0\x04"), "\x01", -1)


def _behind(array: Column) -> Column:
    return F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0)))


def _heading(part: Column, stripped: bool) -> Column:
    below = F.substring_index(part, "\x04", -1)
    return F.struct(
        F.substring_index(part, "\x02", 1).alias("no"),
        T.strip(F.substring_index(F.substring_index(part, "\x03", 1), "\x02", -1)).alias("title"),
        (T.strip(below) if stripped else below).alias("body"),
    )


def headings(text: Column, pattern: str, stripped: bool = True) -> Column:
    """array<struct<no, title, body>> of the headings in a text and what stands below each, stripped or as it is; in time linear in the text."""
    return F.transform(_behind(_parts(text, pattern)), lambda p: _heading(p, stripped))


def _chapters_of(parts: Column, pattern: str) -> Column:
    """array<struct<no, title>>: for each clause the last chapter heading that starts before it, null before the first: an as-of join within the row.

    The clauses' starts are marked in the text, then chapters are found in the marked text; the marks between two chapter headings are the
    clauses of the first one. So no positions are compared, and time is linear in the text.
    """
    marked = F.concat(F.element_at(parts, 1), F.array_join(F.transform(_behind(parts), lambda p: F.concat(F.lit("\x01"), F.translate(F.substring_index(p, "\x03", -1), "\x04", ""))), ""))
    # A chapter heading that starts where a clause does starts behind the clause's mark.
    anchored = ("^(\x01?)(" + pattern[1:] if pattern.startswith("^") else "(\x01?)(" + pattern) + ")"
    segments = F.split(F.regexp_replace(marked, f"(?mdU){anchored}", "$1\x02$3\x03$4\x04$2"), "\x02", -1)

    def members(segment: Column, i: Column) -> Column:
        head, below = F.substring_index(F.translate(segment, "\x01", ""), "\x04", 1), F.substring_index(segment, "\x04", -1)
        chapter = F.struct(F.substring_index(head, "\x03", 1).alias("no"), T.strip(F.substring_index(head, "\x03", -1)).alias("title"))
        return F.array_repeat(F.when(i > 0, chapter), (F.length(below) - F.length(F.translate(below, "\x01", ""))).cast("int"))

    return F.flatten(F.transform(segments, members))


def split_clauses(docs: DataFrame, spec: OutlineSpec | None = None) -> DataFrame:
    """One row per clause: doc_id, pos, clause_no, clause_title, clause_id, body, chapter_no, chapter_title."""
    spec = spec or OutlineSpec()
    body = T.strip(F.translate(F.coalesce("text", F.lit("")), MARKS, ""))
    rows = docs.select("doc_id", _parts(body, spec.clause).alias("parts"))
    found = F.arrays_zip(F.transform(_behind(F.col("parts")), lambda p: _heading(p, True)).alias("c"), _chapters_of(F.col("parts"), spec.chapter).alias("h"))
    rows = rows.select("doc_id", F.posexplode(found).alias("pos", "x"))
    return rows.select(
        "doc_id", "pos", F.col("x.c.no").alias("clause_no"), F.col("x.c.title").alias("clause_title"),
        F.concat("x.c.no", F.lit("_"), "x.c.title").alias("clause_id"), F.col("x.c.body").alias("body"),
        F.col("x.h.no").alias("chapter_no"), F.col("x.h.title").alias("chapter_title"),
    )


def _numbered(text: Column, pattern: str, build) -> Column:
    found = _behind(F.split(F.regexp_replace(text, f"(?mdU){pattern}", "\x01$1\x02"), "\x01", -1))
    # Two steps: a lambda's text would be cut anew for each of its uses, an array's element is not.
    pairs = F.transform(found, lambda p: F.struct(F.substring_index(p, "\x02", 1).alias("no"), T.strip(F.substring_index(p, "\x02", -1)).alias("text")))
    return F.transform(pairs, lambda q: build(q["no"], q["text"]))


def _described(text: Column, details: bool) -> list[Column]:
    if not details:
        return [text.alias("context")]
    return [
        text.alias("context"), T.clean_text(text).alias("raw_text"), T.detect_references(text).alias("reference_clauses"),
        lexicon.label_all(text, lexicon.ACTIONS).alias("action_keywords"), T.extract_entities(text).alias("entities"),
    ]


def parse_subitems(text: Column, spec: OutlineSpec | None = None, details: bool = True) -> Column:
    return _numbered(text, (spec or OutlineSpec()).subitem, lambda no, t: F.struct(no.alias("subitem_no"), *_described(t, details)))


def parse_items(text: Column, spec: OutlineSpec | None = None, details: bool = True) -> Column:
    none, subs = F.array().cast("array<string>").alias("intent_ids"), lambda t: parse_subitems(t, spec, details).alias("sub_items")
    return _numbered(text, (spec or OutlineSpec()).item, lambda no, t: F.struct(no.alias("item_no"), *_described(t, details), none, subs(t)))


def spread(docs: DataFrame) -> DataFrame:
    """docs in as many tasks as there are cores, if a scan of few large row groups would leave cores without work; else as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def generate_chunks(docs: DataFrame, spec: OutlineSpec | None = None, details: bool = True) -> DataFrame:
    """Nested chunks, one row per clause. Without ``details`` only the outline: numbers, titles and contexts, no labels, references or entities."""
    rows = split_clauses(spread(docs), spec)
    body, title = F.col("body"), F.col("clause_title")
    labels = [lexicon.insurance_types(title, body).alias("insurance_types"), lexicon.clause_function(title, body).alias("clause_function")] if details else []
    clause = F.struct(
        "clause_no", "clause_title", "clause_id", *_described(body, details), F.array().cast("array<string>").alias("intent_ids"),
        parse_items(body, spec, details).alias("items"), *labels,
    )
    return rows.select("doc_id", "pos", F.col("clause_id").alias("chunk_id"), "chapter_no", "chapter_title", clause.alias("clause"))


def _last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    value = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("v"))
    return picked.select(*keys, "v.*")


def flatten_outline(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clause, item and sub-item rows by their keys; of equal keys in a document the last wins."""
    base = chunks.select("doc_id", "pos", F.col("clause.clause_id").alias("clause_id"), "clause")
    items = base.select("doc_id", "pos", "clause_id", F.posexplode("clause.items").alias("item_pos", "item"))
    subs = items.select("doc_id", "pos", "clause_id", "item_pos", F.col("item.item_no").alias("item_no"), F.posexplode("item.sub_items").alias("sub_pos", "sub"))
    clauses = _last_wins(base.select("doc_id", "clause_id", "pos", "clause.context", "clause.raw_text"), ["doc_id", "clause_id"], ["pos"])
    flat_items = items.select("doc_id", "clause_id", F.col("item.item_no").alias("item_no"), "pos", "item_pos", "item.context", "item.raw_text")
    flat_subs = subs.select("doc_id", "clause_id", "item_no", F.col("sub.subitem_no").alias("subitem_no"), "pos", "item_pos", "sub_pos", "sub.context", "sub.raw_text")
    return (
        clauses,
        _last_wins(flat_items, ["doc_id", "clause_id", "item_no"], ["pos", "item_pos"]),
        _last_wins(flat_subs, ["doc_id", "clause_id", "item_no", "subitem_no"], ["pos", "item_pos", "sub_pos"]),
    )


def reference_edges(chunks: DataFrame) -> DataFrame:
    """(doc_id, clause_id, item_no, subitem_no, ref, target) for every reference at the three levels, in one pass."""
    null = F.lit(None).cast("string")

    def listed(refs: Column, item: Column, sub: Column) -> Column:
        return F.transform(refs, lambda r: F.struct(item.alias("item_no"), sub.alias("subitem_no"), r.alias("ref")))

    def below(item: Column) -> Column:
        return F.flatten(F.transform(item["sub_items"], lambda s: listed(s["reference_clauses"], item["item_no"], s["subitem_no"])))

    of_items = F.flatten(F.transform("clause.items", lambda i: F.concat(listed(i["reference_clauses"], i["item_no"], null), below(i))))
    rows = chunks.select("doc_id", "clause.clause_id", "clause.clause_no", F.explode(F.concat(listed(F.col("clause.reference_clauses"), null, null), of_items)).alias("e"))
    target = T.resolve_reference(F.col("e.ref"), F.col("clause_no"), F.col("e.item_no"))
    return rows.select("doc_id", "clause_id", "e.item_no", "e.subitem_no", "e.ref", target.alias("target"))


def split_long(text: Column, max_chars: int = 500, stops: str = "。；") -> Column:
    """Pieces of at most ``max_chars`` characters packed from sentences; a longer sentence stays whole.

    The fold over n sentences runs in about the square root of n stretches, so that adding a piece never copies all pieces before it.
    """
    empty = F.array().cast("array<string>")

    def flushed(state):
        return F.when(T.strip(state["buf"]) != "", F.concat(state["out"], F.array(T.strip(state["buf"])))).otherwise(state["out"])

    def add(state, s):
        fits = F.length(state["buf"]) + F.length(s) <= max_chars
        return F.struct(F.when(fits, F.concat(state["buf"], s)).otherwise(s).alias("buf"), F.when(fits, state["out"]).otherwise(flushed(state)).alias("out"))

    def add_stretch(state, stretch):
        packed = F.aggregate(stretch, F.struct(state["buf"].alias("buf"), empty.alias("out")), add)
        once = F.transform(F.array(packed), lambda p: F.struct(p["buf"].alias("buf"), F.concat(state["out"], F.array(p["out"])).alias("out")))
        return F.element_at(once, 1)

    def stretches(sentences):
        width = F.ceil(F.sqrt(F.size(sentences))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(sentences), width), lambda i: F.slice(sentences, i, width))

    last = F.concat(F.split(text, f"(?<=[{stops}])", -1), F.array(F.lit("")))
    cut = F.flatten(F.transform(F.array(last), stretches))
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<array<string>>").alias("out"))
    rest = lambda state: F.concat(F.flatten(state["out"]), flushed(F.struct(state["buf"].alias("buf"), empty.alias("out"))))
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(F.aggregate(cut, start, add_stretch, rest))
