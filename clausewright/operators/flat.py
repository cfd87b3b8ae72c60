"""Flat chunks: chapters, clauses and items as one row per piece of bounded length, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import lexicon, text as T
from clausewright.operators import outline

# Heading patterns of flat chunks; their numerals stop at ten.
FLAT_NUMERAL = "[一二三四五六七八九十]"
FLAT_CHAPTER = rf"^(第{FLAT_NUMERAL}+章)\s*(.+?)\s*$"
FLAT_CLAUSE = rf"^(第{FLAT_NUMERAL}+條)\s*(.+?)\s*$"
FLAT_ITEM = rf"\n({FLAT_NUMERAL}+)、"


def _pieces(body: Column) -> Column:
    """array<struct<item, text>>: the body itself, or each item behind what stands before the first one."""
    parts = F.split(F.regexp_replace(body, FLAT_ITEM, "\x01$1\x02"), "\x01", -1)
    context = T.strip(F.element_at(parts, 1))

    def item(part):
        no, own = F.substring_index(part, "\x02", 1), T.strip(F.substring_index(part, "\x02", -1))
        line = F.concat(no, F.lit("、"), own)
        text = F.when(context != "", F.concat(context, F.lit("\n"), line)).otherwise(line)
        return F.struct(F.struct(no.alias("no"), own.alias("text")).alias("item"), text.alias("text"))

    whole = F.array(F.struct(F.lit(None).cast("struct<no:string,text:string>").alias("item"), body.alias("text")))
    items = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), item)
    return F.when(F.size(parts) > 1, items).otherwise(F.filter(whole, lambda p: p["text"] != ""))


def flat_chunks(docs: DataFrame, version: str = "1.0", max_chars: int = 500) -> DataFrame:
    """One row per piece, in the order of chapter_pos, clause_pos, item_pos, piece_pos.

    Clauses outside any chapter and empty clauses give no rows; a null text has no chapters. An item needs a line before it.
    Type and scope are those of the piece.
    """
    text = T.clean_flat_text(F.translate(F.coalesce("text", F.lit("")), outline.MARKS, ""))
    # A text leaves the row before its parts become rows of their own: no part carries the whole.
    pair = lambda c, name: F.struct(F.col(f"{c}.no").alias("no"), F.col(f"{c}.title").alias("title")).alias(name)
    chapters = outline.spread(docs).select("doc_id", F.posexplode(outline.headings(text, FLAT_CHAPTER, stripped=False)).alias("chapter_pos", "ch"))
    chapters = chapters.select("doc_id", "chapter_pos", pair("ch", "chapter"), outline.headings(F.col("ch.body"), FLAT_CLAUSE).alias("found"))
    clauses = chapters.select("doc_id", "chapter_pos", "chapter", F.posexplode("found").alias("clause_pos", "cl"))
    clauses = clauses.select("doc_id", "chapter_pos", "clause_pos", "chapter", pair("cl", "clause"), _pieces(F.col("cl.body")).alias("found"))
    items = clauses.select("doc_id", "chapter_pos", "clause_pos", "chapter", "clause", F.posexplode("found").alias("item_pos", "p"))
    rows = items.select("doc_id", "chapter_pos", "clause_pos", "item_pos", "chapter", "clause", "p.item", outline.split_long(F.col("p.text"), max_chars).alias("found"))
    rows = rows.select("doc_id", "chapter_pos", "clause_pos", "item_pos", "chapter", "clause", "item", F.posexplode("found").alias("piece_pos", "text"))
    return rows.select(
        "doc_id", "chapter_pos", "clause_pos", "item_pos", "piece_pos", "chapter", "clause",
        "item", "text", F.lit(version).alias("version"),
        lexicon.label_first(F.col("text"), lexicon.CHUNK_TYPES, "coverage").alias("chunk_type"),
        lexicon.label_all(F.col("text"), lexicon.SCOPES, ["general"]).alias("semantic_scope"),
    )
