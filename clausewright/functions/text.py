"""Cleaning, entities and references of clause texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode's white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMERAL = "[一二三四五六七八九十百]"
# Entity patterns by kind, and what counts as a reference.
ENTITIES = {
    "時間": (r"(\d+(?:小時|天|日|個月|年))", "(二十四小時|四小時|六小時)", "(預定出發時間|實際出發時間)"),
    "金額": (r"(新臺幣\s*[零一二三四五六七八九十百千萬億\d]+元)", "(保險金額)"),
    "次數": ("(給付[一二三四五六七八九十]+次)", "([一二三四五六七八九十]+次事故)"),
}
REFERENCE = f"(前項|前款|前條|本條|本項|本款|第{NUMERAL}+條(?:第{NUMERAL}+項)?(?:第{NUMERAL}+款)?)"
PREVIOUS = dict(zip("二三四五六七八九十", "一二三四五六七八九", strict=True))


def strip(text: Column) -> Column:
    """Remove white space of any script from both ends; trimming by characters does not search the whole text as a pattern does."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_page_numbers(text: Column) -> Column:
    """Drop lines of one to three digits, and such numbers behind a full stop or colon."""
    lines = F.split(text, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    kept = F.filter(lines, lambda x: ~x.rlike(r"(?U)^\s*\d{1,3}\s*\z"))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"(?U)(。|：)\s*\d{1,3}\b", "$1")), "\n")


def clean_text(text: Column, remove_numbers: bool = True) -> Column:
    """One line with single spaces, without a leading item number and sub-item number."""
    line = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    if not remove_numbers:
        return line
    line = F.regexp_replace(line, rf"(?U)^{NUMERAL}+、\s*", "")
    return F.regexp_replace(line, r"(?U)^[(（][一二三四五六七八九十百0-9a-zA-Z]+[)）]\s*", "")


def clean_flat_text(text: Column) -> Column:
    """Blank out lines of one to three digits, then join line breaks."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?mdU)^\s*\d{1,3}\s*$", ""), "\n+", "\n"))


def extract_entities(text: Column) -> Column:
    """Kinds of entities to their distinct mentions, sorted; places are never found."""
    found = []
    for kind, patterns in ENTITIES.items():
        hits = F.concat(*[F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(1)) for p in patterns])
        found += [F.lit(kind), F.array_sort(F.array_distinct(hits))]
    return F.create_map(*found, F.lit("地點"), F.array().cast("array<string>"))


def detect_references(text: Column) -> Column:
    """Distinct references in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)))


def resolve_reference(ref: Column, clause_no: Column, item_no: Column) -> Column:
    """The absolute form of a reference, as far as its kind has one."""
    before = F.create_map(*[F.lit(x) for pair in PREVIOUS.items() for x in pair])[item_no]
    own = F.concat(clause_no, F.substring(ref, 2, 100))
    return (
        F.when(ref == "前項", F.when(before.isNotNull(), F.concat(clause_no, F.lit("第"), before, F.lit("項"))).otherwise(F.concat(clause_no, ref)))
        .when(ref == "前款", F.concat(clause_no, ref))
        .when(ref.isin("本條", "本項", "本款"), own)
        .otherwise(ref)
    )
