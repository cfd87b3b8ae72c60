"""Intents: prompts per clause and item, parsing and checking of replies, comparisons, numbering and back-filling of ids."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.functions import hooks, text as T
from clausewright.operators.numbering import number_rows

CLAUSE_PROMPT = """List the questions that policy holders may ask about this clause, as JSON {"intents": [...]}.
Clause: {clause_no} {clause_title}
Function: {clause_function}
Insurance types: {insurance_types}
Actions: {action_keywords}
Text:
{context}"""
ITEM_PROMPT = """List the questions that policy holders may ask about this item, as JSON {"intents": [...]}.
Clause: {clause_no} {clause_title}
Function: {clause_function}
Item: {item_no}
Actions: {action_keywords}
Text:
{item_context}"""

REPLY = (
    "struct<intents:array<struct<user_query:string,excerpt:string,conditions:array<string>,exceptions:array<string>,"
    "referenced_clauses:array<string>,category:string,query_type:string,semantic_tags:array<string>,difficulty:string>>>"
)
# Defaults of fields that a reply leaves out, labels and weights of the quality rules, and the comparisons.
DEFAULTS = {"user_query": "", "excerpt": "", "category": "其他", "query_type": "直接查詢", "difficulty": "簡單"}
LISTS = ("conditions", "exceptions", "referenced_clauses", "semantic_tags")
COMPARISON, EXCLUSION, EXCLUDED = "對比查詢", "不保事項", "不保"
CONFUSABLE = (("延誤", ("遺失", "損失")), ("遺失", ("延誤",)), ("取消", ("更改",)))
COMPARISONS = (
    {
        "user_query": "行李延誤和行李遺失有什麼差別？什麼時候算延誤，什麼時候算遺失？",
        "excerpt": "行李延誤是指抵達6小時後仍未領得；行李損失是指毀損、滅失或遺失",
        "category": "定義說明", "semantic_tags": ("延誤", "遺失", "對比"), "difficulty": "中等", "related": ("第三十六條", "第三十九條"),
    },
    {
        "user_query": "班機延誤和旅程取消有什麼不同？分別在什麼情況下理賠？",
        "excerpt": "班機延誤是班機晚點；旅程取消是在出發前因特定事由取消整個行程",
        "category": "定義說明", "semantic_tags": ("延誤", "取消", "對比"), "difficulty": "中等", "related": ("第二十七條", "第三十條"),
    },
    {
        "user_query": "旅程取消和旅程更改有何差別？",
        "excerpt": "旅程取消是出發前全部取消；旅程更改是旅行中因故變更行程",
        "category": "定義說明", "semantic_tags": ("取消", "更改", "對比"), "difficulty": "中等", "related": ("第二十七條", "第三十三條"),
    },
    {
        "user_query": "行李被偷和被航空公司弄丟，理賠有什麼不同？",
        "excerpt": "竊盜需報警並取得報案證明；處理失當需業者出具事故證明",
        "category": "申請流程", "semantic_tags": ("竊盜", "遺失", "對比"), "difficulty": "中等", "related": ("第三十九條", "第四十二條", "第四十三條"),
    },
)


def fill(template: str, **values: Column) -> Column:
    """The template with its ``{name}`` fields filled from columns; other braces stay."""
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return F.concat(*[F.coalesce(values[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _asked(rows: DataFrame, item_pos: Column, item_no: Column, prompt: Column) -> DataFrame:
    return rows.select(
        "doc_id", "pos", item_pos.cast("int").alias("item_pos"), F.col("clause.clause_id").alias("clause_id"), item_no.cast("string").alias("item_no"), prompt.alias("prompt"),
        F.col("clause.action_keywords").alias("clause_keywords"), F.col("clause.clause_function").alias("clause_function"),
    )


def clause_intent_prompts(chunks: DataFrame, template: str = CLAUSE_PROMPT) -> DataFrame:
    """One prompt per clause, with what checking its reply needs of the clause (so that no join follows)."""
    c = F.col("clause")
    prompt = fill(
        template, clause_no=c["clause_no"], clause_title=c["clause_title"], clause_function=c["clause_function"],
        insurance_types=F.array_join(c["insurance_types"], ", "), action_keywords=F.array_join(c["action_keywords"], ", "), context=c["context"],
    )
    return _asked(chunks, F.lit(-1), F.lit(None), prompt)


def item_intent_prompts(chunks: DataFrame, template: str = ITEM_PROMPT) -> DataFrame:
    """One prompt per item; the keywords carried along are the clause's."""
    rows = chunks.select("doc_id", "pos", "clause", F.posexplode("clause.items").alias("item_pos", "item"))
    c, item = F.col("clause"), F.col("item")
    prompt = fill(
        template, clause_no=c["clause_no"], clause_title=c["clause_title"], clause_function=c["clause_function"],
        item_no=item["item_no"], action_keywords=F.array_join(item["action_keywords"], ", "), item_context=item["context"],
    )
    return _asked(rows, F.col("item_pos"), item["item_no"], prompt)


def parse_intent_response(content: Column) -> Column:
    """The intents of a reply with or without code fences; none if it is null or malformed. Left-out fields take their defaults."""
    bare = F.regexp_replace(T.strip(content), r"^```json\s*\n?", "")
    bare = T.strip(F.regexp_replace(F.regexp_replace(bare, r"^```\s*\n?", ""), r"\n?```$", ""))
    found = F.coalesce(F.from_json(bare, REPLY)["intents"], F.from_json(F.lit('{"intents": []}'), REPLY)["intents"])
    empty = F.array().cast("array<string>")

    def whole(i):
        fields = [F.coalesce(i[k], F.lit(v)).alias(k) for k, v in DEFAULTS.items()]
        return F.struct(*fields, *[F.coalesce(i[k], empty).alias(k) for k in LISTS])

    return F.transform(F.filter(found, lambda i: i.isNotNull()), whole)


def well_formed(content: str) -> bool:
    """Whether a reply, without code fences, is a JSON object: others are asked for again."""
    bare = re.sub(r"\n?```$", "", re.sub(r"^```(json)?\s*\n?", "", (content or "").strip()))
    try:
        return isinstance(json.loads(bare), dict)
    except ValueError:
        return False


def validate_intents(intents: DataFrame) -> DataFrame:
    """Completed tags, quality_score and validation_issues from clause_keywords and clause_function, which go.

    The tags that the last two rules look at are the given ones; 不保 counts among them only if no keyword had to be added.
    """
    empty = F.array().cast("array<string>")
    given = F.coalesce("semantic_tags", empty)
    missing = F.filter(F.coalesce("clause_keywords", empty), lambda k: ~F.array_contains(F.col("_given"), k))
    excluded = (F.coalesce("clause_function", F.lit("")) == EXCLUSION) & ~F.array_contains("_given", EXCLUDED)
    more = F.when(F.col("_excluded"), F.array(F.lit(EXCLUDED))).otherwise(empty)
    rows = intents.withColumn("_given", given).withColumns({"_missing": missing, "_excluded": excluded})
    rows = rows.withColumn("_now", F.when(F.size("_missing") == 0, F.concat("_given", more)).otherwise(F.col("_given")))
    compares = F.coalesce("query_type", F.lit(DEFAULTS["query_type"])) == COMPARISON
    rules = [
        (F.size("_missing") > 0, 0.2, "missing action tags"),
        (F.col("_excluded"), 0.15, "missing exclusion tag"),
        (F.length(F.coalesce("user_query", F.lit(""))) < 6, 0.1, "query too short"),
        (compares & (F.size("_now") < 2), 0.2, "comparison with fewer than two tags"),
    ]
    for tag, others in CONFUSABLE:
        both = F.array_contains("_now", tag) & F.arrays_overlap("_now", F.array(*map(F.lit, others)))
        rules.append((~compares & both, 0.3, f"{tag} may be confused with {' or '.join(others)}"))
    score = F.lit(1.0)
    for hit, cost, _ in rules:
        score = score - F.when(hit, F.lit(cost)).otherwise(F.lit(0.0))
    issues = F.array_compact(F.array(*[F.when(hit, F.lit(say)) for hit, _, say in rules]))
    rows = rows.withColumns({"quality_score": F.round(score, 9), "validation_issues": issues, "semantic_tags": F.concat("_given", "_missing", more)})
    return rows.drop("_given", "_missing", "_excluded", "_now", "clause_keywords", "clause_function")


def comparison_intents(chunks: DataFrame, templates: Sequence[dict] = COMPARISONS) -> DataFrame:
    """Per document and template one intent, at the first clause whose number is in the first related clause, else at the first clause."""
    no, at = F.col("clause.clause_no"), F.struct("pos")
    fields = []
    for n, t in enumerate(templates):
        related = t["related"][0] if t["related"] else ""
        named = F.lit(related).contains(no)
        main = F.coalesce(F.min_by(F.when(named, F.col("clause.clause_id")), F.when(named, F.col("pos"))), F.min_by(F.col("clause.clause_id"), at))
        words = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
        fields.append(
            F.struct(
                F.lit(n).alias("n"), main.alias("clause_id"), F.lit(t["user_query"]).alias("user_query"), F.lit(t["excerpt"]).alias("excerpt"),
                F.lit(t["category"]).alias("category"), F.lit(COMPARISON).alias("query_type"), F.lit(t["difficulty"]).alias("difficulty"),
                words(()).alias("conditions"), words(()).alias("exceptions"), words(t["related"]).alias("referenced_clauses"), words(t["semantic_tags"]).alias("semantic_tags"),
            )
        )
    rows = chunks.groupBy("doc_id").agg(F.array(*fields).alias("all")).select("doc_id", F.explode("all").alias("i")).select("doc_id", "i.*")
    last, null = F.lit(2**31 - 1), F.lit(None).cast("string")
    issues = F.array().cast("array<string>")
    return rows.withColumns({"pos": last, "item_pos": last, "item_no": null, "subitem_no": null, "quality_score": F.lit(1.0), "validation_issues": issues})


def _intent_id(n: Column) -> Column:
    return F.concat(F.lit("intent_"), F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")))


def number_intents(intents: DataFrame) -> DataFrame:
    """``intent_id`` counts from intent_0001 within each document, by pos, item_pos and n; (doc_id, intent_id) is the key."""
    return intents.withColumn("intent_id", _intent_id(F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "item_pos", "n"))))


def number_corpus_intents(intents: DataFrame) -> DataFrame:
    """``intent_id`` counts from intent_0001 over all documents: by doc_id, pos, item_pos and n, comparisons behind all others.

    Numbers come from counts of ranges of the rows and their prefix sums; no window holds all rows, nor those of one document.
    """
    order = [(F.col("pos") == 2**31 - 1).asc(), *(F.col(c).asc() for c in ("doc_id", "pos", "item_pos", "n"))]
    return number_rows(intents, order, "intent_id").withColumn("intent_id", _intent_id(F.col("intent_id")))


def attach_intent_ids(chunks: DataFrame, intents: DataFrame) -> DataFrame:
    """Chunks whose clauses and items list the ids of their own intents, in order; comparisons belong to no clause."""
    own = intents.filter(F.col("pos") < 2**31 - 1)
    each = own.groupBy("doc_id", "pos", "item_pos").agg(F.array_sort(F.collect_list(F.struct("n", "intent_id"))).alias("ids"))
    each = each.select("doc_id", "pos", "item_pos", F.transform("ids", lambda x: x["intent_id"]).alias("ids"))
    found = each.groupBy("doc_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("item_pos", "ids"))).alias("_ids"))
    rows = chunks.join(found, ["doc_id", "pos"], "left")
    empty = F.array().cast("array<string>")
    ids = lambda at: F.coalesce(F.try_element_at("_ids", at), empty)
    items = F.transform("clause.items", lambda x, i: x.withField("intent_ids", ids(i)))
    return rows.withColumn("clause", F.col("clause").withField("items", items).withField("intent_ids", ids(F.lit(-1)))).select(*chunks.columns)


def generate_intents(
    chunks: DataFrame, generate: hooks.Generate, items: bool = True, comparisons: bool = True, templates: Sequence[dict] = COMPARISONS, tasks: int | None = None, over_corpus: bool = False
) -> DataFrame:
    """Prompts, replies, parsing, checking, comparisons and ids in one table of intents.

    With ``over_corpus`` ids are unique among all documents. Write the result before it is used more than once: each use calls ``generate`` again.
    """
    asked = clause_intent_prompts(chunks)
    if items:
        asked = asked.unionByName(item_intent_prompts(chunks))
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    replies = hooks.generate_replies(asked.withColumn("messages", said).drop("prompt"), generate, tasks=tasks, accept=well_formed)
    keys = ["doc_id", "pos", "item_pos", "clause_id", "item_no", "clause_keywords", "clause_function"]
    parsed = replies.select(*keys, F.posexplode(parse_intent_response(F.col("content"))).alias("n", "i")).select(*keys, "n", "i.*")
    found = validate_intents(parsed.withColumn("subitem_no", F.lit(None).cast("string")))
    if comparisons:
        found = found.unionByName(comparison_intents(chunks, templates))
    return number_corpus_intents(found) if over_corpus else number_intents(found)


def intent_corpus_text(query: Column, excerpt: Column, conditions: Column, category: Column) -> Column:
    """What retrieval indexes of an intent; empty conditions and categories are left out."""
    listed = F.when(F.size(conditions) > 0, F.concat(F.lit("條件: "), F.array_join(conditions, "; ")))
    kind = F.when(category != "", F.concat(F.lit("類別: "), category))
    return F.concat_ws(" | ", F.concat(F.lit("問題: "), F.coalesce(query, F.lit(""))), F.concat(F.lit("內容: "), F.coalesce(excerpt, F.lit(""))), listed, kind)
