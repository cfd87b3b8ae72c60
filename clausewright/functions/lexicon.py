"""Keyword lexicons: ordered (label, keywords) tables and the column functions that apply them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Lexicon = Sequence[tuple[str, Sequence[str]]]

# The default lexicons of travel-insurance clauses.
INSURANCE_TYPES: Lexicon = (
    ("班機延誤", ("班機", "航班", "定期航班", "延誤", "預定出發時間")),
    ("行李延誤", ("行李", "延誤", "抵達目的地", "未領得")),
    ("行李損失", ("行李", "損失", "毀損", "滅失", "遺失", "竊盜", "強盜", "搶奪")),
    ("旅程取消", ("旅程", "取消", "預定", "無法取回")),
    ("旅程更改", ("旅程", "更改", "增加之交通", "住宿費用")),
    ("租車事故", ("租用汽車", "租車", "駕駛", "交通事故")),
    ("現金竊盜", ("現金", "竊盜", "強盜", "搶奪", "隨身攜帶")),
    ("信用卡盜用", ("信用卡", "盜用", "掛失", "止付")),
    ("急難救助", ("急難", "救助", "轉送", "搜索", "救援")),
)
CLAUSE_FUNCTIONS: Lexicon = (
    ("承保範圍", ("承保範圍", "保險範圍", "本公司依本保險契約")),
    ("不保事項", ("不保事項", "不負理賠責任", "除外責任", "特別不保")),
    ("理賠文件", ("理賠文件", "申請理賠", "應檢具下列文件")),
    ("理賠金額", ("保險金額", "給付", "理賠金額", "最高以")),
    ("定義說明", ("所稱", "係指", "定義")),
)
ACTIONS: Lexicon = (
    ("延誤", ("延誤", "延遲", "未於", "超過時間")),
    ("遺失", ("遺失", "失蹤", "未尋獲")),
    ("損失", ("損失", "毀損", "滅失")),
    ("取消", ("取消", "終止", "中止")),
    ("更改", ("更改", "變更", "調整")),
    ("竊盜", ("竊盜", "偷竊")),
    ("搶奪", ("搶奪", "搶劫", "強盜")),
)
QUERY_TAGS: Lexicon = (
    ("遺失", ("遺失", "丟", "弄丟", "不見", "失竊")),
    ("延誤", ("延誤", "晚點", "delay", "誤點")),
    ("損失", ("損失", "損壞", "毀損")),
    ("取消", ("取消", "中止")),
    ("更改", ("更改", "變更", "改變")),
    ("竊盜", ("偷", "竊", "搶")),
    ("不保", ("不", "哪些", "除外")),
)
CHUNK_TYPES: Lexicon = (
    ("exception", ("不負賠償責任", "不包括", "不保")),
    ("procedure", ("應備文件", "申請", "理賠", "索取")),
    ("definition", ("係指", "定義", "指")),
)
SCOPES: Lexicon = (
    ("flight", ("航班", "班機", "延誤", "取消")),
    ("baggage", ("行李", "遺失", "毀損", "箱", "提箱")),
    ("typhoon", ("颱風", "天災", "暴風")),
    ("claim", ("理賠", "申請", "文件", "索取")),
)
# How many intents and clauses by the wording of a question.
TOP_K = ((("哪些", "所有", "全部", "什麼"), 10, 5), (("多久", "幾小時", "幾天"), 3, 2))
DEFAULT_K = (5, 3)


def has_any(text: Column, keywords: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(text, F.lit("")).contains(k) for k in keywords], F.lit(False))


def label_all(text: Column, lexicon: Lexicon, default: Sequence[str] = ()) -> Column:
    """All labels with a keyword in the text, in lexicon order; ``default`` if there is none."""
    found = F.array_compact(F.array(*[F.when(has_any(text, keys), F.lit(label)) for label, keys in lexicon]))
    if not default:
        return found
    return F.when(F.size(found) == 0, F.array(*map(F.lit, default))).otherwise(found)


def label_first(text: Column, lexicon: Lexicon, default: str) -> Column:
    """The first label with a keyword in the text."""
    return F.coalesce(*[F.when(has_any(text, keys), F.lit(label)) for label, keys in lexicon], F.lit(default))


def insurance_types(title: Column, body: Column) -> Column:
    return label_all(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))), INSURANCE_TYPES, ["其他"])


def clause_function(title: Column, body: Column) -> Column:
    return label_first(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))), CLAUSE_FUNCTIONS, "一般規定")


def smart_top_k(query: Column, k_intents: Column | None = None, k_clauses: Column | None = None, rules=TOP_K, auto: bool = True):
    """Numbers of intents and clauses by the wording of a query; given numbers win, 0 counts as not given."""
    chosen = []
    for at, given in enumerate((k_intents, k_clauses)):
        cases = [F.when(has_any(query, rule[0]), F.lit(rule[1 + at])) for rule in rules] if auto else []
        fallback = F.coalesce(*cases, F.lit(DEFAULT_K[at]))
        chosen.append(fallback if given is None else F.coalesce(F.nullif(given, F.lit(0)), fallback))
    return tuple(chosen)
