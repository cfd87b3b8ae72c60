"""Personal data by patterns, checks and context (operator 12).

Regular expressions propose spans, validators (Luhn, mod 97, ranges and numbers of digits) confirm or drop them, and words nearby raise the score of what is
left. Spans at ``least`` or more are kept. Recognisers marked ``base`` keep every confirmed span, whatever its score. Every pattern takes
time in proportion to the text: runs are matched possessively and from their beginning only.

Cases: a null or empty text has no spans; every occurrence counts, also in repeated rows; places count code points; spans of one kind never overlap, and a span that is not
base gives way to any base span that it overlaps, unless its check is mod 97; texts are read whole, one at a time; a null doc_id keeps its row; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points before and behind a span in which its words of context count, and what one of them adds to the score.
BEFORE, BEHIND, CONTEXT = 48, 24, 0.35


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(text: str) -> bool:
    """Whether the digits of text, every second one from the right doubled, add up to a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(_digits(text))):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Whether an account number's check digits are right: its first four characters go to the end, letters count 10 to 35."""
    plain = text.replace(" ", "")
    rest = 0
    for c in plain[4:] + plain[:4]:
        value = int(c, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return 15 <= len(plain) <= 34 and rest == 1


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _between(lo: int, hi: int, then: Callable[[str], bool] | None = None) -> Callable[[str], bool]:
    return lambda text: len(text) >= lo and lo <= len(_digits(text)) <= hi and (then is None or then(text))


def _issued(text: str) -> bool:
    """Social security numbers have no part of zeros, and none begins with 666 or 9."""
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Recogniser:
    """A kind of span: a pattern (its group 1 must match if it has one), a check by name, the score of a confirmed span, and words that raise it."""

    kind: str
    pattern: str
    check: str = ""
    score: float = 0.5
    context: tuple[str, ...] = ()
    base: bool = False
    needs: str = ""  # a text without this character has no span


CHECKS: dict[str, Callable[[str], bool]] = {
    "": lambda text: True, "octets": _octets, "card": _between(16, 19, luhn), "short_card": _between(13, 15, luhn), "phone": _between(8, 15), "mod97": mod97, "issued": _issued,
}
_CALL = ("phone", "tel", "telephone", "telefon", "call", "mobile", "fax", "handy", "téléphone", "appelez", "teléfono", "llame", "móvil")
_PAY = ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta")
_BANK = ("iban", "account", "bank", "konto", "compte", "cuenta")
_NUMBER = r"[0-9]++(?:[ -][0-9]++)*+"

BASE = (
    # A run of address characters that no @ follows is passed over as a whole.
    Recogniser("email", r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?", score=0.9, context=("mail", "email", "e-mail", "contact", "kontakt", "correo"), base=True, needs="@"),
    Recogniser("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "octets", 0.6, ("ip", "host", "server", "address", "adresse"), True, "."),
    Recogniser("card", _NUMBER, "card", 0.7, _PAY, True),
    Recogniser("phone", r"\+[0-9][ ().0-9-]+[0-9]", "phone", 0.6, _CALL, True, "+"),
)
MORE = (
    # A card number that stands next to other numbers, as one group or as four groups of four: together they are no card.
    Recogniser("card", r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])", "card", 0.6, _PAY),
    Recogniser("card", _NUMBER, "short_card", 0.3, _PAY),
    Recogniser("phone", r"(?<![0-9+])\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{3,8}(?:[ ./-][0-9]{2,6}){0,3}(?![0-9])", "phone", 0.3, _CALL),
    Recogniser("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "mod97", 0.7, _BANK),
    Recogniser("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "issued", 0.4, ("ssn", "social", "security"), needs="-"),
)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Finder:
    """The spans of one text at a time."""

    def __init__(self, recognisers: tuple[Recogniser, ...], least: float):
        self.least = least
        self.kinds = {k: i for i, k in enumerate(dict.fromkeys(r.kind for r in recognisers))}
        self.recognisers = [(r, re.compile(r.pattern), CHECKS[r.check], frozenset(r.context)) for r in recognisers]

    def of(self, text: str) -> list[tuple[str, int, int, float, bool]]:
        """(kind, start, end, score, base), by kind in the order of the recognisers, then by start."""
        found: list[tuple[str, int, int, float, bool]] = []
        taken: list[tuple[int, int]] = []
        settled: dict[str, list[tuple[int, int]]] = {}
        for r, pattern, check, words in sorted(self.recognisers, key=lambda x: not x[0].base):
            if r.needs not in text:
                continue
            own = settled.setdefault(r.kind, [])
            before = sorted(own) if r.check == "mod97" else sorted({*own, *(() if r.base else taken)})
            for m in pattern.finditer(text):
                if pattern.groups and m[1] is None or not check(m[0]):
                    continue
                start, end = m.span()
                at = bisect_right(before, (start, end))
                if not r.base and any(a < end and b > start for a, b in before[max(0, at - 1) : at + 1]):
                    continue
                score = r.score
                if words:
                    near = _WORD.findall(f"{text[max(0, start - BEFORE) : start]} {text[end : end + BEHIND]}".lower())
                    score = min(1.0, score + CONTEXT) if not words.isdisjoint(near) else score
                if r.base or score >= self.least:
                    found.append((r.kind, start, end, score, r.base))
                    own.append((start, end))
            if r.base:
                taken += own
        return sorted(found, key=lambda s: (self.kinds[s[0]], *s[1:3]))


_SPAN = "struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>"


def find_spans(docs: DataFrame, recognisers: tuple[Recogniser, ...] = BASE + MORE, least: float = 0.6) -> DataFrame:
    """doc_id, text and spans of each document; ``spans`` is an array of kind, start, end, score and base, and goes by kind, then start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
    names = [f.name for f in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(recognisers, least)
        for batch in batches:
            rows = [[dict(zip(names, s, strict=True)) for s in finder.of(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=["doc_id", "text", "spans"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string, spans array<{_SPAN}>")


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame, kinds: tuple[str, ...] = ("email", "ip", "card", "phone")) -> DataFrame:
    """doc_id, the number of base spans of each kind, the SHA-256 of their list, and the list of all spans as kind:start:end."""
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, recognisers: tuple[Recogniser, ...] = BASE + MORE, least: float = 0.6) -> DataFrame:
    """docs with their columns, each span of ``text`` replaced by its kind in brackets; of overlapping spans the first one, and at equal starts the longest, is replaced."""
    others = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others, "text").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(recognisers, least)
        for batch in batches:
            texts = []
            for value in batch.column(len(others)):
                text, parts, done = value.as_py(), [], 0
                for kind, start, end, _, _ in sorted(finder.of(text or ""), key=lambda s: (s[1], -s[2])):
                    if start >= done:
                        parts += [text[done:start], f"[{kind.upper()}]"]
                        done = end
                texts.append(None if text is None else "".join(parts) + text[done:])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string())], names=[*others, "text"])

    return docs.select(*others, "text").mapInArrow(run, fields).select(*docs.columns)
