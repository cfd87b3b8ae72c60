"""Large nested JSON: documents that hold their rows in one array beside metadata, read by ranges and written a document a task.

A JSON document has no line that a reader could start at, so a range of it is first read without knowing where in the document it
begins. Every range is cut at closing braces, which are never part of an escape, and sums itself up for both cases, that it begins outside a string or in
one: how deep it goes, how deep it gets at the least, and which arrays of the wanted name it leaves open. Running sums of these, one row a
range, tell each range how it begins. Then rows that lie in one range leave it whole, and pieces of a row that crosses ranges meet by the range it began in.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clausewright.sources.tables import stored

#: Ranges up to this number (about 100 bytes each) are broadcast; beyond it the text is shuffled to them.
MOST_RANGES = 100_000
_ESCAPE, _BRACKET = re.compile(r"\\.", re.S), re.compile(r"[][{}]")
_CASE = "struct<depth: int, lowest: int, opens: array<int>>"
_RANGE = f"file string, start long, odd boolean, outside {_CASE}, inside {_CASE}"
_PIECE = "file string, start long, origin long, json string"


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, str]]:
    """((file, start, further columns), text) for consecutive rows of one range, with the closing braces put back."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("file", "start", *columns))))
        values, lo = batch.column("value").to_pylist(), 0
        for hi in range(1, len(keys) + 1):
            if hi == len(keys) or keys[hi] != keys[lo]:
                yield keys[lo], "}".join(values[lo:hi]) + "}"
                lo = hi


def _brackets(text: str, inside: bool, name: str) -> Iterator[tuple[int, str, bool]]:
    """(place, bracket, whether it opens the array of this name) outside strings, for a text that begins inside a string or not."""
    parts, at = _ESCAPE.sub("__", text).split('"'), 0
    for i, part in enumerate(parts):
        if (i % 2 == 1) == inside:
            for m in _BRACKET.finditer(part):
                yield at + m.start(), m.group(), m.group() == "[" and i >= 2 and parts[i - 1] == name and part[: m.start()].strip() == ":"
        at += len(part) + 1


class _Case:
    """What is known of a range that begins in one of the two ways; depths count from where it begins."""

    def __init__(self, inside: bool):
        self.inside, self.depth, self.lowest, self.opens = inside, 0, 0, []

    def add(self, text: str, odd: bool, name: str) -> None:
        for _, bracket, named in _brackets(text, self.inside, name):
            if bracket in "[{":
                if named:
                    self.opens.append(self.depth)
                self.depth += 1
            else:
                self.depth -= 1
                self.lowest = min(self.lowest, self.depth)
                while self.opens and self.opens[-1] >= self.depth:
                    self.opens.pop()
        self.inside ^= odd

    def row(self) -> dict:
        return {"depth": self.depth, "lowest": self.lowest, "opens": self.opens}


def _summarise(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, cases = None, False, ()
        case = pa.struct([("depth", pa.int32()), ("lowest", pa.int32()), ("opens", pa.list_(pa.int32()))])
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("odd", pa.bool_()), ("outside", case), ("inside", case)])
        row = lambda: pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "odd": odd, "outside": cases[0].row(), "inside": cases[1].row()}], schema)
        for at, text in _runs(batches):
            if at != key:
                if key:
                    yield row()
                key, odd, cases = at, False, (_Case(False), _Case(True))
            flips = _ESCAPE.sub("", text).count('"') % 2 == 1
            for c in cases:
                c.add(text, flips, name)
            odd ^= flips
        if key:
            yield row()

    return run


def _cut(name: str):
    """Rows of the array: whole ones without origin, pieces with the range in which the row begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("origin", pa.int64()), ("json", pa.string())])
        key, inside, depth, section, origin, held = None, False, 0, False, None, []
        for at, text in _runs(batches, "inside", "depth", "section", "origin"):
            out = []
            if at != key:
                if held:
                    out.append({"file": key[0], "start": key[1], "origin": key[1] if origin is None else origin, "json": "".join(held)})
                key, (inside, depth, section, origin), held = at, at[2:], []
                if not (section and depth >= 3):
                    origin = None
            begin = 0 if section and depth >= 3 else None
            last = -1
            for place, bracket, named in _brackets(text, inside, name):
                last = place
                if bracket in "[{":
                    if depth == 1:
                        section = named
                    elif depth == 2 and section and bracket == "{":
                        begin = place
                    depth += 1
                else:
                    depth -= 1
                    if depth == 2 and begin is not None:
                        out.append({"file": key[0], "start": key[1], "origin": origin, "json": "".join(held) + text[begin : place + 1]})
                        begin, held, origin = None, [], None
            if begin is not None:
                held.append(text[begin:])
            inside = last != len(text) - 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "origin": key[1] if origin is None else origin, "json": "".join(held)}], schema)

    return run


def _beginnings(ranges: DataFrame) -> DataFrame:
    """(file, start, inside, depth, section, origin): how each range begins, and the range in which the row that it begins in began."""
    order = W.partitionBy("file").orderBy("start")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), F.lead("start").over(order)
    rows = ranges.withColumn("inside_", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    rows = rows.withColumn("case", F.when(F.col("inside_"), F.col("inside")).otherwise(F.col("outside"))).withColumn("last", after.isNull())
    rows = rows.withColumn("depth", F.coalesce(F.sum("case.depth").over(before), F.lit(0)).cast("int"))
    lowest: Column = F.col("depth") + F.col("case.lowest")
    turns = F.when(F.array_contains("case.opens", F.lit(1) - F.col("depth")), True).when(lowest <= 1, False)
    rows = rows.withColumn("turns", turns).withColumn("section", F.coalesce(F.last("turns", ignorenulls=True).over(before), F.lit(False)))
    within = F.col("section") & (lowest >= 3)
    rows = rows.withColumn("begins", F.when(~within, F.col("start"))).withColumn("origin", F.last("begins", ignorenulls=True).over(before))
    broken = F.col("last") & ((F.col("inside_") != F.col("odd")) | (F.col("depth") + F.col("case.depth") > 0))
    section = F.when(broken, F.raise_error(F.concat(F.lit("JSON breaks off: "), F.col("file"))).cast("boolean")).otherwise(F.col("section"))
    return rows.select("file", "start", F.col("inside_").alias("inside"), "depth", section.alias("section"), "origin")


def read_nested(spark: SparkSession, path: str, schema: StructType | str, name: str = "chunks") -> DataFrame:
    """Rows of the objects in the array ``name`` of JSON documents, each file read by as many tasks as it has input splits.

    The array belongs to the document itself; arrays of that name deeper down are part of their row. Null fields and fields that a row lacks are null, further
    fields are left out; elements that are no objects are no rows; a document without the array has none. A file may hold several documents, one after the other. A row that
    does not fit the schema, and a file that breaks off before its array ends, are errors. Compressed files can't be split; each is one range.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    text = spark.read.option("lineSep", "}").text(path).select(*place, "value")
    beginnings = stored(_beginnings(stored(text.mapInArrow(_summarise(name), _RANGE), "ranges")), "beginnings")
    if beginnings.count() <= MOST_RANGES:
        begun = text.join(F.broadcast(beginnings), ["file", "start"])
    else:
        numbered = text.withColumn("m", F.monotonically_increasing_id())
        begun = numbered.join(beginnings, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "m").drop("m")
    pieces = stored(begun.mapInArrow(_cut(name), _PIECE), "pieces")
    crossing = pieces.filter("origin is not null").groupBy("file", "origin").agg(F.array_sort(F.collect_list(F.struct("start", "json"))).alias("p"))
    rows = pieces.filter("origin is null").select("json").unionByName(crossing.select(F.array_join("p.json", "").alias("json")))
    return rows.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_nested(rows: DataFrame, path: str, name: str = "chunks", **metadata: str) -> None:
    """One JSON document a task, each with the metadata and its rows in the array ``name``; null fields are left out. A table without rows may leave empty files."""
    head = json.dumps({"metadata": metadata}, ensure_ascii=False)[:-1] + f", {json.dumps(name, ensure_ascii=False)}: ["

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        yield pa.RecordBatch.from_pydict({"value": [head]})
        for batch in batches:
            lines = batch.column("value").to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [("," if begun or i else "") + line for i, line in enumerate(lines)]})
            begun = begun or bool(lines)
        yield pa.RecordBatch.from_pydict({"value": ["]}"]})

    rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(frame, "value string").write.mode("overwrite").text(path)
