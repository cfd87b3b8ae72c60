"""Nested JSON by ranges against the json module, over ranges of a few bytes."""

from __future__ import annotations

import json
import random

import pytest

from clausewright.sources import nested

NASTY = ["", "}", '"chunks": [', "{[", "\\", '"', '\\"}', 'x"}{', "第一條}", "\n", "]}", "chunks", "a" * 300]
SCHEMA = "n long, s string, chunks array<struct<s: string>>, m map<string, string>"


def _element(rng: random.Random, n: int) -> dict:
    row = {"n": n, "s": "".join(rng.choice(NASTY) for _ in range(rng.randrange(4))), "other": {"chunks": [{"s": rng.choice(NASTY)}], "deep": [[{}], "]"]}}
    if rng.random() < 0.5:
        row["chunks"] = [{"s": rng.choice(NASTY)} for _ in range(rng.randrange(3))]
    if rng.random() < 0.5:
        row["m"] = {rng.choice(NASTY) or "k": rng.choice(NASTY)}
    return row


def _document(rng: random.Random, first: int) -> dict:
    chunks = [_element(rng, first + i) for i in range(rng.randrange(12))] + ([None, 3, "{}", [{}]] if rng.random() < 0.3 else [])
    parts = [("metadata", {"chunks": [{"n": -1}], "enhancements": ["{", "]"]}), ("chunks", chunks), ("others", [{"n": -2, "chunks": [{}]}]), ("x", "}")]
    rng.shuffle(parts)
    return dict(parts)


def _plain(row) -> tuple:
    get = row.get if isinstance(row, dict) else lambda k: row[k]
    inner, entries = get("chunks"), get("m")
    return get("n"), get("s"), None if inner is None else tuple(c["s"] for c in inner), None if entries is None else tuple(entries.items())


@pytest.fixture
def small_ranges(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("most", [nested.MOST_RANGES, 0])  # 0: ranges meet their text by a shuffle
def test_read_nested_by_ranges(spark, tmp_path, small_ranges, monkeypatch, most):
    monkeypatch.setattr(nested, "MOST_RANGES", most)
    rng, expected = random.Random(most), []
    for f, style in enumerate([{"indent": 2}, {}, {"ensure_ascii": False}, {"separators": (",", ":")}]):
        documents = [_document(rng, 100 * f + 20 * d) for d in range(2)]
        expected += [_plain(e) for doc in documents for e in doc["chunks"] if isinstance(e, dict)]
        end = rng.choice(["", "\n"])
        (tmp_path / f"{f}.json").write_text("\n".join(json.dumps(d, **style) for d in documents) + end, "utf-8")
    (tmp_path / "none.json").write_text('{"metadata": {"chunks": [{"n": 5}]}}')
    (tmp_path / "empty.json").write_text('{"chunks": []}\n')
    found = nested.read_nested(spark, f"file://{tmp_path}", SCHEMA)
    assert sorted(map(_plain, found.collect()), key=repr) == sorted(expected, key=repr) and len(expected) > 30
    files = spark.read.option("lineSep", "}").text(f"file://{tmp_path}")
    assert files.selectExpr("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 20


def test_read_nested_reports_broken_files(spark, tmp_path, small_ranges):
    whole = json.dumps({"chunks": [{"n": 1, "s": "a}b"}, {"n": 2, "s": "c" * 400}]})
    for cut in (20, len(whole) - 10, len(whole) - 300):
        (tmp_path / "x.json").write_text(whole[:cut])
        with pytest.raises(Exception, match="breaks off"):
            nested.read_nested(spark, f"file://{tmp_path}/x.json", SCHEMA).collect()
    (tmp_path / "x.json").write_text('{"chunks": [{"n": "no number"}]}')
    with pytest.raises(Exception):
        nested.read_nested(spark, f"file://{tmp_path}/x.json", SCHEMA).collect()


def test_write_nested_round_trip(spark, tmp_path, small_ranges):
    rng = random.Random(7)
    rows = [(n, rng.choice(NASTY), None, None if n % 3 else {"k}": rng.choice(NASTY)}) for n in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for path, frame, want in (("a", df, rows), ("b", df.limit(0), [])):
        nested.write_nested(frame, f"file://{tmp_path}/{path}", version="1.0")
        for part in (tmp_path / path).glob("part-*"):
            text = part.read_text("utf-8")
            assert not text or json.loads(text)["metadata"] == {"version": "1.0"}
        found = nested.read_nested(spark, f"file://{tmp_path}/{path}", SCHEMA).collect()
        assert sorted((r.n, r.s, r.chunks, r.m) for r in found) == sorted(want, key=lambda r: r[0])
