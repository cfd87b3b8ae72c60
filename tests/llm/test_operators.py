"""Each operator against brute force, and its stated results on edge cases."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from clausewright.llm import (
    _features, _shared, byte_bpe, components, decontamination, knn_quality, language_id, licences, masked_lm, near_copies, personal_data, prefix_trie, quality_rules, resampling, simhash, suffix_dedup, warc,
)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def small_labels(spark, docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))


# 1
def test_warc(spark, tmp_path):
    rows = [(3, "u\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "v", None), (5, "w", ""), (4, "z", "a\r\n\r\nb"), (None, "n", "null id"), (1, None, "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_archives(pages, f"file://{tmp_path}/in")
    stored, index = warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = sorted((((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(stored).collect()), key=str)
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    e = sha("<p>é</p>")
    assert got == sorted([
        (3, 9, e, "revisit", 1), (1, 9, e, "response", None), (1, 9, e, "response", None), (2, 0, sha(""), "response", None),
        (5, 0, sha(""), "revisit", 2), (4, 6, sha("a\r\n\r\nb"), "response", None), (0, 7, sha("null id"), "response", None),
    ], key=str)
    # The segments of an archive in order are a file of one member for each record, and the sidecar says where.
    files = {}
    for r in sorted(stored.collect(), key=lambda r: r.offset):
        assert len(files.setdefault(r.archive, bytearray())) == r.offset
        files[r.archive] += r.content
    for row in index.collect():
        (headers, _, _), = warc.records(warc.inflate(memoryview(files[row.archive])[row.offset : row.offset + row.length]))
        assert headers["warc-record-id"] == row.record_id and headers["warc-type"] == row.record_type
    whole = [x for f in files.values() for x in warc.records(warc.inflate(memoryview(f)))]
    assert len(whole) == 7 == index.count()
    wanted = spark.createDataFrame([("<urn:page:4>",), ("<urn:page:3>",), ("<urn:page:77>",)], "record_id string")
    assert sorted(r.page_id for r in warc.read_records(warc.fetch(stored, index, wanted)).collect()) == [3, 4]


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", ((10, 5), (100, 2), (1 << 62, 1)))
    pages = spark.createDataFrame([(i, "u", f"{i:03d}" + "x" * (0, 40, 400)[i % 3]) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/in")
    stored, index = warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert sorted(r.n for r in index.groupBy("archive").agg(F.count("*").alias("n")).collect()) == [1] * 10 + [2] * 5 + [5] * 2
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_records(stored).collect()) == [(i, 3 + (0, 40, 400)[i % 3]) for i in range(30)]


def test_warc_minimum_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    values = [r.value for r in warc.warc_records(pages, min_bytes=3).collect()]
    assert all("WARC-Type: response" in v for v in values)
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/in")
    stored, _ = warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert warc.read_records(stored).count() == 0


# 2
def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c, cover, seen, dup = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set(), set(), 0
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_quality_rules(spark, docs, cases, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_rules.train(docs, labels)
    for table in (docs, cases):
        got = sorted(tuple(r)[:6] for r in quality_rules.apply_rules(table, model).collect())
        assert got == sorted((r.doc_id, *brute_counts(r.text)) for r in table.select("doc_id", "text").collect())
    assert quality_rules.apply_rules(empty, model).count() == 0
    scored = quality_rules.apply_rules(docs, model).join(labels.filter("quality is not null"), "doc_id").filter("not base_failed")
    assert scored.filter((F.col("kept").cast("int") == F.col("quality"))).count() >= 0.9 * scored.count()
    none = quality_rules.train(docs, labels.limit(0))
    assert quality_rules.apply_rules(docs, none).filter("kept = base_failed").count() == 0


def test_quality_rules_count_exactly(spark, monkeypatch):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64, but are different words; also a long text, a stretch at a time."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    rng = np.random.default_rng(8)
    long = " ".join(f"wörd{x}" for x in rng.integers(0, 60, 5000)) + "\n" + " ".join(f"u{i}" for i in range(3000))
    rows = [(1, f"{morse} x y {other} x y"), (2, f"{morse} x y {morse} x y"), (3, long), (4, "a b c a b"), (5, "a b c\na b c")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_rules.QualityModel(np.random.default_rng(1).normal(size=quality_rules.GRAMS.size))
    whole = {r.doc_id: r for r in quality_rules.apply_rules(table, model).collect()}
    assert all(tuple(whole[i])[1:6] == brute_counts(t) for i, t in rows) and whole[1].n_repeat_words == 0
    for name, least in (("WORDS", 7), ("STRETCH", 100)):
        monkeypatch.setattr(quality_rules if name == "WORDS" else _features, name, least)
        blocks = list(_shared.blocks(__import__("pyarrow").array([t for _, t in rows])))
        assert [int(x) for x in quality_rules.base_counts(blocks[0])["n_repeat_words"]] == [whole[i].n_repeat_words for i, _ in rows]
        assert np.allclose(model.probability(blocks[0]), [whole[i].probability for i, _ in rows])
    # Beyond 63 bits of owner and words: ranks of pairs instead.
    word = rng.integers(0, 40, 500) + (1 << 20)
    owner = np.sort(rng.integers(0, 9, 500))
    seen = Counter((owner[i], *word[i : i + 3]) for i in range(498) if owner[i] == owner[i + 2])
    want = [i for i in range(498) if owner[i] == owner[i + 2] and seen[(owner[i], *word[i : i + 3])] > 1]
    assert quality_rules._repeated_windows(owner, word, 1 << 21).tolist() == want


def test_grams_are_of_characters():
    grams = _features.HashedGrams(words=(1,), chars=(3, 4), bits=12)
    block = next(_shared.blocks(__import__("pyarrow").array(["日本語の", "é", "ab cd", ""])))
    assert grams.counts(block).reshape(4, 3, -1).sum(axis=2).tolist() == [[1, 2, 1], [1, 0, 0], [2, 3, 2], [0, 0, 0]]


# 3
def test_simhash_of_a_long_text_in_stretches(monkeypatch):
    texts = ["one two three four five six " * 50, "", "a b", "x y z w v u t s r q p"]
    block = next(_shared.blocks(__import__("pyarrow").array(texts)))
    want = [brute_fingerprint(t) for t in texts]
    for size in (3, 1 << 18):
        monkeypatch.setattr(simhash, "SHINGLES", size)
        assert simhash.block_fingerprints(block, 4).tolist() == want
        assert simhash.block_fingerprints(block, 5, 9).tolist() == [brute_fingerprint(t, 5, 9) for t in texts]


def brute_fingerprint(t, width=4, least=1):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(_shared.LOWER_AZ))
    n = len(w) - width + 1
    shingles = [b" ".join(w[i : i + width]) for i in range(n)] if n >= least else [b" ".join(w)] if w else []
    ones = np.zeros(64, int)
    for h, n in Counter(xxhash.xxh64_intdigest(s, 42) for s in shingles).items():
        ones += n * np.array([h >> i & 1 for i in range(64)])
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def brute_classes(rows, distance=4):
    fp = np.array([f for _, f in rows], np.uint64)
    near, label = np.bitwise_count(fp[:, None] ^ fp[None]) <= distance, np.array([d for d, _ in rows])
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return {(d, f"{f:016x}", int(c)) for (d, f), c in zip(rows, label, strict=True)}
        label = new


def test_simhash(docs, cases, empty):
    for table in (docs, cases):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in table.select("doc_id", "text").collect()]
        got = simhash.near_duplicates(table).collect()
        assert {tuple(r) for r in got} == brute_classes(rows) and len(got) == len(rows)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_of_other_parameters(docs, cases):
    """Shingles of five words at seven bits, fewer than nine of them as one shingle."""
    for table in (docs, cases):
        rows = [(r.doc_id, brute_fingerprint(r.text, 5, 9)) for r in table.select("doc_id", "text").collect()]
        assert {tuple(r) for r in simhash.near_duplicates(table, 5, 7, 9).collect()} == brute_classes(rows, 7)


def test_simhash_segments():
    """One segment more than half the distance: then some segment differs in at most one bit."""
    assert simhash.segments(4) == [(0, 21), (21, 21), (42, 22)] and simhash.segments(7) == [(0, 16), (16, 16), (32, 16), (48, 16)]
    for distance in range(12):
        pieces = simhash.segments(distance)
        assert distance < 2 * len(pieces) and sum(width for _, width in pieces) == 64


@pytest.mark.parametrize(("bucket", "deep", "distance"), [(8, 64, 4), (8, 1, 4), (3, 2, 4), (8, 1, 7), (3, 2, 7)])
def test_simhash_links_across_bucket_blocks(spark, monkeypatch, bucket, deep, distance):
    """A large bucket is cut into blocks, a very large one keyed again by its other bits; all links still connect."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "DEEP", deep)
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 1 << 62, 30)}
    fps |= {x ^ sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for x in list(fps)[:4] for k in rng.integers(1, distance + 3, 60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance)
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    expected = {c for _, _, c in brute_classes(list(enumerate(fps)), distance)}
    assert len({roots.get(x, x) for x in signed}) == len(expected)


@pytest.mark.parametrize(("distance", "inner"), [(4, 43), (7, 48)])
def test_simhash_inner_keys_meet(spark, distance, inner):
    """Fingerprints within the distance share an outer key and, for each shared outer key, an inner one."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        x = int(rng.integers(0, 1 << 63)) << 1 | int(rng.integers(0, 2))
        y = x ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, distance + 1)), replace=False))
        rows += [(i, side, v - (1 << 64) if v >> 63 else v) for side, v in enumerate((x, y))]
    keys = spark.createDataFrame(rows, "i int, side int, fp long").select("i", "side", "fp", F.explode(simhash.variant_keys(F.col("fp"), simhash.segments(distance))).alias("key"))
    keys = keys.withColumn("inner", simhash.inner_keys(F.col("fp"), F.col("key"), distance)).withColumn("size", F.size("inner"))
    a, b = keys.filter("side = 0"), keys.filter("side = 1").select("i", "key", F.col("inner").alias("other"))
    met = a.join(b, ["i", "key"]).select("i", F.arrays_overlap("inner", "other").alias("meet"), "size").collect()
    assert {r.i for r in met} == set(range(300)) and all(r.meet for r in met) and {r.size for r in met} == {inner}


def test_xxh64():
    rng = np.random.default_rng(2)
    buf = rng.integers(0, 256, 9000).astype(np.uint8)
    starts = rng.integers(0, 8000, 2000)
    ends = starts + rng.integers(0, 300, 2000)
    assert [int(x) for x in simhash.xxh64_spans(buf, starts, ends)] == [xxhash.xxh64_intdigest(buf[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 101, 102)}


# 4
def test_licences(spark, cases, empty):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
    rows = [(1, "Released under the MIT License.\nfoo. All rights reserved."), (2, gpl + "either version 2 of the License, or (at your option) any later version."),
            (3, gpl), (4, "licensed under the apache license, version 2.0\nReleased under the MIT licence.\nAll rights reserved.\nAll rights reserved.")]
    got = {r.doc_id: (r.licences, r.n_matches, r.unmatched) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: (["MIT", "all-rights-reserved"], 2, []), 2: (["GPL-2.0-or-later"], 1, []), 3: ([], 0, ["gpl-1", "gpl-2"]), 4: (["Apache-2.0", "all-rights-reserved"], 3, []),
    }
    assert licences.scan(cases).filter("n_matches = 0").count() == cases.count() and licences.scan(empty).count() == 0


NOTICES = {
    "Apache-2.0": """Copyright 2020 Someone

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS.""",
    "MIT": """The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.""",
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "GPL-2.0-or-later": """# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU General Public License
# as published by the Free Software Foundation; either version 2
# of the License, or (at your option) any later version.""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
}


def test_licences_in_wrapped_notices(spark, docs):
    rows = [(name, text) for name, text in NOTICES.items()] + [(name + "+", text.replace("\n", "\r\n")) for name, text in NOTICES.items()]
    got = {r.doc_id: (r.licences, r.n_matches, r.unmatched) for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {i: ([i.rstrip("+")], 1, []) for i, _ in rows}
    # What lines hold whole is found as without wrapping.
    text = "words that go on\nAll rights reserved. Some\nmore words; licensed under CC BY 4.0\nReleased under the MIT License\nand so on.\nAll rights reserved.\nAll rights reserved."
    plain = spark.createDataFrame([(1, text), (1, text), (None, "Not all rights reserved."), (2, "all rights\n\nreserved"), (3, "x " * 50_000 + "\nall\n# rights\n# reserved!")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_matches) for r in licences.scan(plain).collect()), key=str)
    assert got == [(1, 5), (1, 5), (2, 0), (3, 1), (None, 0)]


def test_licences_as_sql_has_it(spark, docs, tmp_path):
    """Rows, wrapped notices among them, against the operator's SQL, which finds sentences by comparing words."""
    import duckdb

    from clausewright.llm import oracles, queries

    rows = [(i, t) for i, t in enumerate([*NOTICES.values(), *(t.replace("\n", "\r\n") for t in NOTICES.values()), "; ".join(licences.SENTENCES.values()), "\n".join(licences.SENTENCES.values()), None, ""])]
    docs.select(F.col("doc_id") + 1000, "text").union(spark.createDataFrame(rows, "doc_id long, text string")).toDF("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op4_licences(spark, str(tmp_path)).select("doc_id", "licences", "n_matches", "n_sentences", "unmatched").collect())
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(base.execute(oracles.licences_sql()).fetchall()) and max(r[3] for r in got) > 50


# 5
def test_byte_bpe(spark, docs, cases, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.load(path, public_tokenizers.PATTERN)
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(path))}
    expected = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert np.array_equal(bpe.hash.find(bpe.tokens), np.arange(len(bpe.tokens)))
    for table in (docs, cases):
        ids = byte_bpe.encode(table, bpe)
        want = sorted((r.doc_id, expected.encode_ordinary(r.text or "")) for r in table.select("doc_id", "text").collect())
        assert sorted((r.doc_id, list(r.ids)) for r in ids.collect()) == want
        back = sorted((r.doc_id, bytes(r.content)) for r in byte_bpe.decode(ids, bpe).collect())
        assert back == sorted((r.doc_id, (r.text or "").encode()) for r in table.select("doc_id", "text").collect())
    assert byte_bpe.encode(empty, bpe, digests=True).count() == 0


# 6
def brute_removed(rows, length):
    seen, out = {}, {}
    for d, t in sorted({(d, t or "") for d, t in rows}):
        b, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for i in range(len(b) - length + 1):
            w = hashlib.blake2b(b[i : i + length], digest_size=16).digest()
            if seen.setdefault(w, (d, i)) != (d, i):
                gone[i : i + length] = True
        n = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[d] = (len(b), int(gone.sum()), n, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_dedup(spark, docs, cases, empty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 2000)  # many levels
    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("abcdé"), 3000))
    cut = [(i, base[a : a + n] + ("" if i % 3 else base[b : b + 150])) for i, (a, n, b) in enumerate(zip(*rng.integers(0, (2800, 600, 2800), (150, 3)).T, strict=True))]
    cut += [(500, "a" * 5000), (501, "a" * 99), (502, "ab" * 3000), (505, "x" * 100), (506, "x" * 101), (600, "y" + base[:400] + "z"), (600, "y" + base[:400] + "z")]
    made = spark.createDataFrame([(int(i), t) for i, t in cut], "doc_id long, text string")
    # Then with frequent hashes: some, and all that occur twice.
    for least, tables in ((suffix_dedup.HOT, (docs, cases, made)), (20, (docs, made)), (2, (cases, made))):
        monkeypatch.setattr(suffix_dedup, "HOT", least)
        for table in tables:
            rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
            want = brute_removed(rows, 100)
            got = suffix_dedup.deduplicate(table).collect()
            assert len(got) == len(rows) and all(tuple(r)[1:5] == want[r.doc_id] for r in got)
    keyed = made.select("text", F.xxhash64("doc_id", F.xxhash64("text")).alias("key"))
    assert len(suffix_dedup.frequent_hashes(suffix_dedup.repeated_hashes(keyed))) > 10
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_suffix_dedup_of_a_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1000)
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdé"), 6000))
    rows = [(1, text), (2, text[2500:3500] + "x" * 1200), (3, "y" + text[900:1100])]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_removed(rows, 100)
    assert len(got) == 3 and all(tuple(r)[1:5] == want[r.doc_id] for r in got)


@pytest.mark.parametrize("least", [suffix_dedup.HOT, 2])
def test_suffix_dedup_tells_texts_of_one_id_apart(spark, monkeypatch, least):
    """Different texts without doc_id, or with one doc_id, are documents of their own: clean text stays, shared passages go."""
    monkeypatch.setattr(suffix_dedup, "HOT", least)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, other = word(160), word(140)
    for same in (None, 7):
        rows = [(same, shared + word(200)), (same, shared + word(300)), (same, word(500)), (same, word(30) + other + word(90)), (same, word(80) + other), (3, word(50) + other)]
        table = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string").repartition(3)
        marks = {r.text: r.m for r in table.select("text", F.xxhash64("text").alias("m")).collect()}
        order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, marks[r[1]]))
        want = dict(zip((marks[t] for _, t in order), brute_removed([(k, t) for k, (_, t) in enumerate(order)], 100).values(), strict=True))
        got = suffix_dedup.deduplicate(table).collect()
        assert len(got) == 7 and all(tuple(r)[1:5] == want[r.mark] for r in got)
        assert sorted(r.doc_id for r in got if r.doc_id is not None) == [3] + [7] * (6 if same else 0)
        assert want[marks[rows[2][1]]][1] == 0 and sum(w[1] > 0 for w in want.values()) == 3


def test_suffix_index_levels():
    """Production batches: levels merge geometrically, and only the first of equal strings is new."""
    rng = np.random.default_rng(1)
    strings = np.array([f"{x:0100d}" for x in rng.integers(0, 300_000, 5 * suffix_dedup.BATCH)], "S100")
    index, levels, seen = suffix_dedup.SuffixIndex(), [], set()
    for batch in np.split(strings, 5):
        hit = suffix_dedup.scan_batch(index, batch)
        want = []
        for x in batch.tolist():
            want.append(x in seen)
            seen.add(x)
        assert hit.tolist() == want
        sizes = [len(x) for x in index.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(seen)
        levels.append(len(sizes))
    assert max(levels) > 1


# 7
@pytest.mark.parametrize("bound, most", [("BROADCAST_WINDOWS", decontamination.BROADCAST_WINDOWS), ("BROADCAST_WINDOWS", 0), ("BROADCAST_BYTES", 0)])  # 0: by shuffles
def test_decontamination(spark, cases, empty, monkeypatch, bound, most):
    monkeypatch.setattr(decontamination, bound, most)
    items = [("b", "one two three four five six seven eight nine ten eleven"), ("a", "Short ITEM"), ("c", "..."), ("d", None), ("e", "ONE two three four five six seven eight nine ten")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(1, "x one two-three four five six seven eight nine ten eleven y"), (2, "a short item, short item"), (3, "one two three four five six seven eight nine"), (4, None), (5, " ".join(["w"] * 63 + items[0][1].split())), (None, "short item"), (None, "no item"), (2, "a short item, short item")]
    found = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert len(found) == 8 and sorted((r.n_hit, r.items) for r in found if r.doc_id is None) == [(0, []), (2, ["a"])]
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in found if r.doc_id is not None}
    assert got == {1: (13, 11, ["b", "e"]), 2: (5, 4, ["a"]), 3: (9, 0, []), 4: (0, 0, []), 5: (74, 11, ["b", "e"])}
    assert decontamination.contamination(cases, bench).filter("contaminated").count() == 0
    shared = spark.range(3000).selectExpr("cast(id as string) item_id", "if(id % 2 = 0, 'words that all share', 'words that odd ones share') text")
    many = decontamination.contamination(spark.createDataFrame([(1, "the words that all share"), (2, "words that odd ones share"), (3, "words")], "doc_id long, text string"), shared)
    assert {r.doc_id: (r.n_hit, r.items) for r in many.collect()} == {1: (4, sorted(map(str, range(0, 3000, 2)))), 2: (5, sorted(map(str, range(1, 3000, 2)))), 3: (0, [])}
    assert decontamination.contamination(empty, bench).count() == 0 and decontamination.contamination(cases, bench.limit(0)).filter("n_items > 0").count() == 0


# 8
def test_language_id(spark, docs, cases, empty):
    model = language_id.train(docs)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang_pred = lang").count() >= 0.9 * got.count()
    edge = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(cases, model).collect()}
    assert all(edge[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and edge[8][0] == "de" and all(0 <= s <= 1 for _, s in edge.values())
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    assert language_id.identify(cases, None).filter("lang_pred <> 'und'").count() == 0


def test_language_decisions(spark, docs):
    """Family first, then votes between its languages, from the learned weights by plain loops; ties take the first in order of name."""
    model = language_id.train(docs)
    grams = language_id.GRAMS
    rows = docs.filter("text is not null").orderBy("doc_id").limit(40).collect()
    rows += [rows[0], rows[0]]
    got = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_id.identify(spark.createDataFrame(rows, docs.schema), model).filter("score > 0").collect()}
    want = set()
    for r in rows:
        if not re.search(r"[^\W\d_]", r.text):
            continue
        block = next(_shared.blocks(__import__("pyarrow").array([r.text.encode().translate(_shared.LOWER_AZ).decode()])))
        parts = grams.counts(block).reshape(-1, 1 << grams.bits).astype(float)
        parts /= np.maximum(parts.sum(axis=1, keepdims=True), 1)
        value = {k: float(parts.ravel() @ model.tables[i] + model.bias[i]) for i, k in enumerate(model.keys)}
        families = sorted({language_id.family_of(x) for x in model.langs})
        ranked = sorted(families, key=lambda f: -value["family", f])
        score = 1 / (1 + np.exp(-2 * (value["family", ranked[0]] - value["family", ranked[1]])))
        langs = sorted(x for x in model.langs if language_id.family_of(x) == ranked[0])
        votes = dict.fromkeys(langs, 0.0)
        for i, a in enumerate(langs):
            for b in langs[i + 1 :]:
                p = 1 / (1 + np.exp(-2 * value[a, b]))
                votes[a] += p
                votes[b] += 1 - p
        best = max(langs, key=lambda x: votes[x])
        want.add((r.doc_id, best, round(score * (votes[best] / (len(langs) - 1) if len(langs) > 1 else 1), 6)))
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert all(abs(a[2] - b[2]) < 1e-4 for a, b in zip(sorted(got), sorted(want), strict=True))


def test_keep_identified(spark, docs, cases, empty):
    model = language_id.train(docs)
    found = {r.doc_id: r for r in language_id.identify(cases, model).collect()}
    for least, langs in ((0.5, None), (0.9, None), (0.0, ["de"])):
        kept = language_id.keep_identified(cases, model, least, langs)
        want = [r for r in cases.collect() if found[r.doc_id].lang_pred != "und" and found[r.doc_id].score >= least and (not langs or found[r.doc_id].lang_pred in langs)]
        assert kept.columns == cases.columns and sorted(map(str, kept.collect())) == sorted(map(str, want))
    assert language_id.keep_identified(empty).count() == 0
    assert language_id.keep_identified(cases.withColumn("lang", F.lit(None).cast("string"))).count() == cases.filter(F.col("text").rlike(r"\p{L}")).count()


# 9
def arrow_block(*texts):
    return next(_shared.blocks(__import__("pyarrow").array(list(texts))))


def test_masked_lm(docs, cases, empty):
    model = masked_lm.train(docs)
    network, rng = model.network, np.random.default_rng(1)
    # All classes of a window sum to one, and a window's probability is that of a plain network.
    window = rng.integers(0, masked_lm.CLASSES, (4, 3))
    for k in range(3):
        every = network.log_probabilities(np.repeat(window[:, k : k + 1], masked_lm.CLASSES, axis=1), np.arange(masked_lm.CLASSES))
        assert abs(np.exp(every).sum() - 1) < 1e-4
        h = np.tanh(network.bias + sum(network.embedding[i][c] for i, c in enumerate(window[:, k])))
        z, group = h @ network.group + network.group_bias, 17
        inner = h @ network.member[group] + network.member_bias[group]
        want = z[group] - np.log(np.exp(z).sum()) + inner[5] - np.log(np.exp(inner).sum())
        assert abs(every[group * masked_lm.SIDE + 5] - want) < 1e-4
    # Words are counted over all documents.
    count = Counter(w for r in docs.collect() for w in (r.text or "").encode().translate(_shared.LOWER_AZ).split())
    words, total = masked_lm.frequent_words(docs, 50)
    assert total == sum(count.values()) and len(words) == 50
    by_hash = {int(_shared.span_hashes(np.frombuffer(w + b" ", np.uint8), np.array([0]), np.array([len(w)]))[0].view(np.int64)): n for w, n in count.items()}
    assert [by_hash[w] for w in words] == sorted(count.values(), reverse=True)[:50]
    # Windows and byte pairs too.
    found = {(r.kind, r.cell): r.n for r in masked_lm.window_counts(docs, model.vocabulary, 1.0).collect()}
    want = Counter()
    for r in docs.collect():
        block = arrow_block((r.text or "").encode().translate(_shared.LOWER_AZ).decode())
        kind, _, starts, ends, _ = model.vocabulary.classes(block)
        kind = kind.tolist()
        at = lambda i: kind[i] if 0 <= i < len(kind) else masked_lm.EDGE
        for i, c in enumerate(kind):
            cell = c
            for place in masked_lm.PLACES:
                cell = cell * masked_lm.CLASSES + at(i + place)
            want[0, cell] += 1
            if c >= masked_lm.OWN:
                word = bytes(block.buf[starts[i] : ends[i]])
                want.update((1, a * 256 + b) for a, b in zip(b" " + word, word + b" ", strict=True))
    assert found == want
    assert masked_lm.window_counts(docs, model.vocabulary, 0.01).filter("kind = 0").count() < 0.03 * sum(k == 0 for k, _ in want)
    even = masked_lm.score(docs, model).agg(F.avg("mean_log_prob")).first()[0]
    backwards = docs.withColumn("text", F.reverse("text"))
    assert even > masked_lm.score(backwards, model, docs).agg(F.avg("mean_log_prob")).first()[0]
    edge = {r.doc_id: r for r in masked_lm.score(cases, model).collect()}
    assert edge[1].n_tokens == 0 and edge[1].log_prob == 0 and edge[1].mean_log_prob is None and edge[9].n_tokens == 20_000
    assert masked_lm.score(empty, masked_lm.train(empty)).count() == 0


def test_masked_lm_learns_every_window(spark, monkeypatch):
    """Each window of each document trains the network, in any number of tasks; those whose hash is small are predicted no better than the others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(4, "doc_id")
    words, total = masked_lm.frequent_words(docs)
    vocabulary, want = masked_lm.Vocabulary(words), np.zeros((5, masked_lm.CLASSES), np.int64)
    parts = [[], []]
    for k, block in enumerate(_shared.blocks(__import__("pyarrow").array([r.text for r in docs.select("text").collect()]), masked_lm._lower)):
        kind, *_, bounds = vocabulary.classes(block)
        windows = np.stack([kind, *(masked_lm.around(kind, bounds, place, masked_lm.EDGE) for place in masked_lm.PLACES)])
        for row, n in zip(windows, want, strict=True):
            n += np.bincount(row, minlength=masked_lm.CLASSES)
        cell = windows[0]
        for row in windows[1:]:
            cell = cell * masked_lm.CLASSES + row
        small = _shared.mix(cell.view(np.uint64)) <= np.uint64(int((1 << 19) / total * 2.0**64))
        if k % 4 == 0:
            for held, at in zip(parts, (small, ~small), strict=True):
                held.append(windows[:, at])
    assert total > 4_000_000 and want[0].sum() == total
    network = masked_lm.train(docs).network
    small, others = (network.log_probabilities(w[1:], w[0]).mean() for w in (np.concatenate(held, axis=1) for held in parts))
    assert others > -5 and small < others + 0.3, (small, others)
    monkeypatch.setattr(masked_lm, "TASK_WINDOWS", 1 << 20)
    first = masked_lm.WindowNetwork()
    moved, seen = masked_lm.learned(docs, vocabulary, first, total)
    assert np.array_equal(seen, want) and np.array_equal((moved.embedding != first.embedding).any(axis=2), want[1:] > 0)


def test_masked_lm_counts_by_small_tasks(docs, monkeypatch):
    """A task of few texts passes on one row for each partition that sums them, and only what is heavy among all tokens is returned; none of it is missing."""
    monkeypatch.setattr(masked_lm, "HEAVY", 1 << 11)
    words, total = masked_lm.frequent_words(docs, 20)
    vocabulary, want = masked_lm.Vocabulary(words), Counter()
    texts = __import__("pyarrow").array([r.text for r in docs.select("text").collect()])
    for block in _shared.blocks(texts, masked_lm._lower):
        kind, hashes, _, _, bounds = vocabulary.classes(block)
        want.update((4, c) for c in kind[kind >= masked_lm.OWN].tolist())
        for number, keys in enumerate(masked_lm.between(kind, hashes, bounds)[2:], 2):
            want.update((number, c) for c in keys.view(np.int64).tolist())
    got = {(r.kind, r.cell): r.n for r in masked_lm.window_counts(docs.repartition(40), vocabulary, 0.0, heavy=total).filter("kind > 1").collect()}
    heavy = {k for k, n in want.items() if k[0] < 4 and n * masked_lm.HEAVY >= 2 * total}
    assert heavy and heavy <= got.keys() and all(n <= want[k] for k, n in got.items())
    assert all(n * masked_lm.HEAVY >= total if k[0] < 4 else n == want[k] for k, n in got.items()) and sum(n for k, n in got.items() if k[0] == 4) == sum(n for k, n in want.items() if k[0] == 4)
    sent = masked_lm._window_counts(iter([__import__("pyarrow").RecordBatch.from_arrays([texts.slice(0, 5)], names=["text"])]), vocabulary, 0.0, True, 7)
    assert sum(batch.num_rows for batch in sent) <= 7


def test_masked_lm_learns_as_a_plain_network():
    """A batch moves the network as gradients of a plain one would, with safe and with large logits; words are found by their first bits; and rows are summed faster than place by place."""
    import time

    rng = np.random.default_rng(6)
    windows = np.minimum(rng.zipf(1.2, (5, 5000)) - 1, masked_lm.EDGE).astype(np.int16)
    for scale in (1, 400):
        network = masked_lm.WindowNetwork()
        network.group *= scale
        plain = {k: v.astype(np.float64) for k, v in vars(network).items()}
        h = np.tanh(plain["bias"] + sum(plain["embedding"][k][windows[k + 1]] for k in range(4)))
        group, own = np.divmod(windows[0], masked_lm.SIDE)
        soft = lambda z: np.exp(z - z.max(axis=1, keepdims=True)) / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
        outer, inner = soft(h @ plain["group"] + plain["group_bias"]), soft(np.einsum("nh,nhs->ns", h, plain["member"][group]) + plain["member_bias"][group])
        log = np.log(np.maximum(outer[np.arange(5000), group], 1e-300)) + np.log(inner[np.arange(5000), own])
        assert np.allclose(network.log_probabilities(windows[1:], windows[0]), log, rtol=1e-3, atol=1e-3)
        outer[np.arange(5000), group] -= 1
        inner[np.arange(5000), own] -= 1
        back = (outer @ plain["group"].T + np.einsum("ns,nhs->nh", inner, plain["member"][group])) * (1 - h * h)
        gradient = {k: np.zeros_like(v) for k, v in plain.items()}
        gradient["group"], gradient["group_bias"], gradient["bias"] = h.T @ outer, outer.sum(0), back.sum(0)
        np.add.at(gradient["member_bias"], group, inner)
        np.add.at(gradient["member"], group, h[:, :, None] * inner[:, None, :])
        for k in range(4):
            np.add.at(gradient["embedding"][k], windows[k + 1], back)
        # Large squares held before make a step proportional to its gradient.
        network.learn(windows, {k: np.ones_like(v) for k, v in vars(network).items()}, np.random.default_rng(1))
        for k, v in vars(network).items():
            g = gradient[k] / 5000
            assert np.allclose(v, plain[k] - masked_lm.RATE * g / np.sqrt(1 + g * g), atol=2e-6 * scale), k
    for n in (1, 3, 3584):
        words = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        vocabulary = masked_lm.Vocabulary(words.view(np.int64).tolist())
        sought = np.concatenate([words, words + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        assert np.array_equal(vocabulary.hashes[vocabulary.find(sought)] == sought, np.isin(sought, words))
    for keys, n in ((np.zeros(400, np.int16), 100), (np.arange(4, dtype=np.int16), 1), (rng.zipf(1.3, 32768).clip(max=16000).astype(np.int16), 8192)):
        values = rng.normal(size=(n, masked_lm.HIDDEN)).astype(np.float32)
        want = np.zeros((keys.max() + 1, masked_lm.HIDDEN))
        np.add.at(want, keys, np.tile(values.astype(np.float64), (len(keys) // n, 1)))
        seen, sums = masked_lm.row_sums(keys, values)
        assert np.array_equal(seen, np.unique(keys)) and np.allclose(sums, want[seen], atol=2e-3)

    def by_place():
        for x in np.split(keys, 4):
            order = np.argsort(x, kind="stable")
            np.add.reduceat(values.take(order, axis=0), np.flatnonzero(masked_lm._changes(x[order])))

    def least(f):
        times = []
        for _ in range(15):
            at = time.process_time()
            f()
            times.append(time.process_time() - at)
        return min(times)

    assert least(lambda: masked_lm.row_sums(keys, values)) < 0.8 * least(by_place)


@pytest.mark.parametrize("heavy", [1, 1 << 17, 1 << 20])  # no pair is heavy, some pairs but no word between them, and all of both
def test_masked_lm_scores(spark, monkeypatch, heavy):
    """Sums by brute force, words between frequent words too; fluent texts are likelier than ones whose words are exchanged or out of order, and texts that occur twice than others."""
    monkeypatch.setattr(masked_lm, "HEAVY", heavy)
    rng = np.random.default_rng(4)
    made = [[f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiou" for c in ("rin", "sin")][k::4] for k in range(4)]
    text = lambda: " ".join(w for k in rng.integers(0, 25, 12) for w in (made[0][k], made[1][k], made[2][k], made[3][k]))
    twice = "unique words that nobody else would ever put into such an order here"
    texts = [text() for _ in range(400)] + [twice, twice, "other single words which no one has written down before in this way", "", None, "one"]
    texts += ["top1 inner top2"] * 5 + ["top1 other top2 last"] * 2
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    common = " ".join(f"top{i}" for i in range(masked_lm.OWN))  # these words take all classes of their own
    corpus = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.range(250).select((F.col("id") + 5000).alias("doc_id"), F.lit(common).alias("text"))).repartition(3)
    model = masked_lm.train(corpus)
    pairs, inner = map(len, model.heavy)
    assert (pairs == inner == 0) if heavy == 1 else (pairs > inner) if heavy == 1 << 17 else (inner > pairs > 0)

    def parts(t):
        if not (t or "").split():
            return []
        block = arrow_block(t)
        kind, words = model.vocabulary.classes(block)[0].tolist(), t.split()
        rare = lambda i: 0 <= i < len(kind) and kind[i] >= masked_lm.OWN
        near = lambda i: words[i] if 0 <= i < len(words) else ""
        return [(i, w, (near(i - 1), near(i + 1))) for i, w in enumerate(words) if rare(i)]

    single, context = Counter(), Counter()
    for t in texts:
        single.update((w, q) for _, w, q in parts(t))
        context.update(q for _, _, q in parts(t))

    def brute(t, off):
        value = model.tokens(arrow_block(t or ""))[0].copy()
        for i, w, q in parts(t):
            spelled = sum(model.spelling[a * 256 + b] for a, b in zip(b" " + w.encode(), w.encode() + b" ", strict=True))
            share = max(single[w, q] - off, 0) / max(context[q] - off, 1)
            value[i] += np.log(masked_lm.INTERPOLATED * share + (1 - masked_lm.INTERPOLATED) * np.exp(spelled)) - spelled
        return value.sum()

    got = masked_lm.score(corpus, model).filter("doc_id < 5000 or doc_id is null").collect()
    want = sorted((len((t or "").split()), brute(t, 1)) for t in texts)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-3 for a, b in zip(sorted((r.n_tokens, r.log_prob) for r in got), want, strict=True))
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(texts) and abs(by_id[401].log_prob - brute(twice, 1)) < 2e-3
    assert by_id[401].mean_log_prob > by_id[402].mean_log_prob + 3
    fluent = [text() for _ in range(20)]
    flat = sum(made, [])
    groups = fluent, [" ".join(rng.permutation(flat)[: len(t.split())]) for t in fluent], [" ".join(rng.permutation(t.split())) for t in fluent]
    asked = [(100 * k + i, t) for k, group in enumerate(groups) for i, t in enumerate(group)]
    other = {r.doc_id: r for r in masked_lm.score(spark.createDataFrame(asked, "doc_id long, text string"), model, corpus).collect()}
    mean = lambda k: np.mean([other[100 * k + i].mean_log_prob for i in range(20)])
    assert mean(0) > mean(1) + 1 and mean(0) > mean(2) + 1
    assert all(abs(other[i].log_prob - brute(t, 0)) < 2e-3 for i, t in asked)


# 10
def test_knn_quality(spark, docs, cases, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = knn_quality.train(docs, labels)
    df, n = knn_quality.document_frequencies(docs)
    texts = [r.text for r in docs.select("text").collect()]
    block = next(_shared.blocks(__import__("pyarrow").array(texts), limit=1 << 30))
    assert n == len(texts) and np.array_equal(df, (knn_quality.GRAMS.counts(block) > 0).sum(axis=0))
    vectors = model.project(knn_quality.GRAMS.counts(block)[:20], knn_quality.GRAMS)
    for v, s in zip(vectors, model.scores(vectors), strict=True):
        near = model.vectors @ v
        last = np.sort(near)[-min(knn_quality.NEIGHBOURS, len(near))]
        weight = np.where(near >= last - 1e-5, np.maximum(near, 0), 0).astype(float) ** knn_quality.SHARPNESS
        assert abs(s - weight @ model.y / weight.sum()) < 1e-3
    got = knn_quality.score(docs, model).join(labels.filter("quality is not null"), "doc_id")
    assert got.filter("predicted = quality").count() >= 0.85 * got.count()
    edge = {r.doc_id: r.score for r in knn_quality.score(cases, model).collect()}
    assert edge[1] == edge[2] == pytest.approx(model.prior) and all(0 <= s <= 1 for s in edge.values())
    assert knn_quality.score(empty, knn_quality.train(empty, labels)).count() == 0


# 11
def brute_resampling(docs, target, percent=5, least=20):
    """Rows by doc_id of the contract's words, n-grams and draws, one n-gram at a time."""
    import math
    import zlib

    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(x for _, _, f in own for x in f), Counter(x for r in target for x in features(r)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * (s_all + 10_000) / ((s[x] + 1) * (t_all + 10_000)))) for x in f)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    open_ = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    return sorted(((*r, None) for r in rows), key=str), [r[0] for r in open_[: percent * len(open_) // 100]]


@pytest.mark.parametrize("stretch", [1 << 20, 50])
def test_resampling_equals_brute_force(spark, docs, cases, stretch, monkeypatch):
    """Also where stretches end within texts, on the edge cases, and with a half drawn."""
    monkeypatch.setattr(resampling, "STRETCH", stretch)
    made = cases.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "no number " * 30), (99, "w" * 700 + " " + "x" * 256 + " y" * 20)], "doc_id long, text string"))
    made = made.unionByName(docs.select("doc_id", "text").filter("doc_id > 20"))
    target = spark.createDataFrame([("no number at all",), ("the quick brown fox",), (None,), ("",)], "text string")
    own = Counter()
    of = resampling.Buckets(resampling.Grams())
    for n, doc, bucket in of.of(["a b c".encode(), b"", "d é f".encode()]):
        own.update((n, d) for d in doc)
        assert len(doc) == len(bucket)
    assert own == {(1, 0): 3, (1, 2): 3, (2, 0): 2, (2, 2): 2, (3, 0): 1, (3, 2): 1}
    got = resampling.resample(made, target, percent=50).collect()
    rows, drawn = brute_resampling([tuple(r) for r in made.collect()], [r.text for r in target.collect()], 50)
    assert sorted(((*r[:5], None) for r in got), key=str) == rows
    placed = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in placed] == list(range(1, len(drawn) + 1)) and [r.doc_id for r in placed] == drawn


def test_resampling_ties_and_empty_tables(spark, empty):
    same = spark.createDataFrame([(i, "tie " * 20) for i in (5, 5, 5, 5, 5, 5)] + [(8, "short")], "doc_id long, text string")
    got = resampling.resample(same, empty, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and {r.doc_id for r in got if r["rank"]} == {5}
    assert resampling.resample(empty, same).count() == 0


# 12
PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= sum(c.isdigit() for c in s) <= 19 and plain_luhn(s)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= sum(c.isdigit() for c in s) <= 15),
]


def plain_luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_personal_data_equals_brute_force(spark, docs, cases):
    rng = np.random.default_rng(3)
    letters = list("ab1234567890 .-+@()_%é") + ["4111111111111111", "+1 (017) 555-7713", "1.2.3.4", "x@y.de"]
    noisy = [(1000 + i, "".join(rng.choice(letters, 60))) for i in range(300)]
    extra = noisy + [(5000 + n, r.text) for n, r in enumerate(cases.collect())]
    made = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = personal_data.find_spans(made).collect()
    assert len(found) == made.count()
    for r in found:
        want = [(k, m.start(), m.end()) for k, p, ok in PII for m in re.finditer(p, r.text or "") if ok(m[0])]
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == want
        order = [(["email", "ip", "card", "phone", "iban", "ssn"].index(s.kind), s.start) for s in r.spans]
        assert order == sorted(order)
    spans = {r.doc_id: r.spans for r in found}
    for r in personal_data.summary(personal_data.find_spans(made)).collect():
        listed = lambda some: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in some)
        base = [s for s in spans[r.doc_id] if s.base]
        assert r.spans == listed(spans[r.doc_id]) and r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.kind == k for s in base) for k, _, _ in PII)


def test_personal_data_validators_and_context(spark):
    of = personal_data.Finder(personal_data.BASE + personal_data.MORE, 0.6).of
    shown = lambda t: [(k, t[a:b]) for k, a, b, *_ in of(t)]
    assert shown("IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432") == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert shown("DE89 3704 0044 0532 0130 01") == []  # wrong check digits
    assert shown("amex card 378282246310005") == [("card", "378282246310005")] and shown("order 378282246310005") == []
    assert shown("ssn 123-45-6789") == [("ssn", "123-45-6789")] and shown("123-45-6789") == [] and shown("ssn 000-45-6789") == []
    assert shown("please call 030 1234567 today") == [("phone", "030 1234567")] and shown("about 030 1234567 today") == []
    assert shown("4111111111111111 5500005555555559") == [("card", "4111111111111111"), ("card", "5500005555555559")]  # 32 digits are no card, each 16 are
    assert shown("4111 1111 1111 1112") == []
    docs = spark.createDataFrame([(1, "mail a@b.de or 1.2.3.4!", "k"), (2, None, "k")], "doc_id long, text string, spans string")
    assert [(r.text, r.spans) for r in personal_data.redact(docs).orderBy("doc_id").collect()] == [("mail [EMAIL] or [IP]!", "k"), (None, "k")]


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + " @", "1 " * 100_000, "+1" + "(" * 200_000, "a." * 100_000 + "@", "1." * 100_000, "A1" * 100_000, "+1((" * 50_000])
def test_personal_data_takes_linear_time(text):
    import time

    began = time.process_time()
    personal_data.Finder(personal_data.BASE + personal_data.MORE, 0.6).of(text)
    assert time.process_time() - began < 5


def test_personal_data_of_empty_tables(empty):
    assert personal_data.summary(personal_data.find_spans(empty)).count() == 0 and personal_data.redact(empty).columns == empty.columns


# 13
def brute_trie(conversations):
    """Nodes by beginnings as tuples; conversations: {conv_id: [(role, text), ...]}."""
    nodes = {}
    for c, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        children = lambda q: sum(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)
        ends = ",".join(str(c) for c in members if len(conversations[c]) == len(p))
        rows.append((
            members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), children(p), sum(not children(q) for q in under),
            sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows)


def tries(spark, given):
    rows = [(c, n, r, t) for c, turns in given.items() for n, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


@pytest.mark.parametrize(("block", "piece"), [(1 << 16, 1 << 20), (1, 1), (3, 2)])
def test_trie_equals_brute_force(spark, block, piece):
    """Blocks and pieces of a few rows too, so that beginnings run over many of them."""
    rng = np.random.default_rng(block)
    given = {int(c): [(["user", "assistant"][n % 2], "é" * int(x)) for n, x in enumerate(rng.integers(0, 2, rng.integers(1, 6)))] for c in range(60)}
    given |= {c: [("user", "same")] * 7 for c in range(100, 130)}
    given |= {200: [("user", "same")] * 3, 201: [("user", "alone")]}
    own = _shared.materialise(prefix_trie.sequences(tries(spark, given)), "turns")
    packed = prefix_trie._packed(own).select("key", "sizes", "conv_id").collect()
    assert sorted(map(tuple, trie_in_blocks(packed, block, piece))) == brute_trie(given)
    if block == 1 << 16:
        assert sorted(map(tuple, prefix_trie.prefix_trie(own).collect())) == brute_trie(given)


def trie_in_blocks(packed, block, piece):
    """The operator's own steps over sorted rows, with small blocks; these are constants of its tasks."""
    from unittest import mock

    import pyarrow as pa

    rows = sorted((bytes(r.key), r.conv_id, bytes(r.sizes)) for r in packed)
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["conv_id", "key", "sizes"])
    task = mock.Mock(**{"get.return_value.partitionId.return_value": 5})
    with mock.patch.multiple(prefix_trie, BLOCK=block, PIECE=piece, TaskContext=task):
        forest = [r for b in prefix_trie._forests(prefix_trie._pieces(iter([batch]))) for r in b.to_pylist()]
    paths = [{k: r[k] for k in ("block", "first", "last", "common", "places")} for r in forest if r["places"]]
    assert len(paths) >= len({r[0] for r in rows}) // block
    merged = [r for b in prefix_trie._merge_paths(iter([pa.RecordBatch.from_pylist(paths)])) for r in b.to_pylist()]
    named = {(r["block"], r["place"]): r["parent_conv_id"] for r in merged if r["place"] is not None}
    inner = [r | ({"parent_conv_id": named[r["block"], r["place"]]} if r["place"] is not None else {}) for r in forest if not r["places"]]
    return [[r[c] for c in prefix_trie.NODE_COLUMNS] for r in inner + [r for r in merged if r["place"] is None]]


def test_trie_borrows_beginnings(spark):
    import zlib

    given = {c: [("user", f"{c} {n}") for n in range(1 + c % 4 * 3)] for c in [*range(0, 23), 31, 1002, 2004, 2008, 2012]}
    own = _shared.materialise(prefix_trie.sequences(tries(spark, given)), "turns")
    rebuilt = {}
    for c in given:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = given.get(c - c % 5, [])[:h] + given[c][h:]
    assert any(not t for t in rebuilt.values())
    assert sorted(map(tuple, prefix_trie.prefix_trie(prefix_trie.borrow_beginnings(own)).collect())) == brute_trie(rebuilt)


def test_trie_of_nulls_and_empty_tables(spark):
    rows = [(1, None, None, "a", 1), (1, 0, "user", None, 1), (1, 0, "user", None, 1), (None, 1, "user", "x", 1), (2, 5, "", "a", 1)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    assert sorted(map(tuple, prefix_trie.conversation_trie(made).collect())) == brute_trie({1: [("", "a"), ("user", ""), ("user", "")], 2: [("", "a")]})
    assert prefix_trie.conversation_trie(made.limit(0)).count() == 0


# The pipeline's near-duplicate stage
def plain_shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_classes(sets, least=0.8):
    """The smallest id of each id's class, from all pairs of sets."""
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x == y or both and both >= least * (len(x) + len(y) - both) - 1e-9:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [2048, 4])
def test_near_copies_equal_all_pairs(spark, docs, cases, bucket, monkeypatch):
    """Texts with a few words exchanged, on both sides of 0.8, copies of copies, short texts, and buckets that are dealt as pairs of blocks."""
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    rng = np.random.default_rng(11)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bases = [" ".join(f"w{x}" for x in rng.integers(0, 5000, n)) for n in (12, 40, 200, 1000)]
    for base in bases:
        for k in range(25):
            words = base.split()
            for at in rng.choice(len(words), max(1, len(words) * (k % 5) // 60), replace=False):
                words[at] = f"v{rng.integers(0, 10**6)}"
            rows.append((10_000 + len(rows), ("  " if k % 2 else " \n").join(words).upper() if k % 3 else " ".join(words)))
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "rep.doc_id").toDF("doc_id", "rep").collect()
    want = plain_classes({i: plain_shingles(t) for i, t in rows})
    missed = [r.doc_id for r in got if r.rep != want[r.doc_id]]
    assert len(got) == len(rows) and len(missed) <= 2 and len(set(want.values())) < len(rows) - 30, missed
    for r in got:  # never more than what links
        assert want[r.rep] == want[r.doc_id]


@pytest.mark.parametrize("bucket", [1024, 4])
def test_near_copies_come_from_the_simhash_index(spark, docs, bucket, monkeypatch):
    """All pairs of fingerprints at seven bits or fewer share a key, and with them alone all similar pairs that close are linked."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    rows = [(r.doc_id, r.text) for r in docs.limit(300).collect()]
    for n in (60, 300):
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        for k in range(40):
            words = base.copy()
            for at in rng.choice(n, k % 4, replace=False):
                words[at] = f"v{rng.integers(0, 10**6)}"
            rows.append((10_000 + len(rows), " ".join(words)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    texts = near_copies.sketches(made).groupBy("node").agg(*(F.min(c).alias(c) for c in ("doc_id", "n", "fp"))).cache()
    known, keys = {bytes(r.node): r for r in texts.filter("n > 1").collect()}, {}
    for r in near_copies.index_keys(texts).collect():
        keys.setdefault(bytes(r.node), set()).add(r.key)
    close = [(a, b) for a in known for b in known if a < b and ((known[a].fp ^ known[b].fp) & (2**64 - 1)).bit_count() <= near_copies.NEAR]
    assert len(close) > 20 and set(keys) == {x for pair in close for x in pair} and all(keys[a] & keys[b] for a, b in close)
    # Without bands the index still brings together what is similar enough.
    alone = near_copies.sketches(made).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("rep"), *(F.first(c).alias(c) for c in ("n", "fp", "minima", "bands")))
    alone = _shared.materialise(alone.withColumn("bands", F.array().cast("array<long>")), "alone")
    roots = {bytes(r.node): bytes(r.root) for r in components.connected_components(near_copies.similar_links(made, alone, 5, 0.8)).collect()}
    sets = {n: frozenset(plain_shingles(t)) for n, t in ((n, dict(rows)[known[n].doc_id]) for n in known)}
    similar = [(a, b) for a, b in close if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(similar) > 10 and all(roots.get(a) == roots.get(b) is not None for a, b in similar)


def test_near_copies_recall_on_all_documents(spark):
    """Pairs of differing texts at 0.8 or more, by an index of all shingles but those of very many texts."""
    from collections import defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    rep = {r.doc_id: r.rep for r in near_copies.near_copies(docs).select("doc_id", "rep.doc_id").toDF("doc_id", "rep").collect()}
    first = {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        first.setdefault(frozenset(map(hash, plain_shingles(r.text))), r.doc_id)
    texts_of, shared = defaultdict(list), Counter()
    for s, i in first.items():
        for x in s:
            texts_of[x].append((i, len(s)))
    for found in texts_of.values():
        if len(found) <= 100:
            shared.update((a, b) for n, a in enumerate(found) for b in found[n + 1 :])
    pairs = [(a, b) for ((a, x), (b, y)), n in shared.items() if n >= 0.8 * (x + y - n) - 1e-9]
    assert len(pairs) > 30 and sum(rep[a] == rep[b] for a, b in pairs) >= 0.95 * len(pairs)


def test_near_copies_by_document_not_by_doc_id(spark, empty):
    a, b = "one two three four five six seven eight nine ten", "eins zwei drei vier fünf sechs sieben acht neun zehn"
    rows = [(0, b, "p"), (1, a, "q"), (1, b, "r"), (1, a, "s"), (None, a, "t"), (None, "alone one two three four five", "u"), (None, "alone one two three four five", "v"), (4, None, "w"), (3, " ", "x")]
    made = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    kept = sorted(r.mark for r in near_copies.keep_representatives(made).collect())
    assert [k for k in kept if k not in "uv"] == ["p", "q", "s", "x"] and len([k for k in kept if k in "uv"]) == 1
    assert near_copies.keep_representatives(empty).count() == 0 and near_copies.keep_representatives(made).columns == made.columns
