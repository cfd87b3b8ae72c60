"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from clausewright.llm.licences import RULES, SENTENCES, normalised

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
    16 * (instr('0123456789abcdef', substr(x, (1 + (5 * i) // 4)::INT, 1)) - 1)
    + (CASE WHEN (5 * i) // 4 + 2 <= 40 THEN instr('0123456789abcdef', substr(x, (2 + (5 * i) // 4)::INT, 1)) - 1 ELSE 0 END)
    ) // (2 ** (3 - (5 * i) % 4))::BIGINT) % 32)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(s)),
hits AS (SELECT doc_id, s, p.n, item_id FROM places p JOIN wins USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM hits, unnest(range(s, s + n)) AS t(pos) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: One bit of the CRC-32 of a number's decimal digits; a digit's byte comes in before its first bit.
_CRC_BYTE = "CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT) ELSE c END"
_CRC_STEP = f"lambda c, i: CASE WHEN ({_CRC_BYTE}) & 1 = 1 THEN xor(({_CRC_BYTE}) >> 1, 3988292384) ELSE ({_CRC_BYTE}) >> 1 END"

RESAMPLING = r"""
WITH steps AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS step
  FROM range(256) AS t(b)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS f FROM d, range(1, 4) AS g(n), unnest(range(1, len(w) - n + 2)) AS t(i)),
bf AS (SELECT array_to_string(w[i:i + n - 1], ' ') AS f FROM b, range(1, 4) AS g(n), unnest(range(1, len(w) - n + 2)) AS t(i)),
features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: (16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT),
    lambda c, x: xor(step[1 + (xor(c, x) & 255)], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS k
  FROM features, steps),
sizes AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS s_all, (SELECT count(*) FROM bf)::DOUBLE AS t_all),
s AS (SELECT k, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY k),
gains AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT k FROM hashed) LEFT JOIN s USING (k) LEFT JOIN t USING (k), sizes),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM df JOIN hashed USING (f) JOIN gains USING (k) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)),
placed AS (SELECT *, row_number() OVER (ORDER BY n >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (n >= 20) OVER () AS open FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= 5 * open // 100 THEN place END AS rank FROM placed
"""

PREFIX_TRIE = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, substr(sha256(length(r) || ':' || r || t), 1, 32)) AS a FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, a, (xor(list_reduce(range(8 * length(conv_id::VARCHAR)), lambda c, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, 4294967295::BIGINT), 4294967295) % 9) AS h
  FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(d.a, [])[1:c.h], c.a[c.h + 1:]) AS a FROM heads c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 5),
places AS (SELECT conv_id, d, a[1:d] AS p, len(a) = d AS ended FROM rebuilt, unnest(range(0, len(a) + 1)) AS u(d)),
nodes AS (
  SELECT d, p, min(conv_id) AS node, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends,
    (count(*) - 1) * coalesce(octet_length(encode(p[d].t)), 0) AS saved
  FROM places GROUP BY d, p),
members AS (SELECT conv_id, d, node FROM places JOIN nodes USING (d, p)),
linked AS (SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.conv_id = n.node AND m.d = n.d - 1),
children AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY ALL),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (d, node)),
below AS (
  SELECT m.d, m.node, sum(c.saved) AS saved_tokens, count(*) FILTER (c.n_children = 0) AS n_leaves
  FROM counted c JOIN members m ON m.conv_id = c.node AND m.d <= c.d GROUP BY m.d, m.node)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM counted JOIN below USING (d, node)
""".replace("lambda c, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END", _CRC_STEP)


def licences_sql() -> str:
    """Words with what stands between them; a known sentence is a stretch of words between two marks, without an end of a sentence inside.

    Of stretches that lie in a longer one only the longer counts. The rules are the same table.
    """
    known = ", ".join(f"({str(normalised(s).split())}, '{i}')" for i, s in SENTENCES.items())
    rules = {"".join(f"<{i}>" for i in ids): name for name, ids in sorted(RULES, key=lambda r: -len(r[1]))}
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.items())
    pattern = "|".join(rules)
    return rf"""
WITH known(words, sid) AS (VALUES {known}),
texts AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '\r\n?', chr(10), 'g'), '\bv\.[ \t\n]+', 'v ', 'g') AS t FROM documents),
tokens AS (SELECT doc_id, regexp_extract_all(t, '[a-z0-9]+') AS w, regexp_extract_all(' ' || t || ' ', '[^a-z0-9]+') AS gap FROM texts),
ends AS (
  SELECT doc_id, w, list_transform(gap, lambda g: CASE WHEN regexp_matches(g, '[.!?]["'')]*[ \t\n]|\n[^\n]*\n') THEN 2 WHEN regexp_matches(g, '\n|[;:][ \t]') THEN 1 ELSE 0 END) AS e FROM tokens),
places AS (SELECT doc_id, i, w[i] AS word FROM ends, unnest(range(1, len(w) + 1)) AS t(i) WHERE i = 1 OR e[i] > 0),
found AS (
  SELECT p.doc_id, p.i, len(k.words) AS n, k.sid FROM places p JOIN known k ON p.word = k.words[1] JOIN ends d ON d.doc_id = p.doc_id
  WHERE d.w[p.i:p.i + len(k.words) - 1] = k.words AND (p.i + len(k.words) - 1 = len(d.w) OR d.e[p.i + len(k.words)] > 0)
    AND NOT list_contains(d.e[p.i + 1:p.i + len(k.words) - 1], 2)),
longest AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.n > f.n AND o.i <= f.i AND o.i + o.n >= f.i + f.n)),
chains AS (SELECT doc_id, count(*) AS n, string_agg('<' || sid || '>', '' ORDER BY i) AS chain FROM longest GROUP BY doc_id),
taken AS (SELECT *, list_transform(regexp_extract_all(chain, '{pattern}'), lambda x: CASE x {names} END) AS t FROM chains)
SELECT doc_id,
  coalesce(array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ','), '') AS licences,
  coalesce(len(t), 0)::BIGINT AS n_matches, coalesce(n, 0)::BIGINT AS n_sentences,
  coalesce(array_to_string(regexp_extract_all(regexp_replace(chain, '{pattern}', '', 'g'), '<([^>]*)>', 1), ','), '') AS unmatched
FROM documents LEFT JOIN taken USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC, "op4_licences": licences_sql(), "op7_decontamination": DECONTAMINATION, "op11_importance_resampling": RESAMPLING, "op13_prefix_trie": PREFIX_TRIE}
