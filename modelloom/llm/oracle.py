"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

from .secret_scan import BASE, RULES

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(x, '{_WORD}')) AS BIGINT) AS size,
    greatest(0.05::DOUBLE, 1::DOUBLE - 4::DOUBLE * (len(regexp_extract_all(x, '[^\p{{L}}\p{{M}}\x20\x09-\x0D]'))::DOUBLE / greatest(length(x), 1))) AS w,
    CAST(CAST('0x' || substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) AS u FROM t),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS everything, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER p, 0) AS before, coalesce(sum(weight) OVER p, 0) AS used
    FROM n WINDOW p AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (weights - used) <= weight * (everything - before) AS is_full FROM o),
g AS (SELECT *, everything - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0) AS rest, coalesce(sum(weight) FILTER (WHERE NOT is_full) OVER (), 0) AS among FROM f),
k AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (weight * rest)::DOUBLE / among END AS target FROM g),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM k),
r AS (SELECT d.*, b.source_size, b.target, b.epochs, CAST(round(b.target - b.epochs * b.source_size) AS BIGINT) AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln((d.u + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / d.w, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, budget - before)) AS BIGINT) AS taken FROM r
"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_have >= 90 * (p.n + q.n - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""

EXACT = rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256 FROM d WINDOW g AS (PARTITION BY h)
"""

#: Five hex digits are 20 bits: four letters of base32.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, h, octet_length(encode(x)) AS n, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS b FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS latest FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b AS payload_digest, CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> latest THEN latest END AS refers_to FROM m
"""

#: The polynomial of crc32, eight steps for each value of a byte; ids are decimal, so of ASCII signs.
_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_CRC = f"""t AS (SELECT list(c ORDER BY b) AS crc_of FROM (WITH RECURSIVE s AS (SELECT b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) x(b) UNION ALL SELECT b, {_CRC_STEP.format('c')}, k + 1 FROM s WHERE k < 8) SELECT b, c FROM s WHERE k = 8))"""
_CRC_OF = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc_of[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)".format

#: Every pair of equal words at most a third of the words apart; pairs of one distance that follow each other are a run.
PERIODIC = rf"""
WITH {_CRC},
d AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {_CRC_OF('doc_id')} AS h FROM documents, t)),
p AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM d WHERE n > 0),
x AS (SELECT doc_id, n, i, w[CAST(1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END AS BIGINT)] AS w FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM x JOIN x y ON y.doc_id = x.doc_id AND y.w = x.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS q FROM s GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS told FROM r GROUP BY doc_id),
f AS (SELECT doc_id, start, length, q FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(floor(1000 * length / q) AS BIGINT) DESC, CAST(length % q AS DOUBLE) / q DESC, start, q) = 1),
k AS (SELECT x.doc_id, string_agg(x.w, ' ' ORDER BY x.i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.q AND x.i < r.start + r.length) GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS (SELECT lang, source, id, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, sum(n) AS words, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS words FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(s.words, 0) + l.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (l.words + l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""



def _secrets() -> str:
    """The patterns as they are, over all texts; a text is cut at its matches, so a match begins where what lies before it ends."""
    quoted = lambda r: r.pattern.replace("'", "''")
    found = " UNION ALL ".join(f"SELECT id, {i} AS place, string_split_regex(x, '{quoted(r)}') AS gaps, regexp_extract_all(x, '{quoted(r)}') AS hits, regexp_extract_all(x, '{quoted(r)}', {r.group}) AS parts, {r.least} AS least FROM d" for i, r in enumerate(RULES))
    kinds = ", ".join(f"'{r.kind}'" for r in RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE place = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    given = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS x FROM documents),
f AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM ({found}) WHERE len(hits) > 0),
e AS (SELECT id, place, length(hits[i]) AS n, length(parts[i]) >= least AS long, sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY id, place ORDER BY i) AS stop FROM f),
s AS (SELECT id, place, stop - n AS start, ([{kinds}])[place + 1] || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS told FROM e WHERE long),
g AS (SELECT id, {counts}, string_agg(told, ',' ORDER BY start, place) FILTER (WHERE place < {len(BASE)}) AS base, string_agg(told, ',' ORDER BY start, place) AS spans FROM s GROUP BY id)
SELECT doc_id, {given}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (id)
"""


ORACLE_SQL = {"op11_secret_index": _secrets(), "op12_source_divergence": DIVERGENCE, "op13_periodic_runs": PERIODIC, "op2_weighted_mixing": MIXING, "op5_ngram_jaccard_join": JACCARD, "op7_exact_dedup": EXACT, "op9_arc_to_warc": WARC}
