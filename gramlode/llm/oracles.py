"""The queries of the subpackage that SQL can express, for DuckDB."""

from __future__ import annotations

from . import quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


OP5 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS s FROM p),
bits AS (SELECT *, list_aggregate(list_transform(string_split(s, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), 'string_agg', '') AS z FROM h),
d AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * (substr(z, 5 * i + 1, 1) = '1')::INT + 8 * (substr(z, 5 * i + 2, 1) = '1')::INT + 4 * (substr(z, 5 * i + 3, 1) = '1')::INT + 2 * (substr(z, 5 * i + 4, 1) = '1')::INT + (substr(z, 5 * i + 5, 1) = '1')::INT, 1)), 'string_agg', '') AS payload_digest,
      max(page_id) OVER (PARTITION BY s) AS m FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM d
"""

_TRIM = r"regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS i FROM rep, (VALUES (0), (1), (2)) t(k)) GROUP BY doc_id),
ln AS (SELECT doc_id, l, {_TRIM} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
judged AS (SELECT doc_id, l, (len(string_split_regex(t, '{quality.SPACE}')) >= {quality.LONG_LINE_WORDS} AND NOT regexp_matches(t, '{_quoted(quality.SENTENCE_END)}'))
      OR regexp_matches(t, '{_quoted(quality.NAVIGATION)}') OR length(regexp_replace(t, '{_quoted(quality.PUNCTUATION_RUN)}', '', 'g')) * 10 < length(t) * 8 OR regexp_matches(t, '{_quoted(quality.BOILERPLATE)}') AS bad FROM ln),
per AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, sum(length(l)) AS before, coalesce(sum(length(l)) FILTER (NOT bad), 0) AS after FROM judged GROUP BY doc_id),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM d LEFT JOIN per USING (doc_id) LEFT JOIN cov USING (doc_id)),
g AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ((before - after) * 100 > before * {quality.MAX_LOST_PERCENT}) AS kept FROM g
"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS n FROM win) WHERE n > 1),
starts AS (SELECT doc_id, i, lead(i, 1, i + 35) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM rep),
gone AS (SELECT doc_id, unnest(range(i, least(j, i + 35))) AS i FROM starts),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP10 = f"""
WITH b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
win AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k))),
hit AS (SELECT doc_id, i, n, item_id FROM win JOIN k USING (n, x)),
words AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL = {"op5_warc": OP5, "op6_quality_rules": OP6, "op7_ngram_jaccard": OP7, "op9_substring_dedup": OP9, "op10_decontamination": OP10}
