"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import warc

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
o AS (
  SELECT *, sum(source_size) OVER () AS total, 2 * source_size::DOUBLE / weight AS ratio FROM w),
p AS (
  -- sources in order of the rate at which they reach twice their size; those before are full
  SELECT *, coalesce(sum(source_size) OVER b, 0) AS full_size, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS free_weight
  FROM o WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT min_by((3 * total - 4 * full_size)::DOUBLE, full_size * 1000 - free_weight) AS up, min_by((2 * free_weight)::DOUBLE, full_size * 1000 - free_weight) AS down
  FROM p WHERE ratio > (3 * total - 4 * full_size)::DOUBLE / (2 * free_weight)),
t AS (
  SELECT source, source_size, CASE WHEN 2 * source_size * down <= weight * up THEN 2.0::DOUBLE * source_size ELSE weight * up / down END AS target FROM o, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
r AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
x AS (
  SELECT r.source, r.h, words > 0 AND upto - words <= target - base * source_size AND (upto <= target - base * source_size
         OR upto - (target - base * source_size) <= (target - base * source_size) - (upto - words)) AND target > base * source_size AS extra
  FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size::BIGINT AS source_size, b.target, (d.size * (b.base + x.extra::INT))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""




def _op10() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"regexp_replace(payload, {q(warc.NO_TEXT)}, ' ', 'g')"
    text = f"regexp_replace({text}, {q(warc.BREAKS)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {q(warc.TAG)}, '', 'g')"
    for entity, char in warc.ENTITIES:
        text = f"replace({text}, {q(entity)}, {q(char)})"
    text = f"regexp_replace({text}, ' *\\n[ \\n]*', chr(10), 'g')"
    text = f"trim(regexp_replace({text}, '  +', ' ', 'g'), ' ' || chr(10))"
    crlf = "chr(13) || chr(10)"

    def uuid(kind: str, digest: str) -> str:
        h = f"md5(concat_ws(chr(10), '{kind}', coalesce(page_id::VARCHAR, ''), target_uri, {digest}))"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    def string(x: str) -> str:
        for a, b in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
            x = f"replace({x}, {a}, {b})"
        return f"('\"' || regexp_replace({x}, '[\\x00-\\x1F]', ' ', 'g') || '\"')"

    fields = [("refers-to", string("refers_to")), ("uri", string("target_uri")), ("title", string("title")), ("lang", string("lang")), ("source-headers", string("http_header")),
              ("source-digest", string("source_digest")), ("source-length", "source_length::VARCHAR"), ("text-digest", string("'sha1:' || sha1(txt)")), ("links", f"('[' || coalesce(array_to_string(list_transform(links, lambda x: {string("CASE WHEN x[1] IN (chr(34), chr(39)) THEN substr(x, 2, length(x) - 2) ELSE x END")}), ','), '') || ']')")]
    json = "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields) + " || '}'"
    return f"""
WITH base AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '[\\r\\n]', '', 'g') AS target_uri, coalesce(html, '') AS payload, 'sha1:' || sha1(coalesce(html, '')) AS source_digest,
         'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) || {crlf} || {crlf} AS http_header
  FROM pages),
seen AS (
  SELECT page_id, target_uri, source_digest, http_header, {uuid("response", "source_digest")} AS refers_to, strlen(http_header || payload) AS source_length,
         regexp_replace(regexp_extract(payload, {q(warc.TITLE)}, 1), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS title, lower(regexp_extract(payload, {q(warc.LANG)}, 1)) AS lang,
         regexp_extract_all(payload, {q(warc.LINK)}, 1) AS links, {text} AS txt
  FROM base),
made AS (
  SELECT page_id, 'metadata' AS record_type, {uuid("metadata", "source_digest")} AS record_id, refers_to, '' AS concurrent_to, target_uri, source_digest, 'application/json' AS content_type, {json} AS block FROM seen
  UNION ALL
  SELECT page_id, 'conversion', {uuid("conversion", "source_digest")}, refers_to, {uuid("metadata", "source_digest")}, target_uri, source_digest, 'text/plain', txt FROM seen)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, source_digest, 'sha1:' || sha1(block) AS block_digest, content_type, strlen(block)::BIGINT AS content_length
FROM made
"""


OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: a.vector[i] * b.vector[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3,
         ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d),
f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM e),
g AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""


OP13 = """
WITH t AS (  -- the checksum's table by its rule: eight steps of the reversed polynomial for each byte
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS crc),
d AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes,
         list_transform(range(17), lambda s: ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)) AS scores
  FROM documents),
e AS (
  SELECT doc_id, len(bytes)::BIGINT + 1 AS size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32,
         (list_position(scores, list_max(scores[1:16])) - 1)::INTEGER AS shard, (list_position(scores, list_max(scores)) - 1)::INTEGER AS grown_shard
  FROM d, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM e
"""


def registry() -> dict[str, str]:
    return {"op4_threshold_mixing": OP4, "op10_derivative_records": _op10(), "op11_segment_negatives": OP11, "op12_learned_rank_fim": OP12, "op13_rendezvous_shards": OP13}
