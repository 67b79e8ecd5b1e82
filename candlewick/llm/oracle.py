"""SQL for the queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW_TEXT = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORD = r"[^\x20\x09-\x0D]+"


def _key(seed: int) -> str:
    """The operators' seeded order: the first 60 bits of an MD5."""
    return f"CAST('0x' || substr(md5(concat_ws(chr(31), '{seed}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 15) AS BIGINT)"


_OP2 = f"""WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, coalesce('0' || source, '1') AS k, {_key(7)} AS h FROM documents),
s AS (SELECT k, sum(size) AS total, 1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS w FROM d GROUP BY 1),
-- sources by cap over weight: the first that is not below the level of what is left sets it for itself and all after it
o AS (SELECT *, 3.0::DOUBLE * total / w AS ratio, row_number() OVER (ORDER BY 3.0::DOUBLE * total / w, k) AS pos FROM s),
l AS (SELECT a.pos, a.ratio, (((SELECT sum(total) FROM s) - coalesce(sum(b.total) * 3, 0)) / (((SELECT sum(w) FROM s) - coalesce(sum(b.w), 0)))::DOUBLE) AS level
  FROM o a LEFT JOIN o b ON b.pos < a.pos GROUP BY a.pos, a.ratio),
f AS (SELECT pos, level FROM l WHERE ratio >= level ORDER BY pos LIMIT 1),
t AS (SELECT k, total, CASE WHEN o.pos >= f.pos THEN f.level * w ELSE 3.0 * total END AS target FROM o LEFT JOIN f ON true),
r AS (SELECT doc_id, size, total, target, least(CAST(round(target) AS BIGINT), total * 3) AS budget,
  sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t USING (k))
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(CASE WHEN total = 0 THEN 0 ELSE (budget // total) * size + greatest(0, least(budget % total - before, size)) END AS BIGINT) AS taken FROM r"""

_STRIP = r"[\x20\x09-\x0D]+"
_OP3 = rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{_STRIP}', ''), '{_STRIP}$', ''), '{_UPPER}', '{_LOWER}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.doc_id, i, line, first IS NULL OR first = k.doc_id AS stays FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256 FROM j GROUP BY 1"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OP6 = rf"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW_TEXT}, '{_ALNUM}') AS w FROM benchmark),
q AS (SELECT DISTINCT item, n, w[i:i + n - 1] AS grams FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOW_TEXT}, '{_ALNUM}') AS w FROM documents),
g AS (SELECT doc_id, i, n, w[i:i + n - 1] AS grams FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, q.n, item FROM g JOIN q USING (n, grams)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)"""

_OP8 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW_TEXT}, '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM d),
u AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT doc_id, len(x) AS n_shingles, component_id, component_id = doc_id AS kept FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY 1) USING (doc_id)"""

_OP10 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
c AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT t.a AS vec_id, coalesce(n.n, 0) AS n_links, t.m AS component_id, t.m = t.a AS kept FROM (SELECT a, min(b) AS m FROM c GROUP BY 1) t LEFT JOIN n ON n.a = t.a"""

# CRC-32 byte by byte over the text's hex digits, with the table that its polynomial gives
_POLYNOMIAL = 0xEDB88320
_STEP = f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END"
_TABLE = "CAST(i AS BIGINT)"
for _ in range(8):
    _TABLE = f"(SELECT {_STEP} FROM (SELECT {_TABLE} AS c))"
_OP9 = f"""WITH t AS MATERIALIZED (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, {_TABLE} AS v FROM range(256) r(i))),
x AS (SELECT doc_id, coalesce(source IS NULL, false) AS nosource, coalesce(source, '') AS source, {_key(11)} AS h, coalesce(octet_length(encode(text)), 0) AS n, hex(encode(coalesce(text, ''))) AS hx FROM documents),
d AS (SELECT doc_id, CASE WHEN nosource THEN 'n' ELSE 's' || source END AS stratum, h, n + 8 AS size,
  CASE WHEN n = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda j: CAST('0x' || substr(hx, 2 * j + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) END AS text_crc32 FROM x, t),
r AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, text_crc32) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, stratum, h, doc_id, text_crc32) - 1 AS pos, count(*) OVER () AS n_rows FROM r),
z AS (SELECT *, pos * 24 // n_rows AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * n_rows + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM z"""

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": _OP2,
    "op3_line_dedup": _OP3,
    "op6_benchmark_phrases": _OP6,
    "op8_minhash_groups": _OP8,
    "op9_stratified_shards": _OP9,
    "op10_embedding_links": _OP10,
}
