"""DuckDB SQL of the queries that SQL can state on whole tables."""

from __future__ import annotations

from vulnsift.llm.licenses import LEAST, SHINGLE, TEMPLATES, WINDOW


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle are counted, links closed transitively.
NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_AZ}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.size + y.size - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)"""

#: Exact containment of each run of template shingles; without the windows' sketches, which only retrieve.
LICENSES = rf"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({_text(k)}, {_text(v)})" for k, v in sorted(TEMPLATES.items()))}) v(license, text)),
tw AS (SELECT license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM t),
ts AS (SELECT license, s, min(i) AS idx FROM (
    SELECT license, i - 1 AS i, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS s
    FROM (SELECT license, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM tw)) GROUP BY ALL),
sz AS (SELECT license, count(*) AS size FROM ts GROUP BY license),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM dw WHERE len(w) >= {SHINGLE})),
hit AS (SELECT doc_id, license, size, pos, idx FROM ds JOIN ts USING (s) JOIN sz USING (license)),
mark AS (SELECT *, CASE WHEN idx < lag(idx) OVER o OR pos - lag(pos) OVER o > size + {WINDOW} THEN 1 ELSE 0 END AS new
  FROM hit WINDOW o AS (PARTITION BY doc_id, license ORDER BY pos, idx)),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, license ORDER BY pos, idx) AS run FROM mark)
SELECT doc_id, license, CAST(min(pos) AS BIGINT) AS start_word, CAST(max(pos) + {SHINGLE} AS BIGINT) AS end_word,
  count(DISTINCT idx) AS n_matched, count(DISTINCT idx) / CAST(size AS DOUBLE) AS containment
FROM run GROUP BY doc_id, license, size, run HAVING count(DISTINCT idx) / CAST(size AS DOUBLE) >= {LEAST}"""

WARC = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)"""

#: Every anchor against every row, by integer inner product.
HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER o <= 10 WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)"""

ORACLE_SQL = {"op3_ngram_join": NGRAM_JOIN, "op5_licenses": LICENSES, "op10_warc": WARC, "op12_hard_negatives": HARD_NEGATIVES}
