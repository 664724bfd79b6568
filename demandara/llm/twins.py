"""SQL twins (DuckDB) of the operators that SQL can express, written from their contracts."""

#: Items of fewer than five words are one shingle; containment is over distinct shingles.
CONTAMINATED = r"""
WITH items AS (
  SELECT row_number() OVER () AS i, item_id, least(len(ws), 5) AS width, ws
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS ws
        FROM benchmark)
  WHERE len(ws) > 0),
item_shingles AS (
  SELECT DISTINCT i, width, array_to_string(ws[k:k + width - 1], ' ') AS s
  FROM (SELECT i, width, ws, unnest(range(1, len(ws) - width + 2)) AS k FROM items)),
sizes AS (SELECT i, count(*) AS n_item FROM item_shingles GROUP BY i),
docs AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS ws
  FROM documents),
doc_shingles AS (
  SELECT d, width, array_to_string(ws[k:k + width - 1], ' ') AS s
  FROM (SELECT d, width, ws, unnest(range(1, len(ws) - width + 2)) AS k
        FROM docs, (SELECT DISTINCT width FROM items))),
shared AS (
  SELECT d, i, count(DISTINCT s) AS n_shared
  FROM doc_shingles JOIN item_shingles USING (width, s) GROUP BY d, i)
SELECT doc_id, item_id, n_shared, n_item,
       CAST(n_shared AS DOUBLE) / n_item AS containment
FROM shared JOIN sizes USING (i) JOIN items USING (i) JOIN docs USING (d)
WHERE 5 * n_shared >= 4 * n_item
"""

#: Two lines are within one edit when they are equal without the character at the same place, or
#: when one without a character is the other. Lines under 20 characters go if they are equal only.
WITHOUT_REPEATS = r"""
WITH parts AS (
  SELECT doc_id, no, raw, trim(raw, ' ') AS line
  FROM (SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS no
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
              WHERE text IS NOT NULL))),
placed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, no) AS place FROM parts),
firsts AS (
  SELECT line, min(place) AS place FROM placed WHERE line <> '' GROUP BY line),
long AS (SELECT * FROM firsts WHERE length(line) >= 20),
variants AS (
  SELECT line, place, p, substring(line, 1, p - 1) || substring(line, p + 1) AS v
  FROM (SELECT line, place, unnest(range(1, length(line) + 1)) AS p FROM long)),
swapped AS (
  SELECT line FROM (SELECT line, place, min(place) OVER (PARTITION BY p, v) AS earliest
                    FROM variants) WHERE place > earliest),
longer AS (
  SELECT a.line AS one, a.place AS place_one, b.line AS other, b.place AS place_other
  FROM variants a JOIN long b ON a.v = b.line),
near AS (
  SELECT line FROM swapped
  UNION SELECT CASE WHEN place_one > place_other THEN one ELSE other END FROM longer),
judged AS (
  SELECT p.doc_id, p.no, p.raw,
         f.line IS NOT NULL AND (n.line IS NOT NULL OR p.place <> f.place) AS gone
  FROM placed p LEFT JOIN firsts f ON p.line = f.line LEFT JOIN near n ON p.line = n.line),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, k.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text IS NOT NULL
"""

#: Every document is a row; shares are whole numbers.
DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
         coalesce(source, '') AS source FROM documents),
words AS (
  SELECT d, lang, source,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
full_counts AS (
  SELECT lang, source, term, coalesce(n, 0) AS n
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
  FROM full_counts JOIN sizes USING (lang)),
lang_counts AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term),
lang_shares AS (
  SELECT lang, term,
         1 + (1000000000 * n::HUGEINT + 5000000000) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM lang_counts JOIN sizes USING (lang)),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value
  FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part
                               ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: Codebooks of 64 entries for 16 parts, two rounds; whole numbers throughout.
VECTOR_CODES = r"""
WITH kept AS (
  SELECT row_number() OVER () AS i, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (
  SELECT i, p, list_slice(v, p * len(v) // 16 + 1, (p + 1) * len(v) // 16) AS x
  FROM kept, (SELECT unnest(range(16)) AS p)),
start AS (
  SELECT p, e, x AS c FROM cells
  JOIN (SELECT i, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (i) WHERE e < 64),
near1 AS (
  SELECT i, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c),
                                                lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
  FROM cells JOIN start USING (p) GROUP BY i, p),
sums1 AS (
  SELECT p, best.e AS e, k, sum(x[k]) AS s, count(*) AS n
  FROM near1 JOIN cells USING (i, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM cells))) AS k)
  GROUP BY ALL),
book1 AS (
  SELECT p, e, coalesce(new.c, old.c) AS c
  FROM start old LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM sums1 GROUP BY p, e) new
  USING (p, e)),
near2 AS (
  SELECT i, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c),
                                                lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
  FROM cells JOIN book1 USING (p) GROUP BY i, p),
sums2 AS (
  SELECT p, best.e AS e, k, sum(x[k]) AS s, count(*) AS n
  FROM near2 JOIN cells USING (i, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM cells))) AS k)
  GROUP BY ALL),
book2 AS (
  SELECT p, e, coalesce(new.c, old.c) AS c
  FROM book1 old LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM sums2 GROUP BY p, e) new
  USING (p, e)),
near3 AS (
  SELECT i, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c),
                                                lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
  FROM cells JOIN book2 USING (p) GROUP BY i, p),
codes AS (
  SELECT i, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code,
         CAST(sum(best.d) AS BIGINT) AS error
  FROM near3 GROUP BY i),
digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       codebooks_sha256
FROM codes JOIN kept USING (i), digest
"""
