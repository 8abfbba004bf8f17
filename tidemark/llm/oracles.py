"""SQL of the queries that SQL can express, for DuckDB on the same tables."""

OP1 = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) END) AS shingles
  FROM words
),
items AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
),
links AS (SELECT u, v FROM shared WHERE 100 * c >= 90 * (n + m - c)),
reach AS (
  SELECT doc_id AS node, doc_id AS label FROM sets
  UNION
  SELECT links.v, reach.label FROM reach JOIN links ON links.u = reach.node
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, min(r.label) AS component_id
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.shingles
"""

OP8 = """
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n, pow(count(*), 0.5) AS weight FROM documents GROUP BY source
),
rates AS (
  SELECT source, n, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes
),
pieces AS (
  SELECT source, greatest(1, CAST(ceil(rate / 16) AS INTEGER)) AS pieces, rate / greatest(1, ceil(rate / 16)) AS mean
  FROM rates
),
terms AS (
  SELECT source, 0 AS k, exp(-mean) AS p, exp(-mean) AS below, mean FROM pieces
  UNION ALL
  SELECT source, k + 1, p * mean / (k + 1), below + p * mean / (k + 1), mean FROM terms WHERE k < 100
),
spread AS (SELECT source, list(below ORDER BY k) AS cdf FROM terms GROUP BY source),
drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
    (SELECT sum(len(list_filter(s.cdf, lambda c: c <= CAST(concat('0x', substr(md5(concat('20240:',
        md5(concat(coalesce(CAST(d.doc_id AS VARCHAR), 'null'), chr(31), coalesce(d.text, 'null'))), ':', i)), 1, 13))
        AS BIGINT) / 4503599627370496.0)))
     FROM generate_series(1, p.pieces) AS g(i)) AS copies
  FROM documents d
  JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source
  JOIN spread s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, text, lang, source, n_chars, copy, CAST(copies AS BIGINT) AS copies
FROM drawn, generate_series(1, CAST(copies AS BIGINT)) AS c(copy)
"""

OP10 = """
WITH prints AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
),
typed AS (
  SELECT *, payload_bytes >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY payload_digest) AS again,
         max(page_id) OVER (PARTITION BY payload_digest) AS largest
  FROM prints
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN largest END AS refers_to
FROM typed
"""

OP9 = r"""
WITH prints AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM prints WINDOW same AS (PARTITION BY text_sha256)
"""



def _op11(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """A codebook table per round; ``nearest_r`` has the parts' entries in codebook ``r``."""
    steps = [
        f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cut AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS s
  FROM kept, range({parts}) AS parts(p)
),
firsts AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept),
book_0 AS MATERIALIZED (SELECT p, e, s FROM cut JOIN firsts USING (r) WHERE e < {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
nearest_{i} AS MATERIALIZED (
  SELECT r, p, any_value(c.s) AS s, min({{'d': CAST(coalesce(list_sum(list_transform(range(1, len(c.s) + 1),
    lambda j: (c.s[j] - b.s[j]) * (c.s[j] - b.s[j]))), 0) AS BIGINT), 'e': e}}) AS best
  FROM cut c JOIN book_{i} b USING (p) GROUP BY r, p
)""")
        if i < rounds:
            steps.append(f"""
mean_{i} AS (
  SELECT p, best.e AS e, j, CAST(floor(CAST(sum(s[j]) AS DOUBLE) / count(*)) AS BIGINT) AS m
  FROM nearest_{i}, unnest(range(1, len(s) + 1)) AS places(j) GROUP BY p, best.e, j
),
book_{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.s, b.s) AS s
  FROM book_{i} b LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS s FROM mean_{i} GROUP BY p, e) n USING (p, e)
)""")
    return f"""WITH {",".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM nearest_{rounds} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) FROM book_{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


OP12 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
failing AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e
  FROM texts
),
flags AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
masks AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failing LEFT JOIN flags USING (doc_id) GROUP BY part, a, b, c, d, e
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT concat(p.f, q.f, r.f, s.f, u.f) AS filter_order
  FROM letters p JOIN letters q ON q.f <> p.f JOIN letters r ON r.f NOT IN (p.f, q.f)
    JOIN letters s ON s.f NOT IN (p.f, q.f, r.f) JOIN letters u ON u.f NOT IN (p.f, q.f, r.f, s.f)
),
gone AS (
  SELECT m.*, filter_order, least(
      CASE WHEN a THEN strpos(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 6 END,
      CASE WHEN c THEN strpos(filter_order, 'C') ELSE 6 END, CASE WHEN d THEN strpos(filter_order, 'D') ELSE 6 END,
      CASE WHEN e THEN strpos(filter_order, 'E') ELSE 6 END) AS place
  FROM masks m CROSS JOIN orders
),
steps AS (
  SELECT *, substr(filter_order, step, 1) AS f,
    CASE substr(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
    CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(d AS INTEGER) + CAST(e AS INTEGER) AS failures
  FROM gone, range(1, 6) AS numbers(step)
),
counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, f,
    sum(CASE WHEN place > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN place = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND place < step THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails AND failures = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN place = step THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN place = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

ORACLES = {
    "op1_topk": OP1,
    "op7_jaccard_join": OP7,
    "op8_mixing": OP8,
    "op9_exact_dedup": OP9,
    "op10_warc": OP10,
    "op11_vector_codes": _op11(),
    "op12_filter_audit": OP12,
}
