"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
WITH rules(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT page_id, max_by(h || p, length(h) * 1000 + length(p)) AS rule, max_by(verdict, length(h) * 1000 + length(p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.page_id = best.page_id
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(range(len(w))) AS d, unnest(w) AS x FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM e q JOIN e c ON q.d = c.d WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP7 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('29:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS idx FROM s),
w2 AS (SELECT *, 3 * source_size AS cap, CASE (idx - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM w),
w3 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0 FROM w2),
w4 AS (SELECT *, cap * (all_weight - w0) + c0 * weight <= all_size * weight AS capped FROM w3),
w5 AS (SELECT *, all_size - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS rest, sum(CASE WHEN NOT capped THEN weight END) OVER () AS rest_weight FROM w4),
t AS (SELECT source, idx, source_size, all_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(rest_weight AS DOUBLE) END AS target FROM w5),
seats AS (SELECT idx, unnest(range(1, CAST(floor(target / 16) AS BIGINT) + (SELECT count(*) FROM t) + 2)) AS seat, target FROM t WHERE target > 0),
won AS (SELECT idx, seat, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, idx) AS r FROM seats),
q AS (SELECT idx, count(*) AS blocks FROM won WHERE r <= (SELECT floor(round(max(all_size) / 16)) FROM t) GROUP BY idx),
p AS (SELECT t.*, least(coalesce(q.blocks, 0) * 16, 3 * source_size) AS words FROM t LEFT JOIN q ON t.idx = q.idx),
tape AS (SELECT d.doc_id, d.size, d.source, p.source_size, p.target, p.words,
           CAST(sum(d.size) OVER (PARTITION BY p.idx ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
         FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS full_reads FROM tape)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(full_reads * size + least(greatest(words - full_reads * source_size - start, 0), size) AS BIGINT) AS taken
FROM e
"""

OP11 = r"""
WITH split AS (
  SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 'i', coalesce(CAST(item_id AS VARCHAR), 'null'), row_number() OVER (), text FROM benchmark),
w AS (SELECT side, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM split),
wins AS (SELECT DISTINCT id AS item, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT id, w, least(len(w), 10) AS n FROM w WHERE side = 'i' AND len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM wins),
own AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, lengths WHERE side = 'd' AND len(w) >= n)),
hits AS (SELECT own.r, own.s, own.n, item FROM own JOIN wins ON own.win = wins.win AND own.n = wins.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT CAST(w.id AS BIGINT) AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words ON words.r = w.r LEFT JOIN found ON found.r = w.r WHERE side = 'd'
"""


def _op13(rounds: int = 2) -> str:
    """One pair of tables for each round: the parts' entries, then the new codebooks."""
    dist = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    met = lambda n: f"a{n} AS MATERIALIZED (SELECT r, part, min({dist} * 64 + entry) AS near FROM p JOIN c{n} USING (part) GROUP BY r, part)"
    out = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, part, x[part * (len(x) // 16) + 1:(part + 1) * (len(x) // 16)] AS x FROM v, (SELECT unnest(range(16)) AS part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 64),
"""
    for n in range(rounds):
        out += f"""{met(n)},
m{n} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
  SELECT part, near % 64 AS entry, i, CAST(sum(x[i]) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM (SELECT p.part, near, x, unnest(range(1, len(x) + 1)) AS i FROM p JOIN a{n} ON p.r = a{n}.r AND p.part = a{n}.part) GROUP BY ALL) GROUP BY part, entry),
c{n + 1} AS MATERIALIZED (SELECT c{n}.part, c{n}.entry, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} ON c{n}.part = m{n}.part AND c{n}.entry = m{n}.entry),
"""
    return out + f"""{met(rounds)},
e AS (SELECT r, string_agg(printf('%02x', near % 64), '' ORDER BY part) AS code, CAST(sum(near // 64) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e ON v.r = e.r, s
"""


OP13 = _op13()

ORACLES = {"op3_url_filter": OP3, "op5_topk": OP5, "op7_mix": OP7, "op11_decontaminate": OP11, "op13_codes": OP13}
