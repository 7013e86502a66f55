"""DuckDB SQL for the queries of this subpackage that SQL can express."""

SQL: dict[str, str] = {}

SQL["p2_found"] = """
WITH v AS (
  SELECT DISTINCT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM index_vectors
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS q, b.vec_id AS n, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
ranked AS (SELECT q, n, c, row_number() OVER (PARTITION BY q ORDER BY c DESC, n) AS r FROM pairs)
SELECT DISTINCT least(q, n) AS vec_id_a, greatest(q, n) AS vec_id_b FROM ranked WHERE r <= 5 AND c >= 0.95
"""

SQL["p2_top5"] = """
WITH v AS (
  SELECT DISTINCT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM index_vectors
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour_id) AS r FROM pairs)
SELECT vec_id, neighbour_id FROM ranked WHERE r <= 5
"""

SQL["p5_found"] = r"""
WITH t AS (
  SELECT DISTINCT answer_id, lower(trim(regexp_replace(coalesce(raw_text, text), '[\s\x{0b}\x{85}\x{a0}\x{2028}\x{2029}\p{Zs}]+', ' ', 'g'))) AS s FROM answers),
long AS (SELECT answer_id, s, length(s) AS n FROM t WHERE length(s) >= 80),
grams AS (SELECT answer_id, n, i, substr(s, i::BIGINT, 24) AS g FROM long, unnest(range(1, n - 22)) AS u(i)),
again AS (
  SELECT answer_id, n, i FROM (SELECT *, min(i) OVER (PARTITION BY answer_id, g) AS f FROM grams) WHERE i > f),
gaps AS (
  SELECT answer_id, n, least(24, coalesce(lead(i) OVER (PARTITION BY answer_id ORDER BY i) - i, 24)) AS covered FROM again)
SELECT answer_id FROM gaps GROUP BY answer_id, n HAVING sum(covered) >= 0.5 * n
"""

SQL["p6_found"] = """
SELECT DISTINCT 'chunk' AS item_kind, chunk_no AS item_id FROM chunks WHERE length(source) > 2000
UNION ALL
SELECT DISTINCT 'part' AS item_kind, part_id AS item_id FROM embedding_parts WHERE length(text) > 2000
"""

SQL["p8_found"] = r"""
WITH w AS (
  SELECT DISTINCT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents
  UNION ALL
  SELECT DISTINCT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items WHERE lower(trim(split)) = 'heldout'),
grams AS (
  SELECT side, id, array_to_string(ws[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) AS u(i))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i USING (g) WHERE d.side = 'd' AND i.side = 'i'
"""

# more than 16 chunks of equal text come out as pairs with the first of them, which alone is paired with others
_SHINGLED = r"""
WITH c AS (
  SELECT DISTINCT chunk_no, source, regexp_extract_all(lower(source), '[a-z0-9_]+') AS ws FROM chunks
  WHERE coalesce(lower(trim(kind)), '') NOT IN ('class', 'module')),
k AS (
  SELECT *, count(*) OVER (PARTITION BY md5(source)) AS copies, min(chunk_no) OVER (PARTITION BY md5(source)) AS first FROM c WHERE len(ws) >= 40),
t AS (
  SELECT DISTINCT chunk_no, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM k, unnest(range(1, len(ws) - 1)) AS u(i)),
n AS (SELECT chunk_no, count(*) AS k FROM t GROUP BY chunk_no),
shared AS (
  SELECT a.chunk_no AS x, b.chunk_no AS y, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.chunk_no < b.chunk_no GROUP BY 1, 2),
alike AS (
  SELECT x, y FROM shared JOIN n p ON p.chunk_no = x JOIN n q ON q.chunk_no = y WHERE shared.k >= 0.6 * (p.k + q.k - shared.k))
"""

SQL["p4_found"] = _SHINGLED + """
SELECT x AS chunk_no_a, y AS chunk_no_b FROM alike JOIN k p ON p.chunk_no = x JOIN k q ON q.chunk_no = y
WHERE ((p.copies <= 16 OR p.first = x) AND (q.copies <= 16 OR q.first = y)) OR (p.source = q.source AND p.first = x)
"""

SQL["p4_groups"] = _SHINGLED.replace("WITH c", "WITH RECURSIVE c") + """, sets AS (SELECT chunk_no, min(p) AS rep FROM (
    SELECT y AS chunk_no, x AS p FROM alike JOIN n a ON a.chunk_no = x JOIN n b ON b.chunk_no = y JOIN shared USING (x, y) WHERE a.k = b.k AND a.k = shared.k
    UNION ALL SELECT chunk_no, chunk_no FROM n) GROUP BY chunk_no),
twoway AS (SELECT x AS u, y AS v FROM alike UNION ALL SELECT y, x FROM alike),
walk AS (
  SELECT u, u AS root FROM twoway UNION SELECT b.v, w.root FROM walk w JOIN twoway b ON b.u = w.u WHERE w.root < b.v),
grp AS (SELECT u AS chunk_no, min(root) AS group_id FROM walk GROUP BY u),
links AS (
  SELECT a.rep, count(DISTINCT b.rep) AS n FROM twoway JOIN sets a ON a.chunk_no = u JOIN sets b ON b.chunk_no = v WHERE a.rep <> b.rep GROUP BY a.rep)
SELECT chunk_no, group_id, coalesce(n, 0)::BIGINT AS n_links FROM grp JOIN sets USING (chunk_no) LEFT JOIN links USING (rep)
"""

_CROSSING = r"""
WITH q AS (
  SELECT DISTINCT question_id AS id, corpus,
    CASE WHEN regexp_replace(lower(split), '[^\p{L}]', '', 'g') = 'heldout' THEN 'heldout' ELSE 'tune' END AS part,
    regexp_extract_all(lower(question), '[\p{L}\p{N}_]+') AS ws, relevant FROM questions),
d AS (SELECT id, corpus, part, ws, list_distinct(ws) AS dw, list_filter(relevant, lambda r: r <> '') AS rel FROM q WHERE len(ws) > 0),
pairs AS (
  SELECT h.id AS id, t.id AS other, h.ws = t.ws AS same FROM d h JOIN d t ON h.part = 'heldout' AND t.part = 'tune'
  WHERE h.ws = t.ws OR (len(list_intersect(h.rel, t.rel)) > 0
    AND len(list_intersect(h.dw, t.dw)) >= 0.6 * (len(h.dw) + len(t.dw) - len(list_intersect(h.dw, t.dw)))))
"""

SQL["p7_found"] = _CROSSING + "SELECT least(id, other) AS question_id_a, greatest(id, other) AS question_id_b FROM pairs"

SQL["p7_counts"] = _CROSSING + """, hit AS (
  SELECT id, max(same) AS same, count(*) AS pairs FROM (
    SELECT id, same FROM pairs UNION ALL SELECT other, same FROM pairs) GROUP BY id)
SELECT part AS split, corpus, count(*) AS questions, count(pairs) AS overlapping, count(*) FILTER (WHERE same) AS same,
  coalesce(sum(pairs), 0)::BIGINT AS pairs FROM (SELECT DISTINCT id, corpus, part FROM q) LEFT JOIN hit USING (id) GROUP BY ALL
"""

SQL["p8_spans"] = r"""
WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE lower(trim(split)) = 'heldout'),
ig AS (SELECT DISTINCT item_id, array_to_string(ws[k:k + 12], ' ') AS g FROM i, unnest(range(1, len(ws) - 11)) AS u(k)),
d AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws, regexp_split_to_array(lower(text), '[\p{L}\p{N}]+') AS gaps FROM documents),
dg AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS g FROM d, unnest(range(1, len(ws) - 11)) AS u(k)),
hit AS (SELECT DISTINCT doc_id, item_id, k FROM dg JOIN ig USING (g)),
cut AS (SELECT *, coalesce(k > lag(k) OVER w + 13, true) AS fresh FROM hit WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY k)),
run AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS n FROM cut),
span AS (SELECT doc_id, item_id, min(k) AS a, max(k) + 12 AS b FROM run GROUP BY doc_id, item_id, n)
SELECT doc_id, item_id,
  (list_sum(list_transform(gaps[1:a], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:a - 1], lambda x: length(x))), 0))::INT AS start_pos,
  (list_sum(list_transform(gaps[1:b], lambda x: length(x))) + list_sum(list_transform(ws[1:b], lambda x: length(x))))::INT AS end_pos,
  (b - a + 1)::INT AS n_words
FROM span JOIN d USING (doc_id)
"""

SQL["p9_by_chars"] = r"""
WITH goal AS (
  SELECT source, max(target_share) AS share, greatest(max(coalesce(max_repeats, 1)), 1) AS repeats FROM (
    SELECT regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g') AS source, target_share, max_repeats FROM mix_targets)
  WHERE target_share > 0 AND source IS NOT NULL GROUP BY source),
docs AS (
  SELECT DISTINCT ON (doc_id) doc_id, regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g') AS source, n_chars FROM documents
  WHERE source IS NOT NULL AND length(text) > 0 AND n_chars > 0),
total AS (SELECT source, sum(n_chars) AS total, any_value(share) AS share, any_value(repeats) AS repeats FROM docs JOIN goal USING (source) GROUP BY source),
plan AS (SELECT *, share / (SELECT sum(share) FROM total) AS weight FROM total),
most AS (SELECT min(total * repeats / weight) AS budget FROM plan),
laid AS (
  SELECT doc_id, source, n_chars, sum(n_chars) OVER (
    PARTITION BY source ORDER BY left(md5(concat_ws(':', doc_id, 1)), 16), doc_id ROWS UNBOUNDED PRECEDING) AS running FROM docs JOIN plan USING (source)),
each AS (
  SELECT doc_id, source, n_chars, c AS copy_no, (c * total + running) / weight AS finish, (c * total + running - n_chars) / weight AS begins
  FROM laid JOIN plan USING (source), unnest(range(0, repeats::BIGINT)) AS u(c)),
taken AS (
  SELECT *, sum(n_chars) OVER (ORDER BY finish, source, doc_id, copy_no ROWS UNBOUNDED PRECEDING) AS place_end FROM each, most WHERE begins < budget)
SELECT doc_id, source, copy_no::INT AS copy_no, n_chars, place_end::BIGINT AS place_end FROM taken WHERE place_end <= budget
"""
