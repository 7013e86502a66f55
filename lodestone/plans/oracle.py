"""DuckDB SQL for the queries of the engine."""

from __future__ import annotations

from ..functions.text import NEAR_MISS, QUERY_STOPWORDS, TERM_STOPWORDS

SQL: dict[str, str] = {}


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_C = """c AS (
  SELECT DISTINCT ON (chunk_no) * REPLACE (CASE WHEN lower(trim(kind)) = 'def' THEN 'function' ELSE lower(trim(kind)) END AS kind),
    concat_ws('.', parent, symbol) AS qualname FROM chunks ORDER BY chunk_no, indexed_at DESC)"""
_Q = """q AS (
  SELECT DISTINCT ON (question_id) * REPLACE (CASE WHEN regexp_replace(lower(split), '[^a-z]', '', 'g') = 'heldout' THEN 'heldout' ELSE 'tune' END AS split)
  FROM questions ORDER BY question_id, created_at DESC)"""
_A = "a AS (SELECT DISTINCT ON (answer_id) * FROM answers ORDER BY answer_id, logged_at DESC)"
_H = "h AS (SELECT DISTINCT ON (question_id, hit_rank, chunk_no) * FROM hits ORDER BY question_id, hit_rank, chunk_no, searched_at)"
_R = """r AS (
  SELECT DISTINCT w.question_id, c.chunk_no FROM (SELECT question_id, corpus, unnest(relevant) AS chunk_id FROM q) w JOIN c USING (corpus, chunk_id))"""
_WORDS = r"regexp_extract_all({}, '[\p{{L}}_][\p{{L}}\p{{N}}_]*|\p{{Nd}}+')"


def _words(x: str) -> str:
    return _WORDS.format(x)


def _parts(w: str) -> str:
    cut = rf"regexp_replace(regexp_replace({w}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')"
    return f"list_filter(string_split(lower({cut}), '_'), lambda p: p <> '')"


def _tokens(w: str) -> str:
    """The tokens of one word."""
    return f"CASE WHEN len({_parts(w)}) > 1 OR (len({_parts(w)}) = 1 AND {_parts(w)}[1] <> lower({w})) THEN list_prepend(lower({w}), {_parts(w)}) ELSE [lower({w})] END"


def _code_tokens(x: str) -> str:
    return f"flatten(list_transform({_words(x)}, lambda w: {_tokens('w')}))"


SQL["tokenize_words"] = f"WITH {_C} SELECT corpus, word, count(*) AS n FROM (SELECT corpus, unnest({_words('source')}) AS word FROM c) GROUP BY ALL"

SQL["tokenize_identifier"] = f"WITH {_C} SELECT symbol, array_to_string({_tokens('symbol')}, ' ') AS tokens FROM (SELECT DISTINCT symbol FROM c WHERE symbol IS NOT NULL)"

_QT = f"""
qw AS (
  SELECT question_id, corpus, i, n, unnest({_words('piece')}) AS word FROM (
    SELECT question_id, corpus, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS i, len(pieces) AS n
    FROM (SELECT *, string_split(question, '`') AS pieces FROM q WHERE question IS NOT NULL))),
named AS (SELECT DISTINCT corpus, lower(symbol) AS name FROM c WHERE kind <> 'module' AND symbol IS NOT NULL),
qk AS (
  SELECT qw.question_id, qw.corpus, word FROM qw LEFT JOIN named ON named.corpus = qw.corpus AND named.name = lower(word)
  WHERE lower(word) NOT IN ({_list(QUERY_STOPWORDS)}) OR (i % 2 = 1 AND i < n - 1) OR contains(word, '_')
    OR (regexp_matches(word, '^.\\P{{Lu}}*\\p{{Lu}}') AND regexp_matches(word, '\\p{{Ll}}')) OR named.name IS NOT NULL),
qt AS (
  SELECT question_id, corpus, token, count(*) AS qtf FROM (SELECT question_id, corpus, unnest({_tokens('word')}) AS token FROM qk) GROUP BY ALL)"""
SQL["query_tokens"] = f"WITH {_C}, {_Q}, {_QT} SELECT question_id, token, qtf FROM qt"

_TERMS = f"list_distinct(list_filter({_code_tokens('question')}, lambda t: length(t) > 1 AND t NOT IN ({_list(TERM_STOPWORDS)})))"
SQL["query_terms"] = f"WITH {_Q} SELECT question_id, unnest({_TERMS}) AS term FROM q"

_DOC = r"trim(regexp_replace(docstring, '[\s\x0b]+', ' ', 'g'))"
_HEADER = f"""hd AS (
  SELECT chunk_no, coalesce(source, '') AS source, '# file: ' || coalesce(path, '') || chr(10) || '# symbol: ' || qualname || ' (' || coalesce(kind, '') || ')' || chr(10) ||
    CASE WHEN length(coalesce(docstring, '')) > 0 THEN '# doc: ' || CASE WHEN length({_DOC}) > 400 THEN rtrim(left({_DOC}, 400)) || '…' ELSE {_DOC} END || chr(10) ELSE '' END AS header FROM c)"""
SQL["embedding_headers"] = f"WITH {_C}, {_HEADER} SELECT chunk_no, header FROM hd"
SQL["content_hash"] = f"WITH {_C}, {_HEADER} SELECT chunk_no, left(sha256('hash-64' || chr(0) || header || source), 32) AS hash FROM hd"

SQL["module_paths"] = rf"""
WITH {_C} SELECT path, replace(regexp_replace(regexp_replace(regexp_replace(path, '\.[^./]+$', ''), '^src/(.)', '\1'), '(?:^|/)__init__$', ''), '/', '.') AS module,
  regexp_matches(path, '(?:^|/)tests?/') OR regexp_matches(path, '(?:^|/)(?:test_[^/]*|[^/]*_test\.py|conftest\.py)$') AS is_test
FROM (SELECT DISTINCT path FROM c WHERE path IS NOT NULL)"""

SQL["signatures"] = rf"""
WITH {_C} SELECT chunk_no, CASE WHEN kind <> 'module' THEN
  trim(list_filter(string_split(source, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\s*[@#]'))[1], ' ') END AS signature FROM c"""

SQL["normalised_vectors"] = """
WITH v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM index_vectors
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT vec_id, (unnest(generate_series(0, 63)))::INTEGER AS axis, round(unnest(e) / sqrt(list_sum([x * x FOR x IN e])), 6) AS value FROM v"""

_T = f"t AS (SELECT corpus, chunk_no, {_code_tokens('concat_ws(' + repr(' ') + ', path, qualname, coalesce(source, ' + repr('') + '))')} AS tokens FROM c)"
SQL["doc_lengths"] = f"WITH {_C}, {_T} SELECT chunk_no, len(tokens)::INTEGER AS n_tokens FROM t"
SQL["term_df_idf"] = f"""
WITH {_C}, {_T}, docs AS (SELECT corpus, count(*) AS docs FROM t GROUP BY corpus),
d AS (SELECT corpus, token, count(*) AS df FROM (SELECT corpus, unnest(list_distinct(tokens)) AS token FROM t) GROUP BY ALL)
SELECT corpus, token, df, round(ln(1e0 + (docs - df + 0.5e0) / (df + 0.5e0)), 6) AS idf FROM d JOIN docs USING (corpus)"""

_BM25 = f"""{_T}, st AS (SELECT corpus, count(*) AS docs, avg(len(tokens)) AS avgdl FROM t GROUP BY corpus),
tf AS (SELECT corpus, chunk_no, dl, token, count(*) AS tf FROM (SELECT corpus, chunk_no, len(tokens) AS dl, unnest(tokens) AS token FROM t) GROUP BY ALL),
df AS (SELECT corpus, token, count(*) AS df FROM tf GROUP BY ALL),
bs AS (
  SELECT question_id, chunk_no, round(sum(qtf * ln(1e0 + (docs - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (corpus, token) JOIN df USING (corpus, token) JOIN st USING (corpus) GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_no) AS rk FROM bs WHERE score > 0)"""
SQL["bm25_topk"] = f"WITH {_C}, {_Q}, {_QT}, {_BM25} SELECT question_id, rk::INTEGER AS bm25_rank, chunk_no, score FROM bm WHERE rk <= 10"

_DENSE = """uv AS (
  SELECT * REPLACE ([x::DOUBLE FOR x IN embedding] AS embedding) FROM index_vectors
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pv AS (SELECT part_id, arg_max(embedding, (generation, vec_id)) AS e FROM uv WHERE part_id IS NOT NULL GROUP BY 1),
qv AS (SELECT question_id, arg_max(embedding, (generation, vec_id)) AS e FROM uv WHERE question_id IS NOT NULL GROUP BY 1),
ps AS (SELECT c.corpus, p.chunk_no, p.part_no, pv.e FROM (SELECT DISTINCT part_id, chunk_no, part_no FROM embedding_parts) p JOIN pv USING (part_id) JOIN c ON c.chunk_no = p.chunk_no),
ds AS (
  SELECT q.question_id, ps.chunk_no, ps.part_no, round(list_cosine_similarity(qv.e, ps.e), 5) + 0e0 AS cosine FROM q JOIN qv USING (question_id) JOIN ps ON ps.corpus = q.corpus),
db AS (SELECT DISTINCT ON (question_id, chunk_no) * FROM ds ORDER BY question_id, chunk_no, cosine DESC, part_no),
dn AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, chunk_no) AS rk FROM db)"""
SQL["dense_topk"] = f"WITH {_C}, {_Q}, {_DENSE} SELECT question_id, rk::INTEGER AS dense_rank, chunk_no, part_no, cosine FROM dn WHERE rk <= 10"
_NUMBERS = "CASE WHEN len(spans) > 0 THEN list_sort(list_distinct(flatten(list_transform(spans, lambda s: range(s.start_line, s.end_line + 1))))) ELSE range(start_line, end_line + 1) END"
SQL["dense_part_lines"] = f"""
WITH {_C}, {_Q}, {_DENSE}, p AS (SELECT chunk_no, part_no, min(first_line) AS f, max(last_line) AS l FROM embedding_parts GROUP BY ALL),
n AS (SELECT chunk_no, {_NUMBERS} AS nums FROM c)
SELECT question_id, chunk_no, part_no, nums[least(f, len(nums) - 1) + 1]::INTEGER AS from_line, nums[least(l, len(nums) - 1) + 1]::INTEGER AS to_line
FROM dn JOIN p USING (chunk_no, part_no) JOIN n USING (chunk_no) WHERE rk <= 10"""

_FUSE = """
fs AS (SELECT {k}, item, round(sum(weight / (kk + item_rank)), 9) AS score, min(item_rank) AS best FROM lists GROUP BY ALL),
fu AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, best, item) AS rk FROM fs)"""
SQL["rrf_fused"] = f"""
WITH {_C}, {_Q}, {_QT}, {_BM25}, {_DENSE},
lists AS (
  SELECT question_id, chunk_no AS item, rk AS item_rank, 1e0 AS weight, 60 AS kk FROM bm WHERE rk <= 50
  UNION ALL SELECT question_id, chunk_no, rk, 1e0, 60 FROM dn WHERE rk <= 50), {_FUSE.format(k='question_id')}
SELECT question_id, rk::INTEGER AS fused_rank, item AS chunk_no, score FROM fu WHERE rk <= 10"""

# the engine's own lists, and the default's order as ``h``
_L = f"""{_QT}, {_BM25}, {_DENSE},
l AS (SELECT question_id, chunk_no, 'bm25' AS source, rk AS item_rank FROM bm WHERE rk <= 200 UNION ALL SELECT question_id, chunk_no, 'dense', rk FROM dn WHERE rk <= 200)"""
_OWN = f"""{_L}, lists AS (SELECT question_id, chunk_no AS item, item_rank, 1e0 AS weight, 60 AS kk FROM l), {_FUSE.format(k='question_id')},
h AS (SELECT question_id, item AS chunk_no, rk AS hit_rank FROM fu)"""
_SWEPT = f"""cf AS (
  SELECT (row_number() OVER () - 1)::INTEGER AS config, kk, ww FROM (SELECT kk, ww FROM (SELECT unnest([5, 10, 20, 60]) AS kk), (SELECT unnest([1e0, 1.5e0, 2e0, 3e0]) AS ww) ORDER BY kk, ww)),
lists AS (
  SELECT config, question_id, chunk_no AS item, source, min(item_rank) AS item_rank, CASE WHEN source = 'dense' THEN ww ELSE 1e0 END AS weight, kk
  FROM l, cf WHERE source IN ('bm25', 'dense') GROUP BY ALL), {_FUSE.format(k='config, question_id')}"""
SQL["rrf_weighted_sweep"] = f"WITH {_C}, {_Q}, {_L}, {_SWEPT} SELECT config, question_id, rk::INTEGER AS fused_rank, item AS chunk_no, score FROM fu"
SQL["single_mode"] = f"""
WITH {_C}, {_Q}, {_L}, lists AS (SELECT question_id, chunk_no AS item, min(item_rank) AS item_rank, 1e0 AS weight, 60 AS kk FROM l WHERE source = 'dense' GROUP BY ALL), {_FUSE.format(k='question_id')}
SELECT question_id, rk::INTEGER AS fused_rank, item AS chunk_no, score FROM fu"""

SQL["budget_merge"] = f"""
WITH {_C}, {_Q}, {_OWN}, b AS (SELECT question_id, chunk_no, item_rank AS br FROM l WHERE source = 'dense' AND item_rank <= 10),
e AS (SELECT coalesce(h.question_id, b.question_id) AS question_id, coalesce(h.chunk_no, b.chunk_no) AS chunk_no, hit_rank, br, coalesce(br <= 3, false) AS kept
  FROM h FULL JOIN b ON h.question_id = b.question_id AND h.chunk_no = b.chunk_no),
f AS (SELECT *, sum((br IS NULL)::INT) OVER (PARTITION BY question_id, kept ORDER BY hit_rank, chunk_no ROWS UNBOUNDED PRECEDING) AS n_out,
  sum(kept::INT) OVER (PARTITION BY question_id) AS n_kept FROM e WHERE hit_rank IS NOT NULL OR kept),
g AS (SELECT *, NOT kept AND (br IS NOT NULL OR n_out <= 3) AS adm FROM f),
p AS (SELECT *, sum(adm::INT) OVER (PARTITION BY question_id, kept ORDER BY hit_rank, chunk_no ROWS UNBOUNDED PRECEDING) AS place FROM g),
z AS (SELECT *, CASE WHEN kept THEN 0 WHEN adm AND place <= 10 - n_kept THEN 1 ELSE 2 END AS zone FROM p)
SELECT question_id, chunk_no, row_number() OVER (PARTITION BY question_id ORDER BY zone, CASE WHEN zone = 0 THEN br ELSE hit_rank END, chunk_no)::INTEGER AS final_rank FROM z"""

SQL["dense_relevance"] = f"""
WITH {_C}, {_Q}, {_DENSE}, s AS (SELECT question_id, chunk_no, cosine AS x FROM dn WHERE rk <= 200),
m AS (SELECT *, max(x) OVER (PARTITION BY question_id) AS best FROM s WHERE x IS NOT NULL AND NOT isnan(x))
SELECT question_id, chunk_no, round(CASE WHEN best > 0 THEN least(greatest(x / best, 0e0), 1e0) ELSE 0e0 END, 6) AS relevance FROM m"""

_EDGES = r"""sy AS (SELECT corpus, symbol, count(*) AS n, min(chunk_no) AS dst, min(kind) AS target FROM c WHERE kind IN ('function', 'class') GROUP BY ALL),
me AS (
  SELECT chunk_no, corpus, path, unnest(list_distinct(regexp_extract_all(regexp_replace(source, '(def|class)\s+[A-Za-z_][A-Za-z0-9_]*', ' ', 'g'), '([A-Za-z_][A-Za-z0-9_]*)\(', 1))) AS name, 'call' AS via
  FROM c WHERE kind IN ('function', 'method')
  UNION ALL
  SELECT chunk_no, corpus, path, unnest(list_distinct(regexp_extract_all(regexp_extract(source, 'class [A-Za-z0-9_]+\(([^()]*)\)', 1), '[A-Za-z_][A-Za-z0-9_]*'))), 'base' FROM c WHERE kind = 'class'),
ed AS (
  SELECT DISTINCT src, dst, type FROM (
    SELECT me.chunk_no AS src, sy.dst, CASE WHEN regexp_matches(path, '(?:^|/)tests?/') OR regexp_matches(path, '(?:^|/)(?:test_[^/]*|[^/]*_test\.py|conftest\.py)$') THEN 'tested_by'
      WHEN via = 'base' AND target = 'class' THEN 'inherits' WHEN via = 'call' AND target = 'class' THEN 'instantiates' WHEN via = 'call' THEN 'calls' END AS type
    FROM me JOIN sy ON sy.corpus = me.corpus AND sy.symbol = me.name AND n = 1
    UNION ALL
    SELECT o.src, k.chunk_no, 'contains' FROM c k JOIN (SELECT corpus, path, qualname, max(chunk_no) AS src FROM c GROUP BY ALL) o
      ON o.corpus = k.corpus AND o.path = k.path AND o.qualname = k.parent)
  WHERE src <> dst AND type IS NOT NULL),
ew AS (SELECT * FROM (VALUES ('calls', 1e0, 1e0), ('instantiates', 1e0, 1e0), ('contains', 0.7e0, 0.5e0), ('inherits', 0.5e0, 0.5e0)) AS v(type, fw, bw)),
nb AS (
  SELECT node, neighbour, max(weight) AS weight FROM (
    SELECT src AS node, dst AS neighbour, fw AS weight FROM ed JOIN ew USING (type) UNION ALL SELECT dst, src, bw FROM ed JOIN ew USING (type)) GROUP BY ALL),
ind AS (SELECT dst AS node, count(*) AS in_degree FROM ed JOIN ew USING (type) GROUP BY 1),
ns AS (SELECT nb.node, neighbour, weight / ln(2e0 + coalesce(in_degree, 0)) AS strength FROM nb LEFT JOIN ind ON ind.node = nb.neighbour)"""
SQL["graph_edges"] = f"WITH {_C}, {_EDGES} SELECT src, dst, type FROM ed"
SQL["graph_in_degree"] = f"WITH {_C}, {_EDGES} SELECT node, in_degree FROM ind"
SQL["graph_neighbors"] = f"WITH {_C}, {_EDGES} SELECT node, neighbour, weight FROM nb"


def _hop(n: int, frontier: str, weighed: bool) -> str:
    st = "round(round(strength, 12) * relevance, 12)" if weighed else "round(strength, 12)"
    source = f"{frontier} JOIN ns USING (node)" + (" JOIN rel ON rel.question_id = " + frontier + ".question_id AND rel.item = neighbour" if weighed else "")
    return f"""
s{n} AS (
  SELECT {frontier}.question_id, neighbour AS item, given, {st} AS st, row_number() OVER (PARTITION BY {frontier}.question_id, node ORDER BY {st} DESC, neighbour) AS n
  FROM {source} WHERE {st} > 0),
h{n} AS (SELECT question_id, item, sum(round(given * st, 12)) AS value, max(round(given * st, 12)) AS most FROM s{n} WHERE n <= 8 GROUP BY ALL),
f{n} AS (SELECT question_id, item AS node, most * 0.5e0 AS given FROM h{n})"""


_SEEDS = {
    True: "f0 AS (SELECT question_id, chunk_no AS node, 1e0 / (60 + rk) AS given FROM dn WHERE rk <= 5)",
    False: "f0 AS (SELECT question_id, chunk_no AS node, 1e0 / (60 + hit_rank) AS given FROM h WHERE hit_rank <= 5)",
}
_RELEVANCE = """br AS (SELECT question_id, max(cosine) AS best FROM dn GROUP BY 1),
rel AS (SELECT dn.question_id, dn.chunk_no AS item, CASE WHEN best > 0 THEN least(greatest(cosine / best, 0e0), 1e0) ELSE 0e0 END AS relevance FROM dn JOIN br USING (question_id))"""
for _name, _hops, _weighed in (("graph_rank_1hop", 1, True), ("graph_rank_2hop", 2, True), ("graph_rank_unweighed", 2, False)):
    SQL[_name] = f"""
WITH {_C}, {_H}, {_EDGES}, {f'{_Q}, {_DENSE}, {_RELEVANCE},' if _weighed else ''} {_SEEDS[_weighed]}, {', '.join(_hop(i, f'f{i - 1}', _weighed) for i in range(1, _hops + 1))},
tot AS (SELECT question_id, item, round(sum(value), 12) AS score FROM ({' UNION ALL '.join(f'SELECT * FROM h{i}' for i in range(1, _hops + 1))}) GROUP BY ALL)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item)::INTEGER AS graph_rank, item AS chunk_no, score FROM tot"""

SQL["drop_stats"] = f"""
WITH {_C}, {_EDGES}, lost AS (
  SELECT via || CASE WHEN n IS NULL THEN ':unknown' ELSE ':ambiguous' END AS reason, name FROM me LEFT JOIN sy ON sy.corpus = me.corpus AND sy.symbol = me.name WHERE n IS NULL OR n > 1),
k AS (SELECT reason, name, count(*) AS n FROM lost GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY n DESC, name) AS p FROM k)
SELECT reason, sum(n)::BIGINT AS dropped, string_agg(name, ',' ORDER BY p) FILTER (WHERE p <= 8) AS examples FROM o GROUP BY reason"""
SQL["call_coverage"] = f"""
WITH {_C}, {_EDGES} SELECT me.corpus, count(*) AS calls, count(sy.dst) AS resolved FROM me LEFT JOIN sy ON sy.corpus = me.corpus AND sy.symbol = me.name AND n = 1 WHERE via = 'call' GROUP BY 1"""

SQL["relevant_division"] = f"""
WITH {_Q}, m AS (SELECT DISTINCT question_id, concat_ws('::', corpus, chunk_id) AS name FROM (SELECT question_id, corpus, unnest(relevant) AS chunk_id FROM q)),
s AS (SELECT question_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 2)
SELECT p.question_id, m.question_id AS includes_in FROM m p JOIN s ON s.question_id = p.question_id JOIN m ON m.name = p.name AND m.question_id <> p.question_id GROUP BY 1, 2, s.n HAVING count(*) = s.n"""

SQL["scope_consensus"] = f"WITH {_C} SELECT corpus, symbol, CASE WHEN count(DISTINCT kind) = 1 AND count(kind) = count(*) THEN min(kind) END AS kind, count(*) AS n FROM c GROUP BY corpus, symbol"

SQL["symbol_listing"] = f"""
WITH {_C}, s AS (
  SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY path, start_line, chunk_id, chunk_no) AS place, count(*) OVER (PARTITION BY corpus) AS total
  FROM c WHERE path LIKE 'src/%' AND kind <> 'module')
SELECT corpus, place::INTEGER AS place, chunk_no, kind, total, total > 200 AS truncated FROM s WHERE place <= 200"""
SQL["line_ranges"] = f"""
WITH {_C}, n AS (SELECT DISTINCT chunk_no, unnest({_NUMBERS}) AS line FROM c),
i AS (SELECT chunk_no, line, line - row_number() OVER (PARTITION BY chunk_no ORDER BY line) AS island FROM n),
g AS (SELECT chunk_no, min(line) AS lo, max(line) AS hi FROM i GROUP BY chunk_no, island)
SELECT chunk_no, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS ranges FROM g GROUP BY chunk_no"""
SQL["merge_ranges"] = f"""
WITH {_C}, b AS (SELECT corpus, path, start_line, end_line, max(end_line) OVER (PARTITION BY corpus, path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM c),
i AS (SELECT *, sum((upto IS NULL OR start_line > upto + 1)::INT) OVER (PARTITION BY corpus, path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT corpus, path, min(start_line) AS start_line, max(end_line) AS end_line FROM i GROUP BY corpus, path, island"""
SQL["chunk_ids"] = f"""
WITH {_C}, b AS (SELECT chunk_no, path || '::' || qualname AS base, row_number() OVER (PARTITION BY corpus, path || '::' || qualname ORDER BY start_line, chunk_no) AS n FROM c)
SELECT chunk_no, CASE WHEN n = 1 THEN base ELSE base || '~' || n END AS chunk_id FROM b"""
SQL["hit_locations"] = f"""
WITH {_C}, {_H} SELECT question_id, hit_rank, chunk_no, c.path || ':' || coalesce(first_line, start_line) || '-' || coalesce(last_line, end_line) AS location FROM h JOIN c USING (chunk_no)"""
SQL["latest_rows"] = "SELECT corpus, count(*) AS n_rows, count(DISTINCT file_id) AS files, max(indexed_at)::VARCHAR AS newest FROM source_files GROUP BY corpus"
SQL["incremental_diff"] = f"""
WITH {_C}, v AS (SELECT generation, part_id, max(embedding) AS e, bool_or(true) AS here FROM index_vectors WHERE part_id IS NOT NULL GROUP BY ALL),
b AS (
  SELECT coalesce(o.part_id, n.part_id) AS part_id, CASE WHEN n.part_id IS NULL THEN 'deleted' WHEN o.part_id IS NULL THEN 'embedded' WHEN o.e IS NOT DISTINCT FROM n.e THEN 'reused' ELSE 'changed' END AS state
  FROM (SELECT * FROM v WHERE generation = 'gen-a') o FULL JOIN (SELECT * FROM v WHERE generation = 'gen-b') n ON o.part_id = n.part_id)
SELECT corpus, state, count(*) AS parts FROM b JOIN embedding_parts p USING (part_id) JOIN c ON c.chunk_no = p.chunk_no GROUP BY ALL"""
SQL["build_stats"] = f"""
WITH {_C}, p AS (SELECT chunk_no, count(DISTINCT part_id) AS parts FROM embedding_parts GROUP BY 1)
SELECT corpus, count(DISTINCT path) AS files, count(*) AS chunks, coalesce(sum(parts), 0)::BIGINT AS parts, count(*) FILTER (WHERE parts IS NULL) AS without_parts FROM c LEFT JOIN p USING (chunk_no) GROUP BY corpus"""

SQL["qrels"] = f"WITH {_C}, {_Q}, {_R} SELECT question_id, chunk_no FROM r"
SQL["missing_relevant"] = f"""
WITH {_C}, {_Q}, w AS (SELECT DISTINCT question_id, corpus, unnest(relevant) AS chunk_id FROM q)
SELECT question_id, chunk_id FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.corpus = w.corpus AND c.chunk_id = w.chunk_id)"""
SQL["question_problems"] = f"""
WITH q1 AS (SELECT DISTINCT ON (question_id) * FROM questions ORDER BY question_id, created_at DESC),
f AS (SELECT *, coalesce(len(relevant), 0) > 0 AS many, regexp_replace(lower(coalesce(split, '')), '[^a-z]', '', 'g') AS letters FROM q1)
SELECT question_id, unnest(list_filter([
  CASE WHEN NOT coalesce(qtype IN ('exact_name', 'behavior', 'location', 'flow', 'negative'), false) THEN 'unknown_type' END,
  CASE WHEN trim(coalesce(question, '')) = '' THEN 'blank_question' END,
  CASE WHEN qtype = 'negative' AND many THEN 'negative_with_relevant' END,
  CASE WHEN qtype <> 'negative' AND NOT many THEN 'positive_without_relevant' END,
  CASE WHEN coalesce(expect_abstain, false) <> (qtype = 'negative') THEN 'abstention_mismatch' END,
  CASE WHEN letters = '' THEN 'blank_split' END, CASE WHEN letters <> '' AND NOT coalesce(split IN ('tune', 'heldout'), false) THEN 'odd_split' END], lambda x: x IS NOT NULL)) AS problem FROM f"""

_METRICS = """m AS (
  SELECT r.question_id, min(hr) AS first_rank, count(*) AS n, count(*) FILTER (WHERE hr <= 10) AS n10 FROM r LEFT JOIN (
    SELECT question_id, chunk_no, min(hit_rank) AS hr FROM h WHERE hit_rank <= 50 GROUP BY ALL) x ON x.question_id = r.question_id AND x.chunk_no = r.chunk_no GROUP BY 1),
s AS (SELECT question_id, first_rank, coalesce(first_rank = 1, false) AS hit1, coalesce(first_rank <= 5, false) AS hit5, coalesce(1e0 / first_rank, 0e0) AS rr, n10::DOUBLE / n AS recall10 FROM m)"""
SQL["retrieval_metrics"] = f"WITH {_C}, {_Q}, {_R}, {_OWN}, {_METRICS} SELECT question_id, first_rank::DOUBLE AS first_rank, hit1, hit5, round(rr, 6) AS rr, round(recall10, 6) AS recall10 FROM s"
SQL["metrics_grouping_sets"] = f"""
WITH {_C}, {_Q}, {_R}, {_OWN}, {_METRICS}
SELECT qtype, split, grouping(qtype)::INTEGER AS all_qtype, grouping(split)::INTEGER AS all_split, count(*) AS n, round(avg(hit1::INT), 6) AS hit_at_1, round(avg(hit5::INT), 6) AS hit_at_5,
  round(avg(rr), 6) AS mrr_at_50, round(avg(recall10), 6) AS recall_at_10
FROM s JOIN q USING (question_id) GROUP BY GROUPING SETS ((), (qtype), (split), (split, qtype))"""
SQL["containment_hits"] = f"""
WITH {_C}, {_Q}, {_R}, {_H}, n AS (SELECT chunk_no, corpus, path, {_NUMBERS} AS nums FROM c)
SELECT question_id, min(hit_rank) AS first_rank FROM r JOIN n i ON i.chunk_no = r.chunk_no JOIN h USING (question_id) JOIN n o ON o.chunk_no = h.chunk_no AND o.corpus = i.corpus AND o.path = i.path
WHERE list_has_all(o.nums, i.nums) GROUP BY 1"""

_PAIRED = """one AS (
  SELECT r.question_id, src, min(item_rank) FILTER (WHERE item_rank <= 50) AS fr FROM r, (VALUES ('bm25'), ('dense')) v(src)
  LEFT JOIN l ON l.question_id = r.question_id AND l.chunk_no = r.chunk_no AND l.source = v.src GROUP BY ALL),
pr AS (SELECT b.question_id, q.qtype, b.fr AS mine, d.fr AS theirs FROM one b JOIN one d ON b.question_id = d.question_id AND b.src = 'bm25' AND d.src = 'dense' JOIN q ON q.question_id = b.question_id)"""
SQL["paired_wlt"] = f"""
WITH {_C}, {_Q}, {_R}, {_L}, {_PAIRED}
SELECT qtype, grouping(qtype)::INTEGER AS overall, count(*) FILTER (WHERE coalesce(mine, 2147483647) < coalesce(theirs, 2147483647)) AS wins,
  count(*) FILTER (WHERE coalesce(mine, 2147483647) > coalesce(theirs, 2147483647)) AS losses, count(*) FILTER (WHERE mine IS NOT DISTINCT FROM theirs) AS ties,
  coalesce(string_agg(question_id::VARCHAR, ',' ORDER BY question_id) FILTER (WHERE theirs <= 3 AND (mine IS NULL OR mine > theirs)), '') AS top3_losses
FROM pr GROUP BY GROUPING SETS ((qtype), ())"""

SQL["decision_select"] = f"""
WITH {_C}, {_Q}, {_R}, {_L}, {_SWEPT}, {_PAIRED},
mine AS (
  SELECT cf.config, r.question_id, min(rk) FILTER (WHERE rk <= 50) AS first_rank FROM r CROSS JOIN cf LEFT JOIN fu ON fu.config = cf.config AND fu.question_id = r.question_id AND fu.item = r.chunk_no GROUP BY ALL),
k AS (
  SELECT config, count(*) FILTER (WHERE coalesce(first_rank, 2147483647) < coalesce(theirs, 2147483647)) AS wins, count(*) FILTER (WHERE coalesce(first_rank, 2147483647) > coalesce(theirs, 2147483647)) AS losses,
    count(*) FILTER (WHERE theirs <= 3 AND (first_rank IS NULL OR first_rank > theirs)) AS top3, round(avg(coalesce(1e0 / first_rank, 0e0)), 6) AS mrr FROM mine JOIN pr USING (question_id) GROUP BY 1),
best AS (SELECT config FROM k WHERE wins > losses AND top3 = 0 ORDER BY wins - losses DESC, losses, mrr DESC, config LIMIT 1)
SELECT config, wins, losses, top3, mrr, coalesce((SELECT config FROM best), -1)::INTEGER AS chosen FROM k"""

_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[*_`\"''“”‘’]', '', 'g'), '[\s\x0b]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
_STATUS = f"CASE WHEN {_PLAIN} = 'none of the retrieved code answers this question' THEN 'abstained' WHEN contains({_PLAIN}, 'none of the retrieved code answers this question') THEN 'mixed' ELSE 'answered' END"
_ST = f"st AS (SELECT answer_id, question_id, {_STATUS} AS status, corpus, expect_abstain FROM a JOIN q USING (question_id))"
SQL["abstention_pr"] = f"""
WITH {_Q}, {_A}, {_ST}, m AS (SELECT mode, expect_abstain, status = 'abstained' OR (mode = 'lenient' AND status = 'mixed') AS p FROM st, (VALUES ('strict'), ('lenient')) v(mode))
SELECT mode, count(*) FILTER (WHERE p) AS abstained, count(*) FILTER (WHERE expect_abstain) AS expected, count(*) FILTER (WHERE p AND expect_abstain) AS correct,
  round(count(*) FILTER (WHERE p AND expect_abstain) / nullif(count(*) FILTER (WHERE p), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (WHERE p AND expect_abstain) / nullif(count(*) FILTER (WHERE expect_abstain), 0)::DOUBLE, 6) AS recall
FROM m GROUP BY mode"""
SQL["context_relative_abstention"] = f"""
WITH {_C}, {_Q}, {_R}, {_H}, {_A}, {_ST}, x AS (SELECT DISTINCT question_id FROM h JOIN r USING (question_id, chunk_no) WHERE hit_rank <= 8)
SELECT corpus, x.question_id IS NOT NULL AS in_context, count(*) AS replies, count(*) FILTER (WHERE status = 'abstained') AS abstained, count(*) FILTER (WHERE status = 'mixed') AS mixed
FROM st LEFT JOIN x ON x.question_id = st.question_id GROUP BY ALL"""
SQL["context_diff"] = f"""
WITH {_C}, {_Q}, {_L}, s AS (SELECT question_id, string_agg(chunk_no::VARCHAR, ',' ORDER BY item_rank, chunk_no) FILTER (WHERE source = 'bm25') AS bm25,
  string_agg(chunk_no::VARCHAR, ',' ORDER BY item_rank, chunk_no) FILTER (WHERE source = 'dense') AS dense FROM l WHERE item_rank <= 8 AND source IN ('bm25', 'dense') GROUP BY 1)
SELECT question_id, bm25, dense FROM s WHERE bm25 IS DISTINCT FROM dense"""
SQL["graded_regressions"] = f"""
WITH {_Q}, {_A}, {_ST}, g AS (SELECT *, coalesce(CASE WHEN expect_abstain THEN status = 'abstained' ELSE status = 'answered' END, false) AS ok FROM st),
e AS (SELECT question_id, arg_min(ok, answer_id) AS o, arg_max(ok, answer_id) AS n, arg_max(status, answer_id) AS ns, count(*) AS k FROM g GROUP BY 1)
SELECT CASE WHEN k = 1 THEN 'ungraded' WHEN o AND ns = 'abstained' AND NOT n THEN 'regressed_abstained' WHEN o AND NOT n THEN 'regressed' WHEN NOT o AND n THEN 'improved' ELSE 'same' END AS state, count(*) AS questions FROM e GROUP BY 1"""
SQL["decision_threshold"] = f"""
WITH {_Q}, {_A}, {_ST}, k AS (SELECT corpus, count(*) AS n, count(*) FILTER (WHERE status = 'abstained' AND NOT expect_abstain) AS false_abstentions, count(*) FILTER (WHERE status = 'answered' AND expect_abstain) AS unsupported FROM st GROUP BY 1)
SELECT *, CASE WHEN n < 5 THEN 'VOID' WHEN false_abstentions * 12 > n OR unsupported * 18 > n THEN 'FAIL' ELSE 'PASS' END AS verdict FROM k"""
SQL["median_stats"] = f"""
WITH {_Q}, {_A} SELECT corpus, count(*) AS n, round(median(ttft_s), 6) AS median_ttft, median(prompt_tokens) AS median_prompt, max(generated_tokens)::DOUBLE AS max_generated,
  (arg_max(prompt_tokens, answer_id) - arg_min(prompt_tokens, answer_id))::DOUBLE AS last_minus_first FROM a JOIN q USING (question_id) GROUP BY corpus"""

SQL["budget_allocation"] = f"""
WITH RECURSIVE {_C}, {_H}, z AS (
  SELECT question_id, hit_rank, chunk_no, ceil(length(coalesce(source, '')) / 4e0)::BIGINT AS size, row_number() OVER (PARTITION BY question_id ORDER BY ceil(length(coalesce(source, '')) / 4e0), hit_rank) AS i,
    count(*) OVER (PARTITION BY question_id) AS n FROM h JOIN c USING (chunk_no)),
w AS (
  SELECT question_id, i, n, size, 1200 AS left_over, NULL::BIGINT AS fixed, CASE WHEN size <= 1200 // n THEN size ELSE 1200 // n END AS share, CASE WHEN size <= 1200 // n THEN NULL ELSE 1200 // n END AS keep FROM z WHERE i = 1
  UNION ALL
  SELECT z.question_id, z.i, z.n, z.size, w.left_over - w.share, w.keep,
    CASE WHEN w.keep IS NOT NULL THEN w.keep WHEN z.size <= (w.left_over - w.share) // (z.n - z.i + 1) THEN z.size ELSE (w.left_over - w.share) // (z.n - z.i + 1) END,
    CASE WHEN w.keep IS NOT NULL THEN w.keep WHEN z.size <= (w.left_over - w.share) // (z.n - z.i + 1) THEN NULL ELSE (w.left_over - w.share) // (z.n - z.i + 1) END
  FROM w JOIN z ON z.question_id = w.question_id AND z.i = w.i + 1)
SELECT z.question_id, z.hit_rank, z.chunk_no, z.size, w.share::BIGINT AS share FROM z JOIN w ON w.question_id = z.question_id AND w.i = z.i"""

SQL["truncation_anchor"] = f"""
WITH {_C}, {_Q}, {_H}, te AS (SELECT question_id, {_TERMS} AS terms FROM q),
ln AS (SELECT chunk_no, i, {_code_tokens('txt')} AS tokens FROM (SELECT chunk_no, unnest(ls) AS txt, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT chunk_no, string_split(source, chr(10)) AS ls FROM c))),
x AS (SELECT DISTINCT question_id, chunk_no FROM h),
sc AS (SELECT question_id, chunk_no, i, len(list_intersect(terms, tokens)) AS score FROM x JOIN te USING (question_id) JOIN ln USING (chunk_no))
SELECT DISTINCT ON (question_id, chunk_no) question_id, chunk_no, i::INTEGER AS anchor, score::INTEGER AS score FROM sc WHERE score > 0 ORDER BY question_id, chunk_no, score DESC, i"""

_TAGS = r"list_transform(flatten(list_transform(regexp_extract_all(text, '\[\s*C\d+(?:\s*[,;]\s*C\d+)*\s*\]'), lambda g: regexp_extract_all(g, 'C(\d+)', 1))), lambda t: 'C' || regexp_replace(t, '^0+(\d)', '\1'))"
SQL["citations"] = f"""
WITH {_A}, {_H}, x AS (SELECT answer_id, question_id, {_TAGS} AS tags FROM a), y AS (SELECT answer_id, question_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM x),
y1 AS (SELECT answer_id, question_id, tag, min(i) AS i FROM y GROUP BY ALL),
z AS (SELECT *, (row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1)::INTEGER AS place FROM y1),
s AS (SELECT question_id, 'C' || hit_rank AS tag, min(chunk_no) AS chunk_no FROM h GROUP BY question_id, hit_rank)
SELECT z.answer_id, place, z.tag, s.chunk_no IS NOT NULL AS known, s.chunk_no::DOUBLE AS chunk_no FROM z LEFT JOIN s ON s.question_id = z.question_id AND s.tag = z.tag"""
_NEAR = " OR ".join("regexp_matches(text, '(?i)" + p.replace("'", "''") + "')" for p in NEAR_MISS)
SQL["classify_answers"] = f"WITH {_A} SELECT answer_id, {_STATUS} AS status, coalesce({_NEAR}, false) AS near_miss FROM a"

_ENTRY = r"^[ \t]*(?:[-*•]|\d+[.)])?[ \t]*\[\s*C(\d+)(?:\s*[,;]\s*C\d+)*\s*\][ \t]*[:–—-]?[ \t]*(.*?)[ \t]*$"


def _heading(word: str) -> str:
    return r"^[ \t]*(?:#{1,6}[ \t]*)?(?:\*\*|__)?" + word + r"(?:\*\*|__)?[ \t]*(?::(?:\*\*|__)?|\n|\z)[ \t]*"


_ANSWER, _EVIDENCE = _heading("answer"), _heading("evidence")
_PARSED = rf"""
rp AS (SELECT answer_id, question_id, coalesce(raw_text, text) AS reply FROM a),
bf AS (
  SELECT *, regexp_matches(reply, '(?ims)\A.*?{_ANSWER}') AS has_answer,
    CASE WHEN regexp_matches(reply, '(?ims)\A.*?{_ANSWER}') THEN regexp_extract(reply, '(?ims)\A(.*?){_ANSWER}', 1) ELSE reply END AS before FROM rp),
pa AS (
  SELECT *, regexp_matches(before, '(?ims)\A.*?{_EVIDENCE}') AS has_evidence, regexp_extract(before, '(?ims)\A.*?{_EVIDENCE}(.*)\z', 1) AS evidence,
    regexp_replace(regexp_extract(reply, '(?ims)\A.*?{_ANSWER}(.*)\z', 1), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS answer FROM bf)"""
_VERIFIED = _PARSED + rf""",
es AS (SELECT answer_id, question_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT answer_id, question_id, string_split(evidence, chr(10)) AS ls FROM pa WHERE has_evidence)),
e0 AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1 AS place, regexp_matches(line, '{_ENTRY}') AS is_entry FROM es WHERE trim(line) <> '' AND NOT starts_with(trim(line), '```')),
e1 AS (
  SELECT answer_id, question_id, place, is_entry, trim(line) AS line, CASE WHEN is_entry THEN 'C' || regexp_replace(regexp_extract(line, '{_ENTRY}', 1), '^0+(\d)', '\1') END AS tag,
    CASE WHEN is_entry THEN trim(regexp_extract(line, '{_ENTRY}', 2)) END AS quote FROM e0),
e2 AS (SELECT *, lag(CASE WHEN quote = '' THEN tag END) OVER (PARTITION BY answer_id ORDER BY place) AS waiting FROM e1),
e3 AS (SELECT answer_id, question_id, place, coalesce(tag, waiting) AS tag, CASE WHEN is_entry THEN quote ELSE line END AS quote FROM e2 WHERE is_entry OR waiting IS NOT NULL),
e4 AS (SELECT * REPLACE (trim(CASE WHEN length(quote) >= 2 AND regexp_matches(quote, '^(?:`.*`|".*"|''.*''|“.*”)$') THEN substr(quote, 2, length(quote) - 2) ELSE quote END) AS quote) FROM e3),
eq AS (SELECT *, regexp_replace(trim(regexp_replace(quote, '[\s\x0b]+', ' ', 'g')), '\s*…$', '') AS plain FROM e4 WHERE quote <> ''),
sh AS (SELECT question_id, hit_rank, 'C' || hit_rank AS shown_tag, min(chunk_no) AS chunk_no FROM h GROUP BY question_id, hit_rank),
nn AS (SELECT chunk_no, {_NUMBERS} AS nums, string_split(source, chr(10)) AS ls FROM c),
li AS (SELECT chunk_no, i, nums[i + 1] AS line, regexp_replace(trim(regexp_replace(txt, '[\s\x0b]+', ' ', 'g')), '\s*…$', '') AS shown FROM (SELECT chunk_no, nums, unnest(ls) AS txt, generate_subscripts(ls, 1) - 1 AS i FROM nn)),
mt AS (
  SELECT answer_id, place, tag, shown_tag, hit_rank, i, line FROM eq JOIN sh USING (question_id) JOIN li ON li.chunk_no = sh.chunk_no WHERE length(plain) > 0 AND contains(shown, plain)),
bt AS (
  SELECT answer_id, place, arg_min(line, i) FILTER (WHERE tag = shown_tag) AS own, min(i) FILTER (WHERE tag = shown_tag) AS own_i, arg_min(shown_tag, hit_rank) FILTER (WHERE tag <> shown_tag) AS other FROM mt GROUP BY ALL),
vr AS (
  SELECT eq.answer_id, eq.place::INTEGER AS place, eq.tag, own, other, CASE WHEN k.shown_tag IS NULL THEN 'unknown_tag' WHEN length(replace(plain, ' ', '')) < 12 THEN 'too_short'
    WHEN own_i IS NOT NULL THEN 'verified' WHEN other IS NOT NULL THEN 'wrong_tag' ELSE 'not_found' END AS result
  FROM eq LEFT JOIN (SELECT DISTINCT question_id, shown_tag FROM sh) k ON k.question_id = eq.question_id AND k.shown_tag = eq.tag LEFT JOIN bt ON bt.answer_id = eq.answer_id AND bt.place = eq.place)"""
SQL["quote_verify"] = f"WITH {_A}, {_H}, {_C}, {_VERIFIED} SELECT answer_id, place, tag, result, CASE WHEN result = 'verified' THEN own::DOUBLE END AS line, CASE WHEN result = 'wrong_tag' THEN other END AS found_in FROM vr"
SQL["evidence_status"] = f"""
WITH {_A}, {_H}, {_C}, {_VERIFIED}, g AS (SELECT answer_id, count(*) AS quotes, count(*) FILTER (WHERE result = 'verified') AS ok, list(DISTINCT tag) FILTER (WHERE result = 'verified') AS sup FROM vr GROUP BY 1),
d AS (SELECT answer_id, {_STATUS} AS told, list_filter({_TAGS}, lambda t: true) AS cited FROM a)
SELECT g.answer_id, CASE WHEN told = 'abstained' THEN 'abstained' WHEN ok = 0 THEN 'unverified'
  WHEN ok = quotes AND len(list_filter(coalesce(cited, []), lambda t: NOT list_contains(coalesce(sup, []), t))) = 0 THEN 'verified' ELSE 'partial' END AS status, quotes, ok AS verified_quotes
FROM g JOIN d USING (answer_id)"""
SQL["evidence_entries"] = f"WITH {_A}, {_H}, {_C}, {_VERIFIED} SELECT answer_id, place::INTEGER AS place, tag, quote FROM eq"
SQL["evidence_enforced"] = f"""
WITH {_A}, {_H}, {_C}, {_VERIFIED}, g AS (SELECT answer_id, count(*) AS quotes, count(*) FILTER (WHERE result = 'verified') AS ok, list(DISTINCT tag) FILTER (WHERE result = 'verified') AS good FROM vr GROUP BY 1),
sa AS (SELECT answer_id, question_id, CASE WHEN has_answer THEN answer ELSE '' END AS said, reply FROM pa WHERE has_evidence),
w AS (SELECT answer_id, {_STATUS} AS whole, {_TAGS} AS all_tags FROM (SELECT answer_id, reply AS text FROM sa)),
o AS (SELECT answer_id, {_STATUS} AS part, coalesce({_TAGS}, []) AS own FROM (SELECT answer_id, said AS text FROM sa)),
k AS (SELECT question_id, list(DISTINCT shown_tag) AS tags FROM sh GROUP BY 1),
u AS (
  SELECT answer_id, CASE WHEN whole = 'abstained' THEN 'abstained' ELSE part END AS told, trim(said) = '' AS is_blank, coalesce(ok, 0) AS ok, coalesce(quotes, 0) AS quotes, coalesce(good, []) AS good, coalesce(tags, []) AS tags, own, all_tags
  FROM sa JOIN w USING (answer_id) JOIN o USING (answer_id) LEFT JOIN g USING (answer_id) LEFT JOIN k ON k.question_id = sa.question_id),
v AS (
  SELECT *, list_distinct(list_filter(own, lambda t: NOT list_contains(good, t))) AS unsupported FROM u),
x AS (
  SELECT *, CASE WHEN told = 'abstained' THEN 'abstained' WHEN is_blank OR ok = 0 THEN 'unverified' WHEN ok = quotes AND len(unsupported) = 0 THEN 'verified' ELSE 'partial' END AS verification FROM v),
ci AS (
  SELECT answer_id, string_agg(t, ',' ORDER BY i) AS citations FROM (
    SELECT answer_id, t, min(i) AS i FROM (SELECT answer_id, unnest(all_tags) AS t, generate_subscripts(all_tags, 1) AS i, tags, good, own FROM x WHERE verification IN ('verified', 'partial'))
    WHERE list_contains(tags, t) AND (list_contains(good, t) OR list_contains(own, t)) GROUP BY 1, 2) GROUP BY 1)
SELECT x.answer_id, CASE WHEN verification = 'unverified' THEN 'abstained' ELSE told END AS status, verification, coalesce(citations, '') AS citations, len(unsupported)::INTEGER AS n_unsupported
FROM x LEFT JOIN ci USING (answer_id)"""

# crc32 of a token's bytes, bit by bit
_BYTES = "list_transform(range(0, length(hex(encode(t))) // 2), lambda i: ('0x' || substr(hex(encode(t)), 2 * i + 1, 2))::BIGINT)"
SQL["hash_embed"] = f"""
WITH RECURSIVE {_Q}, tk AS (SELECT question_id, unnest({_code_tokens("coalesce(question, '')")}) AS t FROM q),
w AS (SELECT t, {_BYTES} AS b FROM (SELECT DISTINCT t FROM tk)),
crc AS (
  SELECT t, b, 0 AS i, 0 AS j, 4294967295::BIGINT AS c FROM w
  UNION ALL
  SELECT t, b, CASE WHEN j = 7 THEN i + 1 ELSE i END, CASE WHEN j = 7 THEN 0 ELSE j + 1 END,
    CASE WHEN (CASE WHEN j = 0 THEN xor(c, b[i + 1]) ELSE c END) % 2 = 1 THEN xor((CASE WHEN j = 0 THEN xor(c, b[i + 1]) ELSE c END) // 2, 3988292384) ELSE (CASE WHEN j = 0 THEN xor(c, b[i + 1]) ELSE c END) // 2 END
  FROM crc WHERE i < len(b)),
h AS (SELECT t, (xor(c, 4294967295) % 64)::INTEGER AS axis FROM crc WHERE i = len(b)),
n AS (SELECT question_id, axis, count(*) AS n FROM tk JOIN h USING (t) GROUP BY ALL),
l AS (SELECT question_id, sqrt(sum(n * n)) AS len FROM n GROUP BY 1)
SELECT question_id, axis, round(n / len, 9) AS value FROM n JOIN l USING (question_id)
UNION ALL SELECT question_id, 0, 1e0 FROM q WHERE question_id NOT IN (SELECT question_id FROM n)"""

_N_WORDS = r"len(list_filter(regexp_split_to_array({}, '[\s\x0b]+'), lambda w: w <> ''))"
SQL["part_plan"] = f"""
WITH RECURSIVE {_C}, {_HEADER}, x AS (SELECT chunk_no, header, string_split(source, chr(10)) AS ls FROM hd),
y AS (SELECT chunk_no, greatest(200 - {_N_WORDS.format('header')}, 50) AS budget, list_transform(ls, lambda s: {_N_WORDS.format('s')}) AS sizes FROM x),
f AS (
  SELECT chunk_no, budget, sizes, 1 AS i, sizes[1]::BIGINT AS used, 0 AS part_no FROM y
  UNION ALL
  SELECT chunk_no, budget, sizes, i + 1, CASE WHEN used + sizes[i + 1] > budget THEN sizes[i + 1] ELSE used + sizes[i + 1] END,
    CASE WHEN used + sizes[i + 1] > budget THEN part_no + 1 ELSE part_no END FROM f WHERE i < len(sizes))
SELECT chunk_no, part_no::INTEGER AS part_no, (min(i) - 1)::INTEGER AS first_line, (max(i) - 1)::INTEGER AS last_line FROM f GROUP BY chunk_no, part_no"""
