"""DuckDB SQL of the registered retrieval queries."""

from __future__ import annotations

from ..functions.entities import CASE, CONCEPTS
from ..functions.text import DEFAULT_TITLE, TITLE_PATTERNS, TRAILING
from ..operators.generation import ANSWER_WORDS, PROMPT, REFUSAL
from ..operators.spans import GENERIC

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TOKENS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"


def strip(c: str) -> str:
    return _STRIP.format(c)


def tokens(c: str) -> str:
    return _TOKENS.format(c)


_LIST = "[" + ", ".join(f"'{c}'" for c in CONCEPTS) + "]"
_FOOTERS = r"regexp_replace(regexp_replace(regexp_replace({}, '(?m)\n\s*\d{{1,3}}\s*$', '', 'g'), '\[\d+\]', '', 'g'), '\*{{3,}}', '', 'g')"


def lines(p: str = "p") -> str:
    """One row per line of a document: what the statute view makes of it."""
    return f"""
lines AS (SELECT doc_id, j, {p} AS p FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS p, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS j FROM documents)),
parts AS (SELECT doc_id, j, p, p || ' See Article ' || CAST((doc_id + j) % 60 AS VARCHAR) || ' and Section ' || CAST((doc_id * j) % 37 AS VARCHAR) || '. It concerns ' ||
  {_LIST}[(doc_id + j - 1) % {len(CONCEPTS)} + 1] || ' under Part III. (Alpha Beta v. Gamma Delta, 1978)' ||
  CASE WHEN (doc_id + j - 1) % 4 = 0 THEN chr(10) || '(1) ' || p || chr(10) || '(2) ' || p ELSE '' END AS body FROM lines),
articles AS (SELECT doc_id, j, p, CAST(j AS VARCHAR) AS article, 'Title of ' || CAST(j AS VARCHAR) AS title,
  'Article ' || CAST(j AS VARCHAR) || '. Title of ' || CAST(j AS VARCHAR) || chr(10) || {strip('body')} AS content FROM parts),
kept AS (SELECT *, {tokens('content')} AS token_count FROM articles WHERE {tokens('content')} >= 50)
"""


LINES = lines()
_NOISY = r"(SELECT doc_id, '[PAGE_1]' || chr(10) || 'THE INDIAN  EVIDENCE ACT, 1872' || chr(10) || text || chr(10) || ' 12 ' || chr(10) || 'hy-' || chr(10) || 'phen [3]  a ' || chr(9) || ' b ****' || chr(10) || chr(10) || chr(10) || chr(10) || ' 7' || chr(10) || 'end' || chr(10) || '9' AS text FROM documents)"
_PIECES = f"""pieces AS (SELECT doc_id, {strip('p')} AS content FROM (SELECT doc_id, unnest(CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10)) WHEN contains(text, chr(10)) THEN string_split(text, chr(10))
  WHEN contains(text, '. ') THEN string_split(text, '. ') ELSE string_split(text, ' ') END) AS p FROM documents)),
chunks AS (SELECT doc_id, content, {tokens('content')} AS token_count FROM pieces WHERE {tokens('content')} BETWEEN 50 AND 1024)"""
_TURNS = """turns AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM conversations),
answers AS (SELECT conv_id * 1000 + turn AS answer_id, text || CASE WHEN turn % 3 = 1 THEN ' according to the act.' ELSE '' END AS answer, context FROM turns WHERE role = 'assistant'),
"""
_SPANS = """sentences AS (SELECT answer_id, unnest(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM answers),
worded AS (SELECT answer_id, s, list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '') AS w FROM sentences),
spans AS (SELECT DISTINCT answer_id, span FROM (SELECT answer_id, """ + strip("s") + """ AS span FROM worded WHERE len(w) < 5
  UNION ALL SELECT answer_id, array_to_string(w[i:i + n - 1], ' ') FROM worded, range(4, 8) a(n), range(1, 5000) b(i) WHERE len(w) >= 5 AND i + n - 1 <= len(w)))"""
_ANSWERS = _TURNS + _SPANS
_GENERIC = " OR ".join(f"contains(lower(span), '{g}')" for g in GENERIC)
_DIMS = "list_transform(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''), lambda w: CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64)"
_STATUS = f""",
specific AS (SELECT * FROM spans WHERE NOT ({_GENERIC}) AND {tokens('span')} >= 3),
ctx AS (SELECT answer_id, list_transform(range(64), lambda d: CAST(len(list_filter(dims, lambda x: x = d)) AS DOUBLE)) AS dense FROM (SELECT answer_id, {_DIMS.format('context')} AS dims FROM answers)),
normed AS (SELECT answer_id, dense, sqrt(list_inner_product(dense, dense)) AS n FROM ctx),
scored AS (SELECT s.answer_id, span, n, {_DIMS.format('span')} AS dims, dense FROM specific s JOIN normed USING (answer_id)),
cosines AS (SELECT answer_id, span, CASE WHEN n = 0 OR len(dims) = 0 THEN 0.0 ELSE list_sum(list_transform(dims, lambda d: dense[d + 1])) /
  (sqrt(list_sum(list_transform(dims, lambda d: CAST(len(list_filter(dims, lambda x: x = d)) AS DOUBLE)))) * n) END AS c FROM scored),
detected AS (SELECT answer_id, span, round(c, 4) AS confidence, CASE WHEN round(c, 9) >= 0.65 THEN 'supported' WHEN round(c, 9) >= 0.40 THEN 'uncertain' ELSE 'hallucinated' END AS status FROM cosines)"""
_DETECT = _ANSWERS + _STATUS
_TOP = """sims AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) /
  (sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))) AS c
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
top AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) - 1 AS rank, round(c, 4) AS similarity_score FROM sims) WHERE rank < 5)"""


_STATUTES = f"WITH {LINES}, t AS (SELECT doc_id, string_agg(chr(10) || j || '. Title of ' || j || '.' || chr(10) || body, '' ORDER BY j) AS text FROM parts GROUP BY doc_id)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def refs(pattern: str, prefix: str) -> str:
    return f"{_STATUTES} SELECT DISTINCT doc_id, '{prefix}' || unnest(regexp_extract_all(text, '{pattern}', 1)) AS entity FROM t"


def _case_refs() -> str:
    sides = ", ".join(f"unnest(regexp_extract_all(text, {_quoted(CASE)}, {k})) AS {c}" for k, c in ((1, "a"), (2, "b")))
    return f"{_STATUTES} SELECT DISTINCT doc_id, {strip('a')} || '_v_' || {strip('b')} AS entity FROM (SELECT doc_id, {sides} FROM t) WHERE length(a) > 3 AND length(b) > 3"


def _concepts() -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, '{k.replace(' ', '_')}' AS entity FROM t WHERE regexp_matches(text, '(?i)\\b{k}\\b')" for k in CONCEPTS)
    return f"{_STATUTES} {each}"


def _clean_title() -> str:
    c = strip("text || ' ,-.'")
    for mark in TRAILING:
        c = strip(f"regexp_replace({c}, '[{mark}]$', '')")
    return f"""WITH t AS (SELECT doc_id, regexp_replace({c}, '\\s+', ' ', 'g') AS c FROM documents),
u AS (SELECT doc_id, CASE WHEN length(c) > 120 THEN regexp_replace(substr(c, 1, 120), '(?s)^(.*) [^ ]*$', '\\1') ELSE c END AS c FROM t)
SELECT doc_id, CASE WHEN length(c) > 3 THEN c ELSE 'Unknown' END AS title FROM u"""


def _document_title() -> str:
    found = [f"regexp_replace({strip(f'regexp_extract(substr(text, 1, 1000), {_quoted(p)}, 0)')}, '\\s+', ' ', 'g')" for p in TITLE_PATTERNS]
    tried = ", ".join(f"CASE WHEN length({t}) > 5 THEN {t} END" for t in found)
    return f"SELECT doc_id, coalesce({tried}, {_quoted(DEFAULT_TITLE)}) AS title FROM {_NOISY}"


def _graph(tail: str) -> str:
    """Over mentions (doc_id, j, article, content, kind, entity), rels, nodes and edges of the statute view's chunks."""
    plain = (("article", "(?i)(?:Article|Art\\.?)\\s+(\\d+[A-Z]?)", "Article_"), ("section", "(?i)(?:Section|Sec\\.?)\\s+(\\d+[A-Z]?)", "Section_"), ("part", "(?i)Part\\s+([IVX]+[A-Z]?)", "Part_"))
    found = [f"SELECT doc_id, j, article, content, '{kind}' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(content, '{pattern}', 1), lambda x: '{prefix}' || x))) AS entity FROM kept" for kind, pattern, prefix in plain]
    sides = ", ".join(f"unnest(regexp_extract_all(content, {_quoted(CASE)}, {k})) AS {c}" for k, c in ((1, "a"), (2, "b")))
    found.append(f"SELECT DISTINCT doc_id, j, article, content, 'case' AS kind, {strip('a')} || '_v_' || {strip('b')} AS entity FROM (SELECT *, {sides} FROM kept) WHERE length(a) > 3 AND length(b) > 3")
    found += [f"SELECT doc_id, j, article, content, 'concept' AS kind, '{k.replace(' ', '_')}' AS entity FROM kept WHERE regexp_matches(content, '(?i)\\b{k}\\b')" for k in CONCEPTS]
    at = "instr(content, replace({}, '_', ' '))"
    x, y = at.format("a.entity").replace("content", "a.content"), at.format("b.entity").replace("content", "a.content")
    return f"""WITH {LINES}, mentions AS ({' UNION ALL '.join(found)}),
rels AS (SELECT doc_id, 'Article_' || article AS src, CASE kind WHEN 'concept' THEN 'discusses' WHEN 'case' THEN 'interpreted_by' ELSE 'refers_to' END AS relationship_type, entity AS dst
  FROM mentions WHERE kind IN ('concept', 'case', 'section')
  UNION ALL SELECT a.doc_id, a.entity, 'related_to', b.entity FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.j = b.j AND a.kind = 'article' AND b.kind = 'article' AND b.entity > a.entity
  WHERE {x} > 0 AND {y} > 0 AND abs({x} - {y}) < 500),
nodes AS (SELECT DISTINCT entity, CASE WHEN starts_with(entity, 'Article_') THEN 'article' WHEN starts_with(entity, 'Section_') THEN 'section' WHEN starts_with(entity, 'Part_') THEN 'part'
  WHEN starts_with(entity, 'Case_') OR contains(entity, '_v_') THEN 'case' ELSE 'concept' END AS entity_type, replace(entity, '_', ' ') AS label FROM mentions),
edges AS (SELECT src, dst, relationship_type, count(*) AS weight FROM rels WHERE src IN (SELECT entity FROM nodes) AND dst IN (SELECT entity FROM nodes) GROUP BY ALL),
own AS (SELECT 'Article_' || article AS entity, doc_id, j FROM kept),
held AS (SELECT * FROM own UNION ALL (SELECT entity, doc_id, j FROM mentions WHERE kind IN ('article', 'section', 'concept') AND (entity, doc_id, j) NOT IN (SELECT (entity, doc_id, j) FROM own)))
{tail}"""


_QUESTIONS = "questions AS (SELECT item_id AS query_id, 'What is ' || text || '?' AS query, text AS context FROM benchmark)"


def _prompt_and_answer() -> tuple[str, str]:
    parts = PROMPT.split("%s")
    text = f"{_quoted(parts[0])} || context || {_quoted(parts[1])} || query || {_quoted(parts[2])}"
    first = f"array_to_string(regexp_split_to_array({strip('context')}, '\\s+')[1:{ANSWER_WORDS}], ' ')"
    return text, f"CASE WHEN {first} = '' THEN {_quoted(REFUSAL)} ELSE {first} END"


def _prompts() -> str:
    text, answer = _prompt_and_answer()
    return f"WITH {_QUESTIONS} SELECT query_id, {text} AS prompt, {answer} AS answer FROM questions"


def embedded(source: str, key: str, text: str) -> str:
    """key, v (64 components, as stored in single precision) of a table's texts."""
    words = f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '\\s+'), lambda w: w <> '')[1:512]"
    dims = f"list_transform({words}, lambda w: CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64)"
    counts = f"SELECT {key}, list_transform(range(64), lambda d: CAST(len(list_filter(dims, lambda x: x = d)) AS DOUBLE)) AS c FROM (SELECT {key}, {dims} AS dims FROM {source})"
    return f"SELECT {key}, list_transform(c, lambda x: CAST(CAST(CASE WHEN n > 0 THEN x / n ELSE x END AS FLOAT) AS DOUBLE)) AS v FROM (SELECT {key}, c, sqrt(list_inner_product(c, c)) AS n FROM ({counts}))"


def ranked(queries: str, rows: str, k: int) -> str:
    """query_id, id, rank, similarity_score of the k best; both tables: key, v."""
    size = lambda t: f"sqrt(list_inner_product({t}.v, {t}.v))"
    c = f"CASE WHEN {size('q')} * {size('r')} = 0 THEN 0.0 ELSE list_inner_product(q.v, r.v) / ({size('q')} * {size('r')}) END"
    order = "row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) - 1"
    return f"SELECT query_id, id, rank, round(c, 4) AS similarity_score FROM (SELECT *, {order} AS rank FROM (SELECT query_id, id, {c} AS c FROM {queries} q, {rows} r)) WHERE rank < {k}"


#: Every document's pieces by the fallback split, numbered as in the text.
_NUMBERED = f"""whole AS (SELECT doc_id, list_filter(list_transform(CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10)) WHEN contains(text, chr(10)) THEN string_split(text, chr(10))
  WHEN contains(text, '. ') THEN string_split(text, '. ') ELSE string_split(text, ' ') END, lambda x: {strip('x')}), lambda x: x <> '') AS pieces FROM (SELECT doc_id, text FROM {{source}})),
numbered AS (SELECT doc_id, unnest(pieces) AS content, unnest(range(len(pieces))) AS pos FROM whole),
chunks AS (SELECT *, {tokens('content')} AS token_count FROM numbered WHERE {tokens('content')} BETWEEN 50 AND 1024)"""
_STORE = f"{_NUMBERED.format(source='documents')}, stored AS (SELECT *, 'recursive_' || pos || '_' || doc_id || '_' || pos AS id FROM chunks)"


def _hybrid() -> str:
    clean = _FOOTERS.format("p")
    titles = [f"regexp_replace({strip(f'regexp_extract(substr(text, 1, 1000), {_quoted(p)}, 0)')}, '\\s+', ' ', 'g')" for p in TITLE_PATTERNS]
    title = "coalesce(" + ", ".join(f"CASE WHEN length({t}) > 5 THEN {t} END" for t in titles) + f", {_quoted(DEFAULT_TITLE)})"
    return f"""WITH raw AS (SELECT doc_id, string_agg(chr(10) || j || '. Title of ' || j || '.' || chr(10) || body, '' ORDER BY j) AS text FROM (WITH {lines()} SELECT * FROM parts) GROUP BY doc_id),
titles AS (SELECT doc_id, {title} AS document_title FROM raw), cleaned AS (SELECT doc_id, {_FOOTERS.format('text')} AS text FROM raw),
{lines(clean)}, cut AS (SELECT doc_id, j, article, title, content, token_count,
  list_filter(list_transform(string_split(regexp_replace(content, '(\\n\\s*\\(\\d+\\)\\s*)', chr(1) || '\\1', 'g'), chr(1))[2:], lambda x: {strip('x')}), lambda x: {tokens('x')} >= 50) AS parts FROM kept),
told AS (SELECT *, token_count >= 512 AND len(parts) > 1 AS divide FROM cut),
sub AS (SELECT doc_id, j, article, title, divide, unnest(CASE WHEN divide THEN parts ELSE [content] END) AS content, generate_subscripts(CASE WHEN divide THEN parts ELSE [content] END, 1) AS k FROM told),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sub),
good AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j, k) - 1 AS pos, 'article_' || article || '_' || n AS chunk_id, content, article, title, {tokens('content')} AS token_count, 'improved_regex' AS method,
  CASE WHEN divide THEN regexp_extract(content, '^\\((\\d+)\\)', 1) END AS section, CASE WHEN divide THEN 'subsection' ELSE 'unknown' END AS hierarchy_level FROM counted WHERE n > 5),
rest AS (SELECT * FROM cleaned WHERE doc_id NOT IN (SELECT doc_id FROM good)), {_NUMBERED.format(source='rest')},
both_kinds AS (SELECT * FROM good UNION ALL SELECT doc_id, pos, 'recursive_' || pos, content, NULL, substr(content, 1, 100), token_count, 'recursive', NULL, 'text_block' FROM chunks)
SELECT b.*, document_title, 'Unknown' AS part FROM both_kinds b JOIN titles USING (doc_id)"""


#: Neighbours within two undirected hops and directed distances of ``seeds`` (seed) in ``edges``; edges between articles go up
#: in name only, so walks end by themselves.
_WALKS = """both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
hop1 AS (SELECT DISTINCT seed, dst AS entity FROM seeds JOIN both_ways ON src = seed),
near AS (SELECT * FROM hop1 UNION SELECT seed, b.dst FROM hop1 JOIN both_ways b ON b.src = hop1.entity),
walk AS (SELECT DISTINCT seed, seed AS node, 0 AS d FROM seeds UNION SELECT seed, e.dst, d + 1 FROM walk JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = walk.node),
far AS (SELECT n.seed, n.entity, coalesce(CAST(d AS DOUBLE), CAST('inf' AS DOUBLE)) AS graph_distance FROM near n LEFT JOIN (SELECT seed, node, min(d) AS d FROM walk GROUP BY ALL) w ON w.seed = n.seed AND w.node = n.entity)"""
#: Of ``hits`` (query_id, chunk_id, rank), ``ranked_seeds`` (query_id, seed, seed_rank) and ``links`` (entity, chunk_id).
_FUSED = f"""seeds AS (SELECT DISTINCT seed FROM ranked_seeds), {_WALKS},
first_seed AS (SELECT * FROM (SELECT query_id, entity, graph_distance, seed_rank, row_number() OVER (PARTITION BY query_id, entity ORDER BY seed_rank) AS r
  FROM ranked_seeds JOIN far USING (seed) WHERE starts_with(entity, 'Article_')) WHERE r = 1),
nearest AS (SELECT * FROM (SELECT query_id, entity, graph_distance, row_number() OVER (PARTITION BY query_id ORDER BY graph_distance, seed_rank, entity) AS r FROM first_seed) WHERE r <= 5),
graph_hits AS (SELECT query_id, entity, chunk_id, graph_distance FROM nearest JOIN links USING (entity)),
v AS (SELECT query_id, chunk_id, 1 - max(rank) / 5 AS vw, min(rank) AS slot FROM hits GROUP BY ALL),
g AS (SELECT query_id, chunk_id, 1 / (1 + max(graph_distance)) AS gw, count(*) AS n FROM graph_hits GROUP BY ALL),
weighed AS (SELECT query_id, chunk_id, coalesce(vw, 0.0) AS vw0, coalesce(gw, 0.0) AS gw0, slot, CASE WHEN vw IS NOT NULL THEN 'vector' ELSE 'graph' END AS source,
  CASE WHEN n IS NULL THEN vw WHEN vw IS NOT NULL THEN 0.7 * vw + 0.3 * gw WHEN n = 1 THEN 0.5 * gw ELSE 0.3 * gw END AS final FROM v FULL OUTER JOIN g USING (query_id, chunk_id)),
fused AS (SELECT query_id, chunk_id, round(vw0, 4) AS vector_score, round(gw0, 4) AS graph_weight, round(final, 4) AS final_score, source, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, coalesce(slot, 2147483647), chunk_id) - 1 AS rank FROM weighed) WHERE rank < 5)"""


def _vectors_fused(tail: str) -> str:
    return _graph(f""", {_TOP}, hits AS (SELECT query_id, id AS chunk_id, rank FROM top),
ranked_seeds AS (SELECT query_id, 'Article_' || (chunk_id % 60) AS seed, min(rank) AS seed_rank FROM hits GROUP BY ALL),
links AS (SELECT 'Article_' || (vec_id % 60) AS entity, vec_id AS chunk_id FROM embeddings), {_FUSED}
{tail}""").replace("WITH lines", "WITH RECURSIVE lines", 1).replace("WITH \nlines", "WITH RECURSIVE \nlines", 1)


_SCORES = """s AS (SELECT answer_id, avg(CASE WHEN status = 'supported' THEN 1.0 ELSE 0.0 END) AS f, 1 - avg(CASE WHEN status = 'hallucinated' THEN 1.0 ELSE 0.0 END) AS u, sum(CASE WHEN status <> 'hallucinated' THEN confidence ELSE 0.0 END) / count(*) AS e FROM detected GROUP BY 1),
scores AS (SELECT a.answer_id, round(coalesce(f, 0), 4) AS faithfulness_score, round(coalesce(u, 0), 4) AS unsupported_claim_score, round(coalesce(e, 0), 4) AS evidence_coverage_score, round(coalesce(0.5 * f + 0.3 * u + 0.2 * e, 0), 4) AS overall_faithfulness FROM answers a LEFT JOIN s USING (answer_id))"""


def _answered(tail: str) -> str:
    """The whole way from questions to scores over the statute view's articles."""
    return _graph(f""", {_QUESTIONS}, named AS (SELECT 'article_' || doc_id || '_' || article AS id, article, content FROM kept),
asked AS ({embedded('questions', 'query_id', 'query')}), stored AS ({embedded('named', 'id', 'content')}),
found AS ({ranked('asked', 'stored', 5)}), hits AS (SELECT query_id, id AS chunk_id, rank FROM found),
ranked_seeds AS (SELECT query_id, 'Article_' || article AS seed, min(rank) AS seed_rank FROM hits JOIN named ON id = chunk_id GROUP BY ALL),
links AS (SELECT entity, 'article_' || doc_id || '_' || j AS chunk_id FROM held WHERE entity IN (SELECT entity FROM nodes)), {_FUSED},
contexts AS (SELECT query_id, string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM fused LEFT JOIN named ON id = chunk_id GROUP BY ALL),
answers AS (SELECT query_id AS answer_id, {_prompt_and_answer()[1]} AS answer, context FROM (SELECT query_id, c.context FROM contexts c)), {_SPANS}{_STATUS}, {_SCORES}
{tail}""").replace("WITH \nlines", "WITH RECURSIVE \nlines", 1)


ORACLES: dict[str, str] = {
    "relations": _graph("SELECT doc_id, src, relationship_type, dst, count(*) AS n FROM rels GROUP BY ALL"),
    "graph_nodes": _graph("SELECT * FROM nodes"),
    "graph_edges": _graph("SELECT * FROM edges"),
    "smart_subdivide": f"""WITH {LINES}, cut AS (SELECT doc_id, article, content, token_count,
  list_filter(list_transform(string_split(regexp_replace(content, '(\\n\\s*\\(\\d+\\)\\s*)', chr(1) || '\\1', 'g'), chr(1))[2:], lambda x: {strip('x')}), lambda x: {tokens('x')} >= 50) AS parts FROM kept),
told AS (SELECT *, token_count >= 512 AND len(parts) > 1 AS divide FROM cut),
rows AS (SELECT doc_id, article, divide, unnest(CASE WHEN divide THEN parts ELSE [content] END) AS content FROM told)
SELECT doc_id, article, content, CASE WHEN divide THEN regexp_extract(content, '^\\((\\d+)\\)', 1) END AS section, CASE WHEN divide THEN 'subsection' ELSE 'unknown' END AS hierarchy_level, {tokens('content')} AS token_count FROM rows""",
    "graph_stats": _graph(""", n AS (SELECT count(*) AS nodes, count(*) FILTER (WHERE entity_type = 'article') AS article_nodes, count(*) FILTER (WHERE entity_type = 'section') AS section_nodes,
  count(*) FILTER (WHERE entity_type = 'part') AS part_nodes, count(*) FILTER (WHERE entity_type = 'case') AS case_nodes, count(*) FILTER (WHERE entity_type = 'concept') AS concept_nodes FROM nodes),
e AS (SELECT count(*) AS edges, CAST(coalesce(sum(weight), 0) AS BIGINT) AS total_weight, coalesce(string_agg(DISTINCT relationship_type, ',' ORDER BY relationship_type), '') AS relationship_types FROM edges)
SELECT *, CASE WHEN nodes > 0 THEN round(2 * edges / nodes, 4) ELSE 0.0 END AS avg_degree FROM n, e"""),
    "graph_stats_report": _graph(""", n AS (SELECT entity_type, count(*) AS c FROM nodes GROUP BY ALL), totals AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges)
SELECT 'Nodes: ' || nodes AS line FROM totals UNION ALL SELECT 'Edges: ' || edges FROM totals
UNION ALL SELECT '  ' || t || ': ' || coalesce(c, 0) FROM unnest(['article', 'section', 'part', 'case', 'concept']) u(t) LEFT JOIN n ON entity_type = t
UNION ALL SELECT 'Relationship types: ' || coalesce((SELECT string_agg(DISTINCT relationship_type, ',' ORDER BY relationship_type) FROM edges), '')
UNION ALL SELECT 'Average degree: ' || printf('%.2f', CASE WHEN nodes > 0 THEN 2 * edges / nodes ELSE 0.0 END) FROM totals"""),
    "entity_chunks": _graph("SELECT entity, count(*) AS links, count(DISTINCT doc_id) AS docs FROM held WHERE entity IN (SELECT entity FROM nodes) GROUP BY entity"),
    "case_refs": _case_refs(),
    "concepts": _concepts(),
    "clean_title": _clean_title(),
    "document_title": _document_title(),
    "prompts": _prompts(),
    "vector_topk": f"WITH {_TOP} SELECT * FROM top",
    "embedding_normalize": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS l FROM v) SELECT vec_id, CASE WHEN l > 0 THEN 1.0 ELSE 0.0 END AS norm, len(v) AS size, i - 1 AS dim, round(v[i] / l, 5) + 0.0 AS x FROM n, range(1, 65) t(i)",
    "centroid_mean_pool": "SELECT label, i - 1 AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2",
    "token_count": f"SELECT doc_id, {tokens('text')} AS tokens FROM documents",
    "recursive_chunks": f"WITH {_PIECES} SELECT doc_id, content, token_count FROM chunks",
    "chunk_report": f"WITH {_PIECES} SELECT count(*) AS total_chunks, CAST(sum(token_count) AS BIGINT) AS total_tokens, round(avg(token_count), 1) AS avg_tokens, max(token_count) AS max_tokens, min(token_count) AS min_tokens, count(*) FILTER (WHERE token_count > 512) AS oversized FROM chunks",
    "sample_chunks": f"WITH {_PIECES} SELECT doc_id, md5('0:' || doc_id || ':' || md5(content)) AS sample_key, substr(content, 1, 500) AS preview FROM chunks ORDER BY sample_key LIMIT 5",
    "clean_raw_text": "SELECT doc_id, " + strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[PAGE_\d+\]', '', 'g'), '-\n', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)^\s*\d+\s*$', '', 'g')") + f" AS cleaned FROM {_NOISY}",
    "remove_footers": r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?m)\n\s*\d{1,3}\s*$', '', 'g'), '\[\d+\]', '', 'g'), '\*{3,}', '', 'g') AS cleaned FROM " + _NOISY,
    "clean_text": "SELECT doc_id, " + strip(r"regexp_replace(text, '\s+', ' ', 'g')") + f" AS cleaned FROM {_NOISY}",
    "pages_to_text": r"SELECT conv_id AS doc_id, string_agg('[PAGE_' || (turn + 1) || ']' || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations WHERE regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> '' GROUP BY conv_id",
    "article_chunks": f"WITH {LINES} SELECT doc_id, article, title, content, token_count FROM kept",
    "article_refs": refs(r"(?i)(?:Article|Art\.?)\s+(\d+[A-Z]?)", "Article_"),
    "section_refs": refs(r"(?i)(?:Section|Sec\.?)\s+(\d+[A-Z]?)", "Section_"),
    "part_refs": refs(r"(?i)Part\s+([IVX]+[A-Z]?)", "Part_"),
    "graph_volume_edges": "SELECT 'Article_' || l_partkey AS src, 'Section_' || l_suppkey AS dst, 'refers_to' AS relationship_type, count(*) AS weight FROM lineitem GROUP BY ALL",
    "graph_neighbors": _graph(f", seeds AS (SELECT DISTINCT seed FROM (SELECT src AS seed FROM edges UNION SELECT dst FROM edges) WHERE starts_with(seed, 'Article_')), {_WALKS} SELECT seed, entity FROM near").replace("WITH \nlines", "WITH RECURSIVE \nlines", 1),
    "graph_distance": _graph(f", seeds AS (SELECT DISTINCT seed FROM (SELECT src AS seed FROM edges UNION SELECT dst FROM edges) WHERE starts_with(seed, 'Article_')), {_WALKS} SELECT seed, entity, CASE WHEN isinf(graph_distance) THEN -1.0 ELSE graph_distance END AS graph_distance FROM far").replace("WITH \nlines", "WITH RECURSIVE \nlines", 1),
    "answer_spans": f"WITH {_ANSWERS} SELECT answer_id, span FROM spans",
    "generic_span_filter": f"WITH {_ANSWERS} SELECT answer_id, count(*) AS spans FROM spans WHERE NOT ({_GENERIC}) AND {tokens('span')} >= 3 GROUP BY 1",
    "span_status": f"WITH {_DETECT} SELECT * FROM detected",
    "hallucinated_spans": f"WITH {_DETECT} SELECT * FROM detected WHERE status = 'hallucinated'",
    "hallucination_summary": f"WITH {_DETECT} SELECT a.answer_id, count(status) AS total_spans, count(*) FILTER (WHERE status = 'supported') AS supported, count(*) FILTER (WHERE status = 'uncertain') AS uncertain, count(*) FILTER (WHERE status = 'hallucinated') AS hallucinated, CASE WHEN count(status) > 0 THEN round(count(*) FILTER (WHERE status = 'hallucinated') / count(status), 4) ELSE 0.0 END AS hallucination_rate FROM answers a LEFT JOIN detected d USING (answer_id) GROUP BY 1",
    "faithfulness_scores": f"WITH {_DETECT}, {_SCORES} SELECT * FROM scores",
    "answer_report": f"""WITH {_DETECT}, bad AS (SELECT answer_id, 'hallucinated' AS list, row_number() OVER (PARTITION BY answer_id ORDER BY span) AS n, span, confidence, status FROM detected WHERE status = 'hallucinated'),
good AS (SELECT answer_id, 'spans' AS list, row_number() OVER (PARTITION BY answer_id ORDER BY span) AS n, substr(span, 1, 50) AS span, confidence, status FROM detected) SELECT * FROM bad WHERE n <= 5 UNION ALL SELECT * FROM good WHERE n <= 10""",
    "answer_metrics": f"""WITH {_DETECT}, {_SCORES}, counts AS (SELECT a.answer_id, count(status) AS total_spans, count(*) FILTER (WHERE status = 'supported') AS supported, count(*) FILTER (WHERE status = 'hallucinated') AS hallucinated FROM answers a LEFT JOIN detected USING (answer_id) GROUP BY ALL)
SELECT answer_id, total_spans, supported, hallucinated, overall_faithfulness, round(faithfulness_score, 2) AS faithfulness, hallucinated AS unsupported_claims, round(evidence_coverage_score, 2) AS evidence_coverage FROM counts JOIN scores USING (answer_id)""",
    "text_embedding": f"SELECT doc_id, i - 1 AS dim, round(v[i], 5) AS x FROM ({embedded('documents', 'doc_id', 'text')}), range(1, 65) t(i)",
    "store_rows": f"WITH {_STORE}, e AS ({embedded('stored', 'id', 'content')}) SELECT s.id, doc_id, pos, content AS document, CAST(token_count AS VARCHAR) AS token_count, len(v) AS dim, round(sqrt(list_inner_product(v, v)), 5) AS norm FROM stored s JOIN e USING (id)",
    "store_stats": f"WITH {_STORE} SELECT count(*) AS count FROM stored",
    "store_search": f"WITH {_STORE}, {_QUESTIONS}, asked AS ({embedded('questions', 'query_id', 'query')}), e AS ({embedded('stored', 'id', 'content')}), found AS ({ranked('asked', 'e', 3)}) SELECT found.*, content FROM found JOIN stored USING (id)",
    "hybrid_chunk": _hybrid(),
    "graph_search": _vectors_fused("SELECT query_id, entity, chunk_id, CASE WHEN isinf(graph_distance) THEN -1.0 ELSE graph_distance END AS graph_distance FROM graph_hits"),
    "fused_retrieval": _vectors_fused("SELECT * FROM fused"),
    "context_assembly": _vectors_fused("SELECT query_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM fused LEFT JOIN documents ON doc_id = chunk_id GROUP BY ALL"),
    "process_query": _answered("SELECT answer_id, answer, md5(context) AS context_md5, s.* EXCLUDE (answer_id) FROM answers JOIN scores s USING (answer_id)"),
    "retrieval_metadata": _answered("SELECT query_id, answer, rank, article, final_score AS score, source FROM fused LEFT JOIN named ON id = chunk_id JOIN answers ON answer_id = query_id"),
    "answer_sources": _answered("SELECT query_id, rank + 1 AS n, article, final_score, substr(coalesce(content, ''), 1, 500) || '...' AS preview FROM fused LEFT JOIN named ON id = chunk_id WHERE rank < 3"),
}
