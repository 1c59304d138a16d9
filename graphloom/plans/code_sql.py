"""SQL of the queries on the code graph."""

from __future__ import annotations

from graphloom.functions import paths

_N = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, parent_id DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1)"
_F = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM files) WHERE rn = 1)"
_M = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delivered_at DESC NULLS LAST) AS rn FROM sample_map) WHERE rn = 1)"
_E = "e AS (SELECT edge_id, src_id, dst_id, kind, site_line, min(confidence) AS confidence FROM edges GROUP BY ALL)"
_C = "c AS (SELECT src_id AS src, dst_id AS dst, site_line, confidence FROM e WHERE kind = 'call')"
_TOP = "top AS (SELECT dst AS id FROM c WHERE NOT starts_with(dst, 'name:') GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
_BUSY = "busy AS (SELECT src AS id FROM c WHERE NOT starts_with(dst, 'name:') GROUP BY src ORDER BY count(DISTINCT dst) DESC, src LIMIT 1)"
_CHANGED = "changed AS (SELECT id FROM (SELECT id, first(body_sha ORDER BY updated_at NULLS FIRST, body_sha NULLS FIRST) AS a, last(body_sha ORDER BY updated_at NULLS FIRST, body_sha NULLS FIRST) AS b FROM nodes GROUP BY id) WHERE a IS DISTINCT FROM b)"
_NORMAL = "regexp_replace(replace(path, '\\', '/'), '^(\\./+)+', '')"


def _reach(seeds: str, here: str, there: str) -> str:
    """Distances up to 3 from seeds, each id with its least."""
    levels = [f"l0 AS ({seeds})"]
    for k in (1, 2, 3):
        before = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(k))
        levels.append(f"l{k} AS (SELECT DISTINCT c.{there} AS id FROM c JOIN l{k - 1} ON c.{here} = l{k - 1}.id WHERE c.{there} NOT IN ({before}))")
    return ", ".join(levels)


_ALL = " UNION ALL ".join(f"SELECT id, {k} AS distance FROM l{k}" for k in range(4))


_VERSIONED = ["parent_id", "file_id", "name", "qualified_name", "start_line", "end_line", "signature", "body_sha", "degree"]


def _differing(fields: list[str], a: str, b: str) -> str:
    return ", ".join(f"CASE WHEN {a}.{c} IS DISTINCT FROM {b}.{c} THEN '{c}' END" for c in fields)


def _case(pairs: dict[str, str], value: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


_SUFFIX = "nullif(lower(regexp_extract(p, '[^/]\\.([A-Za-z0-9]+)$', 1)), '')"
_QUOTED = lambda names: ", ".join(f"'{x}'" for x in names)
_ROLES = "concat_ws(',', " + ", ".join(f"CASE WHEN list_has_any(folders, [{_QUOTED(names)}]) THEN '{role}' END" for role, names in sorted(paths.ROLES.items())) + ")"
_LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
_LINES = f"lines AS (SELECT sha256, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM (SELECT sha256, regexp_split_to_array(regexp_replace(content, '(?:{_LINE_END})\\z', ''), '{_LINE_END}') AS l FROM source_texts WHERE content IS NOT NULL))"
_WORDS = "list_filter(regexp_split_to_array(lower(concat_ws(' ', replace(name, '_', ' '), replace(qualified_name, '_', ' '), replace(signature, '_', ' '))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"

SQL = {
    "current_symbols": f"WITH {_N} SELECT id, kind, qualified_name, file_id, updated_at FROM n",
    "degree_topk": f"WITH {_E}, {_C} SELECT dst, count(*) AS degree FROM c GROUP BY dst ORDER BY degree DESC, dst LIMIT 50",
    "degree_recount": f"WITH {_N}, {_E}, {_C} SELECT n.id, n.degree, coalesce(k.counted, 0) AS counted FROM n LEFT JOIN (SELECT dst, count(*) AS counted FROM c GROUP BY dst) k ON k.dst = n.id WHERE n.degree IS DISTINCT FROM coalesce(k.counted, 0)",
    "callers_of_top": f"WITH {_E}, {_C}, {_TOP}, {_reach('SELECT id FROM top', 'dst', 'src')} " + " UNION ALL ".join(f"SELECT {k + 1} AS level, c.* FROM c JOIN l{k} ON c.dst = l{k}.id" for k in range(3)),
    "callers_limited": f"WITH {_E}, {_C}, {_TOP}, {_reach('SELECT id FROM top', 'dst', 'src')}, w AS (" + " UNION ALL ".join(f"SELECT {k + 1} AS level, c.src, c.dst, c.site_line FROM c JOIN l{k} ON c.dst = l{k}.id" for k in range(3)) + ") SELECT *, (SELECT count(*) FROM w) > 100 AS truncated FROM w ORDER BY level, dst, src, site_line LIMIT 100",
    "callees_from_top": f"WITH {_E}, {_C}, {_BUSY}, {_reach('SELECT id FROM busy', 'src', 'dst')} {_ALL}",
    "edge_histogram": f"WITH {_E} SELECT kind, confidence, count(*) AS n FROM e GROUP BY ALL",
    "call_shape": f"""WITH {_E}, {_C}, once AS (SELECT DISTINCT src, dst FROM c WHERE src <> dst), ids AS (SELECT DISTINCT id FROM nodes),
x AS (SELECT ids.id, coalesce(o.k, 0) AS o, coalesce(i.k, 0) AS i FROM ids LEFT JOIN (SELECT src, count(*) AS k FROM once GROUP BY src) o ON o.src = ids.id LEFT JOIN (SELECT dst, count(*) AS k FROM once GROUP BY dst) i ON i.dst = ids.id)
SELECT count(*) AS n_nodes, count(*) FILTER (i = 0 AND o > 0) AS n_source, count(*) FILTER (o = 0 AND i > 0) AS n_sink, count(*) FILTER (o > 1) AS n_fork, count(*) FILTER (i > 1) AS n_join, count(*) FILTER (i = 0 AND o = 0) AS n_isolated FROM x""",
    "file_rollup": f"""WITH {_N}, {_E}, g AS (SELECT id, file_id FROM n WHERE file_id IS NOT NULL),
x AS (SELECT coalesce(a.file_id, src_id) AS from_group, coalesce(b.file_id, dst_id) AS to_group, kind, src_id, dst_id FROM e LEFT JOIN g a ON a.id = src_id LEFT JOIN g b ON b.id = dst_id)
SELECT from_group, to_group, kind, count(*) AS n_edges, count(DISTINCT (src_id, dst_id)) AS n_members FROM x WHERE NOT starts_with(to_group, 'name:') GROUP BY ALL""",
    "folder_rollup": f"""WITH {_N}, {_F}, {_E}, ff AS (SELECT id AS file_id, CASE WHEN regexp_extract({_NORMAL}, '^([^/]+)/', 1) = '' THEN '.' ELSE regexp_extract({_NORMAL}, '^([^/]+)/', 1) END AS folder FROM f),
g AS (SELECT n.id, folder FROM n JOIN ff USING (file_id) UNION ALL SELECT file_id, folder FROM ff)
SELECT a.folder AS from_group, b.folder AS to_group, kind, count(*) AS n_edges, count(DISTINCT (src_id, dst_id)) AS n_members FROM e JOIN g a ON a.id = src_id JOIN g b ON b.id = dst_id WHERE NOT starts_with(dst_id, 'name:') GROUP BY ALL""",
    "related_files": f"""WITH {_N}, {_E} SELECT a.file_id AS from_file, b.file_id AS to_file, count(*) AS n_edges, array_to_string(list_sort(list(DISTINCT e.kind))[1:4], ',') AS kinds
FROM e JOIN n a ON a.id = src_id JOIN n b ON b.id = dst_id WHERE a.file_id <> b.file_id GROUP BY ALL""",
    "resolve_calls": f"""WITH {_N}, {_F}, {_E}, own AS (SELECT n.id, f.project_id AS g, n.file_id, n.name, n.qualified_name AS q FROM n JOIN f ON f.id = n.file_id),
sites AS (SELECT edge_id, g, file_id, coalesce(q, '') AS scope, substr(dst_id, 6) AS name FROM e JOIN own ON own.id = src_id WHERE e.kind = 'call' AND starts_with(dst_id, 'name:')),
tried AS (SELECT *, unnest(range(0, CASE WHEN contains(name, '.') OR scope = '' THEN 1 ELSE len(string_split(scope, '.')) + 1 END)) AS up FROM sites),
fulls AS (SELECT *, CASE WHEN contains(name, '.') OR scope = '' OR up = len(string_split(scope, '.')) THEN name ELSE array_to_string(string_split(scope, '.')[1:len(string_split(scope, '.')) - up], '.') || '.' || name END AS q FROM tried),
local AS (SELECT t.edge_id, t.up, o.id FROM fulls t JOIN own o ON o.file_id = t.file_id AND o.q = t.q),
home AS (SELECT edge_id, id FROM local l WHERE up = (SELECT min(up) FROM local k WHERE k.edge_id = l.edge_id)),
away AS (SELECT s.edge_id, o.id FROM sites s LEFT JOIN own o ON o.g = s.g AND (o.name = s.name OR o.q = s.name) WHERE s.edge_id NOT IN (SELECT edge_id FROM home)),
found AS (SELECT *, 'resolved_local' AS place FROM home UNION ALL SELECT *, 'unique_in_project' FROM away),
k AS (SELECT *, count(id) OVER (PARTITION BY edge_id) AS n FROM found)
SELECT k.edge_id AS site_id, coalesce(k.id, 'name:' || s.name) AS dst_id, CASE WHEN n = 0 THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE place END AS confidence FROM k JOIN sites s USING (edge_id)""",
    "enclosing_symbols": f"""WITH {_N}, {_E}, p AS (SELECT e.edge_id, n.file_id, e.site_line FROM e JOIN n ON n.id = e.src_id WHERE e.kind = 'call' AND n.file_id IS NOT NULL)
SELECT edge_id AS point_id, id AS span_id FROM (SELECT p.edge_id, n.id, row_number() OVER (PARTITION BY p.edge_id ORDER BY n.start_line DESC, n.end_line, n.id) AS k FROM p JOIN n ON n.file_id = p.file_id AND p.site_line BETWEEN n.start_line AND n.end_line) WHERE k = 1""",
    "covered_lines": f"""WITH {_N}, s AS (SELECT file_id, start_line, end_line, max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n WHERE file_id IS NOT NULL AND start_line <= end_line),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT file_id, min(start_line) AS start_line, max(end_line) AS end_line FROM r GROUP BY file_id, run""",
    "uncovered_lines": f"""WITH {_N}, s AS (SELECT file_id, start_line, end_line, max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n WHERE file_id IS NOT NULL AND start_line <= end_line),
top AS (SELECT file_id, max(end_line) AS high FROM n WHERE file_id IS NOT NULL GROUP BY file_id),
g AS (SELECT file_id, coalesce(reach + 1, 1) AS gap_start, start_line - 1 AS gap_end FROM s WHERE start_line > coalesce(reach + 1, 1) UNION ALL SELECT s.file_id, max(s.end_line) + 1, high FROM s JOIN top USING (file_id) GROUP BY s.file_id, high)
SELECT * FROM g WHERE gap_start <= gap_end""",
    "file_mismatch": f"""WITH {_F}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM files WHERE updated_at IS NULL OR updated_at < '2026-01-01T00:00:00Z') WHERE rn = 1),
x AS (SELECT coalesce(o.id, f.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN f.id IS NULL THEN 'deleted' ELSE 'modified' END AS change, CASE WHEN o.id IS NULL OR f.id IS NULL THEN '' ELSE concat_ws(',', {_differing(["commit_id", "language", "parser_id", "path", "sha256", "state"], "o", "f")}) END AS changed_fields FROM o FULL JOIN f ON f.id = o.id)
SELECT * FROM x WHERE change <> 'modified' OR changed_fields <> ''""",
    "symbol_versions": f"""WITH x AS (SELECT DISTINCT id, updated_at, {', '.join(_VERSIONED)} FROM nodes),
y AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY id) AS n FROM x WINDOW w AS (PARTITION BY id ORDER BY updated_at NULLS FIRST, {', '.join(f'{c} NULLS FIRST' for c in _VERSIONED)}))
SELECT a.id, a.n AS n_versions, concat_ws(',', {_differing(sorted(_VERSIONED), "a", "b")}) AS changed_fields FROM y a JOIN y b ON b.id IS NOT DISTINCT FROM a.id AND a.k = 1 AND b.k = b.n WHERE a.n > 1""",
    "containment_left": f"""WITH RECURSIVE {_N}, w AS (SELECT id AS own, parent_id AS up, 1 AS k FROM n WHERE parent_id IN (SELECT id FROM n) UNION ALL SELECT w.own, n.parent_id, w.k + 1 FROM w JOIN n ON n.id = w.up WHERE w.up <> w.own AND w.k < 2000)
SELECT n.parent_id AS src, n.id AS dst FROM n WHERE n.id IN (SELECT own FROM w WHERE up = own)""",
    "call_circles": f"""WITH RECURSIVE {_E}, {_C}, g AS (SELECT DISTINCT src, dst FROM c WHERE NOT starts_with(dst, 'name:')), r AS (SELECT src AS a, dst AS b FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b)
SELECT x.a AS id, min(y.a) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a""",
    "call_components": f"""WITH RECURSIVE {_E}, {_C}, u AS (SELECT src AS a, dst AS b FROM c WHERE NOT starts_with(dst, 'name:') AND src <> dst UNION SELECT dst, src FROM c WHERE NOT starts_with(dst, 'name:') AND src <> dst),
ids AS (SELECT id FROM nodes WHERE id IS NOT NULL UNION SELECT a FROM u),
cc(id, component) USING KEY (id) AS (SELECT id, id FROM ids UNION SELECT u.b, min(cc.component) FROM cc JOIN u ON u.a = cc.id JOIN recurring.cc r ON r.id = u.b WHERE cc.component < r.component GROUP BY u.b)
SELECT id, component FROM cc""",
    "map_renames": f"""WITH {_M}, last AS (SELECT project_id, max(revision) AS revision FROM snapshot_history GROUP BY project_id),
docs AS (SELECT DISTINCT project_id, unnest(from_json(json_extract(document, '$.sources'), '[{{"path":"VARCHAR","sha256":"VARCHAR"}}]')) AS s FROM snapshot_history JOIN last USING (project_id, revision)),
old AS (SELECT project_id, nfc_normalize(regexp_replace(replace(s.path, '\\', '/'), '^(\\./+)+', '')) AS path, max(lower(s.sha256)) AS sha FROM docs GROUP BY ALL),
now AS (SELECT project_id, nfc_normalize({_NORMAL}) AS path, lower(sha256) AS sha FROM m),
gone AS (SELECT project_id, sha, min(path) AS from_path FROM old WHERE (project_id, path) NOT IN (SELECT (project_id, path) FROM now) GROUP BY ALL HAVING count(*) = 1),
came AS (SELECT project_id, sha, min(path) AS to_path FROM now WHERE project_id IN (SELECT project_id FROM old) AND (project_id, path) NOT IN (SELECT (project_id, path) FROM old) GROUP BY ALL HAVING count(*) = 1)
SELECT project_id, from_path, to_path FROM gone JOIN came USING (project_id, sha)""",
    "invalidation": f"""WITH {_E}, {_C}, {_CHANGED}, stale AS (SELECT id FROM changed)
SELECT id, 'stale' AS status FROM stale UNION ALL SELECT DISTINCT src, 'suspect' FROM c WHERE dst IN (SELECT id FROM stale) AND src NOT IN (SELECT id FROM stale)""",
    "impact": f"WITH {_E}, {_C}, {_CHANGED}, {_reach('SELECT id FROM changed', 'dst', 'src')} {_ALL}",
    "work_queue": f"WITH {_N} SELECT id AS node_id, degree * 10 - CASE WHEN degree = 0 THEN 1 ELSE 0 END AS priority, CAST(greatest(128, floor(((end_line - start_line + 1) * 40 + 2) / 3) + 512) AS BIGINT) AS estimated_tokens FROM n",
    "symbol_pages": f"WITH {_N}, r AS (SELECT id, row_number() OVER (ORDER BY file_id NULLS FIRST, start_line NULLS FIRST, id) AS rank FROM n) SELECT id, rank, (rank - 1) // 100 AS page FROM r",
    "repo_map": f"""WITH RECURSIVE {_N}, {_F}, x AS (SELECT f.project_id, n.id, CAST(strlen(f.path || ':' || CAST(n.start_line AS VARCHAR) || '  ' || coalesce(n.signature, '')) + 1 AS INTEGER) AS cost,
  row_number() OVER (PARTITION BY f.project_id ORDER BY n.degree DESC, f.path, n.start_line, n.id) AS k FROM n JOIN f ON f.id = n.file_id WHERE strlen(f.path || ':' || CAST(n.start_line AS VARCHAR) || '  ' || coalesce(n.signature, '')) + 1 <= 2000),
walk AS (SELECT project_id, id, cost, k, true AS taken, 2000 - cost AS remaining FROM x WHERE k = 1
  UNION ALL SELECT x.project_id, x.id, x.cost, x.k, x.cost <= w.remaining, CASE WHEN x.cost <= w.remaining THEN w.remaining - x.cost ELSE w.remaining END FROM walk w JOIN x ON x.project_id = w.project_id AND x.k = w.k + 1)
SELECT project_id, id, cost FROM walk WHERE taken""",
    "symbol_search": f"""WITH {_N}, w AS (SELECT id, {_WORDS} AS t FROM n), s AS (SELECT count(*) AS total, avg(len(t)) AS mean FROM w),
df AS (SELECT term, (SELECT count(*) FROM w WHERE list_contains(t, term)) AS df FROM (VALUES ('scan'), ('ledger')) v(term)),
p AS (SELECT id, term, len(t) AS length, len(list_filter(t, lambda x: x = term)) AS tf, df FROM w, df WHERE list_contains(t, 'scan') AND list_contains(t, 'ledger'))
SELECT id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM p, s GROUP BY id ORDER BY score DESC, id LIMIT 50""",
    "symbol_fuzzy": f"WITH {_N} SELECT id, name FROM n WHERE contains(lower(name), 'ledger') OR contains(lower(qualified_name), 'ledger')",
    "line_grep": f"WITH {_LINES} SELECT sha256, CAST(line_no AS INTEGER) AS line_no, substr(line, 1, 2000) AS line FROM lines WHERE contains(lower(line), 'signal(')",
    "line_counts": f"WITH {_LINES} SELECT sha256, count(*) AS n_lines, CAST(max(length(line)) AS INTEGER) AS longest FROM lines GROUP BY sha256",
    "path_classes": f"""WITH {_M}, x AS (SELECT id, {_NORMAL} AS p FROM m), y AS (SELECT *, {_SUFFIX} AS s, string_split(lower(p), '/') AS parts FROM x), z AS (SELECT *, parts[1:len(parts) - 1] AS folders, parts[len(parts)] AS file FROM y)
SELECT id, s AS suffix, CASE WHEN file IN ({_QUOTED(paths.BUILD_NAMES)}) OR s IN ({_QUOTED(paths.BUILD)}) THEN 'build' WHEN {_case(paths.LANGUAGES, 's')} IS NOT NULL THEN 'source' WHEN s IN ({_QUOTED(paths.DOCUMENTATION)}) THEN 'documentation' ELSE 'resource' END AS category,
  {_case(paths.LANGUAGES, 's')} AS language, {_ROLES} AS roles FROM z""",
    "prefix_files": f"WITH {_F} SELECT id, path, state FROM f WHERE starts_with(path, 'src/')",
    "file_states": f"WITH {_F} SELECT state, count(*) AS n_files, CAST(coalesce(sum(CAST(json_extract_string(document, '$.diagnostic_count') AS BIGINT)), 0) AS BIGINT) AS n_diagnostics FROM f GROUP BY state",
    "read_coverage": f"""WITH {_M} SELECT project_id, count(*) AS n_sources, count(*) FILTER (coalesce(included, false)) AS n_included, count(*) FILTER (coalesce(included, false) AND read_state = 'read') AS n_read,
  CAST(coalesce(sum(bytes) FILTER (coalesce(included, false)), 0) AS BIGINT) AS included_bytes FROM m GROUP BY project_id""",
    "same_content": f"WITH {_M} SELECT lower(sha256) AS sha256, count(*) AS n_files FROM m WHERE sha256 IS NOT NULL GROUP BY lower(sha256) HAVING count(*) > 1",
    "map_digest": f"""WITH {_M}, parts AS (SELECT project_id, substr(sha256(path), 1, 2) AS part, sha256(string_agg(path || ' ' || sha256, chr(10) ORDER BY path || ' ' || sha256)) AS sha FROM m GROUP BY ALL)
SELECT project_id, sha256(string_agg(sha, chr(10) ORDER BY part)) AS digest FROM parts GROUP BY project_id""",
    "key_violations": f"""WITH {_M}, {_N}, {_E} SELECT 'path_unique' AS rule, min(id) AS record_id FROM m GROUP BY project_id, {_NORMAL} HAVING count(*) > 1
UNION ALL SELECT 'sha256_form', id FROM m WHERE NOT coalesce(regexp_matches(sha256, '^[0-9a-f]{{64}}$'), false)
UNION ALL SELECT 'line_order', id FROM n WHERE start_line < 1 OR end_line < start_line
UNION ALL SELECT 'confidence_known', CAST(edge_id AS VARCHAR) FROM e WHERE NOT coalesce(confidence IN ('resolved_local', 'unique_in_project', 'ambiguous', 'unresolved'), false)
UNION ALL SELECT 'placeholder_unresolved', CAST(edge_id AS VARCHAR) FROM e WHERE starts_with(dst_id, 'name:') AND confidence <> 'unresolved'""",
    "name_labels": f"WITH {_N} SELECT id, CASE WHEN count(*) OVER (PARTITION BY file_id, name) > 1 THEN name || ' · ' || CAST(row_number() OVER (PARTITION BY file_id, name ORDER BY id) AS VARCHAR) ELSE name END AS label FROM n WHERE file_id IS NOT NULL AND name IS NOT NULL",
    "file_top_symbols": f"WITH {_N} SELECT file_id, id, degree, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY degree DESC, id) AS place FROM n WHERE file_id IS NOT NULL) WHERE place <= 3",
}
