"""The same queries as plain SQL over the tables, for comparison."""

from __future__ import annotations

import re

from docweave.plans.fixtures import BASE, EDGES, NODES, SNAPSHOT, TABLES, TARGET

_NAMES = {t: t for t in TABLES} | {"lines": "fx_lines"}


def _plain(text: str) -> str:
    for name, view in _NAMES.items():
        text = text.replace("{" + name + "}", view)
    return text


def _snapshot(how: dict) -> str:
    text = SNAPSHOT.replace("{shift}", how["shift"]).replace("{suffix}", how["suffix"]).replace("{keep}", how["keep"])
    return f"SELECT path AS path_pair, kind, qualified_name, path, concat(path, '#', qualified_name, ':', kind) AS symbol_id, name, sha256(text) AS text_hash, ordinal FROM ({_plain(text)})"


VIEWS = {
    "fx_lines": "SELECT doc_id, line_no, string_split(text, chr(10))[line_no] AS line FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents)",
    "fx_nodes": _plain(NODES),
    "fx_edges": _plain(EDGES),
    "fx_base": _snapshot(BASE),
    "fx_target": _snapshot(TARGET),
    "fx_status": "SELECT o_orderkey % 5 AS c, concat('a', o_orderkey, '.ts') AS a, concat('b', o_orderkey, '.md') AS b FROM orders",
    "fx_changed_files": """SELECT CASE c WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'renamed' END AS status,
        CASE c WHEN 3 THEN b ELSE a END AS path, CASE c WHEN 3 THEN a END AS previous_path FROM fx_status WHERE c < 4""",
    "fx_diff": """SELECT coalesce(o.path_pair, n.path_pair) AS path_pair, coalesce(o.kind, n.kind) AS kind, coalesce(o.qualified_name, n.qualified_name) AS qualified_name,
        CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.text_hash = n.text_hash THEN 'unchanged' ELSE 'modified' END AS status,
        o.text_hash AS old_text_hash, n.text_hash AS new_text_hash, o.path AS old_path, n.path AS new_path, o.symbol_id AS old_symbol_id, n.symbol_id AS new_symbol_id,
        coalesce(n.name, o.name) AS name
        FROM fx_base o FULL OUTER JOIN fx_target n ON o.path_pair = n.path_pair AND o.kind = n.kind AND o.qualified_name = n.qualified_name""",
    "fx_moves": """SELECT r.*, a.new_symbol_id AS came, a.new_path AS came_path FROM fx_diff r JOIN fx_diff a ON r.status = 'removed' AND a.status = 'added'
        AND r.qualified_name = a.qualified_name AND r.old_text_hash = a.new_text_hash AND r.old_path <> a.new_path""",
    "fx_gone": "SELECT concat('src/', r_name, '.ts') AS file_path FROM region WHERE r_regionkey IN (1, 3)",
    "fx_up": "SELECT source_id AS a, target_id AS b FROM fx_edges WHERE type = 'CONTAINS'",
    "fx_changed": "SELECT * FROM fx_nodes WHERE type = 'method' AND (node_id % 7 = 0 OR node_id % 11 = 0)",
    "fx_reached": """SELECT node_id AS change_id, node_id AS spot, 0 AS depth, CAST(NULL AS BIGINT) AS hop FROM fx_changed WHERE node_id % 7 = 0
        UNION ALL SELECT c.node_id, u.a, 1, u.a FROM fx_changed c JOIN fx_up u ON u.b = c.node_id WHERE c.node_id % 7 = 0
        UNION ALL SELECT c.node_id, v.a, 2, u.a FROM fx_changed c JOIN fx_up u ON u.b = c.node_id JOIN fx_up v ON v.b = u.a WHERE c.node_id % 7 = 0""",
    "fx_touched": "SELECT concat('docs/', doc_id, '.md') AS path FROM documents WHERE doc_id % 5 = 0",
    "fx_candidates": """SELECT d.file_path AS document_path, CASE WHEN d.type = 'documentation_section' THEN d.name END AS section_heading, c.stable_id AS related_symbol_id,
        c.name AS related_symbol_name, 'modified' AS related_change_type, min(r.depth) AS depth, min(r.hop) AS hop, c.file_path AS symbol_path
        FROM fx_reached r JOIN fx_edges e ON e.type = 'DOCUMENTS' AND e.source_id = r.spot JOIN fx_nodes d ON d.node_id = e.target_id JOIN fx_nodes c ON c.node_id = r.change_id
        GROUP BY ALL""",
    "fx_first": """SELECT document_path, section_heading, related_symbol_id, related_symbol_name, related_change_type, symbol_path, min(depth) AS depth, min(hop) AS hop
        FROM fx_candidates GROUP BY ALL""",
    "fx_findings": """SELECT document_path, section_heading, related_symbol_id, related_symbol_name, related_change_type,
        CASE depth WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS certainty,
        concat('`', related_symbol_name, '` (method) was modified in ', symbol_path, '. ', CASE WHEN depth = 0 THEN 'This symbol is explicitly documented in this section.'
          ELSE concat('Its containing class (`', h.name, '`) is documented in this section.') END) AS explanation, depth + 2 AS steps
        FROM fx_first LEFT JOIN fx_nodes h ON h.node_id = hop
        UNION ALL SELECT d.file_path, CASE WHEN d.type = 'documentation_section' THEN d.name END, c.stable_id, c.name, 'removed', 'HIGH',
        concat('The symbol `', c.name, '` this section documented no longer exists — it was removed from ', c.file_path, '.'), 0
        FROM fx_changed c JOIN fx_edges e ON e.type = 'DOCUMENTS' AND e.source_id = c.node_id JOIN fx_nodes d ON d.node_id = e.target_id WHERE c.node_id % 7 <> 0""",
    "fx_acted": """SELECT f.*, CASE WHEN document_path IN (SELECT path FROM fx_touched) THEN 'NEEDS_MORE_INFORMATION' ELSE 'REVIEW' END AS action FROM fx_findings f""",
    "fx_import": """SELECT p_partkey AS k, CASE k % 5 WHEN 0 THEN NULL WHEN 3 THEN concat('lib/m', k) WHEN 4 THEN concat('src/m', k, '.ts') ELSE concat('src/m', k) END AS joined,
        CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('./m', k) WHEN 2 THEN concat('../src/./m', k) WHEN 3 THEN concat('../lib/x/../m', k) ELSE concat('./m', k, '.ts') END AS specifier FROM part""",
    "fx_source": """SELECT CASE k % 4 WHEN 0 THEN concat('src/m', k, '/index.ts') WHEN 1 THEN concat('src/m', k, '.ts') WHEN 2 THEN concat('src/m', k, '.mjs') ELSE concat('lib/m', k, '.tsx') END AS path
        FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0)""",
    "fx_suffix": "SELECT * FROM (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.mts'), (4, '.cts'), (5, '.js'), (6, '.jsx'), (7, '.mjs'), (8, '.cjs'), (9, '/index.ts'), (10, '/index.tsx'), (11, '/index.js'), (12, '/index.jsx')) t(rank, suffix)",
    "fx_resolved": """SELECT i.k, specifier, arg_min(s.path, rank) AS target_path FROM fx_import i CROSS JOIN fx_suffix f LEFT JOIN fx_source s ON s.path = concat(i.joined, f.suffix)
        WHERE specifier IS NOT NULL GROUP BY i.k, specifier""",
    "fx_target_of": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('src/ASIA.ts#part', c_custkey) WHEN 1 THEN concat('src/EUROPE.ts#part', c_custkey) WHEN 2 THEN 'src/ASIA.ts' ELSE 'src/ASIA.ts#twin' END AS target FROM customer""",
    "fx_fn": "SELECT node_id, concat(file_path, '#', qualified_name) AS full_name FROM fx_nodes WHERE type = 'function'",
    "fx_patch": """SELECT doc_id, concat('docs/', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.mdx' ELSE '.md' END) AS document_path, CASE WHEN doc_id % 5 = 0 THEN 'Missing' END AS section_heading,
        text AS content, CASE WHEN doc_id % 4 = 0 THEN concat(text, ' stale') ELSE text END AS original,
        CASE doc_id % 3 WHEN 0 THEN 'tiny' WHEN 1 THEN concat(text, chr(10), '```', chr(10)) ELSE concat(text, chr(10), '<!-- docweave:other x -->') END AS proposed FROM documents""",
    "fx_fault": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'document-readable' ELSE 'patch-applicability' END AS "check", 'error' AS severity,
        CASE WHEN doc_id % 7 = 0 THEN concat('Document ', document_path, ' no longer exists, could not be read, or its path escapes the repository.')
             WHEN doc_id % 5 = 0 THEN concat('Section "Missing" was not found in ', document_path, ' — it may have been renamed or removed since this patch was generated.')
             ELSE concat('The content of this section in ', document_path, ' has changed since this patch was generated — regenerate the patch before applying.') END AS message
        FROM fx_patch WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 4 = 0""",
    "fx_size": r"SELECT doc_id, length(regexp_replace(original, '^\s+|\s+$', '', 'g')) AS a, length(regexp_replace(proposed, '^\s+|\s+$', '', 'g')) AS b FROM fx_patch",
    "fx_shrunk": "SELECT doc_id, CAST(floor((1 - b / a) * 100 + 0.5) AS BIGINT) AS percent FROM fx_size WHERE a >= 40 AND b < a * 0.2",
    "fx_doc_code": "SELECT concat('docs/', doc_id, '.md') AS document_path, text AS content FROM documents WHERE doc_id % 11 <> 0",
}


def _needed(sql: str) -> str:
    """``sql`` after the views that it uses, each before its users."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    return sql if not order else "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + ("," + sql[5:] if sql.startswith("WITH ") else " " + sql)


def _bfs(start: int, step: str, depth: int, types: str = "") -> str:
    pairs = {"out": "SELECT source_id AS a, target_id AS b, type FROM fx_edges", "in": "SELECT target_id AS a, source_id AS b, type FROM fx_edges"}
    pairs["both"] = f"{pairs['out']} UNION ALL {pairs['in']}"
    levels = [f"l0 AS (SELECT CAST({start} AS BIGINT) AS n)"]
    seen = "SELECT n, 0 AS depth FROM l0"
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT n FROM l{i}" for i in range(d))
        levels.append(f"l{d} AS (SELECT DISTINCT b AS n FROM l{d - 1} JOIN hops ON a = n WHERE b NOT IN ({before}))")
        seen += f" UNION ALL SELECT n, {d} FROM l{d}"
    return f"WITH hops AS (SELECT a, b FROM ({pairs[step]}) {types}), {', '.join(levels)} SELECT n AS node_id, depth FROM ({seen})"


_PATH = "concat('docs/', doc_id, '.md')"
SQL = {
    "scan_manifest": f"SELECT {_PATH} AS path, 'markdown' AS language, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents",
    "detect_language": """SELECT concat('p/', p_partkey, '.', s) AS path, CASE WHEN s IN ('ts', 'TSX', 'd.ts') THEN 'typescript' WHEN s = 'mjs' THEN 'javascript' WHEN s IN ('md', 'Mdx') THEN 'markdown' END AS language
        FROM (SELECT p_partkey, ['ts', 'TSX', 'mjs', 'md', 'Mdx', 'py', 'd.ts', ''][CAST(p_partkey % 8 + 1 AS INT)] AS s FROM part)""",
    "manifest_diff": """SELECT concat('o/', o_orderkey, '.ts') AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'added' WHEN o_orderkey % 13 = 0 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'modified' ELSE 'unchanged' END AS status
        FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 13 = 0)""",
    "manifest_diff_summary": """SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'added' WHEN o_orderkey % 13 = 0 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'modified' ELSE 'unchanged' END AS status, count(*) AS n
        FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 13 = 0) GROUP BY 1""",
    "name_status_parse": "SELECT * FROM fx_changed_files",
    "changed_files_union": """SELECT *, CASE WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.jsx' THEN 'javascript' ELSE 'typescript' END AS language
        FROM (SELECT * FROM fx_changed_files UNION ALL SELECT 'added', concat('new/', c_custkey, '.jsx'), NULL FROM customer)""",
    "symbol_diff": "SELECT path_pair, kind, qualified_name, status, old_text_hash, new_text_hash FROM fx_diff",
    "symbol_moves": "SELECT old_symbol_id AS previous_symbol_id, came AS symbol_id FROM fx_moves",
    "change_set": """SELECT 0 AS order_group, 'added' AS change_type, new_symbol_id AS symbol_id, name, kind, new_path AS file_path, NULL AS previous_file_path, NULL AS previous_symbol_id,
          concat('Function `', qualified_name, '` added in ', new_path) AS description, 'Symbol is absent in the base revision and present in the target.' AS evidence
        FROM fx_diff WHERE status = 'added' AND new_symbol_id NOT IN (SELECT came FROM fx_moves)
        UNION ALL SELECT 1, 'removed', old_symbol_id, name, kind, old_path, NULL, NULL, concat('Function `', qualified_name, '` removed from ', old_path), 'Symbol is present in the base revision and absent in the target.'
        FROM fx_diff WHERE status = 'removed' AND old_symbol_id NOT IN (SELECT old_symbol_id FROM fx_moves)
        UNION ALL SELECT 2, 'modified', new_symbol_id, name, kind, new_path, NULL, NULL, concat('Function `', qualified_name, '` changed in ', new_path), 'This symbol''s own source text differs between the two revisions.'
        FROM fx_diff WHERE status = 'modified'
        UNION ALL SELECT 3, 'moved', came, name, kind, came_path, old_path, old_symbol_id, concat('Function `', qualified_name, '` moved from ', old_path, ' to ', came_path),
          'Identical source text was removed from one file and added, unchanged, to another.' FROM fx_moves""",
    "line_slices": "SELECT doc_id, lines, sha256(lines) AS hash FROM (SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents)",
    "stable_ids": """SELECT concat(p, '#', n_name, ':class') AS symbol_id, concat(p, '#<file>:file') AS file_id, concat(p, '#<page>:documentation_page') AS page_id,
        concat(p, '#', regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9_ -]', '', 'g'), ' ', '-', 'g'), ':documentation_section') AS section_id
        FROM (SELECT n_name, concat('src/', r_name, '.ts') AS p FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "upsert_nodes_last_wins": """SELECT coalesce(n.s, o.s) AS stable_id, coalesce(n.t, o.t) AS type, coalesce(n.name, 'old') AS name, o.s IS NOT NULL AS kept_id FROM
        (SELECT concat('u', user_id, '#', event_type) AS s, min(event_type) AS t FROM events WHERE event_id % 3 = 0 GROUP BY 1) o FULL OUTER JOIN
        (SELECT concat('u', user_id, '#', event_type) AS s, max(event_type) AS t, concat('e', max(event_id)) AS name FROM events WHERE event_id % 3 <> 0 GROUP BY 1) n ON o.s = n.s""",
    "upsert_edges_keep_created": """SELECT user_id % 50 AS source_id, user_id % 7 AS target_id, event_type AS evidence_type, concat('m', max(event_id)) AS metadata, min(event_id) AS created_at FROM events GROUP BY ALL""",
    "delete_nodes_dangling": """SELECT s.stable_id AS source_stable_id, t.stable_id AS target_stable_id, e.type AS edge_type FROM fx_edges e JOIN fx_nodes s ON s.node_id = source_id JOIN fx_nodes t ON t.node_id = target_id
        WHERE (s.file_path IN (SELECT file_path FROM fx_gone)) <> (t.file_path IN (SELECT file_path FROM fx_gone))""",
    "delete_nodes_dangling_between": """WITH gone AS (SELECT concat('src/', r_name, '.ts') AS f FROM region WHERE r_regionkey IN (1, 2, 3) UNION ALL SELECT concat('docs/', doc_id, '.md') FROM documents WHERE doc_id % 4 = 0)
        SELECT s.stable_id AS source_stable_id, t.stable_id AS target_stable_id, e.type AS edge_type FROM fx_edges e JOIN fx_nodes s ON s.node_id = source_id JOIN fx_nodes t ON t.node_id = target_id
        WHERE s.file_path <> t.file_path AND (s.file_path IN (SELECT f FROM gone) OR t.file_path IN (SELECT f FROM gone))""",
    "delete_cascade_remaining": """SELECT type, count(*) AS n, 'node' AS what FROM fx_nodes WHERE file_path NOT IN (SELECT file_path FROM fx_gone) GROUP BY type
        UNION ALL SELECT e.type, count(*), 'edge' FROM fx_edges e JOIN fx_nodes s ON s.node_id = source_id JOIN fx_nodes t ON t.node_id = target_id
        WHERE s.file_path NOT IN (SELECT file_path FROM fx_gone) AND t.file_path NOT IN (SELECT file_path FROM fx_gone) GROUP BY e.type""",
    "delete_files_remaining": "SELECT concat('lib/s', s_suppkey, '.ts') AS path FROM supplier WHERE s_suppkey % 10 <> 3",
    "upsert_files_snapshot": """SELECT concat('lib/s', s_suppkey, '.ts') AS path, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS content_hash FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 <> 0""",
    "code_contains": "SELECT 'class' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'method', count(*) FROM customer UNION ALL SELECT 'function', count(*) FROM part",
    "doc_contains": f"SELECT {_PATH} AS file_path, count(*) AS sections FROM fx_lines WHERE line_no % 3 = 1 GROUP BY doc_id",
    "list_nodes_topn": "SELECT node_id, stable_id, type FROM fx_nodes WHERE type IN ('class', 'method') ORDER BY node_id LIMIT 300",
    "list_edges_topn": "SELECT type, source_id, target_id FROM fx_edges WHERE type IN ('CALLS', 'IMPORTS') ORDER BY type, source_id, target_id LIMIT 500",
    "node_lookup": """SELECT 'id' AS how, node_id, stable_id, name FROM fx_nodes WHERE node_id = 1000007 UNION ALL SELECT 'stable_id', node_id, stable_id, name FROM fx_nodes
        WHERE stable_id = 'docs/3.md#<page>:documentation_page' UNION ALL SELECT 'name', node_id, stable_id, name FROM fx_nodes WHERE file_path = 'src/ASIA.ts' AND qualified_name = 'part2'""",
    "nodes_of_type": "SELECT node_id, name, file_path FROM fx_nodes WHERE type = 'class'",
    "docs_referencing_file": """SELECT DISTINCT s.file_path AS code_path, t.file_path AS doc_path FROM fx_edges e JOIN fx_nodes s ON s.node_id = source_id JOIN fx_nodes t ON t.node_id = target_id
        WHERE e.type = 'DOCUMENTS' AND s.file_path = 'src/ASIA.ts'""",
    "search_nodes": "SELECT node_id, name FROM fx_nodes WHERE contains(lower(name), 'customer#00000001') OR contains(lower(qualified_name), 'customer#00000001') ORDER BY name, node_id LIMIT 50",
    "search_literal_wildcards": """SELECT '%' AS q, node_id FROM fx_nodes WHERE contains(name, '%') OR contains(coalesce(qualified_name, ''), '%') OR contains(file_path, '%')
        UNION ALL SELECT '_', node_id FROM fx_nodes WHERE contains(name, '_') OR contains(coalesce(qualified_name, ''), '_') OR contains(file_path, '_')
        UNION ALL SELECT '<PAGE>', node_id FROM fx_nodes WHERE contains(lower(name), '<page>')
        UNION ALL SELECT 'ÄU', node_id FROM fx_nodes WHERE contains(lower(name), 'äu') OR contains(lower(coalesce(qualified_name, '')), 'äu')""",
    "out_edges": "SELECT type, target_id FROM fx_edges WHERE source_id = 1000007",
    "in_edges": "SELECT type, source_id FROM fx_edges WHERE target_id = 100000002 AND type = 'CALLS'",
    "node_detail": """SELECT node_id, stable_id, (SELECT CAST(count(*) AS INT) FROM fx_edges WHERE source_id = 100003) AS n_out, (SELECT CAST(count(*) AS INT) FROM fx_edges WHERE target_id = 100003) AS n_in
        FROM fx_nodes WHERE node_id = 100003""",
    "neighbor_labels": """SELECT source_id, CASE WHEN target_id % 10 = 9 THEN -target_id ELSE target_id END AS target_id, coalesce(s.qualified_name, s.name) AS source_label,
        CASE WHEN target_id % 10 = 9 THEN concat('#', -target_id) ELSE coalesce(t.qualified_name, t.name) END AS target_label
        FROM fx_edges e JOIN fx_nodes s ON s.node_id = source_id JOIN fx_nodes t ON t.node_id = target_id WHERE e.type IN ('IMPORTS', 'DOCUMENTS')""",
    "induced_subgraph": """SELECT e.type, source_id, target_id FROM fx_edges e WHERE source_id IN (SELECT node_id FROM fx_nodes WHERE type IN ('file', 'class', 'method') ORDER BY node_id LIMIT 300)
        AND target_id IN (SELECT node_id FROM fx_nodes WHERE type IN ('file', 'class', 'method') ORDER BY node_id LIMIT 300)""",
    "merge_by_id": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "count_by_type_nodes": "SELECT type, count(*) AS n FROM fx_nodes GROUP BY type",
    "count_by_type_edges": "SELECT type, count(*) AS n FROM fx_edges GROUP BY type",
    "repo_counts": """SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS repository_root, (SELECT count(*) FROM fx_nodes WHERE type = 'file' AND node_id % 4 = r_regionkey) AS file_count,
        (SELECT count(*) FROM fx_nodes WHERE type IN ('class', 'method', 'file') AND node_id % 4 = r_regionkey) AS node_count,
        (SELECT count(*) FROM fx_edges WHERE type = 'IMPORTS' AND source_id % 4 = r_regionkey) AS edge_count FROM region""",
    "repo_type_breakdown": """SELECT repository_id, string_agg(concat(type, ': ', n), ', ' ORDER BY type) AS breakdown FROM
        (SELECT node_id % 3 AS repository_id, type, count(*) AS n FROM fx_nodes WHERE type IN ('class', 'method', 'file') GROUP BY 1, 2) GROUP BY 1""",
    "bfs_out": _bfs(2, "out", 2),
    "bfs_in": _bfs(100000002, "in", 3),
    "bfs_both": _bfs(1000007, "both", 2),
    "bfs_typed": _bfs(2, "out", 2, "WHERE type IN ('CONTAINS', 'DOCUMENTS')"),
    "bfs_cycle": _bfs(0, "out", 9, "WHERE type = 'IMPORTS'"),
    "shortest_path": f"SELECT CAST(max(depth) AS BIGINT) AS distance FROM ({_bfs(501, 'both', 4)}) WHERE node_id = 100000",
    "traverse_for_docs": "SELECT change_id, target_id AS doc_id, depth, depth + 2 AS steps FROM fx_reached JOIN fx_edges ON source_id = spot WHERE type = 'DOCUMENTS'",
    "resolve_imports": "SELECT 'src/app.ts' AS file_path, target_path FROM fx_resolved WHERE target_path IS NOT NULL",
    "unresolved_imports": "SELECT 'src/app.ts' AS file_path, specifier FROM fx_resolved WHERE target_path IS NULL",
    "resolve_annotations": "SELECT c_custkey, node_id AS target_node FROM fx_target_of JOIN fx_fn ON full_name = target",
    "unresolved_annotations": """SELECT c_custkey, target, CASE WHEN NOT contains(target, '#') THEN 'Target has no #' WHEN target LIKE '%#twin' THEN 'Ambiguous: 5 symbols named twin'
        ELSE concat('No symbol ', string_split(target, '#')[2], ' in ', string_split(target, '#')[1]) END AS reason, CASE WHEN target LIKE '%#twin' THEN 5 ELSE 0 END AS matches
        FROM fx_target_of WHERE target NOT IN (SELECT full_name FROM fx_fn)""",
    "section_for_line": """SELECT l.doc_id AS doc, l.line_no AS line, min(s.line_no) AS section_id FROM fx_lines l LEFT JOIN (SELECT * FROM fx_lines WHERE line <> '' AND line_no % 3 = 1) s
        ON s.doc_id = l.doc_id AND l.line_no BETWEEN s.line_no AND s.line_no + 1 WHERE l.line <> '' GROUP BY 1, 2""",
    "resolve_calls": "SELECT source_id AS caller, target_id AS callee FROM fx_edges WHERE type = 'CALLS'",
    "affected_docs": f"""SELECT DISTINCT t.file_path FROM fx_edges e JOIN fx_nodes s ON s.node_id = source_id JOIN fx_nodes t ON t.node_id = target_id
        WHERE e.type = 'DOCUMENTS' AND s.file_path IN (SELECT file_path FROM fx_gone) AND t.file_path NOT IN (SELECT {_PATH} FROM documents WHERE doc_id % 4 = 0)""",
    "impact_findings": "SELECT document_path, section_heading, related_symbol_id, related_change_type, certainty, action, explanation, steps FROM fx_acted",
    "impact_by_action": "SELECT action, count(*) AS n FROM fx_acted GROUP BY action",
    "impact_by_certainty": "SELECT certainty, count(*) AS n FROM fx_acted GROUP BY certainty",
    "dangling_change_match": """SELECT c.stable_id AS symbol_id, d.stable_id AS target_stable_id FROM fx_changed c JOIN fx_edges e ON e.type = 'DOCUMENTS' AND e.source_id = c.node_id
        JOIN fx_nodes d ON d.node_id = e.target_id WHERE c.node_id % 7 <> 0""",
    "sections": f"""SELECT {_PATH} AS document_path, concat('h', line_no - 1) AS heading, CAST(line_no AS INTEGER) AS start_line, CAST(least(line_no + 2, n) AS INTEGER) AS end_line
        FROM (SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id) AS n FROM fx_lines) WHERE line_no % 3 = 1""",
    "locate_sections": """SELECT doc_id, h AS section_heading, CASE WHEN h IS NULL THEN 1 WHEN spot <= n THEN spot END AS start_line, CASE WHEN h IS NULL THEN n WHEN spot <= n THEN least(spot + 2, n) END AS end_line,
        CASE WHEN h IS NULL THEN 5 * ((n + 2) // 3) + 4 * (n - (n + 2) // 3) + n - 1 WHEN spot <= n THEN 5 + 5 * (least(spot + 2, n) - spot) END AS chars
        FROM (SELECT doc_id, CAST(max(line_no) AS INTEGER) AS n FROM fx_lines GROUP BY doc_id) CROSS JOIN (VALUES ('h0', 1), ('h3', 4), (NULL, 1)) v(h, spot)""",
    "heading_slugs": r"""SELECT page_id, k, CASE WHEN nth = 1 THEN base ELSE concat(base, '-', nth - 1) END AS slug
        FROM (SELECT page_id, k, base, row_number() OVER (PARTITION BY page_id // 4, base ORDER BY page_id, k) AS nth
          FROM (SELECT page_id, k, CASE k WHEN 1 THEN 'setup' ELSE replace(lower(trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '[^A-Za-z0-9 -]', '', 'g'))), ' ', '-') END AS base
            FROM pages CROSS JOIN (VALUES (0), (1), (2)) v(k)))""",
    "links": r"""SELECT page_id, nth - 1 AS nth, texts[nth] AS text, targets[nth] AS target, regexp_matches(targets[nth], '(?i)^([a-z][a-z0-9+.-]*:)?//') OR starts_with(targets[nth], 'mailto:') AS external
        FROM (SELECT page_id, unnest(generate_series(1, len(texts))) AS nth, texts, targets FROM (SELECT page_id,
          regexp_extract_all(html, '<a href="([^"\s<>()]+)">([^<\[\]]*)</a>', 2) AS texts, regexp_extract_all(html, '<a href="([^"\s<>()]+)">([^<\[\]]*)</a>', 1) AS targets FROM pages))""",
    "link_classes": """SELECT page_id, page_id % 7 IN (0, 1, 2, 5) AS external FROM pages""",
    "html_annotations": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'documents' ELSE 'explains' END AS directive, concat('src/p', page_id, '.ts#f', page_id) AS target, page_id % 3 = 0 AS well_formed,
        CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Unknown docweave directive "explains"' END AS issues FROM pages""",
    "page_comments": """SELECT page_id, nth - 1 AS nth, c[nth] AS comment FROM (SELECT page_id, c, unnest(generate_series(1, len(c))) AS nth FROM
        (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->') AS c FROM pages))""",
    "code_fences": "SELECT c_custkey, 'py' AS language, c_name AS content FROM customer",
    "fence_parity": "SELECT c_custkey, c_custkey % 3 = 0 AS odd FROM customer",
    "symbol_references": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('src/p', p_partkey) WHEN 1 THEN concat('p', p_partkey, '.JSON') WHEN 2 THEN concat('Part.p', p_partkey, '()') ELSE concat('$p', p_partkey) END AS raw,
        CASE WHEN p_partkey % 5 < 2 THEN 'file-path' ELSE 'symbol-like' END AS kind FROM part WHERE p_partkey % 5 <> 3""",
    "jsdoc_tags": """SELECT c_custkey, concat('About ', c_name, ' and more.') AS description, nth, CASE nth WHEN 0 THEN 'param' ELSE 'returns' END AS tag, CASE nth WHEN 0 THEN concat('x ', c_custkey) ELSE 'ok' END AS text
        FROM customer CROSS JOIN (VALUES (0), (1)) v(nth)""",
    "patch_applicability": "SELECT * FROM fx_fault",
    "patch_structure": """SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'code-fence-integrity' ELSE 'annotation-well-formed' END AS "check",
        CASE doc_id % 3 WHEN 1 THEN 'An odd number of ``` fence markers were found — a code fence may be unclosed.' ELSE 'Malformed docweave annotation targeting "x": Unknown docweave directive "other"' END AS message
        FROM fx_patch WHERE doc_id % 3 > 0""",
    "accidental_deletion": "SELECT * FROM fx_shrunk",
    "validation_summary": """SELECT valid, count(*) AS n, CAST(sum(issues) AS BIGINT) AS issues FROM (SELECT p.doc_id, f.doc_id IS NULL AND p.doc_id % 3 = 0 AS valid,
        (f.doc_id IS NOT NULL)::INT + (p.doc_id % 3 > 0)::INT + (s.doc_id IS NOT NULL)::INT AS issues FROM fx_patch p LEFT JOIN fx_fault f USING (doc_id) LEFT JOIN fx_shrunk s USING (doc_id)) GROUP BY valid""",
    "link_anchor_check": """SELECT c_custkey, CASE WHEN k % 5 = 0 THEN 'invalid-anchor' ELSE 'broken-link' END AS "check", CASE WHEN k % 5 = 0 THEN concat('Link "t', k, '" points at anchor "#h', k % 4, '", which doesn''t match any heading in docs/a.md.')
        WHEN k % 5 = 2 THEN concat('Link "t', k, '" points at "../../up.md", which resolves outside the repository.')
        WHEN k % 5 = 1 THEN concat('Link "t', k, '" points at "s', k % 20, '.md#x", which does not exist relative to docs/a.md.')
        ELSE concat('Link "t', k, '" points at "./../docs/s', k % 20, '.md", which does not exist relative to docs/a.md.') END AS message
        FROM (SELECT c_custkey, c_custkey AS k FROM customer) WHERE (k % 5 = 0 AND k % 4 <> 1) OR k % 5 = 2 OR (k % 5 IN (1, 4) AND k % 20 >= 10)""",
    "annotation_target_check": """SELECT c_custkey, concat('Annotation target "', target, '" does not resolve to exactly one known symbol (found 0).') AS message
        FROM fx_target_of WHERE contains(target, '#') AND target NOT IN (SELECT full_name FROM fx_fn)""",
    "safe_paths": """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN concat('/repo/b', p_partkey) WHEN 2 THEN concat('/repo/a/b', p_partkey) WHEN 3 THEN concat('/repo/c', p_partkey) WHEN 5 THEN concat('/repo/d', p_partkey)
        WHEN 7 THEN '/repo' END AS path FROM part""",
    "apply_patch": f"""SELECT {_PATH} AS document_path, sha256(CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'tiny' ELSE text END) AS hash FROM documents""",
    "splice_documents": """SELECT doc_id, sha256(array_to_string(list_concat(l[1:1], ['new' || chr(10) || 'lines'], l[4:]), chr(10))) AS hash FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "generate_offline": """SELECT f.document_path, section_heading, related_symbol_id, CASE WHEN d.content IS NULL THEN 'PROVIDER_UNAVAILABLE' WHEN n.node_id % 2 = 0 THEN 'PROPOSED' ELSE 'NEEDS_MORE_INFORMATION' END AS status,
        CASE WHEN d.content IS NULL THEN 'Could not assemble enough context to attempt generation (matching source or documentation content was not readable).'
             WHEN n.node_id % 2 = 1 THEN 'No "after" source snippet was available for this symbol.' END AS reason,
        CASE WHEN d.content IS NOT NULL AND n.node_id % 2 = 0 THEN sha256(concat(d.content, chr(10), chr(10), '> **Note:** `', related_symbol_name, '` changed and this section may need review. _(mock-generated placeholder, not real prose)_')) END AS proposed_sha256
        FROM fx_acted f JOIN fx_nodes n ON n.stable_id = related_symbol_id LEFT JOIN fx_doc_code d ON d.document_path = f.document_path WHERE action = 'REVIEW' AND related_change_type = 'modified'""",
    "report_summary": """SELECT (SELECT count(*) FROM fx_touched) AS files_changed, (SELECT count(*) FROM fx_changed) AS symbols_changed, (SELECT count(*) FROM fx_acted) AS findings,
        (SELECT string_agg(concat(action, '=', n), ',' ORDER BY action) FROM (SELECT action, count(*) AS n FROM fx_acted GROUP BY action)) AS by_action,
        (SELECT string_agg(concat(certainty, '=', n), ',' ORDER BY certainty) FROM (SELECT certainty, count(*) AS n FROM fx_acted GROUP BY certainty)) AS by_certainty""",
    "report_annotations": """SELECT related_symbol_id, document_path, concat('::', CASE certainty WHEN 'HIGH' THEN 'warning' ELSE 'notice' END, ' file=', document_path, ',line=', steps, CASE WHEN steps <> 2 THEN ',endLine=2' ELSE '' END,
        ',title=docweave%3A ', action, ' (', certainty, ')::', replace(explanation, '%', '%25'), '%0A100%25') AS line FROM fx_acted""",
    "report_markdown_lines": """SELECT concat('| modified | ', path, ' |') AS line FROM fx_touched
        UNION ALL SELECT concat('| ', CASE WHEN node_id % 7 = 0 THEN 'modified' ELSE 'removed' END, ' | `', name, '` (method) | ', file_path, ' |') FROM fx_changed
        UNION ALL SELECT concat('### [', action, '] ', document_path, ' — ', coalesce(section_heading, '(whole page)'), chr(10), chr(10), '- **Certainty:** ', certainty, chr(10), '- **Related:** `', related_symbol_name, '` (', related_change_type, ')',
          chr(10), '- **Why:** ', explanation) FROM fx_acted""",
    "label_nodes": """SELECT type, CASE type WHEN 'file' THEN 'File' WHEN 'documentation_page' THEN 'Doc page' WHEN 'documentation_section' THEN 'Doc section' WHEN 'class' THEN 'Class' WHEN 'function' THEN 'Function' ELSE 'Method' END AS label,
        replace(type, '_', ' ') AS described, count(*) AS n FROM fx_nodes GROUP BY type""",
}
ORACLE = {name: _needed(sql) for name, sql in SQL.items()}
