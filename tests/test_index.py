import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from docweave import model
from docweave.api import Api, NotFound
from docweave.operators import changes, graph, impact, index, traverse, validate
from docweave.parsing import typescript
from docweave.sources import git
from docweave.sources.files import GraphStore, read_tree

A = "import { log } from './log'\nexport class Auth {\n  refresh() { this.check() }\n  check() { return 1 }\n}\n"
LOG = "export function log(x) { write(x) }\nfunction write(x) { return x }\n"
DOC = "intro\n\n# Tokens\n<!-- docweave:documents src/a.ts#Auth.refresh -->\ntext\n\n# Classes\n<!-- docweave:documents src/a.ts#Auth -->\n<!-- docweave:documents src/a.ts#Nope -->\n"


def scan_of(spark, files):
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    from docweave.functions.text import language

    return rows.select("path", language(F.col("path")).alias("language"), "content", F.sha2("content", 256).alias("content_hash"))


def empty(spark):
    return [spark.createDataFrame([], s) for s in (model.FILES, model.NODES, model.EDGES)]


def stored(spark, done):
    """An indexing result with its lineage cut."""
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    return keep(done.files), keep(done.nodes), keep(done.edges)


def shape(nodes, edges):
    ids = {r.node_id: r.stable_id for r in nodes.collect()}
    return set(ids.values()), {(ids[r.source_id], r.type, ids[r.target_id]) for r in edges.collect()}


def test_index_change_and_impact(spark):
    first = index.index(spark, scan_of(spark, {"src/a.ts": A, "src/log.ts": LOG, "docs/a.md": DOC}), *empty(spark))
    files, nodes, edges = stored(spark, first)
    _, links = shape(nodes, edges)
    assert ("src/a.ts#<file>:file", "IMPORTS", "src/log.ts#<file>:file") in links
    assert ("src/a.ts#Auth.refresh:method", "CALLS", "src/a.ts#Auth.check:method") in links
    assert ("src/log.ts#log:function", "CALLS", "src/log.ts#write:function") in links
    assert ("src/a.ts#Auth.refresh:method", "DOCUMENTS", "docs/a.md#tokens:documentation_section") in links
    assert ("src/a.ts#Auth:class", "DOCUMENTS", "docs/a.md#classes:documentation_section") in links
    assert [r.target for r in first.unresolved_annotations.collect()] == ["src/a.ts#Nope"]

    # an unchanged tree changes nothing
    same = index.index(spark, scan_of(spark, {"src/a.ts": A, "src/log.ts": LOG, "docs/a.md": DOC}), files, nodes, edges)
    assert shape(same.nodes, same.edges) == shape(nodes, edges) and same.dangling.count() == 0

    # a changed body, a moved function
    now = {"src/a.ts": A.replace("return 1", "return 2"), "src/log.ts": LOG.split("\n")[0] + "\n", "src/w.ts": LOG.split("\n")[1] + "\n", "docs/a.md": DOC}
    before = spark.createDataFrame([(p, p, c) for p, c in {"src/a.ts": A, "src/log.ts": LOG}.items()], "path_pair string, path string, content string")
    after = spark.createDataFrame([(p, p, c) for p, c in now.items() if p != "docs/a.md"], "path_pair string, path string, content string")
    rows = [index.symbol_rows(typescript.parse_files(x), x).drop("code") for x in (before, after)]
    found = changes.symbol_changes(*rows)
    assert {(r.change_type, r.symbol_id) for r in found.collect()} == {
        ("modified", "src/a.ts#Auth:class"), ("modified", "src/a.ts#Auth.check:method"), ("moved", "src/w.ts#write:function"),
    }
    second = index.index(spark, scan_of(spark, now), files, nodes, edges)
    full = index.index(spark, scan_of(spark, now), *empty(spark))
    assert shape(second.nodes, second.edges) == shape(full.nodes, full.edges)
    _, nodes2, edges2 = stored(spark, second)
    touched = spark.createDataFrame([], "status string, path string, previous_path string")
    findings = impact.analyze_impact(nodes2, edges2, found, touched, second.dangling).collect()
    assert {(f.section_heading, f.related_symbol_name, f.certainty, f.action) for f in findings} == {
        ("Classes", "Auth", "HIGH", "REVIEW"), ("Classes", "check", "MEDIUM", "REVIEW"),
    }


def test_strict_incremental_loses_edges_into_changed_files(spark):
    base = {"src/a.ts": A, "src/log.ts": LOG, "docs/a.md": DOC}
    state = stored(spark, index.index(spark, scan_of(spark, base), *empty(spark)))
    now = scan_of(spark, base | {"src/log.ts": LOG + "// more\n"})
    strict = index.index(spark, now, *state, strict_incremental=True)
    _, links = shape(strict.nodes, strict.edges)
    assert not any(t == "IMPORTS" for _, t, _ in links)
    assert ("src/a.ts#<file>:file", "src/log.ts#<file>:file", "IMPORTS") in {tuple(r) for r in strict.dangling.collect()}


def test_repositories_stay_independent(spark):
    tree = scan_of(spark, {"src/a.ts": A, "docs/a.md": DOC})
    one = stored(spark, index.index(spark, tree, *empty(spark), repository=1))
    two = index.index(spark, scan_of(spark, {"src/a.ts": A}), *one, repository=2)
    files, nodes, edges = stored(spark, two)
    assert {(r.repository_id, r.path) for r in files.collect()} == {(1, "src/a.ts"), (1, "docs/a.md"), (2, "src/a.ts")}
    of = lambda df, r: df.filter(F.col("repository_id") == r)
    assert shape(of(nodes, 1), of(edges, 1)) == shape(*one[1:]) and two.dangling.count() == 0
    assert two.summary().first().asDict() == {
        "files_added": 1, "files_modified": 0, "files_removed": 0, "files_unchanged": 0, "total_nodes": 4, "total_edges": of(edges, 2).count(),
        "unresolved_imports": 1, "unresolved_annotations": 0, "dangling_references": 0,
    }
    # the second is emptied, the first stays; ids stay on a new run of the same tree
    gone = index.index(spark, tree.limit(0), files, nodes, edges, repository=2)
    assert {r.repository_id for r in gone.nodes.collect()} == {1} == {r.repository_id for r in gone.files.collect()}
    again = index.index(spark, tree, files, nodes, edges, repository=1)
    assert {r.node_id for r in again.nodes.collect()} == {r.node_id for r in nodes.collect()}


def test_symbol_removed_and_document_edited(spark):
    state = stored(spark, index.index(spark, scan_of(spark, {"src/a.ts": A, "docs/a.md": DOC}), *empty(spark)))
    less = A.replace("  refresh() { this.check() }\n", "")
    done = index.index(spark, scan_of(spark, {"src/a.ts": less, "docs/a.md": DOC + "more\n"}), *state)
    lost = ("src/a.ts#Auth.refresh:method", "docs/a.md#tokens:documentation_section", "DOCUMENTS")
    assert [tuple(r) for r in done.dangling.collect()].count(lost) == 1
    sides = [spark.createDataFrame([("src/a.ts", "src/a.ts", c)], "path_pair string, path string, content string") for c in (A, less)]
    found = changes.symbol_changes(*[index.symbol_rows(typescript.parse_files(x), x).drop("code") for x in sides])
    touched = spark.createDataFrame([("modified", "docs/a.md", None), ("modified", "src/a.ts", None)], "status string, path string, previous_path string")
    _, nodes, edges = stored(spark, done)
    findings = {(f.section_heading, f.related_symbol_name, f.related_change_type, f.action) for f in impact.analyze_impact(nodes, edges, found, touched, done.dangling).collect()}
    assert ("Tokens", "refresh", "removed", "NEEDS_MORE_INFORMATION") in findings


def test_doc_comment_is_stored_parsed(spark):
    text = "/**\n * Adds.\n * @param a one\n */\nexport function add(a) { return a }\n"
    nodes = index.index(spark, scan_of(spark, {"a.ts": text}), *empty(spark)).nodes
    (row,) = nodes.filter("name = 'add'").collect()
    assert json.loads(row.metadata)["doc"] == {"description": "Adds.", "tags": [{"tag": "param", "text": "a one"}]}


PAGE = "# Authentication\n\n## Refresh tokens\n\nOriginal text.\n\n## Other\n\nMore.\n\n## Other\n\nAgain.\n"
PATCH = ("docs/auth.md", "Refresh tokens", "## Refresh tokens\n\nOriginal text.", "## Refresh tokens\n\nUpdated text.")


def applied(spark, patches, page=PAGE):
    documents = spark.createDataFrame([("docs/auth.md", page), ("docs/b.md", "# B\n")], "document_path string, content string")
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(patches)], "n int, document_path string, section_heading string, original_content string, proposed_content string")
    after, outcomes = validate.apply_all(documents, rows, "n", "docweave", documents.select(F.col("document_path").alias("path")))
    texts = {r.document_path: r.content for r in after.collect()}
    assert set(texts) == {"docs/auth.md", "docs/b.md"} and after.count() == 2
    return texts["docs/auth.md"], {r.n: r for r in outcomes.collect()}


def test_apply_checks_right_before_writing(spark):
    text, done = applied(spark, [PATCH])
    assert text == PAGE.replace("Original", "Updated") and done[0].valid
    changed = PAGE.replace("Original text.", "Someone changed this.")
    text, done = applied(spark, [PATCH], changed)
    assert text == changed and not done[0].valid
    text, done = applied(spark, [(*PATCH[:3], "## Refresh tokens\n\n```ts\nopen\n")])
    assert text == PAGE and not done[0].valid
    text, done = applied(spark, [("../outside.md", None, "", "x"), ("docs/../../docs/auth.md", *PATCH[1:]), ("./docs/../docs/auth.md", *PATCH[1:])])
    assert [[i.check for i in done[n].issues] for n in (0, 1, 2)] == [["document-readable"], ["document-readable"], []] and text == PAGE.replace("Original", "Updated")


def test_patches_of_one_document_apply_in_turn(spark):
    longer = (*PATCH[:3], "## Refresh tokens\n\nUpdated text.\n\nLine.\n\nLine.")
    other = ("docs/auth.md", "Other", "## Other\n\nMore.", "## Other\n\nMore [here](#other-1), [there](#nowhere), [b](b.md), [c](c.md).")
    text, done = applied(spark, [longer, other, PATCH])
    assert "Line.\n\nLine." in text and "[here](#other-1)" in text and "Again." in text
    assert [done[n].valid for n in range(3)] == [True, True, False]
    assert [(i.check, i.severity) for i in done[1].issues] == [("invalid-anchor", "warning"), ("broken-link", "warning")]
    assert done[2].checks_not_performed == ["annotation-target-resolution"]
    text, done = applied(spark, [])
    assert text == PAGE and done == {}


def test_until_ends_each_search_by_itself(spark, small):
    starts = spark.createDataFrame([(0,), (3,)], "node_id long")
    rows = traverse.traverse(small.nodes, small.edges, starts, "out", 9, until=1).collect()
    assert {(r.start, r.node_id) for r in rows} == {(0, 0), (0, 1), (3, 3), (3, 0), (3, 1)}


def test_a_store_of_another_schema_is_refused(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    (tmp_path / "CURRENT.json").write_text(json.dumps({"version": 1, "schema": model.SCHEMA_VERSION + 1}))
    with pytest.raises(ValueError):
        store.read("nodes")


@pytest.fixture(scope="module")
def small(spark):
    nodes = [(1, i, f"s#{n}:function", "function", n, n, "src/x.ts") for i, n in enumerate("abcde")]
    nodes = spark.createDataFrame(nodes, "repository_id long, node_id long, stable_id string, type string, name string, qualified_name string, file_path string")
    edges = spark.createDataFrame([(1, 10 + i, i, (i + 1) % 4, "CALLS") for i in range(4)], "repository_id long, edge_id long, source_id long, target_id long, type string")
    repositories = spark.createDataFrame([(1, "/r"), (2, "/s")], "id long, repository_root string")
    return Api(repositories, nodes.select("repository_id", F.col("file_path").alias("path")).distinct(), nodes, edges)


def test_traversal_of_a_cycle(spark, small):
    start = spark.createDataFrame([(0,)], "node_id long")
    walk = lambda *a, **k: {r.node_id: (r.depth, r.via_edge) for r in traverse.traverse(small.nodes, small.edges, start, *a, **k).collect()}
    assert walk("out", 9) == {0: (0, None), 1: (1, 10), 2: (2, 11), 3: (3, 12)}
    assert walk("in", 1) == {0: (0, None), 3: (1, 13)}
    assert walk("out", 9, []) == {0: (0, None)}
    steps = lambda a, b, n, d="both": [(r.node_id, r.via_edge) for r in traverse.shortest_path(small.nodes, small.edges, a, b, n, d).collect()]
    assert steps(0, 3, 6) == [(0, None), (3, 13)] and steps(0, 3, 6, "out") == [(0, None), (1, 10), (2, 11), (3, 12)]
    assert steps(0, 3, 2, "out") == [] and steps(2, 2, 3) == [(2, None)] and steps(0, 4, 6) == []


def test_api(small):
    assert [(r.id, r.file_count, r.node_count, r.edge_count) for r in small.repositories().collect()] == [(1, 1, 5, 4), (2, 0, 0, 0)]
    assert small.repository(1).first().nodes_by_type == {"function": 5}
    got = small.graph(1, limit=3)
    assert got["nodes"].count() == 3 and got["edges"].count() == 2 and got["truncated"]
    assert {r.node_id for r in small.neighbors(1, 0).collect()} == {0, 1, 3}
    assert [r.name for r in small.search(1, "X.TS", 2).collect()] == ["a", "b"]
    for call in (lambda: small.graph(3), lambda: small.node(2, 1), lambda: small.path(1, 0, 4)):
        with pytest.raises(NotFound):
            call()
    for call in (lambda: small.graph(1, "nothing"), lambda: small.neighbors(1, 0, 6), lambda: small.search(1, ""), lambda: small.path(1, 0, 1, 11)):
        with pytest.raises(ValueError):
            call()


def test_greedy_moves_with_a_shared_path(spark):
    schema = "kind string, qualified_name string, text_hash string, path string, symbol_id string, ordinal long"
    gone = spark.createDataFrame([("function", "f", "h", "a", "a#f", 0), ("function", "f", "h", "b", "b#f", 1)], schema)
    came = spark.createDataFrame([("function", "f", "h", "a", "a2#f", 0), ("function", "f", "h", "c", "c#f", 1)], schema)
    assert {tuple(r) for r in changes.match_moves(gone, came).collect()} == {("a#f", "c#f"), ("b#f", "a2#f")}


def test_upsert_keeps_ids(spark):
    old = spark.createDataFrame([(1, "x", 77, "old"), (1, "y", 78, "stay")], "repository_id long, stable_id string, node_id long, name string")
    batch = spark.createDataFrame([(1, "x", "first", 0), (1, "x", "last", 1), (1, "z", "new", 2)], "repository_id long, stable_id string, name string, n int")
    got = {r.stable_id: (r.node_id, r.name) for r in graph.upsert_nodes(old, batch, "n").collect()}
    assert got["x"] == (77, "last") and got["y"] == (78, "stay") and got["z"][1] == "new"


def test_git_and_store(spark, tmp_path):
    root = str(tmp_path / "repo")
    os.makedirs(f"{root}/src")
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    assert git.current_revision(root) is None
    for name, text in (("src/a.ts", A), ("src/old.ts", LOG)):
        open(f"{root}/{name}", "w").write(text)
    run("add", "-A")
    run("commit", "-qm", "one")
    os.rename(f"{root}/src/old.ts", f"{root}/src/new.ts")
    run("add", "-A")
    open(f"{root}/src/a.ts", "w").write(A + "// x\n")
    open(f"{root}/n.md", "w").write("# N\n")
    got = {(r.status, r.path, r.previous_path, r.language) for r in git.changes_between(spark, root, "HEAD").collect()}
    assert got == {("modified", "src/a.ts", None, "typescript"), ("renamed", "src/new.ts", "src/old.ts", "typescript"), ("added", "n.md", None, "markdown")}
    assert git.read_at(root, "HEAD", "src/old.ts") == LOG and git.read_at(root, "HEAD", "none") is None
    store = GraphStore(spark, str(tmp_path / "store"))
    os.makedirs(store.path)
    done = index.index(spark, read_tree(spark, root), store.read("files"), store.read("nodes"), store.read("edges"))
    assert store.write(files=done.files, nodes=done.nodes, edges=done.edges) == 1
    assert store.read("nodes").filter("type = 'documentation_page'").count() == 1


def test_stream(spark, tmp_path):
    from docweave.streaming.incremental import incremental

    source, seen = tmp_path / "in", []
    for i, rows in enumerate(([("a", "1", 0), ("b", "1", 1)], [("a", "1", 2), ("b", "2", 3), ("c", "1", 4)], [("a", "2", 5)])):
        spark.createDataFrame(rows, "path string, content string, ordinal long").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("path string, content string, ordinal long").parquet(str(source))
        query = incremental(stream, str(tmp_path / "state"), str(tmp_path / "check"), lambda df, _: seen.append({(r.path, r.status) for r in df.collect()}))
        query.awaitTermination()
    assert seen == [{("a", "added"), ("b", "added")}, {("b", "modified"), ("c", "added")}, {("a", "modified")}]
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["v1", "v2"]
