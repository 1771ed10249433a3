"""One query for each operator, over the projected tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave import model
from docweave.functions import text as tx
from docweave.operators import changes, generate, graph, impact, index, report, resolve, traverse, validate
from docweave.parsing import markdown, typescript
from docweave.plans.fixtures import Fixtures

PREFIX = "docweave"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
    return f


def cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def doc_path() -> Column:
    return cat("docs/", F.col("doc_id"), ".md")


# ------------------------------------------------------------- scans, manifests
@query
def scan_manifest(fx: Fixtures) -> DataFrame:
    path = doc_path()
    return fx.table("documents").select(
        path.alias("path"), tx.language(path).alias("language"), tx.digest(F.col("text")).alias("content_hash"),
        F.octet_length("text").cast("long").alias("size_bytes"),
    )


@query
def detect_language(fx: Fixtures) -> DataFrame:
    suffixes = ["ts", "TSX", "mjs", "md", "Mdx", "py", "d.ts", ""]
    path = cat("p/", F.col("p_partkey"), ".", F.element_at(F.array(*[F.lit(s) for s in suffixes]), (F.col("p_partkey") % 8 + 1).cast("int")))
    return fx.table("part").select(path.alias("path"), tx.language(path).alias("language"))


def _manifests(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    orders = fx.table("orders")
    path = cat("o/", F.col("o_orderkey"), ".ts").alias("path")
    old = orders.filter("o_orderkey % 11 <> 0").select(path, tx.digest(F.col("o_orderstatus")).alias("content_hash"))
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus"))
    new = orders.filter("o_orderkey % 13 <> 0").select(path, tx.digest(text).alias("content_hash"))
    return old, new


@query
def manifest_diff(fx: Fixtures) -> DataFrame:
    old, new = _manifests(fx)
    return changes.diff_manifest(new, old)


@query
def manifest_diff_summary(fx: Fixtures) -> DataFrame:
    old, new = _manifests(fx)
    return changes.diff_manifest(new, old).groupBy("status").agg(F.count("*").alias("n"))


def _status_lines(fx: Fixtures) -> DataFrame:
    k = F.col("o_orderkey")
    old = cat("a", k, ".ts")
    line = (
        F.when(k % 5 == 0, cat("A\t", old)).when(k % 5 == 1, cat("M\t", old)).when(k % 5 == 2, cat("D\t", old))
        .when(k % 5 == 3, cat("R100\t", old, "\tb", k, ".md")).otherwise(cat("T\t", old))
    )
    return fx.table("orders").select(line.alias("line"))


@query
def name_status_parse(fx: Fixtures) -> DataFrame:
    return changes.parse_name_status(_status_lines(fx))


@query
def changed_files_union(fx: Fixtures) -> DataFrame:
    untracked = fx.table("customer").select(cat("new/", F.col("c_custkey"), ".jsx").alias("path"))
    return changes.changed_files(changes.parse_name_status(_status_lines(fx)), untracked)


# ---------------------------------------------------------------- symbol changes
@query
def symbol_diff(fx: Fixtures) -> DataFrame:
    return changes.diff_symbols(fx.base, fx.target).select("path_pair", "kind", "qualified_name", "status", "old_text_hash", "new_text_hash")


@query
def symbol_moves(fx: Fixtures) -> DataFrame:
    return changes.symbol_changes(fx.base, fx.target).filter("change_type = 'moved'").select("previous_symbol_id", "symbol_id")


@query
def change_set(fx: Fixtures) -> DataFrame:
    return changes.symbol_changes(fx.base, fx.target).drop("ordinal")


@query
def line_slices(fx: Fixtures) -> DataFrame:
    part = tx.slice_lines(F.col("text"), F.lit(2), F.lit(4))
    return fx.table("documents").select("doc_id", part.alias("lines"), tx.digest(part).alias("hash"))


@query
def stable_ids(fx: Fixtures) -> DataFrame:
    n = fx.table("nation").join(fx.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = cat("src/", F.col("r_name"), ".ts")
    return n.select(
        model.symbol_id(path, F.col("n_name"), F.lit("class")).alias("symbol_id"), model.file_id(path).alias("file_id"),
        model.page_id(path).alias("page_id"), model.section_id(path, tx.slug(F.col("n_name"))).alias("section_id"),
    )


# ------------------------------------------------------------------------ writes
@query
def upsert_nodes_last_wins(fx: Fixtures) -> DataFrame:
    e = fx.table("events").select(
        F.lit(1).cast("long").alias("repository_id"), cat("u", F.col("user_id"), "#", F.col("event_type")).alias("stable_id"),
        F.col("event_type").alias("type"), cat("e", F.col("event_id")).alias("name"), "event_id",
    )
    old = e.filter("event_id % 3 = 0").groupBy("repository_id", "stable_id").agg(F.min("type").alias("type"), F.lit("old").alias("name"))
    old = old.withColumn("node_id", F.length("stable_id").cast("long"))
    out = graph.upsert_nodes(old, e.filter("event_id % 3 <> 0"), "event_id")
    kept = F.when(F.col("node_id") == F.length("stable_id"), True).otherwise(False)
    return out.select("stable_id", "type", "name", kept.alias("kept_id"))


@query
def upsert_edges_keep_created(fx: Fixtures) -> DataFrame:
    batch = fx.table("events").select(
        F.lit(1).cast("long").alias("repository_id"), (F.col("user_id") % 50).alias("source_id"), (F.col("user_id") % 7).alias("target_id"),
        F.lit("CALLS").alias("type"), F.col("event_type").alias("evidence_type"), cat("m", F.col("event_id")).alias("metadata"),
        F.col("event_id").alias("created_at"), "event_id",
    )
    return graph.merge_edge_batch(batch, "event_id").select("source_id", "target_id", "evidence_type", "metadata", "created_at")


def _region_files(fx: Fixtures) -> DataFrame:
    return fx.table("region").filter("r_regionkey in (1, 3)").select(cat("src/", F.col("r_name"), ".ts").alias("file_path"))


@query
def delete_nodes_dangling(fx: Fixtures) -> DataFrame:
    return graph.dangling_references(fx.nodes, fx.edges, _region_files(fx))


@query
def delete_nodes_dangling_between(fx: Fixtures) -> DataFrame:
    files = fx.table("region").filter("r_regionkey in (1, 2, 3)").select(cat("src/", F.col("r_name"), ".ts").alias("file_path"))
    gone = files.unionByName(fx.table("documents").filter("doc_id % 4 = 0").select(doc_path().alias("file_path")))
    return graph.dangling_references(fx.nodes, fx.edges, gone)


@query
def delete_cascade_remaining(fx: Fixtures) -> DataFrame:
    nodes, edges = graph.delete_nodes_of_files(fx.nodes, fx.edges, _region_files(fx))
    left = graph.count_by_type(nodes).withColumn("what", F.lit("node"))
    return left.unionByName(graph.count_by_type(edges).withColumn("what", F.lit("edge")))


@query
def delete_files_remaining(fx: Fixtures) -> DataFrame:
    files = fx.table("supplier").select(F.lit(1).cast("long").alias("repository_id"), cat("lib/s", F.col("s_suppkey"), ".ts").alias("path"))
    return graph.delete_files(files, files.filter(F.col("path").endswith("3.ts"))).select("path")


@query
def upsert_files_snapshot(fx: Fixtures) -> DataFrame:
    s = fx.table("supplier").select(
        F.lit(1).cast("long").alias("repository_id"), cat("lib/s", F.col("s_suppkey"), ".ts").alias("path"), F.col("s_name").alias("content_hash"), "s_suppkey"
    )
    new = s.filter("s_suppkey % 2 = 0").withColumn("content_hash", F.upper("content_hash"))
    return graph.upsert_files(s.filter("s_suppkey % 3 <> 0").drop("s_suppkey"), new.drop("s_suppkey")).select("path", "content_hash")


@query
def code_contains(fx: Fixtures) -> DataFrame:
    """A file for each nation: a class with a method for each customer, and functions."""
    line = lambda key, text: F.array_join(F.array_sort(F.collect_list(cat(*text(F.col(key))))), "\n")
    methods = fx.table("customer").groupBy(F.col("c_nationkey").alias("k")).agg(line("c_custkey", lambda c: ("  m", c, "() { return 1 }")).alias("methods"))
    functions = fx.table("part").groupBy((F.col("p_partkey") % 25).cast("int").alias("k")).agg(line("p_partkey", lambda c: ("export function f", c, "() {}")).alias("functions"))
    text = cat("export class N", F.col("n_nationkey"), " {\n", F.coalesce("methods", F.lit("")), "\n}\n", F.coalesce("functions", F.lit("")), "\n")
    keyed = fx.table("nation").withColumn("k", F.col("n_nationkey"))
    files = keyed.join(methods, "k", "left").join(functions, "k", "left").select(cat("src/n", F.col("k"), ".ts").alias("path"), text.alias("content"))
    nodes, edges = index.code_nodes(typescript.parse_files(files), 1)
    kinds = nodes.select(F.col("stable_id").alias("target_stable_id"), F.col("type").alias("kind"))
    return edges.join(kinds, "target_stable_id").groupBy("kind").agg(F.count("*").alias("n"))


def _headed(fx: Fixtures, name: Callable[[Column], Column]) -> DataFrame:
    """documents(document_path, content, doc_id) with every third line a heading."""
    lines = F.transform(F.split("text", "\n", -1), lambda _, i: F.when(i % 3 == 0, F.concat(F.lit("## "), name(i))).otherwise("text"))
    return fx.table("documents").select(doc_path().alias("document_path"), F.array_join(lines, "\n").alias("content"), "doc_id")


@query
def doc_contains(fx: Fixtures) -> DataFrame:
    docs = _headed(fx, lambda i: cat("h", i))
    _, edges = index.document_nodes(markdown.parse_files(docs.select(F.col("document_path").alias("path"), "content"), PREFIX), 1)
    return edges.groupBy(F.col("evidence_location.filePath").alias("file_path")).agg(F.count("*").alias("sections"))


# ------------------------------------------------------------------------- reads
@query
def list_nodes_topn(fx: Fixtures) -> DataFrame:
    return graph.list_nodes(fx.nodes, ["class", "method"], 300).select("node_id", "stable_id", "type")


@query
def list_edges_topn(fx: Fixtures) -> DataFrame:
    found = graph.list_edges(fx.edges, ["CALLS", "IMPORTS"], 500, ("type", "source_id", "target_id"))
    return found.select("type", "source_id", "target_id")


@query
def node_lookup(fx: Fixtures) -> DataFrame:
    nodes = fx.nodes
    one = graph.node_by_id(nodes, 1000007).withColumn("how", F.lit("id"))
    two = graph.node_by_stable_id(nodes, "docs/3.md#<page>:documentation_page").withColumn("how", F.lit("stable_id"))
    three = graph.nodes_named(nodes, "src/ASIA.ts", "part2").withColumn("how", F.lit("name"))
    return one.unionByName(two).unionByName(three).select("how", "node_id", "stable_id", "name")


@query
def nodes_of_type(fx: Fixtures) -> DataFrame:
    return graph.of_types(fx.nodes, ["class"]).select("node_id", "name", "file_path")


@query
def docs_referencing_file(fx: Fixtures) -> DataFrame:
    return graph.docs_referencing(fx.nodes, fx.edges, "src/ASIA.ts")


@query
def search_nodes(fx: Fixtures) -> DataFrame:
    return graph.search_nodes(fx.nodes, "CUSTOMER#00000001", 50).select("node_id", "name")


@query
def search_literal_wildcards(fx: Fixtures) -> DataFrame:
    found = [graph.search_nodes(fx.nodes, q, None, fold).select(F.lit(q).alias("q"), "node_id") for q, fold in (("%", True), ("_", True), ("<PAGE>", True), ("ÄU", False))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query
def out_edges(fx: Fixtures) -> DataFrame:
    return graph.outgoing(fx.edges, 1000007).select("type", "target_id")


@query
def in_edges(fx: Fixtures) -> DataFrame:
    return graph.incoming(fx.edges, 100000002, "CALLS").select("type", "source_id")


@query
def node_detail(fx: Fixtures) -> DataFrame:
    return graph.node_detail(fx.nodes, fx.edges, 100003).select(
        "node_id", "stable_id", F.size("out_edges").alias("n_out"), F.size("in_edges").alias("n_in")
    )


@query
def neighbor_labels(fx: Fixtures) -> DataFrame:
    edges = fx.edges.filter("type in ('IMPORTS', 'DOCUMENTS')").withColumn("target_id", F.when(F.col("target_id") % 10 == 9, -F.col("target_id")).otherwise(F.col("target_id")))
    return graph.neighbor_labels(fx.nodes, edges).select("source_id", "target_id", "source_label", "target_label")


@query
def induced_subgraph(fx: Fixtures) -> DataFrame:
    _, edges = graph.induced_subgraph(fx.nodes, fx.edges, ["file", "class", "method"], None, 300)
    return edges.select("type", "source_id", "target_id")


@query
def merge_by_id(fx: Fixtures) -> DataFrame:
    o = fx.table("orders")
    old = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("old").alias("v"))
    return graph.merge_by_id(old, o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("v")), "o_orderkey")


# -------------------------------------------------------------------- aggregates
@query
def count_by_type_nodes(fx: Fixtures) -> DataFrame:
    return graph.count_by_type(fx.nodes)


@query
def count_by_type_edges(fx: Fixtures) -> DataFrame:
    return graph.count_by_type(fx.edges)


@query
def repo_counts(fx: Fixtures) -> DataFrame:
    repositories = fx.table("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("repository_root"))
    repo = (F.pmod(F.col("node_id"), F.lit(4))).alias("repository_id")
    nodes = fx.nodes.filter("type in ('class', 'method', 'file')").select("type", repo)
    edges = fx.edges.filter("type = 'IMPORTS'").select((F.col("source_id") % 4).alias("repository_id"))
    return graph.repository_counts(repositories, nodes.filter("type = 'file'"), nodes, edges)


@query
def repo_type_breakdown(fx: Fixtures) -> DataFrame:
    nodes = fx.nodes.filter("type in ('class', 'method', 'file')").select("type", (F.col("node_id") % 3).alias("repository_id"))
    return graph.type_map(nodes).select("repository_id", "breakdown")


# --------------------------------------------------------------------- traversal
def _bfs(fx: Fixtures, start: int, direction: str, depth: int, types=None) -> DataFrame:
    fx.keep()
    starts = fx.spark.createDataFrame([(start,)], "node_id long")
    return traverse.traverse(fx.nodes, fx.edges, starts, direction, depth, types).select("node_id", "depth")


@query
def bfs_out(fx: Fixtures) -> DataFrame:
    return _bfs(fx, 2, "out", 2)


@query
def bfs_in(fx: Fixtures) -> DataFrame:
    return _bfs(fx, 100000002, "in", 3)


@query
def bfs_both(fx: Fixtures) -> DataFrame:
    return _bfs(fx, 1000007, "both", 2)


@query
def bfs_typed(fx: Fixtures) -> DataFrame:
    return _bfs(fx, 2, "out", 2, ["CONTAINS", "DOCUMENTS"])


@query
def bfs_cycle(fx: Fixtures) -> DataFrame:
    return _bfs(fx, 0, "out", 9, ["IMPORTS"])


@query
def shortest_path(fx: Fixtures) -> DataFrame:
    fx.keep()
    path = traverse.shortest_path(fx.nodes, fx.edges, 501, 100000, 6)
    return path.agg((F.count("*") - 1).alias("distance"))


@query
def traverse_for_docs(fx: Fixtures) -> DataFrame:
    changed = fx.nodes.filter("type = 'method' and node_id % 7 = 0")
    found = traverse.traverse_for_docs(fx.nodes, fx.edges, changed.select("node_id"))
    return found.select("change_id", "doc_id", "depth", F.size("path").alias("steps"))


# -------------------------------------------------------------------- resolution
def _imports(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    files = fx.table("part").filter("p_partkey % 3 <> 0").select(
        F.when(k % 4 == 0, cat("src/m", k, "/index.ts")).when(k % 4 == 1, cat("src/m", k, ".ts")).when(k % 4 == 2, cat("src/m", k, ".mjs"))
        .otherwise(cat("lib/m", k, ".tsx")).alias("path")
    )
    spec = F.when(k % 5 == 0, cat("pkg", k)).when(k % 5 == 1, cat("./m", k)).when(k % 5 == 2, cat("../src/./m", k)).when(k % 5 == 3, cat("../lib/x/../m", k)).otherwise(cat("./m", k, ".ts"))
    return fx.table("part").select(F.lit("src/app.ts").alias("file_path"), spec.alias("specifier")), files


@query
def resolve_imports(fx: Fixtures) -> DataFrame:
    return resolve.import_edges(resolve.resolve_imports(*_imports(fx)))[0].select("file_path", "target_path")


@query
def unresolved_imports(fx: Fixtures) -> DataFrame:
    return resolve.import_edges(resolve.resolve_imports(*_imports(fx)))[1]


def _annotations(fx: Fixtures) -> DataFrame:
    k = F.col("c_custkey")
    target = F.when(k % 4 == 0, cat("src/ASIA.ts#part", k)).when(k % 4 == 1, cat("src/EUROPE.ts#part", k)).when(k % 4 == 2, cat("src/ASIA.ts")).otherwise(cat("src/ASIA.ts#twin"))
    return fx.table("customer").select("c_custkey", target.alias("target"))


def _annotated(fx: Fixtures) -> DataFrame:
    twins = fx.table("region").select(F.col("r_regionkey").cast("long").alias("node_id"), F.lit("src/ASIA.ts").alias("file_path"), F.lit("twin").alias("qualified_name"))
    nodes = fx.nodes.filter("type = 'function'").select("node_id", "file_path", "qualified_name").unionByName(twins)
    return resolve.resolve_annotations(_annotations(fx), nodes)


@query
def resolve_annotations(fx: Fixtures) -> DataFrame:
    return _annotated(fx).filter("target_node is not null").select("c_custkey", "target_node")


@query
def unresolved_annotations(fx: Fixtures) -> DataFrame:
    return _annotated(fx).filter("reason is not null").select("c_custkey", "target", "reason", F.col("matches").cast("long").alias("matches"))


@query
def section_for_line(fx: Fixtures) -> DataFrame:
    lines = fx.lines.filter("line <> ''")
    sections = lines.filter("line_no % 3 = 1").selectExpr("doc_id as doc", "line_no as section_id", "line_no as start_line", "line_no + 1 as end_line")
    return resolve.section_for_line(lines.selectExpr("doc_id as doc", "line_no as line"), sections)


@query
def resolve_calls(fx: Fixtures) -> DataFrame:
    symbols = fx.nodes.filter("type in ('method', 'function')").select(
        "file_path", F.col("type").alias("kind"), F.when(F.col("type") == "function", F.col("qualified_name")).otherwise(F.col("name")).alias("name"),
        "qualified_name", F.col("node_id").alias("symbol_id"), F.col("node_id").alias("ordinal"),
    )
    sold = fx.table("lineitem").join(fx.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    callers = symbols.filter("kind = 'method'").select("file_path", F.col("symbol_id").alias("caller"))
    calls = sold.select((F.col("o_custkey") + 1000000).alias("caller"), cat("part", F.col("l_partkey")).alias("callee_name")).distinct()
    return resolve.resolve_calls(calls.join(callers, "caller"), symbols)


@query
def affected_docs(fx: Fixtures) -> DataFrame:
    changed = _region_files(fx).unionByName(fx.table("documents").filter("doc_id % 4 = 0").select(doc_path().alias("file_path")))
    return resolve.affected_documents(fx.nodes, fx.edges, changed)


# ------------------------------------------------------------------------ impact
def _change_set(fx: Fixtures) -> DataFrame:
    methods = fx.nodes.filter("type = 'method' and (node_id % 7 = 0 or node_id % 11 = 0)")
    return methods.select(
        F.when(F.col("node_id") % 7 == 0, "modified").otherwise("removed").alias("change_type"), F.col("stable_id").alias("symbol_id"), "name",
        F.lit("method").alias("kind"), "file_path", F.lit(None).cast("string").alias("previous_file_path"),
        F.lit(None).cast("string").alias("previous_symbol_id"), F.col("node_id").alias("ordinal"),
    )


def _dangling(fx: Fixtures) -> DataFrame:
    gone = fx.nodes.filter("type = 'method' and node_id % 11 = 0 and node_id % 7 <> 0").select(F.col("node_id").alias("source_id"), F.col("stable_id").alias("source_stable_id"))
    ends = fx.nodes.select(F.col("node_id").alias("target_id"), F.col("stable_id").alias("target_stable_id"))
    return fx.edges.filter("type = 'DOCUMENTS'").join(gone, "source_id").join(ends, "target_id").select("source_stable_id", "target_stable_id", F.col("type").alias("edge_type"))


def _file_changes(fx: Fixtures) -> DataFrame:
    return fx.table("documents").filter("doc_id % 5 = 0").select(
        F.lit("modified").alias("status"), doc_path().alias("path"), F.lit(None).cast("string").alias("previous_path")
    )


def _impact(fx: Fixtures) -> impact.Impact:
    fx.keep()
    return impact.impact_of(fx.nodes, fx.edges, _change_set(fx), _file_changes(fx), _dangling(fx))


def _findings(fx: Fixtures) -> DataFrame:
    return _impact(fx).findings()


@query
def impact_findings(fx: Fixtures) -> DataFrame:
    return _findings(fx).select(
        "document_path", "section_heading", "related_symbol_id", "related_change_type", "certainty", "action", "explanation", F.size("graph_path").alias("steps")
    )


@query
def impact_by_action(fx: Fixtures) -> DataFrame:
    return impact.count_by(_impact(fx), "action")


@query
def impact_by_certainty(fx: Fixtures) -> DataFrame:
    return impact.count_by(_impact(fx), "certainty")


@query
def dangling_change_match(fx: Fixtures) -> DataFrame:
    return impact.dangling_matches(_change_set(fx), _dangling(fx)).select("symbol_id", "target_stable_id")


# -------------------------------------------------------------------------- text
@query
def heading_slugs(fx: Fixtures) -> DataFrame:
    """Documents of four pages: each gives its title, a heading that repeats, and its title again."""
    title = F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    heads = fx.table("pages").select(F.floor(F.col("page_id") / 4).alias("doc"), "page_id", F.trim(F.regexp_replace(title, r"[^A-Za-z0-9 -]", "")).alias("title"))
    per = heads.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page_id", "title"))).alias("h"))  # four at most
    text = F.array_join(F.transform("h", lambda x: F.concat(F.lit("# "), x["title"], F.lit("\n\n## Setup\n\n# "), x["title"])), "\n\n")
    parsed = markdown.parse_files(per.select(F.col("doc").cast("string").alias("path"), text.alias("content")), PREFIX)
    slugs = parsed.select(F.col("path").cast("long").alias("doc"), F.posexplode("headings").alias("nth", "s"))
    page = F.element_at("h", (F.floor(F.col("nth") / 3) + 1).cast("int"))["page_id"]
    return slugs.join(per, "doc").select(page.alias("page_id"), (F.col("nth") % 3).alias("k"), F.col("s.slug").alias("slug"))


@query
def sections(fx: Fixtures) -> DataFrame:
    docs = _headed(fx, lambda i: cat("h", i))
    found = validate.sections_of(docs)
    return found.select("document_path", "heading", "start_line", "end_line")


@query
def locate_sections(fx: Fixtures) -> DataFrame:
    """Headings repeat: h0 and h3 in turn; the first of a name is meant."""
    docs = _headed(fx, lambda i: cat("h", i % 6))
    patches = docs.select("doc_id", "document_path", F.explode(F.array(F.lit("h0"), F.lit("h3"), F.lit(None))).alias("section_heading"))
    found = validate.locate_sections(patches, docs, validate.sections_of(docs))
    return found.select("doc_id", "section_heading", "start_line", "end_line", F.length("current_text").cast("long").alias("chars"))


@query
def links(fx: Fixtures) -> DataFrame:
    text = F.regexp_replace("html", r'<a href="([^"]*)">([^<\[\]]*)</a>', "[$2]($1)")
    found = fx.table("pages").select("page_id", F.posexplode(tx.links(text)).alias("nth", "l"))
    return found.select("page_id", "nth", "l.text", "l.target", tx.is_external(F.col("l.target")).alias("external"))


@query
def link_classes(fx: Fixtures) -> DataFrame:
    schemes = ["", "//", "mailto:", "tel:", "#", "HTTP://", "../"]
    target = F.concat(F.element_at(F.array(*[F.lit(s) for s in schemes]), (F.col("page_id") % 7 + 1).cast("int")), F.col("url"))
    return fx.table("pages").select("page_id", tx.is_external(target).alias("external"))


@query
def html_annotations(fx: Fixtures) -> DataFrame:
    k = F.col("page_id")
    directive = F.when(k % 3 == 0, "documents").otherwise("explains")
    comment = cat("<!-- ", f"{PREFIX}:", directive, " src/p", k, ".ts#f", k, " -->")
    a = tx.annotation(comment, PREFIX)
    return fx.table("pages").select("page_id", a["directive"].alias("directive"), a["target"].alias("target"), a["well_formed"].alias("well_formed"), F.array_join(a["issues"], ";").alias("issues"))


@query
def page_comments(fx: Fixtures) -> DataFrame:
    return fx.table("pages").select("page_id", F.posexplode(tx.comments(F.col("html"))).alias("nth", "comment"))


def _fenced() -> Column:
    return cat("intro\n```py\n", F.col("c_name"), "\n```\n", F.when(F.col("c_custkey") % 3 == 0, "```\nopen").otherwise("end"))


@query
def code_fences(fx: Fixtures) -> DataFrame:
    return fx.table("customer").select("c_custkey", F.explode(tx.fences(_fenced())).alias("f")).select("c_custkey", "f.language", "f.content")


@query
def fence_parity(fx: Fixtures) -> DataFrame:
    return fx.table("customer").select("c_custkey", tx.odd_fences(_fenced()).alias("odd"))


@query
def symbol_references(fx: Fixtures) -> DataFrame:
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, cat("src/p", k)).when(k % 5 == 1, cat("p", k, ".JSON")).when(k % 5 == 2, cat("Part.p", k, "()")).when(k % 5 == 3, cat(k, "x")).otherwise(cat("$p", k))
    text = cat("see `", code, "` and ``no``")
    spans = fx.table("part").select("p_partkey", F.explode(tx.inline_code(text)).alias("raw"))
    return spans.withColumn("kind", tx.reference_kind(F.col("raw"))).filter("kind is not null")


@query
def jsdoc_tags(fx: Fixtures) -> DataFrame:
    raw = cat("/**\n * About ", F.col("c_name"), "\n * and more.\n * @param x ", F.col("c_custkey"), "\n * ignored\n * @returns  ok \n */")
    d = fx.table("customer").select("c_custkey", tx.doc_comment(raw).alias("d"))
    return d.select("c_custkey", "d.description", F.posexplode("d.tags").alias("nth", "t")).select("c_custkey", "description", "nth", "t.tag", "t.text")


# -------------------------------------------------------------------- validation
def _patches(fx: Fixtures) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = fx.table("documents").select(doc_path().alias("document_path"), F.col("text").alias("content"), "doc_id")
    k = F.col("doc_id")
    original = F.when(k % 4 == 0, F.concat("content", F.lit(" stale"))).otherwise(F.col("content"))
    proposed = F.when(k % 3 == 0, F.lit("tiny")).when(k % 3 == 1, F.concat("content", F.lit("\n```\n"))).otherwise(F.concat("content", F.lit("\n<!-- docweave:other x -->")))
    heading = F.when(k % 5 == 0, F.lit("Missing"))
    patches = docs.select(
        "doc_id", F.when(k % 7 == 0, F.concat("document_path", F.lit("x"))).otherwise(F.col("document_path")).alias("document_path"),
        heading.alias("section_heading"), original.alias("original_content"), proposed.alias("proposed_content"),
    )
    none = docs.limit(0).select("document_path", F.lit("").alias("heading"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), "content")
    return patches, docs.select("document_path", "content"), none


@query
def patch_applicability(fx: Fixtures) -> DataFrame:
    located = validate.locate_sections(*_patches(fx))
    return located.select("doc_id", F.explode(validate.applicability(located)).alias("i")).select("doc_id", "i.check", "i.severity", "i.message")


@query
def patch_structure(fx: Fixtures) -> DataFrame:
    patches, _, _ = _patches(fx)
    return patches.select("doc_id", F.explode(validate.structure(F.col("proposed_content"), PREFIX)).alias("i")).select("doc_id", "i.check", "i.message")


@query
def accidental_deletion(fx: Fixtures) -> DataFrame:
    patches, _, _ = _patches(fx)
    percent = tx.deletion_percent(F.col("original_content"), F.col("proposed_content"))
    return patches.select("doc_id", percent.alias("percent")).filter("percent is not null")


@query
def validation_summary(fx: Fixtures) -> DataFrame:
    patches, docs, none = _patches(fx)
    done = validate.validate(patches, "doc_id", docs, none, PREFIX)
    return done.groupBy("valid").agg(F.count("*").alias("n"), F.sum(F.size("issues")).alias("issues"))


@query
def link_anchor_check(fx: Fixtures) -> DataFrame:
    k = F.col("c_custkey")
    target = F.when(k % 5 == 0, cat("#h", k % 4)).when(k % 5 == 1, cat("s", k % 20, ".md#x")).when(k % 5 == 2, F.lit("../../up.md")).when(k % 5 == 3, F.lit("https://x.org/a")).otherwise(cat("./../docs/s", k % 20, ".md"))
    patches = fx.table("customer").select("c_custkey", F.lit("docs/a.md").alias("document_path"), cat("[t", k, "](", target, ")").alias("proposed_content"))
    slugs = fx.table("customer").select("c_custkey", F.lit("h1").alias("slug"))
    files = fx.table("supplier").filter("s_suppkey < 10").select(cat("docs/s", F.col("s_suppkey"), ".md").alias("path"))
    out = validate.links_and_anchors(patches, "c_custkey", slugs, files, "/repo")
    return out.select("c_custkey", F.explode("link_issues").alias("i")).select("c_custkey", "i.check", "i.message")


@query
def annotation_target_check(fx: Fixtures) -> DataFrame:
    patches = _annotations(fx).select("c_custkey", cat("text <!-- docweave:documents ", F.col("target"), " -->").alias("proposed_content"))
    nodes = fx.nodes.filter("type = 'function'").select("node_id", "file_path", "qualified_name")
    out = validate.annotation_targets(patches, "c_custkey", nodes, PREFIX)
    return out.select("c_custkey", F.explode("target_issues").alias("i")).select("c_custkey", "i.message")


@query
def safe_paths(fx: Fixtures) -> DataFrame:
    k = F.col("p_partkey")
    forms = ["a/../b{}", "../x{}", "./a//b{}/.", "/repo/c{}", "/etc/p{}", "a/../../repo/d{}", "../repo2/e{}", ""]
    given = F.replace(F.element_at(F.array(*[F.lit(f) for f in forms]), (k % 8 + 1).cast("int")), F.lit("{}"), k.cast("string"))
    return fx.table("part").select("p_partkey", tx.safe_path(F.lit("/repo"), given).alias("path"))


@query
def apply_patch(fx: Fixtures) -> DataFrame:
    patches, docs, none = _patches(fx)
    done = validate.validate(patches, "doc_id", docs, none, PREFIX)
    return validate.apply(docs, done).select("document_path", tx.digest(F.col("content")).alias("hash"))


@query
def splice_documents(fx: Fixtures) -> DataFrame:
    out = tx.splice_lines(F.col("text"), F.lit(2), F.lit(3), F.lit("new\nlines"))
    return fx.table("documents").select("doc_id", tx.digest(out).alias("hash"))


# ------------------------------------------------------- generation and reporting
@query
def generate_offline(fx: Fixtures) -> DataFrame:
    code = fx.nodes.filter("type = 'method'").select(F.col("stable_id").alias("symbol_id"), F.when(F.col("node_id") % 2 == 0, F.col("name")).otherwise("").alias("code"))
    docs = fx.table("documents").filter("doc_id % 11 <> 0").select(doc_path().alias("document_path"), F.col("text").alias("content"))
    contexts = generate.contexts_of(_impact(fx), _change_set(fx), code, code, docs)
    out = generate.generate(contexts, generate.offline_provider())
    return out.select("document_path", "section_heading", "related_symbol_id", "status", "reason", tx.digest(F.col("proposed_content")).alias("proposed_sha256"))


@query
def report_summary(fx: Fixtures) -> DataFrame:
    s = report.summary_of_counts(_file_changes(fx), _change_set(fx), _impact(fx).counts())
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("files_changed", "symbols_changed", "findings", flat("findings_by_action").alias("by_action"), flat("findings_by_certainty").alias("by_certainty"))


@query
def report_annotations(fx: Fixtures) -> DataFrame:
    lines = _findings(fx).withColumns({"start_line": F.size("graph_path"), "end_line": F.lit(2), "explanation": F.concat("explanation", F.lit("\n100%"))})
    return lines.select("related_symbol_id", "document_path", report.annotation_line().alias("line"))


@query
def report_markdown_lines(fx: Fixtures) -> DataFrame:
    rows = _file_changes(fx).select(report.file_change_row().alias("line")).unionByName(_change_set(fx).select(report.symbol_change_row().alias("line")))
    return rows.unionByName(_findings(fx).select(report.finding_text().alias("line")))


@query
def label_nodes(fx: Fixtures) -> DataFrame:
    nodes = fx.nodes.groupBy("type").agg(F.count("*").alias("n"))
    return nodes.select("type", model.labelled(F.col("type"), model.NODE_LABELS).alias("label"), impact.describe_node_type(F.col("type")).alias("described"), "n")
