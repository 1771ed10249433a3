"""Building and refreshing the graph from file contents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import model
from docweave.functions.text import digest, doc_comment, slice_lines
from docweave.operators import changes, graph, resolve
from docweave.parsing import markdown, typescript
from docweave.plans.materialize import settled


@dataclass
class Indexed:
    """What an indexing run found; every table is lazy."""

    repository: int
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    status: DataFrame
    dangling: DataFrame
    unresolved_imports: DataFrame
    unresolved_annotations: DataFrame

    def summary(self) -> DataFrame:
        """One row of counts: files by status, the repository's nodes and edges,
        and what stayed open."""
        kinds = {"files_added": "added", "files_modified": "modified", "files_removed": "removed", "files_unchanged": "unchanged"}
        out = self.status.agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in kinds.items()]).withColumn("__k", F.lit(1))
        own = F.col("repository_id") == self.repository
        counted = {
            "total_nodes": self.nodes.filter(own), "total_edges": self.edges.filter(own), "unresolved_imports": self.unresolved_imports,
            "unresolved_annotations": self.unresolved_annotations, "dangling_references": self.dangling,
        }
        for name, rows in counted.items():
            out = out.join(rows.agg(F.count("*").alias(name)).withColumn("__k", F.lit(1)), "__k")  # tables of one row
        return out.drop("__k")


def code_nodes(parsed: DataFrame, repository: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, CONTAINS edges) of parsed code: files, symbols, and what holds them."""
    repo = F.lit(repository).cast("long").alias("repository_id")
    none = F.lit(None)
    file_node = parsed.select(
        repo, model.file_id(F.col("path")).alias("stable_id"), F.lit("file").alias("type"), F.col("path").alias("name"), none.cast("string").alias("qualified_name"),
        F.col("path").alias("file_path"), none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), none.cast("string").alias("metadata"), F.lit(0).alias("ordinal"),
    )
    symbols = parsed.select("path", F.posexplode("symbols").alias("ordinal", "s"))
    metadata = F.to_json(F.struct(F.col("s.exported").alias("exported"), F.col("s.is_default_export").alias("isDefaultExport"), F.when(F.col("s.doc").isNotNull(), doc_comment(F.col("s.doc"))).alias("doc")))
    symbol_node = symbols.select(
        repo, F.col("s.id").alias("stable_id"), F.col("s.kind").alias("type"), F.col("s.name").alias("name"), F.col("s.qualified_name").alias("qualified_name"),
        F.col("path").alias("file_path"), F.col("s.location.startLine").alias("start_line"), F.col("s.location.endLine").alias("end_line"), metadata.alias("metadata"),
        (F.col("ordinal") + 1).alias("ordinal"),
    )
    holds = symbols.select(F.coalesce("s.parent_id", model.file_id(F.col("path"))).alias("source_stable_id"), F.col("s.id").alias("target_stable_id"), "path", F.col("s.location.startLine").alias("line"))
    return file_node.unionByName(symbol_node), _edges(holds, repository, "CONTAINS")


def document_nodes(parsed: DataFrame, repository: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, CONTAINS edges) of parsed documents: pages and headed sections."""
    repo = F.lit(repository).cast("long").alias("repository_id")
    none = F.lit(None)
    page = parsed.select(
        repo, model.page_id(F.col("path")).alias("stable_id"), F.lit("documentation_page").alias("type"), F.col("path").alias("name"),
        none.cast("string").alias("qualified_name"), F.col("path").alias("file_path"), none.cast("int").alias("start_line"), none.cast("int").alias("end_line"),
        none.cast("string").alias("metadata"), F.lit(0).alias("ordinal"),
    )
    headed = parsed.select("path", F.posexplode("sections").alias("ordinal", "s")).filter("s.heading is not null")
    section_id = model.section_id(F.col("path"), F.col("s.slug"))
    section = headed.select(
        repo, section_id.alias("stable_id"), F.lit("documentation_section").alias("type"), F.col("s.heading").alias("name"), F.col("s.slug").alias("qualified_name"),
        F.col("path").alias("file_path"), F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"), none.cast("string").alias("metadata"),
        (F.col("ordinal") + 1).alias("ordinal"),
    )
    holds = headed.select(model.page_id(F.col("path")).alias("source_stable_id"), section_id.alias("target_stable_id"), "path", F.col("s.start_line").alias("line"))
    return page.unionByName(section), _edges(holds, repository, "CONTAINS")


def _edges(rows: DataFrame, repository: int, type_: str, evidence: str = "static_analysis") -> DataFrame:
    where = F.struct(F.col("path").alias("filePath"), F.col("line").cast("int").alias("startLine"), F.col("line").cast("int").alias("endLine"))
    return rows.select(
        F.lit(repository).cast("long").alias("repository_id"), "source_stable_id", "target_stable_id", F.lit(type_).alias("type"), F.lit(evidence).alias("evidence_type"),
        where.alias("evidence_location"), F.lit("HIGH").alias("certainty"), F.lit(None).cast("string").alias("metadata"),
    )


def cross_edges(code: DataFrame, docs: DataFrame, files: DataFrame, nodes: DataFrame, repository: int):
    """(edges by stable ids, unresolved imports, unresolved annotations)."""
    imports = code.select(F.col("path").alias("file_path"), F.explode("imports").alias("i")).select("file_path", "i.specifier")
    found, lost_imports = resolve.import_edges(resolve.resolve_imports(imports, files))
    line = F.lit(None).cast("int").alias("line")
    imported = _edges(
        found.select(model.file_id(F.col("file_path")).alias("source_stable_id"), model.file_id(F.col("target_path")).alias("target_stable_id"), F.col("file_path").alias("path"), line),
        repository, "IMPORTS",
    )
    calls = code.select(F.col("path").alias("file_path"), F.explode("calls").alias("c")).select("file_path", F.col("c.caller_symbol_id").alias("caller"), "c.callee_name")
    symbols = code.select("path", F.posexplode("symbols").alias("ordinal", "s")).select(
        F.col("path").alias("file_path"), "s.kind", "s.name", "s.qualified_name", F.col("s.id").alias("symbol_id"), "ordinal"
    )
    called = resolve.resolve_calls(calls, symbols)
    called = _edges(called.select(F.col("caller").alias("source_stable_id"), F.col("callee").alias("target_stable_id"), F.split("caller", "#")[0].alias("path"), line), repository, "CALLS")

    notes = docs.select(F.col("path").alias("doc"), F.explode("annotations").alias("a")).filter("a.well_formed").select("doc", "a.line", "a.target")
    sections = docs.select(F.col("path").alias("doc"), F.explode("sections").alias("s")).filter("s.heading is not null")
    spans = sections.select("doc", model.section_id(F.col("doc"), F.col("s.slug")).alias("section_id"), "s.start_line", "s.end_line")
    placed = notes.join(resolve.section_for_line(notes.select("doc", "line"), spans), ["doc", "line"])
    judged = resolve.resolve_annotations(placed, nodes.filter("type in ('class', 'function', 'method')"))
    ids = nodes.select(F.col("node_id").alias("target_node"), F.col("stable_id").alias("source_stable_id"))
    documented = judged.filter("target_node is not null").join(ids, "target_node").select(
        "source_stable_id", F.coalesce("section_id", model.page_id(F.col("doc"))).alias("target_stable_id"), F.col("doc").alias("path"), "line"
    )
    documented = _edges(documented, repository, "DOCUMENTS", "explicit_annotation")
    lost_notes = judged.filter("reason is not null").select(F.col("doc").alias("file_path"), "target", "reason")
    return imported.unionByName(called).unionByName(documented), lost_imports, lost_notes


def index(spark: SparkSession, scan: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame, repository: int = 1, prefix: str = "docweave", strict_incremental: bool = False) -> Indexed:
    """The next graph from scan(path, language, content, content_hash) of one
    repository and the graph before, whose other repositories stay as they are.
    Nodes of unchanged files stay too. Edges are made anew from the whole
    snapshot; with ``strict_incremental`` only those of changed files and of
    documents that refer to them are, so an edge into a changed file from an
    unchanged one is lost, and reported as dangling."""
    at = F.current_timestamp()
    ours = F.col("repository_id") == repository
    others = [df.filter(~ours) for df in (files, nodes, edges)]
    files, nodes, edges = (df.filter(ours) for df in (files, nodes, edges))
    # small tables that most of what follows reads
    status = settled(changes.diff_manifest(scan, files))
    touched = status.filter("status <> 'unchanged'").select(F.col("path").alias("file_path"))
    reparsed = status.filter("status in ('added', 'modified')").select(F.col("path").alias("file_path"))
    again = settled(touched.unionByName(resolve.affected_documents(nodes, edges, reparsed)).distinct())
    dangling = graph.dangling_references(nodes, edges, again)
    kept_nodes, kept_edges = graph.delete_nodes_of_files(nodes, edges, again)

    reread = scan.join(again.select(F.col("file_path").alias("path")), "path", "left_semi")
    source = reread if strict_incremental else scan
    # parsing is the costly step and several tables come from it: it runs once
    code = settled(typescript.parse_files(source.filter("language in ('typescript', 'javascript')")))
    docs = settled(markdown.parse_files(source.filter("language = 'markdown'"), prefix))
    new_code, code_holds = code_nodes(code, repository)
    new_docs, doc_holds = document_nodes(docs, repository)
    fresh = new_code.unionByName(new_docs).join(again, "file_path", "left_semi")
    batch = fresh.withColumn("content_hash", F.lit(None).cast("string")).select(*[c for c in nodes.columns if c != "node_id"], "ordinal")
    next_nodes = settled(graph.upsert_nodes(kept_nodes, batch, "ordinal"))

    next_files = scan.select(F.lit(repository).cast("long").alias("repository_id"), "path", "language", "content_hash", at.alias("last_indexed_at"))
    cross, lost_imports, lost_notes = cross_edges(code, docs, scan, next_nodes, repository)
    made = code_holds.unionByName(doc_holds).unionByName(cross).withColumns({"created_at": at, "updated_at": at, "ordinal": F.lit(0)})
    old = kept_edges if strict_incremental else kept_edges.limit(0)
    next_edges = graph.upsert_edges(old, next_nodes, made, "ordinal")
    whole = [other.unionByName(own.select(*other.columns)) for other, own in zip(others, (next_files, next_nodes, next_edges), strict=True)]
    return Indexed(repository, *whole, status, dangling, lost_imports, lost_notes)


def symbol_rows(parsed: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows for changes.symbol_changes of parsed files and their
    contents(path_pair, path, content)."""
    rows = parsed.select("path", F.posexplode("symbols").alias("ordinal", "s")).join(contents, "path")
    text = slice_lines(F.col("content"), F.col("s.location.startLine"), F.col("s.location.endLine"))
    return rows.select(
        "path_pair", "s.kind", "s.qualified_name", "path", F.col("s.id").alias("symbol_id"), "s.name", digest(text).alias("text_hash"), text.alias("code"), "ordinal"
    )
