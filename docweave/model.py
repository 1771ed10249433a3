"""Record types, enumerations and identities of the traceability graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

# Names that stored graphs and callers share.
NODE_TYPES = ("file", "documentation_page", "documentation_section", "class", "function", "method")
CODE_TYPES = ("file", "class", "function", "method")
DOCUMENT_TYPES = ("documentation_page", "documentation_section")
EDGE_TYPES = ("CONTAINS", "IMPORTS", "CALLS", "DOCUMENTS")
EVIDENCE_TYPES = ("static_analysis", "explicit_annotation", "documentation_link", "ai_inferred")
CERTAINTIES = ("HIGH", "MEDIUM", "LOW")
FILE_CHANGE_TYPES = ("added", "modified", "deleted", "renamed")
SYMBOL_CHANGE_TYPES = ("added", "removed", "modified", "moved")
ACTIONS = ("REVIEW", "NO_ACTION", "NEEDS_MORE_INFORMATION", "PROPOSE_UPDATE")
GENERATION_STATUSES = ("PROPOSED", "NEEDS_MORE_INFORMATION", "PROVIDER_UNAVAILABLE")
LANGUAGE_BY_SUFFIX = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".md": "markdown",
    ".mdx": "markdown",
}
KIND_LABELS = {"file": "File", "class": "Class", "function": "Function", "method": "Method"}
NODE_LABELS = {
    "file": "File",
    "documentation_page": "Doc page",
    "documentation_section": "Doc section",
    "class": "Class",
    "function": "Function",
    "method": "Method",
}
EDGE_LABELS = {"CONTAINS": "Contains", "IMPORTS": "Imports", "CALLS": "Calls", "DOCUMENTS": "Documents"}

# Schemas of the stored tables.
REPOSITORIES = "id long, repository_root string, current_revision string, indexed_at timestamp"
FILES = "repository_id long, path string, language string, content_hash string, last_indexed_at timestamp"
NODES = (
    "repository_id long, node_id long, stable_id string, type string, name string, qualified_name string, file_path string, "
    "start_line int, end_line int, content_hash string, metadata string"
)
EDGES = (
    "repository_id long, edge_id long, source_id long, target_id long, type string, evidence_type string, "
    "evidence_location struct<filePath:string,startLine:int,endLine:int>, certainty string, metadata string, "
    "created_at timestamp, updated_at timestamp"
)


def symbol_id(path: Column, qualified_name: Column, kind: Column) -> Column:
    """Stable id of a symbol: never from line numbers."""
    return F.concat(path, F.lit("#"), qualified_name, F.lit(":"), kind)


def file_id(path: Column) -> Column:
    return F.concat(path, F.lit("#<file>:file"))


def page_id(path: Column) -> Column:
    return F.concat(path, F.lit("#<page>:documentation_page"))


def section_id(path: Column, slug: Column) -> Column:
    return F.concat(path, F.lit("#"), slug, F.lit(":documentation_section"))


def repository_id(root: Column) -> Column:
    """A repository's number follows from its root."""
    return F.xxhash64(root)


def node_key(repository: Column, stable_id: Column) -> Column:
    """A node's number follows from its identity, so that it survives rewrites."""
    return F.xxhash64(repository, stable_id)


def edge_key(repository: Column, source: Column, target: Column, type_: Column, evidence: Column) -> Column:
    return F.xxhash64(repository, source, target, type_, evidence)


def labelled(column: Column, labels: dict[str, str]) -> Column:
    """Label of a value; what has none stays."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[column], column)
