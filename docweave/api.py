"""Entry functions with checked arguments, as a service would call them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.model import EDGE_TYPES, NODE_TYPES
from docweave.operators import graph, index, traverse
from docweave.plans.materialize import settled
from docweave.sources import git
from docweave.sources.files import GraphStore, read_tree

# Defaults and largest values of requests.
NODE_LIMIT, DEPTH, PATH_DEPTH, SEARCH_LIMIT = (300, 2000), (1, 5), (6, 10), (50, 200)


class NotFound(LookupError):
    """The repository, node or path does not exist."""


def types_of(text: str | None, allowed: tuple[str, ...]) -> list[str] | None:
    """A comma list of types; empty or missing means no filter."""
    if not text:
        return None
    found = text.split(",")
    if unknown := [t for t in found if t not in allowed]:
        raise ValueError(f"unknown types {unknown}")
    return found


def bounded(value, default: int, largest: int, smallest: int = 1) -> int:
    if value is None:
        return default
    number = int(value)
    if not smallest <= number <= largest:
        raise ValueError(f"{value} is not between {smallest} and {largest}")
    return number


def index_repository(spark: SparkSession, root: str, store: GraphStore) -> index.Indexed:
    """Index the tree at ``root`` into the store; other repositories in it stay."""
    repository = graph.repository_key(spark, root)
    done = index.index(spark, read_tree(spark, root), store.read("files"), store.read("nodes"), store.read("edges"), repository)
    # what the last version tells has to be read before the next one is current
    kept = {name: settled(getattr(done, name)) for name in ("status", "dangling", "unresolved_imports", "unresolved_annotations")}
    repositories = graph.mark_indexed(
        graph.upsert_repository(store.read("repositories"), root), F.lit(repository), F.lit(git.current_revision(root)), F.current_timestamp()
    )
    store.write(repositories=repositories, files=done.files, nodes=done.nodes, edges=done.edges)
    return replace(done, files=store.read("files"), nodes=store.read("nodes"), edges=store.read("edges"), **kept)


@dataclass
class Api:
    """Queries over one graph."""

    repositories_table: DataFrame
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def open(cls, store: GraphStore) -> Api:
        return cls(*(store.read(t) for t in ("repositories", "files", "nodes", "edges")))

    def repositories(self) -> DataFrame:
        return graph.repository_counts(self.repositories_table, self.files, self.nodes, self.edges).orderBy("id")

    def repository(self, repository_id: int) -> DataFrame:
        found = self.repositories().filter(F.col("id") == repository_id)
        if found.isEmpty():
            raise NotFound(f"repository {repository_id}")
        for name, rows in (("nodes", self.nodes), ("edges", self.edges)):
            own = graph.type_map(rows).select(F.col("repository_id").alias("id"), F.col("by_type").alias(f"{name}_by_type"))
            found = found.join(own, "id", "left")
        return found

    def _of(self, repository_id: int) -> tuple[DataFrame, DataFrame]:
        if self.repositories_table.filter(F.col("id") == repository_id).isEmpty():
            raise NotFound(f"repository {repository_id}")
        own = F.col("repository_id") == repository_id
        return self.nodes.filter(own), self.edges.filter(own)

    def files_of(self, repository_id: int) -> DataFrame:
        self._of(repository_id)
        return graph.list_files(self.files, repository_id)

    def _node(self, nodes: DataFrame, node_id: int) -> None:
        if graph.node_by_id(nodes, node_id).isEmpty():
            raise NotFound(f"node {node_id}")

    def graph(self, repository_id: int, node_types: str | None = None, edge_types: str | None = None, limit=None) -> dict:
        """nodes, edges between them, and whether the limit was reached."""
        most = bounded(limit, *NODE_LIMIT)
        nodes, edges = self._of(repository_id)
        kept, between = graph.induced_subgraph(nodes, edges, types_of(node_types, NODE_TYPES), types_of(edge_types, EDGE_TYPES), most)
        return {"nodes": kept, "edges": between, "truncated": kept.count() >= most}

    def node(self, repository_id: int, node_id: int) -> DataFrame:
        nodes, edges = self._of(repository_id)
        self._node(nodes, node_id)
        return graph.node_detail(nodes, edges, node_id)

    def neighbors(self, repository_id: int, node_id: int, depth=None, edge_types: str | None = None) -> DataFrame:
        hops = bounded(depth, *DEPTH, smallest=0)
        nodes, edges = self._of(repository_id)
        self._node(nodes, node_id)
        start = nodes.sparkSession.createDataFrame([(node_id,)], "node_id long")
        return traverse.traverse(nodes, edges, start, "both", hops, types_of(edge_types, EDGE_TYPES)).select("node_id", "depth", "via_edge")

    def search(self, repository_id: int, query: str, limit=None) -> DataFrame:
        if not query:
            raise ValueError("the query is empty")
        nodes, _ = self._of(repository_id)
        return graph.search_nodes(nodes, query, bounded(limit, *SEARCH_LIMIT))

    def path(self, repository_id: int, start: int, end: int, max_depth=None, edge_types: str | None = None) -> DataFrame:
        hops = bounded(max_depth, *PATH_DEPTH)
        nodes, edges = self._of(repository_id)
        for n in (start, end):
            self._node(nodes, n)
        found = traverse.shortest_path(nodes, edges, start, end, hops, "both", types_of(edge_types, EDGE_TYPES))
        if found.isEmpty():
            raise NotFound(f"path from {start} to {end}")
        return found
