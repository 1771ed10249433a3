"""The typed property graph as DataFrames: writes, reads and aggregates.

Writes take a snapshot and return the next one; nothing is changed in place.
``nodes`` are unique by (repository_id, stable_id) and ``edges`` by
(repository_id, source_id, target_id, type, evidence_type).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import ascii_lower
from docweave.model import edge_key, node_key, repository_id

EDGE_IDENTITY = ("repository_id", "source_id", "target_id", "type", "evidence_type")


# ----------------------------------------------------------------------- writes
def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the largest ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``table`` with ``rows`` (unique by ``keys``) written over it. Columns in
    ``keep`` stay as the table had them, where it had the key."""
    old, new = table.alias("o"), rows.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    same = on[0]
    for c in on[1:]:
        same = same & c
    joined = old.join(new, same, "full_outer")
    is_new = F.col(f"n.{keys[0]}").isNotNull()

    def column(c: str) -> Column:
        if c not in rows.columns:
            return F.col(f"o.{c}").alias(c)
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*[column(c) for c in table.columns])


def upsert_repository(repositories: DataFrame, root: str) -> DataFrame:
    """The repositories with ``root`` among them."""
    new = repositories.sparkSession.createDataFrame([(root,)], "repository_root string")
    missing = new.join(repositories, "repository_root", "left_anti")
    row = missing.select(repository_id(F.col("repository_root")).alias("id"), "repository_root")
    return repositories.unionByName(row, allowMissingColumns=True)


def repository_key(spark: SparkSession, root: str) -> int:
    """The number of the repository at ``root``, as upsert_repository() gives it."""
    return spark.range(1).select(repository_id(F.lit(root))).first()[0]


def list_files(files: DataFrame, repository: int) -> DataFrame:
    """(path, language, content_hash) of one repository's files."""
    return files.filter(F.col("repository_id") == repository).select("path", "language", "content_hash").orderBy("path")


def mark_indexed(repositories: DataFrame, repository: Column, revision: Column, at: Column) -> DataFrame:
    hit = F.col("id") == repository
    return repositories.withColumns(
        {
            "current_revision": F.when(hit, revision).otherwise(F.col("current_revision")),
            "indexed_at": F.when(hit, at).otherwise(F.col("indexed_at")),
        }
    )


def upsert_files(files: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(files, rows, ("repository_id", "path"))


def delete_files(files: DataFrame, gone: DataFrame) -> DataFrame:
    return files.join(gone.select("repository_id", "path"), ["repository_id", "path"], "left_anti")


def upsert_nodes(nodes: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Write a batch of nodes: inside it the last of a stable id wins, and what
    was there is overwritten but keeps its node_id."""
    final = last_wins(batch, ("repository_id", "stable_id"), order).drop(order)
    final = final.withColumn("node_id", node_key(F.col("repository_id"), F.col("stable_id")))
    return upsert(nodes, final, ("repository_id", "stable_id"), keep=("node_id",))


def resolve_edges(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges given by stable ids, with node ids; those that lack an end go."""
    ends = nodes.select("repository_id", "stable_id", "node_id")
    source = ends.select("repository_id", F.col("stable_id").alias("source_stable_id"), F.col("node_id").alias("source_id"))
    target = ends.select("repository_id", F.col("stable_id").alias("target_stable_id"), F.col("node_id").alias("target_id"))
    return batch.join(source, ["repository_id", "source_stable_id"]).join(target, ["repository_id", "target_stable_id"])


def merge_edge_batch(batch: DataFrame, order: str, created: str = "created_at") -> DataFrame:
    """One row per edge identity: the last one's fields, the first one's creation."""
    rest = [c for c in batch.columns if c not in EDGE_IDENTITY and c != created]
    best = batch.groupBy(*EDGE_IDENTITY).agg(F.max_by(F.struct(*rest), order).alias("__row"), F.min(created).alias(created))
    return best.select(*EDGE_IDENTITY, created, *[F.col("__row")[c].alias(c) for c in rest])


def upsert_edges(edges: DataFrame, nodes: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Write edges given by stable ids; an existing one keeps created_at and id."""
    resolved = resolve_edges(nodes, batch).drop("source_stable_id", "target_stable_id")
    final = merge_edge_batch(resolved, order).drop(order)
    final = final.withColumn("edge_id", edge_key(*[F.col(c) for c in EDGE_IDENTITY]))
    return upsert(edges, final, EDGE_IDENTITY, keep=("edge_id", "created_at"))


def dangling_references(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges between two files of which one or both go: gone(file_path). Files
    go one by one, and the first to go of an edge's two leaves it dangling."""
    paths = gone.select("file_path").distinct().withColumn("__gone", F.lit(True))
    ends = nodes.join(paths, "file_path", "left").select("node_id", "stable_id", F.col("file_path").alias("f"), F.coalesce("__gone", F.lit(False)).alias("g"))
    end = lambda name: ends.select(*[F.col(c).alias(f"{name}_{c}") for c in ("stable_id", "f", "g")], F.col("node_id").alias(f"{name}_id"))
    both = edges.join(end("source"), "source_id").join(end("target"), "target_id")
    crossing = both.filter((F.col("source_g") | F.col("target_g")) & ~F.col("source_f").eqNullSafe(F.col("target_f")))
    return crossing.select("source_stable_id", "target_stable_id", F.col("type").alias("edge_type"))


def delete_nodes_of_files(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of gone(file_path) and their edges."""
    left = nodes.join(gone.select("file_path").distinct(), "file_path", "left_anti").select(*nodes.columns)
    return left, cascade(left, edges)


def cascade(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("node_id")
    return (
        edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
        .join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
        .select(*edges.columns)
    )


# ------------------------------------------------------------------------ reads
def of_types(rows: DataFrame, types: Sequence[str] | None) -> DataFrame:
    """Rows of the types; none given means no filter."""
    return rows.filter(F.col("type").isin(*types)) if types else rows


def list_nodes(nodes: DataFrame, types: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    found = of_types(nodes, types).orderBy("node_id")
    return found.limit(limit) if limit is not None else found


def list_edges(edges: DataFrame, types: Sequence[str] | None = None, limit: int | None = None, order: Sequence[str] = ("edge_id",)) -> DataFrame:
    found = of_types(edges, types).orderBy(*order)
    return found.limit(limit) if limit is not None else found


def node_by_stable_id(nodes: DataFrame, stable_id: str) -> DataFrame:
    return nodes.filter(F.col("stable_id") == stable_id)


def node_by_id(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.filter(F.col("node_id") == node_id)


def nodes_named(nodes: DataFrame, path: str, qualified_name: str) -> DataFrame:
    return nodes.filter((F.col("file_path") == path) & (F.col("qualified_name") == qualified_name))


def docs_referencing(nodes: DataFrame, edges: DataFrame, paths: DataFrame | str) -> DataFrame:
    """Distinct (code_path, doc_path) of DOCUMENTS edges from the files."""
    code = nodes.select(F.col("node_id").alias("source_id"), F.col("file_path").alias("code_path"))
    if isinstance(paths, str):
        code = code.filter(F.col("code_path") == paths)
    else:
        code = code.join(paths.select(F.col("file_path").alias("code_path")).distinct(), "code_path", "left_semi")
    docs = nodes.select(F.col("node_id").alias("target_id"), F.col("file_path").alias("doc_path")).filter("doc_path is not null")
    used = edges.filter("type = 'DOCUMENTS'").select("source_id", "target_id")
    return used.join(code, "source_id").join(docs, "target_id").select("code_path", "doc_path").distinct()


def search_nodes(nodes: DataFrame, query: str, limit: int | None = 50, fold_ascii: bool = True) -> DataFrame:
    """Nodes that hold ``query`` literally in name, qualified name or path,
    whatever its case (of ASCII letters, or of all), by name."""
    fold = ascii_lower if fold_ascii else F.lower
    hit = F.lit(False)
    for c in ("name", "qualified_name", "file_path"):
        hit = hit | F.coalesce(F.contains(fold(F.col(c)), fold(F.lit(query))), F.lit(False))
    found = nodes.filter(hit).orderBy("name", "node_id")
    return found.limit(limit) if limit is not None else found


def outgoing(edges: DataFrame, node_id: int, type_: str | None = None) -> DataFrame:
    return of_types(edges.filter(F.col("source_id") == node_id), [type_] if type_ else None)


def incoming(edges: DataFrame, node_id: int, type_: str | None = None) -> DataFrame:
    return of_types(edges.filter(F.col("target_id") == node_id), [type_] if type_ else None)


def node_detail(nodes: DataFrame, edges: DataFrame, node_id: int) -> DataFrame:
    """One row: the node, and its edges out and in as sorted arrays."""
    near = edges.filter((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    edge = F.struct("type", "source_id", "target_id")
    lists = near.agg(
        F.array_sort(F.collect_list(F.when(F.col("source_id") == node_id, edge))).alias("out_edges"),
        F.array_sort(F.collect_list(F.when(F.col("target_id") == node_id, edge))).alias("in_edges"),
    ).withColumn("node_id", F.lit(node_id).cast("long"))
    return node_by_id(nodes, node_id).join(lists, "node_id")


def neighbor_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a readable name of either end: qualified name, name or #id."""
    label = F.coalesce("qualified_name", "name")
    names = nodes.select("node_id", label.alias("label"))
    out = edges
    for end in ("source", "target"):
        own = names.select(F.col("node_id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"))
        out = out.join(own, f"{end}_id", "left")
        out = out.withColumn(f"{end}_label", F.coalesce(f"{end}_label", F.concat(F.lit("#"), F.col(f"{end}_id"))))
    return out


def induced_subgraph(
    nodes: DataFrame, edges: DataFrame, node_types=None, edge_types=None, limit: int | None = 300
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the first nodes of the types, and edges between them."""
    kept = list_nodes(nodes, node_types, limit)
    return kept, cascade(kept, of_types(edges, edge_types))


def merge_by_id(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union by key; of equal keys the new row stays."""
    both = old.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)))
    return last_wins(both, (key,), "__o").drop("__o")


# ------------------------------------------------------------------- aggregates
def count_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count("*").alias("n"))


def repository_counts(repositories: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each repository with its numbers of files, nodes and edges (0: none)."""
    out = repositories
    for name, rows in (("file_count", files), ("node_count", nodes), ("edge_count", edges)):
        counted = rows.groupBy(F.col("repository_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(counted, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def type_map(rows: DataFrame) -> DataFrame:
    """One row per repository: counts by type as a map and as one line of text."""
    counted = rows.groupBy("repository_id", "type").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("type", "n")))
    line = F.array_join(F.transform(pairs, lambda p: F.concat(p["type"], F.lit(": "), p["n"].cast("string"))), ", ")
    return counted.groupBy("repository_id").agg(F.map_from_entries(pairs).alias("by_type"), line.alias("breakdown"))


def first_by(rows: DataFrame, keys: Sequence[Column], order: Sequence[Column | str]) -> DataFrame:
    """Of rows with equal keys the first in order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
