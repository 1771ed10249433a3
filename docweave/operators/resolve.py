"""Resolution joins: imports, annotations and calls become edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import import_candidates
from docweave.operators.graph import docs_referencing


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, specifier, target_path) of relative imports; target_path is
    null where nothing fits, bare specifiers are left out."""
    relative = imports.filter(F.col("specifier").startswith(".")).select("file_path", "specifier").distinct()
    tried = relative.select("file_path", "specifier", F.posexplode(import_candidates(F.col("file_path"), F.col("specifier"))).alias("rank", "path"))
    hits = tried.join(files.select("path").distinct(), "path")
    best = hits.groupBy("file_path", "specifier").agg(F.min_by("path", "rank").alias("target_path"))
    return relative.join(best, ["file_path", "specifier"], "left")


def import_edges(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between file paths, unresolved imports)."""
    edges = resolved.filter("target_path is not null").select("file_path", "target_path", F.lit("IMPORTS").alias("type")).distinct()
    return edges, resolved.filter("target_path is null").select("file_path", "specifier")


def section_for_line(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, line, section_id) with the section whose span holds the line (the
    first such), else null. lines(doc, line), sections(doc, section_id,
    start_line, end_line): an equi-join on the document with a range on top."""
    spans = sections.select(F.col("doc").alias("__d"), "section_id", "start_line", "end_line")
    hit = (F.col("doc") == F.col("__d")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    found = lines.distinct().join(spans, hit, "left")
    return found.groupBy("doc", "line").agg(F.min_by("section_id", "start_line").alias("section_id"))


def resolve_annotations(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Annotations with target_node (where exactly one symbol fits) and reason
    (where not). Targets are ``path#qualified name``."""
    at = F.instr("target", "#")
    parted = annotations.withColumns(
        {
            "__path": F.when(at > 0, F.expr("substring(target, 1, instr(target, '#') - 1)")),
            "__name": F.when(at > 0, F.expr("substring(target, instr(target, '#') + 1)")),
        }
    )
    known = nodes.filter("qualified_name is not null").groupBy(F.col("file_path").alias("__path"), F.col("qualified_name").alias("__name"))
    counted = known.agg(F.count("*").alias("matches"), F.min("node_id").alias("__node"))
    joined = parted.join(counted, ["__path", "__name"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    reason = (
        F.when(F.col("__path").isNull(), "Target has no #")
        .when(F.col("matches") == 0, F.concat(F.lit("No symbol "), F.col("__name"), F.lit(" in "), F.col("__path")))
        .when(F.col("matches") > 1, F.concat(F.lit("Ambiguous: "), F.col("matches").cast("string"), F.lit(" symbols named "), F.col("__name")))
    )
    one = (F.col("matches") == 1) & F.col("__path").isNotNull()
    return joined.select(*annotations.columns, "matches", F.when(one, F.col("__node")).alias("target_node"), reason.alias("reason"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, callee): calls(file_path, caller, callee_name) resolved inside
    their file. A bare name is a function (the last of the name); ``this.m`` in
    a method is the method of its class; other dotted names are nothing."""
    last = Window.partitionBy("file_path", "key").orderBy(F.desc("ordinal"))

    def keyed(kind: str, key: str) -> DataFrame:
        rows = symbols.filter(F.col("kind") == kind).withColumn("key", F.col(key)).withColumn("__n", F.row_number().over(last))
        return rows.filter("__n = 1").select("file_path", "key", F.col("symbol_id").alias("callee"))

    known = calls.filter("caller is not null")
    bare = known.filter(~F.col("callee_name").contains(".")).withColumn("key", F.col("callee_name")).join(keyed("function", "name"), ["file_path", "key"])
    callers = symbols.filter("kind = 'method'").select(F.col("symbol_id").alias("caller"), F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("__class"))
    own = known.filter(F.col("callee_name").rlike(r"^this\.[^.]+$")).join(callers.dropDuplicates(["caller"]), "caller")
    own = own.withColumn("key", F.concat("__class", F.expr("substring(callee_name, 5)"))).join(keyed("method", "qualified_name"), ["file_path", "key"])
    return bare.select("caller", "callee").unionByName(own.select("caller", "callee")).distinct()


def affected_documents(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Documents that reference changed(file_path) code and have not changed."""
    docs = docs_referencing(nodes, edges, changed).select(F.col("doc_path").alias("file_path")).distinct()
    return docs.join(changed.select("file_path"), "file_path", "left_anti")
