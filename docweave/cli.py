"""Command line: index, graph, analyze, impact, generate and report."""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.api import index_repository
from docweave.operators import changes, generate, graph, impact, index, report, validate
from docweave.parsing import typescript
from docweave.plans.materialize import settled
from docweave.sources import git
from docweave.sources.files import GraphStore, read_tree

PREFIX = "docweave"
KEY = "patch"


def _session() -> SparkSession:
    return SparkSession.builder.appName("docweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def analyze(spark: SparkSession, root: str, base: str, target: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(file changes, symbol changes, symbols before, symbols after)."""
    files = git.changes_between(spark, root, base, target)
    before, after = (settled(index.symbol_rows(typescript.parse_files(rows), rows)) for rows in git.contents(spark, root, base, target, files))
    narrow = lambda rows: rows.drop("code")
    return files, settled(changes.symbol_changes(narrow(before), narrow(after))), before, after


def provider_named(name: str) -> generate.Provider:
    """``offline``, or a function of contexts given as module:function."""
    if name == "offline":
        return generate.offline_provider()
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"unknown provider {name!r}: neither offline nor module:function")
    return getattr(importlib.import_module(module), function)


def documents_of(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, paths of all files) as they are on disk now."""
    scan = read_tree(spark, root)
    return scan.filter("language = 'markdown'").select(F.col("path").alias("document_path"), "content"), scan.select("path")


def write_documents(root: str, before: DataFrame, after: DataFrame) -> list[str]:
    """Write what changed of the documents of one change set; their paths."""
    old = before.select("document_path", F.col("content").alias("old"))
    changed = after.join(old, "document_path").filter("content <> old").select("document_path", "content").collect()
    for path, content in changed:
        whole = os.path.join(root, path)
        with open(whole + ".new", "w", encoding="utf-8", newline="") as f:
            f.write(content)
        os.replace(whole + ".new", whole)
    return sorted(r[0] for r in changed)


def indented(text: str) -> str:
    return "\n".join("    " + x for x in text.split("\n"))


def told(outcome) -> str:
    """One outcome of generation as lines for a reader."""
    lines = [f"\n{outcome.document_path} — {outcome.section_heading or report.WHOLE_PAGE}", f"  Status: {outcome.status}"]
    if outcome.status != "PROPOSED":
        return "\n".join([*lines, f"  Reason: {outcome.reason}"])
    lines.append(f"  Explanation: {outcome.patch_explanation}")
    if outcome.assumptions:
        lines.append(f"  Assumptions: {'; '.join(outcome.assumptions)}")
    lines += ["  --- original ---", indented(outcome.original_content), "  --- proposed ---", indented(outcome.proposed_content)]
    lines.append(f"  Validation: {'valid' if outcome.valid else 'INVALID'}")
    lines += [f"    [{i.severity}] {i.check}: {i.message}" for i in outcome.issues or []]
    if outcome.checks_not_performed:
        lines.append(f"    Not checked: {', '.join(outcome.checks_not_performed)}")
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "graph", "analyze", "impact", "generate", "report"):
        p = commands.add_parser(name)
        p.add_argument("root", nargs="?", default=".")
        p.add_argument("--store", help="folder of the graph; .docweave/graph under the root if not given")
        if name in ("analyze", "impact", "generate", "report"):
            p.add_argument("--base", required=True)
        if name in ("analyze", "report"):
            p.add_argument("--target")
        if name == "generate":
            p.add_argument("--provider", default="offline", help="offline, or module:function")
            p.add_argument("--apply", action="store_true", help="write valid patches to disk; needs --yes")
            p.add_argument("--yes", action="store_true", help="approve writing")
        if name == "report":
            p.add_argument("--format", choices=("markdown", "json", "annotations"), default="markdown")
            p.add_argument("--out")
            p.add_argument("--provider", help="generate and check patches too: offline, or module:function")
    args = parser.parse_args(argv)
    if getattr(args, "apply", False) and not args.yes:
        raise ValueError("--apply needs --yes")
    provide = provider_named(args.provider) if getattr(args, "provider", None) else None
    spark, root = _session(), os.path.abspath(args.root)
    store = GraphStore(spark, args.store or os.path.join(root, ".docweave", "graph"))
    os.makedirs(store.path, exist_ok=True)

    if args.command == "index":
        done = index_repository(spark, root, store)
        for name, n in done.summary().first().asDict().items():
            print(f"{name}: {n}")
        return 0
    if args.command == "graph":
        own = F.col("repository_id") == graph.repository_key(spark, root)
        graph.count_by_type(store.read("nodes").filter(own)).show()
        graph.count_by_type(store.read("edges").filter(own)).show()
        return 0
    base, target = git.resolve_revision(root, args.base), getattr(args, "target", None)
    target = git.resolve_revision(root, target) if target else None
    files, symbols, before, after = analyze(spark, root, base, target)
    if args.command == "analyze":
        files.show(truncate=False)
        symbols.select("change_type", "symbol_id", "description").show(truncate=False)
        return 0
    done = index_repository(spark, root, store)
    own = F.col("repository_id") == done.repository
    nodes, edges = done.nodes.filter(own), done.edges.filter(own)
    findings = settled(report.with_path_names(impact.analyze_impact(nodes, edges, symbols, files, done.dangling), nodes))
    if args.command == "impact":
        found = findings.orderBy("ordinal", "depth", "edge_id").collect()  # of one change set, for a reader
        print(f"Documentation impact findings: {len(found)}" if found else "No documentation impact found.")
        for f in found:
            print(f"\n[{f.action}] {f.document_path} — {f.section_heading or report.WHOLE_PAGE}")
            print(f"  Certainty: {f.certainty}\n  Related:   {f.related_symbol_name} ({f.related_change_type})\n  Why:       {f.explanation}")
            if f.path_names:
                print(f"  Path:      {' -> '.join(f.path_names)}")
        return 0

    outcomes = None
    if provide is not None:
        documents, paths = documents_of(spark, root)
        made = generate.generate(generate.contexts(findings, symbols, before.select("symbol_id", "code"), after.select("symbol_id", "code"), documents), provide)
        made = settled(made.withColumn(KEY, F.row_number().over(generate.in_order())))
        proposed = made.filter("status = 'PROPOSED'").select(KEY, "document_path", "section_heading", "original_content", "proposed_content")
        code = nodes.filter("type in ('class', 'function', 'method')")
        judged = validate.check_patches(proposed, KEY, documents, PREFIX, paths, code).select(KEY, "issues", "valid", "checks_not_performed")
        outcomes = settled(made.join(judged, KEY, "left"))
    if args.command == "generate":
        rows = outcomes.orderBy(KEY).collect()  # of one change set, for a reader
        print("\n".join(map(told, rows)) if rows else "No finding qualified for a patch.")
        if args.apply:
            documents, paths = documents_of(spark, root)
            documents = settled(documents)
            changed, tried = validate.apply_all(documents, proposed, KEY, PREFIX, paths, code)
            write_documents(root, documents, changed)
            for r in tried.orderBy(KEY).collect():
                print(f"{'Applied' if r.valid else 'Not applied'}: {r.document_path} — {r.section_heading or report.WHOLE_PAGE}")
        return 0
    if args.format == "annotations":
        text = "\n".join(r[0] for r in findings.orderBy("ordinal", "depth", "edge_id").select(report.annotation_line()).collect())
    else:
        now = datetime.datetime.now(datetime.UTC).isoformat()
        parts = (root, base, target, now, files, symbols, findings)
        lost = (done.unresolved_imports, done.unresolved_annotations, done.dangling)
        if args.format == "json":
            text = json.dumps(report.as_dict(*parts, outcomes, *lost), indent=2)
        else:
            text = report.render_markdown(spark, *parts, outcomes, *lost)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
