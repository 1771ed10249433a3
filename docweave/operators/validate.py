"""Checks of proposed patches, and applying the valid ones.

A patch has document_path, section_heading, original_content and
proposed_content. Every check adds an array of struct<check, severity,
message>; a patch is valid if none is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import messages
from docweave.functions.messages import says
from docweave.functions.text import annotation, comments, deletion_percent, dirname, is_external, links, odd_fences, safe_path, splice_lines
from docweave.operators.resolve import resolve_annotations
from docweave.parsing import markdown
from docweave.plans.materialize import settled

ISSUE = "array<struct<check:string,severity:string,message:string>>"


def issue(when: Column, check: str, severity: str, sentence: str, *values: Column) -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), says(sentence, *values).alias("message")))


def present(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda x: x.isNotNull()).cast(ISSUE)


def inside(path: Column) -> Column:
    """A path as it comes to below the repository; null if it leads out of it."""
    return F.substring(safe_path(F.lit("/r"), F.concat(F.lit("./"), path)), F.lit(4), F.lit(2**31 - 1))


def locate_sections(patches: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Patches with content, and start_line, end_line and current_text of the
    section now: the whole document for a null heading, else the first section
    with the heading. sections(document_path, heading, start_line, end_line,
    content). A path is looked up as it comes to below the repository; one that
    leads out of it finds nothing."""
    first = sections.filter("heading is not null").groupBy(F.col("document_path").alias("__path"), F.col("heading").alias("section_heading")).agg(
        F.min_by(F.struct("start_line", "end_line", "content"), "start_line").alias("s")
    )
    texts = documents.select(F.col("document_path").alias("__path"), "content")
    joined = patches.withColumn("__path", inside(F.col("document_path"))).join(texts, "__path", "left").join(first, ["__path", "section_heading"], "left")
    whole = F.col("section_heading").isNull() & F.col("content").isNotNull()
    lines = F.size(F.split("content", "\n", -1))
    return joined.select(
        *patches.columns, "content",
        F.when(whole, 1).otherwise(F.col("s.start_line")).cast("int").alias("start_line"),
        F.when(whole, lines).otherwise(F.col("s.end_line")).cast("int").alias("end_line"),
        F.when(whole, F.col("content")).otherwise(F.col("s.content")).alias("current_text"),
    )


def applicability(located: DataFrame) -> Column:
    """Is the section still there, and as it was?"""
    path, unread = F.col("document_path"), F.col("content").isNull()
    gone = ~unread & F.col("start_line").isNull()
    stale = ~unread & ~gone & ~F.col("current_text").eqNullSafe(F.col("original_content"))
    return present(
        issue(unread, "document-readable", "error", messages.UNREADABLE, path),
        issue(gone, "patch-applicability", "error", messages.NO_SECTION, F.coalesce("section_heading", F.lit("null")), path),
        issue(stale, "patch-applicability", "error", messages.STALE, path),
    )


def structure(text: Column, prefix: str) -> Column:
    """Balanced fences and well-formed annotations."""
    fence = issue(odd_fences(text), "code-fence-integrity", "error", messages.OPEN_FENCE)
    found = F.filter(F.transform(comments(text), lambda c: annotation(c, prefix)), lambda a: a.isNotNull() & ~a["well_formed"])
    bad = F.transform(
        found,
        lambda a: issue(F.lit(True), "annotation-well-formed", "error", messages.BAD_ANNOTATION, F.lit(prefix), a["target"], F.array_join(a["issues"], "; ")),
    )
    return F.concat(present(fence), bad.cast(ISSUE))


def accidental_deletion(original: Column, proposed: Column) -> Column:
    percent = deletion_percent(original, proposed)
    return present(issue(percent.isNotNull(), "accidental-deletion", "warning", messages.DELETION, percent.cast("string")))


def _collected(patches: DataFrame, key: str, issues: DataFrame, name: str) -> DataFrame:
    gathered = issues.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("nth", "issue"))).alias("__i"))
    joined = patches.join(gathered, key, "left")
    return joined.withColumn(name, F.coalesce(F.transform("__i", lambda x: x["issue"]), F.array()).cast(ISSUE)).drop("__i")


def links_and_anchors(patches: DataFrame, key: str, slugs: DataFrame, files: DataFrame, root: str, name: str = "link_issues") -> DataFrame:
    """Internal links of the proposed content: anchors must be slugs of the
    resulting document, slugs(key, slug); paths must exist, files(path)."""
    found = patches.select(key, "document_path", F.posexplode(links(F.col("proposed_content"))).alias("nth", "l"))
    found = found.select(key, "document_path", "nth", "l.text", "l.target").filter(~is_external(F.col("target")))
    anchors = found.filter(F.col("target").startswith("#")).withColumn("slug", F.expr("substring(target, 2)"))
    lost = anchors.join(slugs.select(key, "slug").distinct(), [key, "slug"], "left_anti")
    lost = lost.select(
        key, "nth",
        issue(F.lit(True), "invalid-anchor", "warning", messages.LOST_ANCHOR, F.col("text"), F.col("slug"), F.col("document_path")).alias("issue"),
    )
    paths = found.filter(~F.col("target").startswith("#")).withColumn("part", F.split("target", "#", -1)[0]).filter("part <> ''")
    joined = F.concat(dirname(F.col("document_path")), F.lit("/"), F.col("part"))
    full = safe_path(F.lit(root), F.concat(F.lit("./"), joined))
    base = root.rstrip("/") + "/"
    known = files.select(F.concat(F.lit(base), F.col("path")).alias("full"), F.lit(True).alias("__known")).distinct()
    checked = paths.withColumn("full", full).join(known, "full", "left")
    told = [F.col("text"), F.col("target")]
    outside = issue(F.col("full").isNull(), "broken-link", "warning", messages.OUTSIDE, *told)
    missing = issue(F.col("__known").isNull(), "broken-link", "warning", messages.MISSING, *told, F.col("document_path"))
    broken = checked.select(key, "nth", F.coalesce(outside, missing).alias("issue")).filter("issue is not null")
    return _collected(patches, key, lost.unionByName(broken), name)


def annotation_targets(patches: DataFrame, key: str, nodes: DataFrame, prefix: str, name: str = "target_issues") -> DataFrame:
    """Well-formed annotations must mean exactly one symbol of the graph."""
    found = patches.select(key, F.posexplode(comments(F.col("proposed_content"))).alias("nth", "c")).withColumn("a", annotation(F.col("c"), prefix))
    targets = found.filter("a.well_formed and contains(a.target, '#')").select(key, "nth", "a.target")
    bad = resolve_annotations(targets, nodes).filter("matches <> 1")
    bad = bad.select(
        key, "nth",
        issue(F.lit(True), "annotation-target-resolution", "warning", messages.NOT_ONE_TARGET, F.col("target"), F.col("matches").cast("string")).alias("issue"),
    )
    return _collected(patches, key, bad, name)


def validate(
    patches: DataFrame, key: str, documents: DataFrame, sections: DataFrame, prefix: str,
    slugs: DataFrame | None = None, files: DataFrame | None = None, root: str = "/", nodes: DataFrame | None = None,
) -> DataFrame:
    """Patches located, with issues, valid and checks_not_performed."""
    located = locate_sections(patches, documents, sections)
    skipped = []
    parts = [
        applicability(located), structure(F.col("proposed_content"), prefix),
        accidental_deletion(F.col("original_content"), F.col("proposed_content")),
    ]
    out = located.withColumn("issues", F.concat(*parts))
    links = F.array(F.lit("broken-link"), F.lit("invalid-anchor"))
    if slugs is not None and files is not None:
        # without a section there is no resulting document to look into
        found = F.col("start_line").isNotNull()
        out = links_and_anchors(out, key, slugs, files, root)
        out = out.withColumn("issues", F.when(found, F.concat("issues", "link_issues")).otherwise(F.col("issues"))).drop("link_issues")
        links = F.when(found, F.array().cast("array<string>")).otherwise(links)
    if nodes is not None:
        out = annotation_targets(out, key, nodes, prefix)
        out = out.withColumn("issues", F.concat("issues", "target_issues")).drop("target_issues")
    else:
        skipped.append("annotation-target-resolution")
    valid = ~F.exists("issues", lambda i: i["severity"] == "error")
    return out.withColumns({"valid": valid, "checks_not_performed": F.concat(links, F.array(*[F.lit(s) for s in skipped]).cast("array<string>"))})


def resulting_document(located: DataFrame) -> Column:
    return splice_lines(F.col("content"), F.col("start_line"), F.col("end_line"), F.col("proposed_content"))


def apply(documents: DataFrame, validated: DataFrame) -> DataFrame:
    """The next snapshot of documents(document_path, content): of each document
    the first valid patch (by its place, then its content) spliced in, all
    others as they were. apply_all() takes several patches of a document."""
    good = validated.filter("valid").withColumn("__new", resulting_document(validated))
    one = good.groupBy(inside(F.col("document_path")).alias("document_path")).agg(F.min_by("__new", F.struct("start_line", "proposed_content")).alias("__new"))
    joined = documents.join(one, "document_path", "left")
    return joined.withColumn("content", F.coalesce("__new", "content")).drop("__new")


def sections_of(documents: DataFrame) -> DataFrame:
    """sections(document_path, heading, start_line, end_line, content) of documents(document_path, content)."""
    parsed = markdown.parse_files(documents.select(F.col("document_path").alias("path"), "content"))
    return parsed.select(F.col("path").alias("document_path"), F.explode("sections").alias("s")).select("document_path", "s.heading", "s.start_line", "s.end_line", "s.content")


def check_patches(patches: DataFrame, key: str, documents: DataFrame, prefix: str, files: DataFrame, nodes: DataFrame | None = None, root: str = "/r") -> DataFrame:
    """validate() with sections of the documents as they are now, and anchors of
    the documents as the patches would leave them. files(path)."""
    sections = settled(sections_of(documents.join(patches.select(inside(F.col("document_path")).alias("document_path")).distinct(), "document_path", "left_semi")))
    located = locate_sections(patches, documents, sections).filter("start_line is not null")
    after = located.select(F.col(key).cast("string").alias("path"), resulting_document(located).alias("content"))
    heads = markdown.parse_files(after, prefix).select("path", F.explode("headings").alias("h"))
    slugs = heads.select(F.col("path").cast(dict(patches.dtypes)[key]).alias(key), "h.slug")
    return validate(patches, key, documents, sections, prefix, slugs, files, root, nodes)


def apply_all(documents: DataFrame, patches: DataFrame, key: str, prefix: str, files: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, outcomes): patches applied by ``key``, one of each document
    at a time, each checked against what those before it left. outcomes has the
    validated columns; ``valid`` says whether the patch was applied."""
    turn = F.row_number().over(Window.partitionBy(F.coalesce(inside(F.col("document_path")), F.col("document_path"))).orderBy(key))
    pending = settled(patches.withColumn("__turn", turn))
    rounds = pending.agg(F.max("__turn")).first()[0] or 0
    done = []
    for n in range(1, rounds + 1):
        done.append(settled(check_patches(pending.filter(F.col("__turn") == n).drop("__turn"), key, documents, prefix, files, nodes)))
        documents = settled(apply(documents, done[-1]))
    return documents, reduce(DataFrame.unionByName, done) if done else check_patches(patches, key, documents, prefix, files, nodes)
