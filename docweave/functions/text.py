"""Column functions over text: paths, lines, slugs, Markdown and comments.

All of them are built-in expressions, so they stay inside generated code or
at least inside the JVM.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.model import LANGUAGE_BY_SUFFIX

# Patterns that decide what counts as what.
EXTERNAL_LINK = r"(?i)^([a-z][a-z0-9+.-]*:)?//"
FILE_REFERENCE = r"(?i)^[\w./-]+\.(ts|tsx|js|jsx|mjs|cjs|md|mdx|json)$"
SYMBOL_REFERENCE = r"^[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*(\(\))?$"
IMPORT_SUFFIXES = (
    "", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx",
)
DELETION_LENGTH, DELETION_SHARE = 40, 0.2


# ------------------------------------------------------------------------ paths
def language(path: Column) -> Column:
    """Language of a path by the suffix after its last dot, else null."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    return F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_SUFFIX.items() for x in pair])[suffix]


def normalize(path: Column) -> Column:
    """POSIX normalization: no empty or ``.`` parts, ``..`` resolved; an
    absolute path can't leave the root, a relative one keeps leading ``..``."""
    absolute = path.startswith("/")

    def step(done, part):
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        back = F.when(up, shorter).when(absolute, done).otherwise(F.array_append(done, F.lit("..")))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def dirname(path: Column) -> Column:
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), F.when(found == "", F.lit("/")).otherwise(found)).otherwise(F.lit("."))


def safe_path(root: Column, relative: Column) -> Column:
    """Absolute path of ``relative`` under ``root``; null if it ends outside."""
    base = normalize(root)
    full = normalize(F.when(relative.startswith("/"), relative).otherwise(F.concat(root, F.lit("/"), relative)))
    inside = (full == base) | full.startswith(F.when(base == "/", F.lit("/")).otherwise(F.concat(base, F.lit("/"))))
    return F.when(inside, full)


def import_candidates(path: Column, specifier: Column) -> Column:
    """Paths a relative import may mean, in order of preference."""
    joined = normalize(F.concat(dirname(path), F.lit("/"), specifier))
    return F.transform(F.array(*[F.lit(s) for s in IMPORT_SUFFIXES]), lambda s: F.concat(joined, s))


# ------------------------------------------------------------------------ lines
def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, inclusive), joined again."""
    return F.array_join(F.slice(F.split(text, "\n", -1), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def splice_lines(text: Column, start: Column, end: Column, new: Column) -> Column:
    """``text`` with lines ``start`` to ``end`` replaced by ``new``."""
    lines = F.split(text, "\n", -1)
    before = F.slice(lines, F.lit(1), start - 1)
    after = F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))
    return F.array_join(F.concat(before, F.array(new), after), "\n")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


# --------------------------------------------------------------------- Markdown
def slug(heading: Column) -> Column:
    """Anchor of a heading before repeated ones are numbered."""
    kept = F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}\p{M}_\- ]", "")
    return F.regexp_replace(kept, " ", "-")


def numbered_slugs(slugs: Column) -> Column:
    """Anchors of a document's headings in order: a repeated one gets -1, -2,
    ... and skips what is taken already."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("seen"))

    def step(acc, base):
        tries = F.sequence(F.lit(0), F.size(acc["out"]) + 1)
        count = F.coalesce(acc["seen"][base], F.lit(0))
        name = lambda i: F.when(i == 0, base).otherwise(F.concat(base, F.lit("-"), i.cast("string")))
        free = F.filter(tries, lambda i: (i >= count) & ~F.array_contains(acc["out"], name(i)))
        n = F.element_at(free, 1)
        seen = F.map_concat(F.map_filter(acc["seen"], lambda k, _: k != base), F.create_map(base, n))
        return F.struct(F.array_append(acc["out"], name(n)).alias("out"), seen.alias("seen"))

    return F.aggregate(slugs, start, step, lambda acc: acc["out"])


def links(markdown: Column) -> Column:
    """Inline links of Markdown as array<struct<text, target>>; images are none."""
    pattern = F.lit(r"(?<!!)\[([^\[\]]*)\]\(\s*<?([^\s<>()]+)>?(?:\s+\"[^\"]*\")?\s*\)")
    texts, targets = (F.regexp_extract_all(markdown, pattern, F.lit(i)) for i in (1, 2))
    return F.zip_with(texts, targets, lambda a, b: F.struct(a.alias("text"), b.alias("target")))


def is_external(target: Column) -> Column:
    return target.rlike(EXTERNAL_LINK) | target.startswith("mailto:")


def annotation(comment: Column, prefix: str) -> Column:
    """struct<directive, target, issues, well_formed> of the first annotation in
    an HTML comment ``<!-- prefix:directive target -->``, else null."""
    pattern = rf"<!--\s*{prefix}:(\S+)\s+(.*?)\s*-->"
    directive, target = (F.regexp_extract(comment, pattern, i) for i in (1, 2))
    unknown = F.when(directive != "documents", F.concat(F.lit(f'Unknown {prefix} directive "'), directive, F.lit('"')))
    missing = F.when(target == "", F.lit("Annotation is missing a target"))
    issues = F.filter(F.array(unknown, missing), lambda x: x.isNotNull())
    found = F.struct(directive.alias("directive"), target.alias("target"), issues.alias("issues"), (F.size(issues) == 0).alias("well_formed"))
    return F.when(comment.rlike(pattern), found)


def comments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)(<!--.*?-->)"), F.lit(1))


def odd_fences(text: Column) -> Column:
    """Is the number of unindented ``` lines odd?"""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?m)^```"), F.lit(0))) % 2 == 1


def fences(text: Column) -> Column:
    """Fenced blocks as array<struct<language, content>>; language may be null."""
    pattern = F.lit(r"(?ms)^```[ \t]*([^\s`]*)[^\n`]*\n(.*?)^```[ \t]*$")
    names, contents = (F.regexp_extract_all(text, pattern, F.lit(i)) for i in (1, 2))
    return F.zip_with(
        names, contents, lambda a, b: F.struct(F.when(a != "", a).alias("language"), F.regexp_replace(b, r"\n$", "").alias("content"))
    )


def inline_code(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?<!`)`([^`\n]+)`(?!`)"), F.lit(1))


def reference_kind(code: Column) -> Column:
    """What an inline code span seems to name: file-path, symbol-like or null."""
    return F.when(code.contains("/") | code.rlike(FILE_REFERENCE), "file-path").when(code.rlike(SYMBOL_REFERENCE), "symbol-like")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where the value is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def doc_comment(raw: Column) -> Column:
    """struct<description, tags array<struct<tag, text>>> of a /** comment */."""
    body = F.regexp_replace(F.regexp_replace(raw, r"^/\*\*", ""), r"\*/$", "")
    lines = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(trimmed(x), r"^\*\s?", ""))
    tag_line = lambda x: x.startswith("@") & x.rlike(r"^@(\w+)\s*(.*)$")

    def parts(lines: Column) -> Column:
        tags = F.transform(
            F.filter(lines, tag_line),
            lambda x: F.struct(F.regexp_extract(x, r"^@(\w+)\s*(.*)$", 1).alias("tag"), trimmed(F.regexp_extract(x, r"^@(\w+)\s*(.*)$", 2)).alias("text")),
        )
        first = F.array_position(F.transform(lines, lambda x: F.when(tag_line(x), 1).otherwise(0)), 1)
        before = lambda n: F.slice(lines, F.lit(1), F.when(n > 0, n - 1).otherwise(F.size(lines)).cast("int"))
        told = F.filter(_once(first, before), lambda x: x != "")
        description = _once(trimmed(F.array_join(told, " ")), lambda d: F.when(d != "", d))
        return F.struct(description.alias("description"), tags.alias("tags"))

    return _once(lines, parts)


# ------------------------------------------------------------------ validation
def deletion_percent(original: Column, proposed: Column) -> Column:
    """By how many percent a text shrank, if suspiciously much; else null."""
    a, b = F.length(trimmed(original)), F.length(trimmed(proposed))
    percent = F.floor((1 - b / a) * 100 + 0.5).cast("long")
    return F.when((a >= DELETION_LENGTH) & (b < a * DELETION_SHARE), percent)


def escape_message(text: Column) -> Column:
    """Percent-escapes of a workflow command's message."""
    for raw, escaped in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def escape_property(text: Column) -> Column:
    for raw, escaped in ((",", "%2C"), (":", "%3A")):
        text = F.replace(text if raw == ":" else escape_message(text), F.lit(raw), F.lit(escaped))
    return text
