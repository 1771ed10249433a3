"""Sentences of findings, changes and checks, and how they are filled in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences that results carry. A {} stands for a value.
# -- changes of symbols
ADDED = "Symbol is absent in the base revision and present in the target."
REMOVED = "Symbol is present in the base revision and absent in the target."
MODIFIED = "This symbol's own source text differs between the two revisions."
MOVED = "Identical source text was removed from one file and added, unchanged, to another."
# -- findings
DOCUMENTED = "This symbol is explicitly documented in this section."
CONTAINER_DOCUMENTED = "Its containing {} (`{}`) is documented in this section."
WHY_MODIFIED = "`{}` ({}) was modified in {}. {}"
GONE = "The symbol `{}` this section documented no longer exists — it was removed from {}."
ELSEWHERE = "The symbol `{}` this section documented moved from {} to {}."
# -- checks of patches
UNREADABLE = "Document {} no longer exists, could not be read, or its path escapes the repository."
NO_SECTION = 'Section "{}" was not found in {} — it may have been renamed or removed since this patch was generated.'
STALE = "The content of this section in {} has changed since this patch was generated — regenerate the patch before applying."
OPEN_FENCE = "An odd number of ``` fence markers were found — a code fence may be unclosed."
BAD_ANNOTATION = 'Malformed {} annotation targeting "{}": {}'
DELETION = "The proposed content is {}% shorter than the original — check this wasn't an accidental deletion."
LOST_ANCHOR = 'Link "{}" points at anchor "#{}", which doesn\'t match any heading in {}.'
OUTSIDE = 'Link "{}" points at "{}", which resolves outside the repository.'
MISSING = 'Link "{}" points at "{}", which does not exist relative to {}.'
NOT_ONE_TARGET = 'Annotation target "{}" does not resolve to exactly one known symbol (found {}).'
# -- constructs that the scanner passes over
COMPUTED_NAME = "Computed method name is not modeled"
DESTRUCTURED_EXPORT = "Destructured export binding is not modeled"
EXPORT_ASSIGNMENT = "CommonJS-style `export =` is not modeled"


def says(sentence: str, *values: Column) -> Column:
    """The sentence with its values; null if one of them is."""
    texts = sentence.split("{}")
    if len(texts) != len(values) + 1:
        raise ValueError(f"{len(values)} values for {sentence!r}")
    parts = [F.lit(texts[0])]
    for value, text in zip(values, texts[1:], strict=True):
        parts += [value, F.lit(text)]
    return F.concat(*parts)
