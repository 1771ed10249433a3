"""Differences between snapshots of files and of symbols."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import messages
from docweave.functions.text import language
from docweave.model import KIND_LABELS, labelled
from docweave.operators.graph import last_wins
from docweave.plans.materialize import settled

SYMBOL_KEY = ("path_pair", "kind", "qualified_name")


def diff_manifest(scan: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, status) of scan(path, content_hash) against the manifest before:
    added, modified, removed or unchanged."""
    old = previous.select("path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("was"))
    new = scan.select("path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("is"))
    status = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "removed")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged")
        .otherwise("modified")
    )
    return new.join(old, "path", "full_outer").select("path", status.alias("status"))


def to_manifest(scan: DataFrame) -> DataFrame:
    """(path, content_hash, language) of a scan or of the files table."""
    return scan.select("path", "content_hash", "language")


def parse_name_status(lines: DataFrame, column: str = "line") -> DataFrame:
    """(status, path, previous_path) of ``git diff --name-status`` lines; other
    letters than A, M, D and R are skipped."""
    parts = F.split(column, "\t", -1)
    code = F.substring(parts[0], 1, 1)
    status = F.when(code == "R", "renamed").when(parts[0] == "A", "added").when(parts[0] == "M", "modified").when(parts[0] == "D", "deleted")
    rows = lines.select(
        status.alias("status"),
        F.when(code == "R", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"),
        F.when(code == "R", F.get(parts, F.lit(1))).alias("previous_path"),
    )
    return rows.filter(F.col("status").isNotNull() & F.col("path").isNotNull())


def changed_files(tracked: DataFrame, untracked: DataFrame | None = None) -> DataFrame:
    """File changes with languages; untracked(path) counts as added."""
    rows = tracked.select("status", "path", "previous_path")
    if untracked is not None:
        rows = rows.unionByName(untracked.select(F.lit("added").alias("status"), "path", F.lit(None).cast("string").alias("previous_path")))
    return rows.withColumn("language", language(F.col("path")))


def _sides(base: DataFrame, target: DataFrame) -> DataFrame:
    def side(rows: DataFrame, name: str) -> DataFrame:
        # of equal keys the last stays, as in a map that is filled in order
        unique = last_wins(rows.select(*SYMBOL_KEY, "path", "symbol_id", "name", "text_hash", "ordinal"), SYMBOL_KEY, "ordinal")
        return unique.select(*SYMBOL_KEY, *[F.col(c).alias(f"{name}_{c}") for c in ("path", "symbol_id", "name", "text_hash", "ordinal")])

    return side(base, "old").join(side(target, "new"), list(SYMBOL_KEY), "full_outer")


def diff_symbols(base: DataFrame, target: DataFrame) -> DataFrame:
    """Symbols of paired files matched by kind and qualified name: columns old_*
    and new_* and status modified, added or removed (candidates), or unchanged.
    Rows need path_pair, kind, qualified_name, path, symbol_id, name, text_hash
    and ordinal."""
    status = (
        F.when(F.col("old_symbol_id").isNull(), "added")
        .when(F.col("new_symbol_id").isNull(), "removed")
        .when(F.col("old_text_hash") == F.col("new_text_hash"), "unchanged")
        .otherwise("modified")
    )
    return _sides(base, target).withColumn("status", status)


def _greedy(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one group in input order: each removed symbol takes the first
    added one of another file that nobody took."""
    removed = rows[rows.side == "removed"].sort_values("ordinal")
    added = list(rows[rows.side == "added"].sort_values("ordinal").itertuples())
    pairs = []
    for r in removed.itertuples():
        hit = next((i for i, a in enumerate(added) if a.path != r.path), None)
        if hit is not None:
            pairs.append((r.symbol_id, added.pop(hit).symbol_id))
    return pd.DataFrame(pairs, columns=["old_symbol_id", "new_symbol_id"])


def match_moves(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(old_symbol_id, new_symbol_id) of symbols that left one file and came,
    word for word, to another. Both inputs: kind, qualified_name, text_hash,
    path, symbol_id, ordinal. Groups whose candidates share no path pair up by
    rank; only a group with a shared path needs the greedy rule."""
    key = ["kind", "qualified_name", "text_hash"]
    both = removed.withColumn("side", F.lit("removed")).unionByName(added.withColumn("side", F.lit("added")))
    paths = lambda s: F.collect_set(F.when(F.col("side") == s, F.col("path")))
    groups = both.groupBy(*key).agg(F.count_distinct("side").alias("sides"), F.arrays_overlap(paths("removed"), paths("added")).alias("shared"))
    groups = groups.filter("sides = 2").select(*key, "shared")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))
    plain = groups.filter("not shared")

    def ranked(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(plain, key, "left_semi").select(*key, nth.alias("nth"), F.col("symbol_id").alias(name))

    easy = ranked(removed, "old_symbol_id").join(ranked(added, "new_symbol_id"), [*key, "nth"])
    hard = both.join(groups.filter("shared"), key, "left_semi").groupBy(*key).applyInPandas(_greedy, "old_symbol_id string, new_symbol_id string")
    return easy.select("old_symbol_id", "new_symbol_id").unionByName(hard)


def _described(kind: Column, name: Column, *rest: Column | str) -> Column:
    parts = [F.lit(x) if isinstance(x, str) else x for x in rest]
    return F.concat(labelled(kind, KIND_LABELS), F.lit(" `"), name, F.lit("` "), *parts)


def symbol_changes(base: DataFrame, target: DataFrame) -> DataFrame:
    """The change set of two symbol snapshots: added, removed, modified and
    moved, with descriptions and evidence, in that order (``order_group``)."""
    # what changed is far less than what was compared, and five branches read it
    diff = settled(diff_symbols(base, target).filter("status <> 'unchanged'"))

    def candidates(status: str, side: str) -> DataFrame:
        own = diff.filter(F.col("status") == status)
        return own.select("kind", "qualified_name", *[F.col(f"{side}_{c}").alias(c) for c in ("text_hash", "path", "symbol_id", "name", "ordinal")])

    removed, added = candidates("removed", "old"), candidates("added", "new")
    narrow = ["kind", "qualified_name", "text_hash", "path", "symbol_id", "ordinal"]
    moves = match_moves(removed.select(*narrow), added.select(*narrow))
    nothing = F.lit(None).cast("string")
    one = lambda rows, group, type_, text, evidence: rows.select(
        F.lit(group).alias("order_group"), F.lit(type_).alias("change_type"), "symbol_id", "name", "kind", F.col("path").alias("file_path"),
        nothing.alias("previous_file_path"), nothing.alias("previous_symbol_id"), text.alias("description"), F.lit(evidence).alias("evidence"), "ordinal",
    )
    kind, name, path = F.col("kind"), F.col("qualified_name"), F.col("path")
    new = one(
        added.join(moves.select(F.col("new_symbol_id").alias("symbol_id")), "symbol_id", "left_anti"), 0, "added",
        _described(kind, name, "added in ", path), messages.ADDED,
    )
    gone = one(
        removed.join(moves.select(F.col("old_symbol_id").alias("symbol_id")), "symbol_id", "left_anti"), 1, "removed",
        _described(kind, name, "removed from ", path), messages.REMOVED,
    )
    changed = one(
        candidates("modified", "new"), 2, "modified",
        _described(kind, name, "changed in ", path), messages.MODIFIED,
    )
    came = added.withColumnRenamed("symbol_id", "new_symbol_id").join(moves, "new_symbol_id")
    left = removed.select(F.col("symbol_id").alias("old_symbol_id"), F.col("path").alias("old_path"))
    moved = came.join(left, "old_symbol_id").select(
        F.lit(3).alias("order_group"), F.lit("moved").alias("change_type"), F.col("new_symbol_id").alias("symbol_id"), "name", "kind",
        F.col("path").alias("file_path"), F.col("old_path").alias("previous_file_path"), F.col("old_symbol_id").alias("previous_symbol_id"),
        _described(kind, name, "moved from ", F.col("old_path"), " to ", path).alias("description"),
        F.lit(messages.MOVED).alias("evidence"), "ordinal",
    )
    return new.unionByName(gone).unionByName(changed).unionByName(moved)


