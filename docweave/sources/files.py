"""Repository trees as tables: discovery, hashing, manifests and snapshots."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import model
from docweave.functions.text import language
from docweave.model import LANGUAGE_BY_SUFFIX, SCHEMA_VERSION

# Folders that hold no sources.
EXCLUDED = ("node_modules", ".git", "dist", "build", "coverage", ".docweave")


def read_gitignore(root: str) -> str:
    path = Path(root, ".gitignore")
    return path.read_text() if path.exists() else ""


def ignore_pattern(line: str) -> tuple[bool, str] | None:
    """(negated, regular expression over relative paths) of a .gitignore line."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            j = line.index("]", i + 1)
            out, i = out + "[" + line[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return negated, ("^" if anchored else "^(?:.*/)?") + out + ("/" if folder else "(?:/|$)")


def kept_by_gitignore(path: Column, content: str) -> Column:
    """The last pattern that fits decides."""
    keep = F.lit(True)
    for found in filter(None, map(ignore_pattern, content.split("\n"))):
        keep = F.when(path.rlike(found[1]), found[0]).otherwise(keep)
    return keep


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, content, content_hash, size_bytes) of the supported
    files under ``root``: no dot files, no excluded folders, none ignored."""
    base = os.path.abspath(root)
    suffixes = "{" + ",".join("*" + s for s in LANGUAGE_BY_SUFFIX) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(base)
    relative = F.substring("path", F.locate(base + "/", F.col("path")) + F.lit(len(base) + 1), F.length("path"))
    rows = files.select(relative.alias("path"), F.col("length").alias("size_bytes"), "content")
    hidden = F.col("path").rlike(r"(^|/)\.")
    excluded = F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, EXCLUDED)) + ")/")
    kept = rows.filter(~hidden & ~excluded & kept_by_gitignore(F.col("path"), read_gitignore(root)))
    return kept.select(
        "path", language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"), "size_bytes"
    )


def discover(spark: SparkSession, root: str) -> DataFrame:
    return read_tree(spark, root).select("path").orderBy("path")


def hash_content(content: Column) -> Column:
    return F.sha2(content, 256)


def save_manifest(manifest: DataFrame, path: str) -> None:
    """Write (path, content_hash, language) as JSON rows."""
    manifest.select("path", "content_hash", "language").write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; an empty one where there is none that can be read."""
    schema = "path string, content_hash string, language string"
    try:
        return spark.read.schema(schema).json(path).filter("path is not null")
    except Exception:  # noqa: BLE001  a missing or broken manifest is an empty one
        return spark.createDataFrame([], schema)


class GraphStore:
    """Snapshots of the graph's tables in a folder. A write makes a new version
    and then moves the pointer, so readers see whole versions only."""

    TABLES = ("repositories", "files", "nodes", "edges")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        """The current version; 0 for an empty store. A store of another schema
        is not read: it has to be indexed anew."""
        pointer = Path(self.path, "CURRENT.json")
        if not pointer.exists():
            return 0
        found = json.loads(pointer.read_text())
        if found.get("schema") != SCHEMA_VERSION:
            raise ValueError(f"the store has schema {found.get('schema')}, this version reads {SCHEMA_VERSION}: index into a new store")
        return found["version"]

    def read(self, table: str) -> DataFrame:
        schema = getattr(model, table.upper())
        if not self.version():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{self.version()}/{table}")

    def write(self, **tables: DataFrame) -> int:
        version = self.version() + 1
        for name in self.TABLES:
            (tables[name] if name in tables else self.read(name)).write.parquet(f"{self.path}/v{version}/{name}")
        pointer = Path(self.path, "CURRENT.json.new")
        pointer.write_text(json.dumps({"version": version, "schema": SCHEMA_VERSION}))
        os.replace(pointer, Path(self.path, "CURRENT.json"))
        return version
