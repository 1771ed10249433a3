"""URL rules: a blocked Bloom filter in front of an exact hash join.

A rule is a canonical URL, host and path; it fits its host and all subdomains
where the URL's path starts with the rule's path. Every URL gives candidate
keys: each suffix of its host (cut at dots) with each prefix of its path that
has the length of some rule's path. The blocked Bloom filter (one 64-bit word
per block, ``PROBES`` bits of it per key) lets possible hits through; those
join the rule table exactly on host and path, which removes false positives,
and the longest rule wins. Without a rule the verdict is the method's: a URL
that is not listed is allowed.

The filter is sized from the number of rules and never above ``MAX_WORDS``
words, so what is sent to executors is bounded; with more than half a million
rules it lets more through and the join stays exact. Distinct URLs only are
joined back, and only those with a possible hit: sent to all executors while
they are few, by shuffling beyond that. Of more than ``MAX_LENGTHS`` lengths of
rule paths, prefixes of every length are tried.

Defined results: null URLs and those without ``://`` have empty host and path
and no rule; rows that repeat are judged alike; of equally long rules the one
with the longest host wins, then the larger text; of a rule that is listed
twice the larger verdict holds (block over allow); an empty rule table allows
everything; input columns named as an output column are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm._common import sent_if_few, stage

PROBES = 4
BITS_PER_RULE = 16
MAX_WORDS = 1 << 17
#: Different lengths of rule paths; a URL gives a key for each that fits.
MAX_LENGTHS = 4096
OUTPUT = ("host", "path", "rule", "verdict")
_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _PATTERN, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATTERN, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rules(rule_host, rule_path, verdict) of (canonical URL, verdict) pairs
    such as ("example.net/en/", "allow")."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", v) for r, v in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, verdict string")


def _bits(host: Column, path: Column, words: int) -> tuple[Column, Column]:
    """(block, its bits) of a key."""
    h = F.xxhash64(host, path)
    g = F.xxhash64(path, host, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(h, F.lit(words)).cast("int"), mask


def build_filter(rules: DataFrame) -> list[int]:
    """The words of the filter over rules(rule_host, rule_path)."""
    n = rules.count()
    words = max(1, min(MAX_WORDS, 1 << max(0, (n * BITS_PER_RULE // 64 - 1).bit_length())))
    block, mask = _bits(F.col("rule_host"), F.col("rule_path"), words)
    keys = rules.select(block.alias("block"), mask.alias("mask"))
    out = [0] * words
    for r in keys.groupBy("block").agg(F.bit_or("mask").alias("mask")).collect():  # at most MAX_WORDS rows
        out[r["block"]] = r["mask"]
    return out


def _lookup(words: list[int]):
    """A column function from block to word. The words are one literal that
    the optimizer makes of a string, so the expression stays small."""
    literal = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return lambda block: F.get(literal, block)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    found = [r[0] for r in rules.select(F.length("rule_path")).distinct().limit(MAX_LENGTHS + 1).collect()]
    words = build_filter(rules)
    url = F.col(url_col)
    urls = pages.select(url.alias("__url")).filter(F.col("__url").contains("://"))
    parsed = urls.select("__url", host_of(F.col("__url")).alias("h"), path_of(F.col("__url")).alias("p"))
    parts = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    lengths = F.array(*[F.lit(n) for n in sorted(found)]).cast("array<int>") if len(found) <= MAX_LENGTHS else F.sequence(F.lit(0), F.length("p"))
    fitting = F.filter(lengths, lambda n: n <= F.length("p"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("p"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda x: F.struct(s.alias("host"), x.alias("path")))))
    word = _lookup(words)

    def possible(k):
        block, mask = _bits(k["host"], k["path"], len(words))
        return word(block).bitwiseAND(mask) == mask

    hits = parsed.withColumn("keys", F.filter(keys, possible)).filter(F.size("keys") > 0)
    hits = hits.select("__url", F.explode("keys").alias("k"))
    hits = hits.select("__url", F.col("k.host").alias("rule_host"), F.col("k.path").alias("rule_path")).distinct()
    listed = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule), F.length("rule_host"), rule)
    best = (
        hits.join(listed, ["rule_host", "rule_path"])
        .groupBy("__url").agg(F.max_by(F.struct(rule.alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("__best"))
    )
    best = sent_if_few(stage(best, "verdicts"))
    joined = pages.withColumn("__u", url).join(best, F.col("__u") == F.col("__url"), "left")
    return joined.select(
        *[F.col(c) for c in pages.columns if c not in OUTPUT],
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.col("__best.rule").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )
