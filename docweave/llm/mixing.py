"""Mixing sources to target weights with a multivariate-hypergeometric
splitting tree.

1. Every row falls into one of its source's blocks of about ``BLOCK_ROWS`` rows
   by a hash of its key, and a Feistel permutation puts the blocks of a source
   in order.
2. A target is met by whole passes over the source's blocks, then by a prefix of
   the permuted order; its last block is cut at the row nearest to the target.
   A draw is one block in one pass, and the number of a source's draws is its
   quota.
3. A binary tree over the output shards splits the quotas exactly: each node
   draws a multivariate-hypergeometric vector for its left half and leaves the
   rest to the right one. So shards hold as many draws each, by one at most,
   in near the global proportions.
4. The draws of a source are permuted once more and dealt to the shards in
   consecutive runs as long as their quotas: draws of different shards are
   disjoint. A row is taken once for each draw of its block, by the shard
   that owns the draw, and ``mix`` deals rows out by shard and sorts each
   shard by a hashed order of its own.

Sources may be many: targets, quotas and offsets are aggregates and windows
over a table with one row per source. The tree sees at most ``BUNDLES`` quotas.
With more sources than that a bundle is several of them, whose draws are
permuted together, which has the same law. Windows are bounded: superblocks of
a source (2 million rows each), blocks of one superblock, rows of one block,
sources of one bundle.

Defined results: null text has size 0; a null source is a source, the last;
sources without words have target 0; rows that repeat are numbered and drawn
one by one, so they spread over blocks too; an empty table gives an empty mix.
Reruns agree for any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm._common import sent_if_few, stage
from docweave.llm.sharding import network, number_rows, permute_by

BLOCK_ROWS = 512
#: Blocks of a superblock.
SUPER = 4096
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SHARDS = 8
#: Quotas that the tree splits on the driver.
BUNDLES = 4096
#: Rows of the table of sources that is sent to every executor; a larger one is joined by shuffling.
SMALL = 10_000
#: Copies of a row that one task numbers.
COPIES = 65_536
#: Words of an output partition, about.
PART_WORDS = 1_000_000
_BIG = "decimal(38,0)"


def target_table(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """sources(s, size, ...) with sid, the place by code point from 0, null
    last, and target: shares by weight of all words, none above ``cap`` times
    its source's; the excess is shared again by weight. Each round is one
    aggregate; the share of a weight of 1 only grows, so the last tells all."""
    ranked, _ = number_rows(sources.withColumn("none", F.col("s").isNull()), ["none", "s"], "sid")
    listed = ranked.drop("none").withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    rest, shares, closed = None, None, -1
    while True:
        over = F.lit(False)
        if shares:
            over = F.col("weight").cast(_BIG) * F.lit(Decimal(rest)) > F.col("size").cast(_BIG) * F.lit(Decimal(cap * shares))
        one = lambda c: F.sum(c.cast(_BIG))
        total, taken, left, n = listed.agg(
            one(F.col("size")), one(F.when(over, F.col("size") * cap).otherwise(0)), one(F.when(over, 0).otherwise(F.col("weight"))), F.count_if(over)
        ).first()
        if n == closed or total is None or not left:
            break
        rest, shares, closed = int(total - taken), int(left), n
    if not shares:
        return listed.withColumn("target", F.lit(0.0))
    wanted = (F.col("weight").cast(_BIG) * F.lit(Decimal(rest))).cast("double") / F.lit(float(shares))
    return listed.withColumn("target", F.when(over, (F.col("size") * cap).cast("double")).otherwise(wanted))


def split(quotas: Sequence[int], shards: int, seed: int = 0) -> list[list[int]]:
    """Quotas of each shard: they add up exactly, and shards differ in their
    number of draws by one at most."""
    rng = np.random.default_rng(seed)

    def down(counts: np.ndarray, k: int) -> list[np.ndarray]:
        if k == 1:
            return [counts]
        left = k // 2
        take = int(counts.sum()) * left // k
        chosen = rng.multivariate_hypergeometric(counts, take, method="marginals") if len(counts) else counts
        return down(chosen, left) + down(counts - chosen, k - left)

    return [list(map(int, c)) for c in down(np.array(quotas, np.int64), shards)]


def numbered_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with __copy, the number from 0 among rows that are equal."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    few = counted.filter(F.col("__n") <= COPIES).withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    # of a row with very many copies, runs of copies are dealt out first
    cuts = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("__n") - 1, F.lit(COPIES)))
    runs = counted.filter(F.col("__n") > COPIES).withColumn("__run", F.explode(cuts)).repartition("__run", *rows.columns)
    first = F.col("__run") * COPIES
    many = runs.withColumn("__copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("__n")) - 1)))
    return few.unionByName(many.drop("__run")).drop("__n")


@dataclass
class Plan:
    """Rows by source that say which rows are drawn, how often and for whom."""

    sized: DataFrame
    sources: DataFrame
    source_col: str
    key: list[str]
    few: bool
    seed: int

    def near(self, table: DataFrame) -> DataFrame:
        """A table of at most one row by source, sent to all if it is small."""
        return F.broadcast(table) if self.few else table

    def at(self) -> Column:
        """A row's place in the permuted order of its source's blocks."""
        return permute_by(F.pmod("__hash", F.col("__blocks")), network(F.col("__blocks")), self.seed)

    def place(self) -> Column:
        """A row's place in its block; no two rows have one."""
        return F.struct(F.col("__hash").alias("h"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(self.key)], F.col("__copy").alias("c"))

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have source, key, __copy and __hash, with
        __source_size, __target and __shards. Rows stay where they are unless
        there are very many sources."""
        found = rows.join(self.near(self.sources), F.col(self.source_col).eqNullSafe(F.col("__s"))).withColumn("__at", self.at())
        extra = (F.col("__at") < F.col("__cut")) | ((F.col("__at") == F.col("__cut")) & (self.place() <= F.col("__last")))
        times = F.col("__passes") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)
        turns = F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<long>"))
        of = lambda t: F.col("__first") + t * F.col("__blocks") + F.col("__at")
        # a lambda variable holds a draw's place, so that it is found once
        places = F.transform(turns, lambda t: permute_by(of(t), network(F.col("__total")), self.seed + 1))
        shards = F.transform(places, lambda p: F.size(F.filter("__bounds", lambda b: b <= p)))
        return found.withColumn("__shards", shards).select(*rows.columns, "__source_size", "__target", "__shards")


def hashed(rows: DataFrame, key: list[str], seed: int) -> DataFrame:
    return rows.withColumn("__hash", F.xxhash64(*key, "__copy", F.lit(seed).cast("long")))


def plan_draws(
    rows: DataFrame,
    key: list[str],
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    cap: int = MAX_REPEATS,
    shards: int = SHARDS,
    seed: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> Plan:
    """The plan for narrow rows with __size, which ``key`` tells apart but for copies."""
    spark = rows.sparkSession
    sized = stage(hashed(numbered_copies(rows), key, seed), "sized")
    sources = sized.groupBy(F.col(source_col).alias("s")).agg(F.sum("__size").alias("size"), F.count("*").alias("n"))
    passes = F.when(F.col("size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("size")))).otherwise(0).cast("long")
    rest = F.when((F.col("passes") < cap) & (F.col("size") > 0), F.col("target") - F.col("passes") * F.col("size")).otherwise(F.lit(0.0))
    listed = target_table(sources, weights, cap).withColumn("passes", passes).withColumn("rest", rest)
    blocks = F.ceil(F.col("n") / block_rows).cast("long")
    listed = listed.select(
        F.col("s").alias("__s"), F.col("sid").alias("__sid"), F.col("size").alias("__source_size"), F.col("target").alias("__target"),
        F.col("passes").alias("__passes"), F.col("rest").alias("__rest"), blocks.alias("__blocks"),
    )
    listed = stage(listed, "sources")
    plan = Plan(sized, listed, source_col, key, listed.count() <= SMALL, seed)
    own = listed.select("__s", "__sid", "__blocks", "__rest")
    dealt = sized.join(plan.near(own), F.col(source_col).eqNullSafe(F.col("__s"))).withColumn("__at", plan.at())
    dealt = stage(dealt.select("__sid", "__rest", "__at", "__size", "__hash", "__copy", *key), "dealt").filter("__rest > 0")

    # where the permuted order passes the rest: in which superblock, in which block, at which row
    def passed(groups: DataFrame, order: str) -> DataFrame:
        """Of groups(__sid, __rest, <order>, words, base): the last that begins before the rest."""
        ahead = Window.partitionBy("__sid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        begins = groups.withColumn("begin", F.col("base") + F.coalesce(F.sum("words").over(ahead), F.lit(0))).filter(F.col("begin") < F.col("__rest"))
        return begins.groupBy("__sid").agg(F.max_by(F.struct(order, "begin"), order).alias("x")).select("__sid", f"x.{order}", "x.begin")

    words = F.sum("__size").alias("words")
    sup = F.call_function("div", F.col("__at"), F.lit(SUPER))
    supers = dealt.groupBy("__sid", "__rest", sup.alias("sup")).agg(words).withColumn("base", F.lit(0).cast("long"))
    inside = dealt.withColumn("sup", sup).join(plan.near(passed(supers, "sup")), ["__sid", "sup"])
    cuts = stage(passed(inside.groupBy("__sid", "__rest", "__at", F.col("begin").alias("base")).agg(words), "__at"), "cuts")
    ordered = Window.partitionBy("__sid").orderBy(plan.place()).rowsBetween(Window.unboundedPreceding, -1)
    most = F.col("begin") + F.coalesce(F.sum("__size").over(ordered), F.lit(0))
    taken = dealt.join(plan.near(cuts), ["__sid", "__at"]).withColumn("near", 2 * most + F.col("__size") <= 2 * F.col("__rest")).filter("near")
    last = taken.groupBy("__sid").agg(F.max(plan.place()).alias("__last"))

    # quotas, the tree, and which run of its bundle's draws a shard owns
    cut = cuts.select("__sid", F.col("__at").alias("__cut"))
    quota = F.col("__passes") * F.col("__blocks") + F.coalesce(F.col("__cut") + 1, F.lit(0))
    planned = listed.join(cut, "__sid", "left").join(last, "__sid", "left").withColumn("quota", quota).withColumn("bundle", F.col("__sid") % BUNDLES)
    ahead = Window.partitionBy("bundle").orderBy("__sid").rowsBetween(Window.unboundedPreceding, -1)
    planned = planned.withColumn("__first", F.coalesce(F.sum("quota").over(ahead), F.lit(0))).withColumn("__total", F.sum("quota").over(Window.partitionBy("bundle")))
    planned = stage(planned, "planned")
    bundles = sorted((r["bundle"], r["__total"]) for r in planned.select("bundle", "__total").distinct().collect())  # at most BUNDLES
    upto = np.cumsum(np.array(split([t for _, t in bundles], shards, seed), np.int64).reshape(shards, -1), axis=0)
    bounds = spark.createDataFrame([(b, [int(x) for x in upto[:, i]]) for i, (b, _) in enumerate(bundles)], "bundle long, __bounds array<long>")
    plan.sources = planned.join(F.broadcast(bounds), "bundle").drop("bundle", "quota", "__sid", "__rest")
    return plan


def draws(rows: DataFrame, size: Column, key: list[str], source_col: str = "source", **options) -> DataFrame:
    """``rows`` with __copy, __size, __source_size, __target and __shards: the
    output shard of each time that the mix takes the row (empty: not taken).
    Pass narrow rows, which ``key`` tells apart but for copies; names that
    begin with two underscores are kept for the operator."""
    plan = plan_draws(rows.withColumn("__size", size.cast("long")), key, source_col, **options)
    out = plan.assign(plan.sized)
    return out.select(*rows.columns, "__copy", "__size", "__source_size", "__target", "__shards")


def words_in(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(rows: DataFrame, size: Column, seed: int = 0, source_col: str = "source", shards: int = SHARDS, **options) -> DataFrame:
    """The mix itself: rows as often as taken, dealt out by __shard and in each
    shard sorted by __order. A shard is one or more whole partitions, in order.
    Whole rows move once, but for those that repeat."""
    cells = [F.col(c) for c in rows.columns] + [F.col(c).isNull() for c in rows.columns]
    key = ["__row1", "__row2"]
    keyed = rows.withColumns({"__row1": F.xxhash64(*cells), "__row2": F.xxhash64(F.lit(1), *cells)})
    narrow = stage(keyed.select(*key, F.col(source_col), size.cast("long").alias("__size")), "narrow")
    plan = plan_draws(narrow, key, source_col, seed=seed, shards=shards, **options)
    one = F.lit(0).cast("long")
    copies = stage(plan.sized.filter("__copy > 0").select(*key).distinct(), "copies")
    if copies.isEmpty():
        numbered = keyed.withColumn("__copy", one)
    else:
        # rows that repeat meet the numbers of their copies once
        known = sent_if_few(copies)
        numbers = plan.sized.join(known, key, "left_semi").select(*key, "__copy")
        repeated = keyed.join(known, key, "left_semi").dropDuplicates(key).join(numbers, key)
        numbered = keyed.join(known, key, "left_anti").withColumn("__copy", one).unionByName(repeated)
    total = plan.sources.agg(F.sum("__target")).first()[0]
    drawn = plan.assign(hashed(numbered, key, seed)).select(*rows.columns, *key, "__copy", F.posexplode("__shards").alias("__pass", "__shard"))
    # a shard is cut into equal parts of the range of its order
    parts = max(1, -(-int(total or 0) // (shards * PART_WORDS)))
    order = F.xxhash64(*key, "__copy", "__pass", F.lit(seed + 1).cast("long"))
    part = F.floor((F.col("__order").cast("double") / 2.0**64 + 0.5) * parts)
    place = F.col("__shard") * parts + F.least(part, F.lit(parts - 1))
    placed = drawn.withColumn("__order", order).withColumn("__place", place.cast("int"))
    dealt = placed.repartitionById(shards * parts, "__place").sortWithinPartitions("__shard", "__order")
    return dealt.select(*rows.columns, "__shard", "__order")
