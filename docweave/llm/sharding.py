"""Reproducible sharding: a Feistel permutation over global row numbers.

Rows are numbered 0..N-1 in ascending order of an id (ties by the other order
columns), which no partitioning changes. A Feistel network on the smallest number
of bits that holds N permutes the numbers; what falls
outside 0..N-1 walks the cycle until it is inside. Shard and slot are the
permuted number modulo and divided by the number of shards, so shard sizes
differ by one at most, slots have no gaps, and both directions can be computed
for any single row without data.

Numbering costs one range exchange of the narrow columns that are passed in:
the table is written once with its place inside its partition, and partition
sizes (one row per partition) give the offsets.

Defined results: null ids come first; rows that repeat get places of their
own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm._common import stage

ROUNDS = 4
#: Cycle-walking steps; a step fails with a chance below 1/2, and a row that
#: is still outside afterwards is an error, never a wrong place.
WALK = 96


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with global row numbers from 0, ascending by ``order``; and how
    many. Pass narrow columns."""
    # a range exchange samples its input first: the table spares a second scan
    df = stage(df, "narrow")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ranged.withColumn("__place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg((F.max("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("__n"))
    # one row per partition of the exchange: bounded by its number of partitions
    counts = sorted((r["__part"], r["__n"]) for r in sizes.collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    # one row per partition again, so small enough for every executor
    table = df.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("__part", part).join(F.broadcast(table), "__part")
    return numbered.withColumn(name, F.col("__offset") + inside).select(*df.columns, name), total


def network(n: Column) -> dict[str, Column]:
    """Of a Feistel network for 0..n-1 (n a long column, 1 at least): the bits
    of its low half, and the masks of its halves."""
    # bit length of n - 1; halves may differ by one
    bits = F.greatest(F.lit(2), F.length(F.bin(F.greatest(n - 1, F.lit(0))))).cast("int")
    low = F.floor(bits / 2).cast("int")
    one = F.lit(1).cast("long")
    mask = lambda b: F.call_function("shiftleft", one, b) - 1
    return {"low": low, "low_mask": mask(low), "high_mask": mask(bits - low), "n": n}


def _mix(half: Column, round_: Column, seed: int) -> Column:
    return F.xxhash64(half, round_, F.lit(seed).cast("long"))


def _once(x: Column, net: dict[str, Column], seed: int, inverse: bool) -> Column:
    """One pass through the network."""
    # even rounds change the high half by the low one, odd rounds the low by the high
    state = F.struct(F.call_function("shiftright", x, net["low"]).alias("h"), x.bitwiseAND(net["low_mask"]).alias("l"))

    def step(s, r):
        even = r % 2 == 0
        h = s["h"].bitwiseXOR(_mix(s["l"], r, seed).bitwiseAND(net["high_mask"]))
        l = s["l"].bitwiseXOR(_mix(s["h"], r, seed).bitwiseAND(net["low_mask"]))  # noqa: E741
        return F.struct(F.when(even, h).otherwise(s["h"]).alias("h"), F.when(even, s["l"]).otherwise(l).alias("l"))

    rounds = list(range(ROUNDS))[:: -1 if inverse else 1]
    order = F.array(*[F.lit(r).cast("long") for r in rounds])
    return F.aggregate(order, state, step, lambda s: F.call_function("shiftleft", s["h"], net["low"]).bitwiseOR(s["l"]))


def permute_by(x: Column, net: dict[str, Column], seed: int = 0, inverse: bool = False) -> Column:
    """A permutation of 0..n-1 that the network's n and the seed determine."""
    n = net["n"]
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), _once(x, net, seed, inverse), lambda y, _: F.when(y < n, y).otherwise(_once(y, net, seed, inverse))
    )
    return F.when(n <= 1, x).when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def permute(x: Column, n: int, seed: int = 0, inverse: bool = False) -> Column:
    """permute_by() for a number that is known when the plan is made."""
    return permute_by(x, network(F.lit(n).cast("long")), seed, inverse)


def place(number: Column, n: int, shards: int, seed: int = 0) -> tuple[Column, Column]:
    """(shard, slot) of a row number among n."""
    at = permute(number, n, seed)
    return F.pmod(at, F.lit(shards)).cast("int"), F.call_function("div", at, F.lit(shards))


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 0) -> Column:
    """The row number at a shard and slot: the inverse of place()."""
    return permute(slot * F.lit(shards) + shard, n, seed, inverse=True)


def assign(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with shard and slot. Pass narrow columns: text can be joined or
    written by write_shards() later."""
    numbered, n = number_rows(df, order, "__row")
    at = numbered.withColumn("__at", permute(F.col("__row"), n, seed))
    shard, slot = F.pmod(F.col("__at"), F.lit(shards)).cast("int"), F.call_function("div", F.col("__at"), F.lit(shards))
    return at.withColumn("shard", shard).withColumn("slot", slot).drop("__row", "__at")


def write_shards(df: DataFrame, path: str, parts_per_shard: int = 1) -> None:
    """Write assigned rows as one folder per shard, each file sorted by slot;
    a shard may be cut into several files by ranges of slots."""
    per = F.expr(f"slot % {int(parts_per_shard)}")
    dealt = df.repartition(F.col("shard"), per).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)
