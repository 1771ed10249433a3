import collections
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F
from test_sharding import permuted

from docweave.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, size string, block int, rest string, first long"


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Words to take by source, with plain numbers."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        rest, shares = total - sum(capped.values()), sum(weight[s] for s in open_)
        wanted = {s: rest * weight[s] / shares for s in open_}
        over = [s for s in open_ if wanted[s] > cap * sizes[s]]
        if not over:
            return {s: float(capped[s]) if s in capped else wanted[s] for s in order}
        capped |= {s: cap * sizes[s] for s in over}


def chain(values):
    """xxhash64() of longs and strings; nulls leave it as it is."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), h)
    return h - 2**64 if h >> 63 else h


def plain(rows, block_rows, shards=8, seed=0, bundles=mixing.BUNDLES):
    """Of (source, size, key) the multiset of (key, size, source size, target, shards), by loops."""
    copies, items = collections.Counter(), []
    for s, n, key in rows:
        items.append((s, n, key, copies[s, key]))
        copies[s, key] += 1
    sizes = {}
    for s, n, _, _ in items:
        sizes[s] = sizes.get(s, 0) + n
    want, plans = targets(sizes), []
    for sid, s in enumerate(want):
        mine = [(chain([*key, c, seed]), key, c, n) for t, n, key, c in items if t == s]
        blocks = -(-len(mine) // block_rows)
        passes = min(3, int(want[s] // sizes[s])) if sizes[s] else 0
        rest = want[s] - passes * sizes[s] if passes < 3 and sizes[s] else 0.0
        at = lambda h, blocks=blocks: permuted(h % blocks, blocks, seed)
        words = collections.Counter()
        for h, _, _, n in mine:
            words[at(h)] += n
        begin, cut = 0, -1
        base = 0
        for a in sorted(words):
            if base < rest:
                cut, begin = a, base
            base += words[a]
        plans.append((s, sid, mine, blocks, passes, rest, at, cut, begin, passes * blocks + cut + 1))
    quotas, first = collections.Counter(), {}
    for p in plans:
        first[p[1]] = quotas[p[1] % bundles]
        quotas[p[1] % bundles] += p[9]
    order = sorted(quotas)
    parts = mixing.split([quotas[b] for b in order], shards, seed)
    out = []
    for s, sid, mine, blocks, passes, rest, at, cut, begin, _ in plans:
        total = quotas[sid % bundles]
        upto = [sum(p[order.index(sid % bundles)] for p in parts[: j + 1]) for j in range(shards)]
        ahead = begin
        for h, key, _, n in sorted(mine, key=lambda m: (m[0], [(x is not None, x) for x in m[1]], m[2])):
            extra = at(h) < cut
            if at(h) == cut:
                extra = 2 * ahead + n <= 2 * rest
                ahead += n
            times = passes + (1 if extra else 0)
            where = [permuted(first[sid] + t * blocks + at(h), total, seed + 1) for t in range(times)]
            out.append((key, n, sizes[s], round(want[s], 6), [sum(u <= w for u in upto) for w in where]))
    return sorted(out, key=repr)


def got(rows, key):
    return sorted(((tuple(r[k] for k in key), r["__size"], r["__source_size"], round(r["__target"], 6), r["__shards"]) for r in rows), key=repr)


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def table(spark, sizes):
    rows = mixing.target_table(spark.createDataFrame(list(sizes.items()), "s string, size long")).collect()
    return {r.s: r.target for r in sorted(rows, key=lambda r: r.sid)}


def test_targets_by_hand(spark):
    assert table(spark, {"a": 60, "b": 60, "c": 60}) == {"a": 30.0, "b": 60.0, "c": 90.0}
    # c would get 50 of 100, but holds 10 words: 30, and 70 is shared 1 to 2
    found = table(spark, {"a": 45, "b": 45, "c": 10})
    assert found["c"] == 30.0 and abs(found["a"] - 70 / 3) < 1e-9 and abs(found["b"] - 140 / 3) < 1e-9
    assert table(spark, {"a": 0, None: 5})["a"] == 0.0
    assert list(table(spark, {None: 1, "b": 1, "a": 1, "é": 1, "Z": 1})) == ["Z", "a", "b", "é", None]
    assert table(spark, {"a": 0}) == {"a": 0.0}
    rng = random.Random(8)
    many = {f"s{i}": rng.choice([1, 3, 10, 1000, 10**6]) for i in range(300)}
    found, want = table(spark, many), targets(many)
    assert list(found) == list(want) and all(abs(found[s] - want[s]) < 1e-6 for s in want)


def test_tree_is_exact():
    rng = random.Random(3)
    for shards in (1, 2, 7, 8):
        quotas = [rng.randint(0, 500) for _ in range(9)]
        parts = mixing.split(quotas, shards, 4)
        assert [sum(p[i] for p in parts) for i in range(9)] == quotas
        assert max(map(sum, parts)) - min(map(sum, parts)) <= 3
        assert parts == mixing.split(quotas, shards, 4)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    run = lambda d: mixing.draws(d, mixing.words_in(F.col("text")), ["doc_id"], block_rows=3).collect()
    rows = run(docs)
    assert all(r["__size"] == count(r.text) for r in rows)
    assert got(rows, ["doc_id"]) == plain([(r.source, count(r.text), (r.doc_id,)) for r in docs.collect()], 3)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(len(r["__shards"]) * r["__size"] for r in own) - own[0]["__target"]) <= max(r["__size"] for r in own) / 2 + 1
    assert {x for r in rows for x in r["__shards"]} == set(range(8))
    assert got(run(docs.repartition(7)), ["doc_id"]) == got(rows, ["doc_id"])


def test_query_against_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = plain([(r.source, count(r.text), (r.doc_id, chain([r.text]))) for r in docs], mixing.BLOCK_ROWS)
    want = sorted((k[0], n, total, t, n * len(at), ",".join(map(str, at))) for k, n, total, t, at in want)
    found = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.shards) for r in queries.op4_mixing(spark, sf).collect())
    assert found == want


def test_mix_deals_and_shuffles(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 2000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix(docs, mixing.words_in(F.col("text")), block_rows=3)
    assert out.columns == [*docs.columns, "__shard", "__order"]
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    # partitions in order give the shards in order, and each shard in its own order
    assert [(r["__shard"], r["__order"]) for r in rows] == sorted((r["__shard"], r["__order"]) for r in rows)
    assert len({r.part for r in rows}) > 8 and all(len({r["__shard"] for r in rows if r.part == p}) == 1 for p in {r.part for r in rows})
    ids = [r.doc_id for r in rows if r["__shard"] == 0]
    assert ids != sorted(ids)
    again = mixing.mix(docs.repartition(5), mixing.words_in(F.col("text")), block_rows=3).collect()
    assert [r.doc_id for r in again] == [r.doc_id for r in rows]


@pytest.mark.parametrize("bundles", [mixing.BUNDLES, 2])
def test_odd_rows(spark, monkeypatch, bundles):
    monkeypatch.setattr(mixing, "BUNDLES", bundles)
    monkeypatch.setattr(mixing, "COPIES", 7)
    monkeypatch.setattr(mixing, "SUPER", 2)
    monkeypatch.setattr(mixing, "SMALL", 3)
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2]) for i in range(200)]
    rows += [(None, "one two", None), (None, "one two", None), (7, None, "only null"), (8, "", ""), (8, "", "")]
    rows += [(999, "long " * 100_000, "long")] + [(5, "same row again", "hot")] * 90
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    out = mixing.draws(docs, mixing.words_in(F.col("text")), ["doc_id", "text"], block_rows=10)
    assert out.columns[:7] == docs.columns
    found = out.collect()
    assert got(found, ["doc_id", "text"]) == plain([(s, count(t), (d, t)) for d, t, s in rows], 10, bundles=bundles)
    mixed = collections.Counter((r.doc_id, r.text, r.source) for r in mixing.mix(docs, mixing.words_in(F.col("text")), block_rows=10).collect())
    assert max(n for (d, _, s), n in mixed.items() if s != "hot") <= 6
    for s in {s for _, _, s in rows}:
        own = [r for r in found if r.source == s]
        taken = sum(count(t) * n for (_, t, u), n in mixed.items() if u == s)
        assert abs(taken - own[0]["__target"]) <= max(r["__size"] for r in own) / 2 + 1
    assert mixing.draws(docs.limit(0), mixing.words_in(F.col("text")), ["doc_id"]).count() == 0
    assert mixing.mix(docs.limit(0), mixing.words_in(F.col("text"))).count() == 0
