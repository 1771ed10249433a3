import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from docweave.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_and_inverse(spark, n):
    df = spark.range(n).select("id", sharding.permute(F.col("id"), n, 7).alias("p"))
    rows = df.withColumn("back", sharding.permute(F.col("p"), n, 7, inverse=True)).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)
    if n >= 64:
        assert sum(r.p == r.id for r in rows) < n / 4


def permuted(x, n, seed=0):
    """The permutation by plain integers."""
    bits = max(2, (n - 1).bit_length())
    low = bits // 2

    def mixed(half, r):
        h = 42
        for v in (half, r, seed):
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        return h

    while True:
        h, l = x >> low, x & ((1 << low) - 1)  # noqa: E741
        for r in range(4):
            if r % 2 == 0:
                h ^= mixed(l, r) & ((1 << (bits - low)) - 1)
            else:
                l ^= mixed(h, r) & ((1 << low) - 1)  # noqa: E741
        x = h << low | l
        if x < n:
            return x


@pytest.mark.parametrize("n", [2, 3, 200, 1025])
def test_against_plain_integers(spark, n):
    sizes = spark.range(n).withColumn("n", F.lit(n).cast("long"))
    rows = sizes.select("id", sharding.permute(F.col("id"), n, 7).alias("p"), sharding.permute_by(F.col("id"), sharding.network(F.col("n")), 7).alias("q")).collect()
    assert all(r.p == r.q == permuted(r.id, n, 7) for r in rows)


def test_query_against_plain_version(spark, sf):
    """Rows of op3: ids ascending, numbered, permuted, dealt by modulo."""
    import zlib

    from docweave.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {}
    for i, r in enumerate(sorted(docs, key=lambda r: r.doc_id)):
        data, at = (r.text or "").encode(), permuted(i, len(docs))
        want[r.doc_id] = (len(data) + 1, zlib.crc32(data), "rows", at % 8, at // 8, None)
    assert {r[0]: tuple(r)[1:] for r in queries.op3_sharding(spark, sf).collect()} == want


def test_rows_law(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    rows = sharding.assign(docs, ["doc_id"], 8).collect()
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs.repartition(5), ["doc_id"], 8).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 8 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    # shard and slot of one row, and the row at a shard and slot, without data
    ids = sorted(r.doc_id for r in rows)
    one = spark.range(len(ids)).select("id", *[c.alias(k) for c, k in zip(sharding.place(F.col("id"), len(ids), 8), ("s", "t"), strict=True)])
    got = one.withColumn("back", sharding.row_at(F.col("s"), F.col("t"), len(ids), 8)).collect()
    assert all(again[ids[r.id]] == (r.s, r.t) and r.back == r.id for r in got)


def test_odd_rows_and_files(spark, tmp_path):
    rows = [(1, "a", 5, "x"), (1, "a", 5, "x"), (None, None, 6, ""), (None, None, 6, ""), (3, "", 7, "y"), (2, "z" * 100_000, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard_no int, slot_no string")
    out = sharding.assign(df, ["doc_id", "text"], 4)
    assert out.columns == [*df.columns, "shard", "slot"]
    got = out.collect()
    assert sorted((r.slot, r.shard) for r in got) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]
    key = lambda t: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in (t[0], t[2])) + (t[1] or "",)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(rows, key=key)
    sharding.write_shards(out, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 6 and back.select("shard").distinct().count() == 4
    assert sharding.assign(df.limit(0), ["doc_id", "text"], 4).count() == 0
