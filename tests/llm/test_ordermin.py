import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from docweave.llm import ordermin, queries

MASK = 2**64 - 1


def long_hash(x, seed):
    return xxhash.xxh64_intdigest((x & MASK).to_bytes(8, "little"), seed)


def int_hash(x, seed):
    return xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed)


def signed(x):
    return x - 2**64 if x >> 63 else x


def tokens_of(text):
    n = ordermin.PIECE
    runs = [r for r in re.split("[ \t\n\x0b\f\r]+", text) if r]
    return [r[i : i + n] for r in runs for i in range(max(1, len(r) - n + 1))]


def brute(text):
    tokens, grams = tokens_of(text), []
    for i in range(max(1, len(tokens) - ordermin.K + 1) if tokens else 0):
        seed = 42
        for t in tokens[i : i + ordermin.K]:
            seed = xxhash.xxh64_intdigest(t.encode(), seed)
        grams.append(seed)
    seen, numbered = {}, []
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
        numbered.append(int_hash(seen[g], long_hash(g, 42)))
    out = []
    for t in range(ordermin.TUPLES) if numbered else ():
        fresh = [int_hash(t, long_hash(h, 42)) for h in numbered]
        a, at_a = min((x >> 32, pos) for pos, x in enumerate(fresh))
        b, at_b = min((x & 0xFFFFFFFF, pos) for pos, x in enumerate(fresh))
        order = 0 if at_a == at_b else 1 if at_a < at_b else 2
        out.append(long_hash(b, long_hash(a, int_hash(order, int_hash(t, 42)))))
    return out


def shown(sig):
    return "".join(f"{h:016x}" for h in sig)


def alike(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def expected(rows):
    """By (id, text), ascending, of distinct rows as the operator orders them."""
    key = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    order = sorted({(d, t or "") for d, t in rows}, key=key)
    out = {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = brute(t), brute(edited), brute(nxt)
        out[d, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), alike(a, b), alike(a, c))
    return out


def compare(spark, rows, schema="doc_id long, text string, n_chars int, fingerprint string"):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got = ordermin.fingerprint_with_edits(docs).collect()
    want = expected(rows)
    flat = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((tuple(r) for r in got), key=flat) == sorted(((d, *want[d, t or ""]) for d, t in rows), key=flat)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    compare(spark, rows)
    got = ordermin.fingerprint_with_edits(spark.createDataFrame(rows, "doc_id long, text string"))
    near = got.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert near[0] > near[1] + 0.05


def test_odd_rows(spark):
    rows = [
        (1, ""), (2, None), (3, "one"), (4, "one two"), (5, "same same same same same"), (5, "same same same same same"), (6, "é\U0001f600 ü  \n x" * 9),
        (None, "no id"), (None, "no id"), (7, "y" * 1000), (8, "a b c d " * 30_000), (5, "other text of five"),
    ]
    compare(spark, rows)
    compare(spark, [(1, "alone in the table")])
    assert ordermin.fingerprint_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def mean_likeness(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, a string, b string")
    signed = ordermin.signatures(rows, ["id"], ["a", "b"])
    return signed.agg(F.avg(ordermin.likeness("a", "b"))).first()[0]


@pytest.mark.parametrize("n", [10, 20, 40, 80, 400])
def test_order_matters(spark, n):
    """Halves swapped: about half the tuples keep their order, whatever the length."""
    swapped, edited = [], []
    for k in range(40):
        w = [f"t{k}w{i}" for i in range(n)]
        swapped.append((" ".join(w), " ".join(w[n // 2 :] + w[: n // 2])))
        edited.append((" ".join(w), " ".join(w[:-1] + ["new"])))
    found = mean_likeness(spark, swapped)
    assert 0.2 < found < 0.6
    assert mean_likeness(spark, edited) > found + 0.1


def test_likeness_falls_with_edit_distance(spark):
    rng, means = random.Random(2), []
    for edits in (0, 2, 8, 32, 128):
        pairs = []
        for k in range(30):
            w = [f"t{k}w{i}" for i in range(200)]
            v = list(w)
            for i in rng.sample(range(200), edits):
                v[i] = f"e{k}{i}"
            pairs.append((" ".join(w), " ".join(v)))
        means.append(mean_likeness(spark, pairs))
    assert means[0] == 1.0 and means == sorted(means, reverse=True) and means[1] > 0.85 and means[4] < 0.1


def test_insertion_in_a_run_without_white_space(spark):
    run = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(3000))
    assert mean_likeness(spark, [(run, "x" + run), ("\U0001f600" * 2 + run, run)]) > 0.9


def test_pieces(spark):
    text = "ab \U0001f600\U0001f601 abcdefghijkl abcdefghijklmn\n"
    df = spark.createDataFrame([(text,)], "t string").select(F.size(ordermin.kmers(F.col("t"))).alias("n"))
    assert df.first().n == 3 + 3 - 1  # three short tokens, three pieces


def test_query(spark, sf):
    found = queries.op6_ordermin(spark, sf)
    assert found.filter("n_chars > 0 and length(fingerprint) = 32 * 16").count() > 150
