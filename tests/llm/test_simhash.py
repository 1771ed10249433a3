import random

import numpy as np
import xxhash

from docweave.llm import simhash

SCHEMA = "doc_id long, text string, fp string, key int"


def brute(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def first_of(rows):
    """(id is null, id) of the row that stays of each component."""
    best = {}
    for (d, _), r in zip(rows, grouped(rows), strict=True):
        best[r] = min(best.get(r, (True, 1 << 63)), (d is None, d or 0))
    return sorted(best.values())


def grouped(rows):
    """Of each (id, fingerprint) a number of its component, by looking at all pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def classes(rows):
    """component_id of each (id, fingerprint)."""
    own, ids = grouped(rows), {}
    for (d, _), r in zip(rows, own, strict=True):
        if d is not None:
            ids[r] = min(d, ids.get(r, d))
    return [ids.get(r) for r in own]


def test_any_two_within_four_bits_share_a_key():
    rng = random.Random(1)
    a, b = [], []
    for _ in range(3000):
        x, y = rng.getrandbits(64), 0
        for p in rng.sample(range(64), rng.randint(0, 4)):
            y |= 1 << p
        a.append(x)
        b.append(x ^ y)
    sets = []
    for values in (a, b):
        row, key = simhash.keys_of(np.array(values, np.uint64))
        by = [set() for _ in values]
        for r, k in zip(row.tolist(), key.tolist(), strict=True):
            by[r].add(k)
        sets.append(by)
    assert all(p & q for p, q in zip(*sets, strict=True))
    assert sum(map(len, sets[0])) / len(a) < 40


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    rows = [(r.doc_id, brute(r.text)) for r in docs.collect()]
    want = classes(rows)
    assert got == {d: (f, c) for (d, f), c in zip(rows, want, strict=True)}


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    texts = ["", None, " \n\t", "One two", "one TWO", "one two three four five", "İ É", long, long, "a b c d"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "one two", "x", 2), (3, "One two", "x", 3), (None, "alone in here", "", 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    pairs = [(r[0], brute(r[1])) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((d, f, c) for (d, f), c in zip(pairs, classes(pairs), strict=True)), key=key)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=key) == want
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "key"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == first_of(pairs)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_that_repeat_or_are_large(spark):
    texts = {k: f"{k} tells of {k} and its {k} in many {k} words" for k in ("apple", "river", "stone", "cloud", "metal")}
    top = (1 << 63) - 1
    rows = [(5, "apple"), (5, "river"), (3, "river"), (9, "stone"), (top, "cloud"), (top - 1, "cloud"), (top, "metal"), (-(1 << 63), "stone"), (None, "apple"), (None, "metal")]
    docs = spark.createDataFrame([(d, texts[k], "x", 1) for d, k in rows], SCHEMA)
    pairs = [(d, brute(texts[k])) for d, k in rows]
    assert len({f for _, f in pairs}) == 5 == len(set(grouped(pairs)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((d, f, c) for (d, f), c in zip(pairs, classes(pairs), strict=True)), key=key)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=key) == want
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == first_of(pairs)
    assert sorted(r.text for r in kept) == sorted(texts.values())


def test_hot_bucket_and_long_chain(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        x = rng.choice(sorted(fps)) if rng.random() < 0.5 else base
        for p in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << p
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    chain = [rng.getrandbits(64)]
    for i in range(15):
        chain.append(chain[-1] ^ (0b1111 << (4 * i)))
    values = sorted(fps | set(chain))
    rng.shuffle(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, bucket=40)).collect()}
    assert [roots.get(i, i) for i in range(len(values))] == classes(list(enumerate(values)))
