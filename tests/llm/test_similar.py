import random

import corpus_pipeline
from docweave.llm import simhash, similar


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def expected(rows):
    """Row numbers that stay, by looking at all pairs of (id, text)."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(root(i), []).append((d is None, d or 0))
    return sorted(min(x) for x in best.values())


def stay(out):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_stage_takes_similarity_not_bits(spark, sf):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = words(rng, rng.choice([30, 120, 400]))
        other = list(base)
        for p in rng.sample(range(len(base) // 12), max(1, len(base) // 12 * (i % 6 + 1) // 10)):
            other[12 * p] = "new"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    far = lambda i: (simhash.fingerprint(rows[2 * i][1]) ^ simhash.fingerprint(rows[2 * i + 1][1])).bit_count() > 4
    want = expected(rows)
    assert any(far(i) and (False, 2 * i + 1) not in want for i in range(60))
    assert stay(corpus_pipeline.drop_near_duplicates(spark, docs, sf)) == want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert stay(similar.drop_similar(docs)) == expected([tuple(r) for r in docs.collect()])


def test_large_group_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 2000)
    rng = random.Random(4)
    base, rows = words(rng, 200), []
    for i in range(150):  # a chain: each a little further from the first
        base = [*base[1:], f"c{i}"] if i % 2 else base
        rows.append((i, " ".join(base)))
    rows += [(None, "no id at all"), (None, "No  id at all"), (500, ""), (501, None), (502, " \n"), (None, rows[3][1])]
    rows += [(7, rows[7][1]), (600, "one id two texts"), (600, "another text of the id"), (601, "one id two texts")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert stay(similar.drop_similar(docs)) == expected(rows)
    assert similar.drop_similar(docs.limit(0)).count() == 0
