"""Near duplicates by SimHash, found with Golay-code fuzzy hashing.

A fingerprint (64 bits) is cut into two halves of 32. Two fingerprints that
differ in at most 4 bits differ in at most 2 bits of one half. Inside that
half three disjoint blocks of 9 bits are looked at; one of them is free of
errors, and the other 23 bits hold at most 2. Those 23 bits are decoded with
the perfect binary Golay code: every codeword within distance 4 gives a key.
For two vectors at distance 2 the vector midway is within 3 of a codeword,
which is then within 4 of both, so they share a key: the candidate search is
exact, not probabilistic. Keys are (half, block, the block's 9 bits, 12-bit
codeword index), about 5 for each of the 6 (half, block) choices.

Fingerprints that share a key are verified by the bits they differ in. A
bucket emits the edges of a spanning forest of its links, never all pairs, so
groups of copies cost no square of their size. A bucket above ``BUCKET`` rows
is cut into chunks, and each pair of chunks becomes its own task. Components
come from alternating large-star and small-star steps on the edges.

The nodes of the search are the distinct fingerprints themselves, and a
component's id is the smallest doc_id over all rows of its fingerprints. So
nothing hangs on doc_id being unique, present or small.

Defined results: null text counts as empty; a text without words has
fingerprint zero; rows that repeat share fingerprint and component; rows that
share an id but not their text belong to components of their own, which may
then have one id; a null id never is a component's id unless all of the
component's ids are null (then the component id is null); an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._common import lean, sent_if_few, slices, stage, unstage

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Rows of one bucket that a task connects at once.
BUCKET = 16_384
#: Generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011

_tables: tuple[np.ndarray, np.ndarray] | None = None


# ---------------------------------------------------------------- fingerprints
def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], length: int, seed: int) -> np.ndarray:
    """Hashes of the shingles of ``length`` words, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[length - 1 :] if len(words) >= length else ends[-1:]
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts.tolist(), last.tolist(), strict=False)
    return np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, len(last))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in over half the hashes; of none, zero."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over the 4-word shingles of a text."""
    return majority(shingle_hashes(split_words(text), SHINGLE, SEED))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            values = [fingerprint(t) for t in part.column("text").to_pylist()]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), fp], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp) of every row; th is a hash of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(_fingerprint_batches), "doc_id long, th long, fp long")


# ------------------------------------------------------------------------ keys
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of the high 12 bits, errors of weight up to 4 by syndrome)."""
    global _tables
    if _tables is None:
        high = np.zeros(4096, np.int64)
        for v in range(4096):
            r = v << 11
            for bit in range(22, 10, -1):
                if r >> bit & 1:
                    r ^= GOLAY << (bit - 11)
            high[v] = r
        by: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(MAX_BITS + 1):
            for places in combinations(range(23), weight):
                e = sum(1 << p for p in places)
                by[high[e >> 11] ^ (e & 2047)].append(e)
        width = max(map(len, by))
        errors = np.full((2048, width), -1, np.int64)
        for s, found in enumerate(by):
            errors[s, : len(found)] = found
        _tables = high, errors
    return _tables


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of uint64 fingerprints."""
    high, errors = _golay()
    rows, keys = [], []
    for half in range(2):
        x = ((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for block in range(3):
            at = 9 * block
            raw = (x >> at) & 511
            rest = (x & ((1 << at) - 1)) | ((x >> (at + 9)) << at)
            e = errors[high[rest >> 11] ^ (rest & 2047)]
            row, col = np.nonzero(e >= 0)
            index = (rest[row] ^ e[row, col]) >> 11
            rows.append(row)
            keys.append(((half * 3 + block) << 21) | (raw[row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            fp = part.column("fp").to_numpy()
            rep = part.column("rep").to_numpy()
            row, key = keys_of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.astype(np.int32)), pa.array(fp[row]), pa.array(rep[row])], ["key", "fp", "rep"]
            )


# ----------------------------------------------------------------------- links
def _forest(fp: np.ndarray, rep: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what is linked in one bucket: breadth first, each
    member looking only at those that nobody reached yet."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= MAX_BITS
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found.tolist())
                out.extend((int(rep[at]), int(r)) for r in rep[found])
    return out


def _edges(pairs: list[tuple[int, int]], hot: list[tuple]) -> pa.RecordBatch:
    a = [max(p) for p in pairs] + [None] * len(hot)
    b = [min(p) for p in pairs] + [None] * len(hot)
    key = [None] * len(pairs) + hot
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], ["a", "b", "hot"])


def _connect(limit: int):
    """Of rows sorted by bucket: edges of each bucket; one with more rows than
    ``limit`` is named in column hot instead, and none of its rows is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, reps, size = None, [], [], 0
        pairs: list[tuple[int, int]] = []
        hot: list[int] = []

        def close():
            if size > limit:
                hot.append(now)
            elif size > 1:
                pairs.extend(_forest(np.concatenate(fps).view(np.uint64), np.concatenate(reps)))

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("bucket").to_numpy()
            fp, rep = batch.column("fp").to_numpy(), batch.column("rep").to_numpy()
            bounds = np.flatnonzero(np.diff(key)) + 1
            starts = np.concatenate([[0], bounds])
            ends = np.concatenate([bounds, [len(key)]])
            # the buckets inside the batch that hold one row link nothing
            several = (ends - starts) > 1
            several[0] = several[-1] = True
            for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                if key[s] != now or now is None:
                    close()
                    now, fps, reps, size = int(key[s]), [], [], 0
                size += e - s
                if size <= limit:
                    fps.append(fp[s:e])
                    reps.append(rep[s:e])
                else:
                    fps, reps = [], []
            if len(pairs) > 50_000:
                yield _edges(pairs, hot)
                pairs, hot = [], []
        close()
        yield _edges(pairs, hot)

    return lean(run)


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b), a > b, that connect the linked rows of nodes(fp, rep)."""
    keys = nodes.select("fp", "rep").mapInArrow(lean(_key_batches), "key int, fp long, rep long")
    dealt = keys.select(F.col("key").cast("long").alias("bucket"), "fp", "rep").repartition("bucket").sortWithinPartitions("bucket")
    found = stage(dealt.mapInArrow(_connect(bucket), "a long, b long, hot long"), "links")
    edges = found.filter("a is not null").select("a", "b")
    hot = found.filter("hot is not null").select(F.col("hot").alias("key"))
    if not hot.isEmpty():
        # chunks of a hot bucket, every two of them a task of its own
        many = stage(keys.join(hot.withColumn("key", F.col("key").cast("int")), "key"), "hot")
        cuts = many.groupBy("key").agg(F.ceil(2 * F.count("*") / F.lit(bucket)).cast("int").alias("cuts"))
        chunk = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
        cells = F.transform(
            F.sequence(F.lit(0), F.col("cuts") - 1),
            lambda j: F.least(j, F.col("chunk")).cast("long") * F.col("cuts") + F.greatest(j, F.col("chunk")),
        )
        grid = (
            many.join(cuts, "key").withColumn("chunk", chunk).select("key", "fp", "rep", F.explode(cells).alias("cell"))
            .select(F.xxhash64("key", "cell").alias("bucket"), "fp", "rep")
        )
        more = grid.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_connect(1 << 40), "a long, b long, hot long")
        edges = edges.unionByName(more.filter("a is not null").select("a", "b"))
    return edges.distinct()


# ------------------------------------------------------------------ components
def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges(a, b) reaches."""

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    seen = mark(now)
    while seen[0]:
        # large star: what is above a node moves to the least that the node knows
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        above = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m")), "least")
        large = stage(now.join(above, "b").select("a", F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        # small star: what is below a node moves to the least below it
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        old, now = now, stage(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        unstage(old, above, large, least)
        was, seen = seen, mark(now)
        if was == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classify(fps: DataFrame) -> DataFrame:
    """(fp, component) of the distinct fingerprints of ``fps``; the component
    is one of its fingerprints."""
    nodes = stage(fps.select("fp").distinct(), "nodes")
    roots = components(links(nodes.select("fp", F.col("fp").alias("rep"))))
    return stage(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("component")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    fps = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = classify(fps)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = classes.join(least, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(classes.join(ids, "component").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def keep_first(docs: DataFrame, rows: DataFrame, classes: DataFrame, node: str, id_col: str, text_col: str) -> DataFrame:
    """Of ``docs``, with rows(<node>, d, th) for their ids and text hashes and
    classes(<node>, component): each component's first row, by id, null ids
    last, then by text hash. Of rows that repeat both, one stays."""
    counted = rows.groupBy(node, "d", "th").agg(F.count("*").alias("copies")).join(classes, node)
    place = F.struct(F.col("d").isNull().alias("none"), "d", "th")
    counted = stage(counted.select("component", place.alias("place"), "copies"), "counted")
    first = counted.groupBy("component").agg(F.min("place").alias("place")).withColumn("first", F.lit(True))
    judged = stage(counted.join(first, ["component", "place"], "left").select("place.*", "copies", "first"), "judged")

    def met(s: DataFrame, how: str) -> DataFrame:
        s = s.select(F.col("d").alias("__d"), F.col("th").alias("__th"))
        return docs.withColumn("__row", text_hash(text_col)).join(
            sent_if_few(s), F.col(id_col).cast("long").eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__th")), how
        )

    # what goes is mostly less than what stays
    goes, repeated = judged.filter("first is null"), judged.filter("first and copies > 1")
    if repeated.isEmpty():
        return met(goes, "left_anti").select(*docs.columns)
    once = met(goes.unionByName(repeated), "left_anti")
    return once.unionByName(met(repeated, "left_semi").dropDuplicates([id_col, "__row"])).select(*docs.columns)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first row of each component: by id, null ids last,
    then by a hash of the text. Of rows that repeat both, one stays."""
    fps = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    rows = fps.select("fp", F.col("doc_id").alias("d"), "th")
    return keep_first(docs, rows, classify(fps), "fp", id_col, text_col)
