"""Near duplicates by the similarity of their word shingles.

Two texts are linked if the Jaccard similarity of their sets of ``SHINGLE``-word
shingles is ``SIMILAR`` or more. Candidates are the links of the SimHash search
(simhash.py: exact up to 4 bits, by Golay-code keys) over fingerprints of those
shingles. Texts at 0.8 differ in about 10 of 64 bits, which no exact search
over bits reaches at a bearable number of keys, so MinHash completes the
candidates: ``BANDS`` bands of ``ROWS`` minima. A pair at similarity s shares
no band with probability (1 - s^4)^20, 3e-5 at 0.8. Of texts that share a band
those are candidates whose minima, two bits kept of each, agree in ``ROUGH``
or more of all places (4.5 standard deviations below 0.85, which is what 0.8
comes to with two bits). Every link is then verified on the whole
sets of shingles, so no text goes that is not linked.

Texts of the same words are one node. A candidate component is dealt out once,
a large one as pairs of chunks; a task emits the edges of a spanning forest of
its links, never all pairs. Components of all these edges are those of all links.

Defined results: null text counts as empty; texts without words are copies of
each other; texts of fewer than ``SHINGLE`` words have one shingle of what
there is. Of each component the row with the smallest id stays; rows without
an id come last, and ties go by the hash of the text. Of rows that repeat id
and text one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._common import lean, ragged, sent_if_few, slices, stage
from docweave.llm.simhash import components, keep_first, links, majority, shingle_hashes, split_words, text_hash

SHINGLE = 5
#: SIMILAR as a fraction of whole numbers, for an exact comparison.
SIMILAR = (4, 5)
BANDS, ROWS = 20, 4
ROUGH = 54
#: Rows of a band's bucket that are compared; a larger bucket is one candidate group.
BUCKET = 4096
#: Shingles of a chunk of a candidate component: the first few chunks, all others.
CHUNK, MORE = 16_384, 2_097_152
_random = np.random.default_rng(42)
_FLIP = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_TIMES = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(words, SHINGLE, 0))


def minima(grams: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(grams), 4096):
        np.minimum(least, ((grams[i : i + 4096] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> bytes:
    """Two bits of each minimum, four to a byte."""
    pairs = (least >> np.uint64(20)).astype(np.uint8).reshape(-1, 4) & 3
    return (pairs << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def agreeing(m: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many places the rows of m agree with one."""
    other = m ^ one
    return BANDS * ROWS - np.bitwise_count((other | other >> 1) & 0x55).sum(axis=1, dtype=np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            node, size, fp, bands, minis = [], [], [], [], []
            for text in part.column("text").to_pylist():
                words = split_words(text)
                grams = shingles(words)
                least = minima(grams)
                node.append(xxhash.xxh64_intdigest(b" ".join(words)))
                size.append(len(grams))
                fp.append(majority(grams))
                rows = least.reshape(BANDS, ROWS)
                bands.append([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)] if words else [])
                minis.append(packed(least))
            longs = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            offsets = np.cumsum([0, *map(len, bands)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("d"), part.column("th"), longs(node), pa.array(size, pa.int64()), longs(fp),
                 pa.ListArray.from_arrays(pa.array(offsets), longs([x for b in bands for x in b])), pa.array(minis, pa.binary())],
                ["d", "th", "node", "size", "fp", "bands", "minis"],
            )


def _forest(n: int, near) -> list[tuple[int, int]]:
    """Edges that connect what is linked among n members; near(i, those) tells
    which of those members are linked to i."""
    out, left = [], np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            linked = near(at, left)
            found, left = left[linked].tolist(), left[~linked]
            queue.extend(found)
            out.extend((at, f) for f in found)
    return out


def _rough(nodes: list[int], minis: list[bytes]) -> list[tuple[int, int]]:
    if len(nodes) > BUCKET:
        return [(nodes[0], x) for x in nodes[1:]]
    m = np.frombuffer(b"".join(minis), np.uint8).reshape(len(nodes), -1)
    return [(nodes[i], nodes[j]) for i, j in _forest(len(nodes), lambda i, those: agreeing(m[those], m[i]) >= ROUGH)]


def _exact(nodes: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
    sizes = np.fromiter(map(len, sets), np.int64, len(sets)) // 8
    _, ids = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(len(ids) + 1, bool)
    over, under = SIMILAR

    def near(i: int, those: np.ndarray) -> np.ndarray:
        own = ids[ends[i] - sizes[i] : ends[i]]
        linked = np.minimum(sizes[those], sizes[i]) * under >= np.maximum(sizes[those], sizes[i]) * over
        close = those[linked]
        if len(close):
            mark[own] = True
            hits = mark[ids[ragged(ends[close] - sizes[close], sizes[close])]]
            mark[own] = False
            both = np.add.reduceat(hits, np.cumsum(sizes[close]) - sizes[close], dtype=np.int64)
            linked[linked] = both * under >= (sizes[close] + sizes[i] - both) * over
        return linked

    return [(nodes[i], nodes[j]) for i, j in _forest(len(nodes), near)]


def _connect(column: str, edges_of):
    """Edges of each bucket of rows sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, values = None, [], []
        pairs: list[tuple[int, int]] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            key, node, value = batch.column("bucket").to_numpy(), batch.column("node").to_numpy(), batch.column(column)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
                if now is None or key[s] != now:
                    if len(nodes) > 1:
                        pairs.extend(edges_of(nodes, values))
                    now, nodes, values = key[s], [], []
                nodes.extend(node[s:e].tolist())
                values.extend(value.slice(s, e - s).to_pylist())
            if len(pairs) > 50_000:
                yield made()
                pairs = []
        if len(nodes) > 1:
            pairs.extend(edges_of(nodes, values))
        yield made()

    return lean(run)


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            sets = [shingles(split_words(t)).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("root"), part.column("cuts"), pa.array(sets, pa.binary())], ["node", "root", "cuts", "grams"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("d"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(node, d, th) of every row, and (node, component) of every node; a
    component is named by one of its nodes."""
    rows = _rows(docs, id_col, text_col)
    sketches = stage(rows.mapInArrow(lean(_sketch_batches), "d long, th long, node long, size long, fp long, bands array<long>, minis binary"), "sketches")
    first = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "th")).alias("row")
    nodes = stage(sketches.groupBy("node").agg(first, F.max("size").alias("size"), F.max("fp").alias("fp"), F.max("bands").alias("bands"), F.max("minis").alias("minis")), "nodes")
    banded = nodes.select(F.explode("bands").alias("bucket"), "node", "minis").repartition("bucket").sortWithinPartitions("bucket")
    rough = stage(banded.mapInArrow(_connect("minis", _rough), "a long, b long"), "rough")
    # texts of one fingerprint hang on the least of them, which stands for it in the search over bits
    prints = stage(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    same = nodes.join(prints, "fp").filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    near = links(prints.select("fp", "rep"))
    candidates = components(rough.unionByName(same).unionByName(near).distinct())
    found = candidates.select("node", "root").unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())
    members = stage(nodes.select("node", "size", "row").join(found, "node").select("node", "root", "size", "row.d", "row.th"), "members")

    # the whole shingles of a candidate component; a large one as pairs of chunks
    total = members.groupBy("root").agg(F.sum("size").alias("total"))
    cuts = F.least(F.ceil(F.col("total") / CHUNK), F.ceil(F.col("total") / MORE) + 15)
    plan = members.join(total.select("root", F.greatest(cuts, F.lit(1)).cast("int").alias("cuts")), "root")
    same = lambda x: F.coalesce(x, F.lit(0))
    texts = rows.withColumns({"none": F.col("d").isNull(), "d": same(F.col("d"))})
    wanted = stage(plan.select("node", "root", "cuts", "th", F.col("d").isNull().alias("none"), same(F.col("d")).alias("d")), "wanted")
    wanted = sent_if_few(wanted)
    texts = texts.join(wanted, ["none", "d", "th"]).select("node", "root", "cuts", "text")
    # rows that repeat id and text meet as the same node, which links nothing new
    sets = stage(texts.mapInArrow(lean(_shingle_batches), "node long, root long, cuts int, grams binary"), "shingles")
    chunk = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda j: F.least(j, F.col("chunk")).cast("long") * F.col("cuts") + F.greatest(j, F.col("chunk")),
    )
    grid = sets.withColumn("chunk", chunk).select("root", "node", "grams", F.explode(cells).alias("cell"))
    dealt = grid.select(F.xxhash64("root", "cell").alias("bucket"), "node", "grams").repartition("bucket").sortWithinPartitions("bucket")
    roots = components(stage(dealt.mapInArrow(_connect("grams", _exact), "a long, b long"), "links").distinct())

    component = F.coalesce("root", "node").alias("component")
    of = stage(nodes.select("node").join(roots, "node", "left").select("node", component), "classes")
    return sketches.select("node", "d", "th"), of


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first row of each component (see simhash.keep_first)."""
    return keep_first(docs, *similar(docs, id_col, text_col), "node", id_col, text_col)
