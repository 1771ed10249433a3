"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are grouped by the nearest of some pivots, which are vectors of the
table. Summaries hold, for each cell, the distances of the k + 1 members next
to its pivot, and for the queries in it their number, their largest distance
from the pivot and their longest norm. For a query q, a member x of cell c at
distance d from pivot p scores at least q.p - |q|d, so the (k+1)-th largest of
these over all cells is a bound below the query's k-th score (its own row may
be among them). A vector s can matter to the queries of a cell only if
p.s + R|s| reaches the lowest of their bounds, R being the radius of the
queries. Cells are chained by nearness into groups of about ``GROUP`` queries;
a vector is sent to the groups in which some cell needs it, in packed blocks,
and each group is solved block by block in numpy.

How many vectors a group needs is counted first. Where they are many, its
blocks are dealt over several tasks by a hash, each with a copy of the group's
queries, about one for ``TASK_ROWS`` vectors that are needed; the partial
results are ranked again. What is broadcast is bounded: ``PIVOTS`` pivots and
their summaries. Vectors travel in the narrowest type that holds their block.

Scores are exact integers: float64 products while they stay below 2**53, 64-bit
or Python integers otherwise, and the ends of the long range beyond it.

The ``LENGTHS`` most frequent vector lengths each have pivots of their own. If
there are more, all others are solved together, without pivots: queries and
data of one length meet in blocks.

Defined results: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; vectors of different lengths are
compared with those of their length only; equal scores go to the smaller id;
rows that repeat are rows of their own, so a copy of the query's row is a
candidate; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm._common import stage

PIVOTS = 512
GROUP = 4096
#: Groups at most; beyond that they hold more queries each.
GROUPS = 4096
#: Rows of a packed block, and data rows that one task of a group sees, about.
PACK = 4096
TASK_ROWS = 1 << 17
LENGTHS = 16
_EXACT = float(1 << 53)
_LARGEST = np.finfo(np.float64).max


def _clean(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            ok = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
            lengths = np.array(pc.fill_null(pc.list_value_length(vectors), 0))
            flat = pc.list_flatten(vectors)
            values = np.array(pc.fill_null(flat.cast(pa.float64()), float("nan")))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            ends = np.cumsum(lengths)
            ok &= bad[ends] == bad[ends - lengths]
            with np.errstate(invalid="ignore"):
                scaled = np.clip(np.floor(values * scale), -_LARGEST, _LARGEST)
            ids = batch.column("id")
            rows = [(ids[i].as_py(), int(lengths[i]), scaled[ends[i] - lengths[i] : ends[i]].tobytes()) for i in np.flatnonzero(ok)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["id", "length", "v"]
            )

    return run


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, length))
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), length)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b, as int64 or Python integers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [np.array([[int(x) for x in row] for row in m], object) for m in (a, b)]
    return np.maximum(np.minimum(whole[0] @ whole[1].T, 2**63 - 1), -(2**63))


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them."""
    most = np.abs(v).max(initial=0)
    return v.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


_BLOCK = "grp long, task int, kind int, rids binary, ids binary, width int, v binary"


def _block(group: int, task: int, kind: int, rid: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    v = _narrow(v)
    values = [group, task, kind, rid.tobytes(), ids.tobytes(), v.itemsize, np.ascontiguousarray(v).tobytes()]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], ["grp", "task", "kind", "rids", "ids", "width", "v"])


def _opened(width: int, v: bytes, rows: int) -> np.ndarray:
    flat = np.frombuffer(v, {2: np.int16, 4: np.int32, 8: np.float64}[width])
    return flat.reshape(rows, len(flat) // max(1, rows)).astype(np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _assign(pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = pivots.value
        for batch in batches:
            v = _matrix(batch.column("v"), centers.shape[1])
            d = _distances(v, centers)
            cell = d.argmin(axis=1) if len(v) else np.zeros(0, np.int64)
            norm = np.sqrt((v * v).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("rid", "id", "query", "v")], pa.array(cell, pa.int32()), pa.array(d[np.arange(len(v)), cell]), pa.array(norm)],
                ["rid", "id", "query", "v", "cell", "dist", "norm"],
            )

    return run


def _bounds(pivots, near, k: int):
    """Of queries: (cell, bound below the k-th score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, cells, dists = pivots.value, *near.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), centers.shape[1])
            norm = np.sqrt((v * v).sum(1))
            floor = (v @ centers.T)[:, cells] - norm[:, None] * dists
            at = k  # the (k+1)-th largest
            bound = -np.partition(-floor, at, axis=1)[:, at] if floor.shape[1] > at else np.full(len(v), -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("dist"), pa.array(bound)], ["cell", "dist", "bound"])

    return run


def _slack(x):
    """Room for rounding in bounds computed with floating point."""
    return 1e-6 + 1e-9 * np.abs(x)


def _needs(pivots, plan, length: int, batches: Iterator[pa.RecordBatch]):
    """Slices of about PACK rows with their vectors, and by row and group: is it needed there?"""
    centers, (group_of, parts, radius, bound) = pivots.value, plan.value
    groups = int(max((g + n for g, n in zip(group_of, parts, strict=True) if n), default=0))
    for whole in batches:
        for s in range(0, whole.num_rows, PACK):
            batch = whole.slice(s, PACK)
            v = _matrix(batch.column("v"), length)
            norm = np.sqrt((v * v).sum(1))
            most = v @ centers.T + norm[:, None] * radius
            needed = (most + _slack(most) >= bound) & (parts > 0)
            by_group = np.zeros((len(v), groups), bool)
            for c in np.flatnonzero(parts):
                by_group[:, group_of[c] : group_of[c] + parts[c]] |= needed[:, c : c + 1]
            yield batch, v, by_group


def _count(pivots, plan, length: int):
    """(grp, n): how many vectors each group needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, _, by_group in _needs(pivots, plan, length, batches):
            total = total + by_group.sum(axis=0, dtype=np.int64)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["grp", "n"])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of whole numbers."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _send(pivots, plan, tasks, length: int):
    """Packed blocks of the data that each group needs, and of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_of, parts, _, _ = plan.value
        for batch, v, by_group in _needs(pivots, plan, length, batches):
            rid, ids = batch.column("rid").to_numpy(), batch.column("id").to_numpy()
            for g in np.flatnonzero(by_group.any(axis=0)).tolist():
                rows = by_group[:, g]
                task = int(_mixed(rid[:1] + g)[0] % np.uint64(tasks.value[g]))
                yield _block(g, task, 1, rid[rows], ids[rows], v[rows])
            asks = np.flatnonzero(batch.column("query").to_numpy(zero_copy_only=False))
            if len(asks):
                cell = batch.column("cell").to_numpy()[asks]
                own = group_of[cell] + (_mixed(rid[asks]) % parts[cell].astype(np.uint64)).astype(np.int64)
                for g in np.unique(own).tolist():
                    rows = asks[own == g]
                    for t in range(int(tasks.value[g])):
                        yield _block(g, t, 0, rid[rows], ids[rows], v[rows])

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, task, kind, rid, id, v) as blocks, those of a batch that go together in one."""
    for whole in batches:
        keys = np.stack([whole.column(c).to_numpy() for c in ("grp", "task", "kind")], axis=1).astype(np.int64)
        _, place = np.unique(keys, axis=0, return_inverse=True)
        for p in range(int(place.max(initial=-1)) + 1):
            part = whole.take(pa.array(np.flatnonzero(place.reshape(-1) == p)))
            grp, task, kind = (part.column(c)[0].as_py() for c in ("grp", "task", "kind"))
            v = _matrix(part.column("v"), len(part.column("v")[0].as_py()) // 8)
            yield _block(grp, task, kind, part.column("rid").to_numpy(), part.column("id").to_numpy(), v)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best by row: larger score, then smaller id."""
    n = score.shape[1]
    rank = np.empty(n, np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(n)
    if score.dtype != object and n and np.abs(score).max(initial=0) < (1 << 62) // max(n, 1):
        key = score * n + (n - 1 - rank)
        top = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(score), 1))
        order = np.argsort(-np.take_along_axis(key, top, axis=1), axis=1)
        return np.take_along_axis(top, order, axis=1)
    return np.array([sorted(range(n), key=lambda j, i=i: (-int(score[i, j]), rank[j]))[:k] for i in range(len(score))], np.int64)


def _solve(k: int):
    names = ["query_rid", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, found = None, [], []

        def close():
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                # of a query's candidates from several blocks the k best
                order = np.lexsort((columns[2], [-int(x) for x in columns[3]], columns[0]))
                columns = [c[order] for c in columns]
                starts = np.concatenate([[True], columns[0][1:] != columns[0][:-1]])
                nth = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
                return [c[nth < k] for c in columns]
            return None

        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, i=i: batch.column(c)[i].as_py()
                key = (get("grp"), get("task"))
                if key != now:
                    out = close()
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
                    now, asked, found = key, [], []
                rid, ids = np.frombuffer(get("rids"), np.int64), np.frombuffer(get("ids"), np.int64)
                v = _opened(get("width"), get("v"), len(rid))
                if get("kind") == 0:
                    asked.append((rid, ids, v))
                    continue
                if not asked:
                    continue
                if len(asked) > 1:
                    asked = [tuple(np.concatenate(c) for c in zip(*asked, strict=True))]
                qrid, qids, q = asked[0]
                score = _scores(q, v)
                mine = qrid[:, None] == rid
                best = _best(score, ids, k + 1)
                rows = np.repeat(np.arange(len(q)), best.shape[1])
                best = best.reshape(-1)
                keep = ~mine[rows, best]
                rows, best = rows[keep], best[keep]
                found.append((qrid[rows], qids[rows], ids[best], score[rows, best].astype(np.int64)))
                if sum(len(f[0]) for f in found) > 200_000 + 20 * k * len(q):
                    found = [tuple(close())]
        out = close()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return run


def _chain(pivots: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of each cell: cells next to each other
    share a group of about ``size`` queries; a large cell has several alone."""
    n = len(pivots)
    left = np.ones(n, bool)
    at, order = 0, []
    for _ in range(n):
        left[at] = False
        order.append(at)
        if left.any():
            d = _distances(pivots[at : at + 1], pivots)[0]
            at = int(np.where(left, d, np.inf).argmin())
    group_of, parts, group, held = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0
    for c in order:
        if not counts[c]:
            continue
        if counts[c] > size:
            group, held = group + (held > 0), 0
            group_of[c], parts[c] = group, -(-counts[c] // size)
            group += parts[c]
            continue
        if held and held + counts[c] > size:
            group, held = group + 1, 0
        group_of[c], parts[c], held = group, 1, held + counts[c]
    return group_of, parts


def _blocks(vectors: DataFrame, length: int, k: int) -> DataFrame:
    """Blocks of vectors(rid, id, query, v) of one length and of their queries."""
    spark = vectors.sparkSession
    send = spark.sparkContext.broadcast
    total, queries = vectors.agg(F.count("*"), F.count_if("query")).first()
    wanted = max(1, min(PIVOTS, int(total**0.5)))
    drawn = vectors.orderBy(F.xxhash64("rid"), "rid").limit(wanted).select("v").collect()  # at most PIVOTS
    pivots = np.unique(np.stack([np.frombuffer(r["v"], np.float64) for r in drawn]).reshape(len(drawn), length), axis=0)
    sent = send(pivots)
    schema = "rid long, id long, query boolean, v binary, cell int, dist double, norm double"
    cells = stage(vectors.mapInArrow(_assign(sent), schema), "cells")

    nearest = F.row_number().over(Window.partitionBy("cell").orderBy("dist"))
    near = cells.select("cell", "dist").withColumn("nth", nearest).filter(F.col("nth") <= k + 1).collect()  # (k + 1) x PIVOTS
    near = send((np.array([r["cell"] for r in near], np.int64), np.array([r["dist"] for r in near])))
    asks = cells.filter("query").select("cell", "dist", "v").mapInArrow(_bounds(sent, near, k), "cell int, dist double, bound double")
    summary = asks.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.min("bound").alias("bound")).collect()
    counts, radius, bound = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.full(len(pivots), np.inf)
    for r in summary:
        counts[r["cell"]], radius[r["cell"]], bound[r["cell"]] = r["n"], r["radius"], r["bound"]
    bound = bound - np.where(np.isfinite(bound), _slack(bound), 0)
    group_of, parts = _chain(pivots, counts, max(GROUP, -(-queries // GROUPS)))
    plan = send((group_of, parts, radius + _slack(radius), bound))
    needs = cells.mapInArrow(_count(sent, plan, length), "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n"))
    tasks = np.ones(int((group_of + parts).max(initial=0)) + 1, np.int64)
    for r in needs.collect():  # a row by group
        tasks[r["grp"]] = max(1, -(-r["n"] // TASK_ROWS))
    return cells.mapInArrow(_send(sent, plan, send(tasks), length), _BLOCK)


def _rest(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of all rows whose length is in sizes(length, n, asks), without pivots."""
    at = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    rows = table.join(sizes, "length").withColumns({"parts": F.ceil(F.col("asks") / GROUP), "tasks": F.ceil(F.col("n") / TASK_ROWS)})
    grp = (F.col("length").cast("long") * (1 << 32) + F.col("part")).alias("grp")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    data = rows.withColumn("part", up_to("parts")).select(grp, at(F.col("tasks")).alias("task"), F.lit(1).alias("kind"), "rid", "id", "v")
    asks = rows.filter("query").withColumn("part", at(F.col("parts"))).withColumn("task", up_to("tasks")).select(grp, "task", F.lit(0).alias("kind"), "rid", "id", "v")
    return data.unionByName(asks).mapInArrow(_each, _BLOCK)


def top_k(
    embeddings: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows by the inner
    product of floor(scale * x), for rows where ``is_query`` (an expression
    over ``id_col``) holds."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null")
    clean = rows.mapInArrow(_clean(scale), "id long, length int, v binary")
    named = clean.withColumnRenamed("id", id_col)
    marked = named.withColumn("query", F.coalesce(is_query, F.lit(False))).withColumnRenamed(id_col, "id")
    table = stage(marked.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    sizes = stage(table.groupBy("length").agg(F.count("*").alias("n"), F.count_if("query").alias("asks")).filter("asks > 0"), "lengths")
    most = sizes.orderBy(F.desc("n"), "length").limit(LENGTHS)
    blocks = [_blocks(table.filter(F.col("length") == r["length"]).select("rid", "id", "query", "v"), r["length"], k) for r in most.collect()]
    blocks.append(_rest(table, sizes.join(F.broadcast(most.select("length")), "length", "left_anti")))
    found = [
        b.repartition("grp", "task").sortWithinPartitions("grp", "task", "kind").mapInArrow(_solve(k), "query_rid long, query_id long, vec_id long, score long")
        for b in blocks
    ]
    order = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
