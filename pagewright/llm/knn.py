"""Exact k nearest neighbours of a query set by a Voronoi kNN join.

The queries are the vectors whose vec_id is divisible by ``every``; each is asked
against all vectors. Vectors are assigned to their nearest pivot. Each cell's summary
(the k + 1 smallest distances of its members to the pivot) bounds from above the
distance of a query's k-th neighbour, by the triangle inequality. Queries are grouped
by neighbouring cells; from its queries' bounds a group has, for each cell, a range
of distances to the pivot, and only vectors within that range are copied to it. Each
group is then solved on its own, exactly, in blocks. How many vectors a group will
get is counted first; where they are many they are dealt to slabs of about SLAB_ROWS,
so that no task holds more, and the slabs' neighbours are merged.

Distances are Euclidean, in double precision, computed by differences for the
vectors that a bound with slack lets through, so equal vectors tie exactly; ties go
to the lower vec_id. The slack grows with the largest norm, as the error of the fast
distances does.

Defined results: null vectors, vectors with an entry that is null, NaN or beyond
1e150, empty ones, rows with a null vec_id, and vectors of another dimension than the
most common one (the larger, on a tie) are left out; of several rows with one vec_id
the greatest embedding counts; a vector is not its own neighbour. A query has fewer
than k neighbours only if there are no more vectors. Columns besides vec_id and
embedding are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import cut, mix, prepare

K = 10
EVERY = 50
#: More pivots make smaller cells but dearer assignment; their number does not change the result.
MAX_PIVOTS = 2048
GROUP_ROWS = 4096
MAX_GROUPS = 1024
SLAB_ROWS = 50_000
BLOCK_CELLS = 1_000_000
SLACK = 1e-6
SCHEMA = "vec_id long, neighbour_id long, rank int, distance double"


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs, fast; right to about 1e-7 times the largest norm."""
    out = a @ b.T
    out *= -2
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)
    return np.sqrt(np.maximum(out, 0, out=out), out=out)


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            near, far = np.empty(len(x), np.int32), np.empty(len(x))
            for lo in range(0, len(x), 4096):
                d = distances(x[lo : lo + 4096], pivots)
                near[lo : lo + 4096] = d.argmin(1)
                far[lo : lo + 4096] = d.min(1)
            norm = np.sqrt((x * x).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), pa.array(far), pa.array(norm)], ["vec_id", "embedding", "cell", "far", "norm"])

    return run


def _summarise(k: int):
    """(cell, n, norm, nearest): of each cell in this partition the largest norm and the k + 1 smallest distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, norm, near = {}, {}, {}
        for batch in batches:
            cell, far, length = (batch.column(i).to_numpy() for i in range(3))
            for c in np.unique(cell).tolist():
                own = cell == c
                size[c] = size.get(c, 0) + int(own.sum())
                norm[c] = max(norm.get(c, 0.0), float(length[own].max()))
                near[c] = np.sort(np.concatenate([near.get(c, np.zeros(0)), far[own]]))[: k + 1]
        cells = sorted(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int32()), pa.array([size[c] for c in cells], pa.int64()), pa.array([norm[c] for c in cells], pa.float64()), pa.array([near[c].tolist() for c in cells], pa.list_(pa.float64()))],
            ["cell", "n", "norm", "nearest"],
        )

    return run


def bound(to_pivots: np.ndarray, nearest: np.ndarray, k: int) -> np.ndarray:
    """For each query (a row of distances to all pivots) one within which it has k vectors besides itself; nearest[j] has
    cell j's smallest distances to its pivot, filled up with infinity."""
    out = np.empty(len(to_pivots))
    for i, row in enumerate(to_pivots):
        reach = (row[:, None] + nearest).ravel()
        out[i] = np.partition(reach, k)[k] if len(reach) > k else np.inf
    return out


def _groups(between: np.ndarray, size: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each cell: neighbouring cells together, about ``rows`` queries in each group; a
    cell with more has several groups to itself."""
    first, parts, left, now = np.full(len(size), -1), np.ones(len(size), np.int64), set(np.flatnonzero(size).tolist()), 0
    while left:
        at = max(left, key=lambda i: (size[i], -i))
        if size[at] > rows:
            first[at], parts[at] = now, -(-size[at] // rows)
            left.discard(at)
            now += int(parts[at])
            continue
        held = 0
        for i in np.argsort(between[at], kind="stable").tolist():
            if i in left and held + size[i] <= rows:
                first[i] = now
                held += size[i]
                left.discard(i)
        now += 1
    return first, parts


def _ask(pivots: np.ndarray, nearest: np.ndarray, first: np.ndarray, parts: np.ndarray, k: int):
    """(group, least, most): of this partition's queries the ends of the range of each cell, and (group, vec_id, embedding) of each."""

    def group_of(batch: pa.RecordBatch) -> np.ndarray:
        cell = batch.column(2).to_numpy()
        return first[cell] + (mix(batch.column(0).to_numpy().astype(np.uint64)) % parts[cell].astype(np.uint64)).astype(np.int64)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = {}, {}
        for batch in batches:
            group = group_of(batch)
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            for lo in range(0, len(x), 1024):
                d = distances(x[lo : lo + 1024], pivots)
                theta = bound(d, nearest, k)[:, None]
                for g in np.unique(group[lo : lo + 1024]).tolist():
                    own = group[lo : lo + 1024] == g
                    low, high = (d[own] - theta[own]).min(0), (d[own] + theta[own]).max(0)
                    least[g] = np.minimum(least[g], low) if g in least else low
                    most[g] = np.maximum(most[g], high) if g in most else high
        for g in sorted(least):
            cells = len(least[g])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(cells, g, np.int32)), pa.array(np.arange(cells, dtype=np.int32)), pa.array(least[g]), pa.array(most[g])], ["group", "cell", "least", "most"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(group_of(batch).astype(np.int32)), batch.column(0), batch.column(1)], ["group", "vec_id", "embedding"])

    return ranges, grouped


def _useful(least: np.ndarray, most: np.ndarray, slack: float, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    cell, far = batch.column("cell").to_numpy(), batch.column("far").to_numpy()
    for g in range(len(least)):
        take = (far >= least[g, cell] - slack) & (far <= most[g, cell] + slack)
        if take.any():
            yield g, take


def _count(shared, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value[0]), np.int64)
        for batch in batches:
            for g, take in _useful(*shared.value, slack, batch):
                total[g] += int(take.sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["group", "n"])

    return run


def _replicate(shared, slabs: np.ndarray, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = mix(batch.column("vec_id").to_numpy().astype(np.uint64))
            for g, take in _useful(*shared.value, slack, batch):
                own = batch.filter(pa.array(take))
                slab = (home[take] % np.uint64(slabs[g])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, g, np.int32)), pa.array(slab), own.column("vec_id"), own.column("embedding")], ["group", "slab", "vec_id", "embedding"])

    return run


def _spread(slabs: np.ndarray):
    """Each query once for each slab of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(0).to_numpy()
            for s in range(int(slabs[group].max()) if len(group) else 0):
                own = batch.filter(pa.array(slabs[group] > s))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(own.num_rows, s, np.int32)), own.column(1), own.column(2)], ["group", "slab", "vec_id", "embedding"])

    return run


def _solve(k: int, slack: float):
    """The k nearest of the slab's vectors to each query, exact distances."""

    def run(queries: pa.Table, held: pa.Table) -> pa.Table:
        if not queries.num_rows or not held.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "rank": pa.array([], pa.int32()), "distance": pa.array([], pa.float64())})
        asked, wanted = queries.column("vec_id").to_numpy(), _matrix(queries.column("embedding"))
        ids, x = held.column("vec_id").to_numpy(), _matrix(held.column("embedding"))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out: tuple[list, ...] = ([], [], [], [])
        block = max(1, BLOCK_CELLS // len(ids))
        for lo in range(0, len(asked), block):
            d = distances(wanted[lo : lo + block], x)
            at = np.searchsorted(ids, asked[lo : lo + block])
            same = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == asked[lo : lo + block])
            d[np.flatnonzero(same), at[same]] = np.inf
            for i in range(len(d)):
                most = min(k, len(ids) - int(same[i]))
                if not most:
                    continue
                near = np.flatnonzero(d[i] <= np.partition(d[i], most - 1)[most - 1] + slack)
                exact = np.sqrt(((x[near] - wanted[lo + i]) ** 2).sum(1))
                best = np.lexsort((ids[near], exact))[:most]
                out[0].append(np.full(most, asked[lo + i]))
                out[1].append(ids[near][best])
                out[2].append(np.arange(1, most + 1))
                out[3].append(exact[best])
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"vec_id": pa.array(flat[0].astype(np.int64)), "neighbour_id": pa.array(flat[1].astype(np.int64)), "rank": pa.array(flat[2].astype(np.int32)), "distance": pa.array(flat[3].astype(np.float64))})

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, max_pivots: int = MAX_PIVOTS, group_rows: int = GROUP_ROWS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): k rows for each query, a query being a vector whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    prepare(spark)
    whole = F.expr("size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) > 1e150D)")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    own = cut(own.groupBy("vec_id").agg(F.max("embedding").alias("embedding")))
    common = own.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    own, n = own.where(F.size("embedding") == common["size"]), common["count"]
    pivots = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(max_pivots, math.isqrt(n)))).select("embedding").toArrow().column(0)
    pivots = np.unique(_matrix(pivots), axis=0)
    placed = cut(own.mapInArrow(_assign(pivots), "vec_id long, embedding array<double>, cell int, far double, norm double"))
    queries = placed.where(F.col("vec_id") % every == 0)
    parts = placed.select("cell", "far", "norm").mapInArrow(_summarise(k), "cell int, n long, norm double, nearest array<double>")
    summary = parts.groupBy("cell").agg(F.max("norm").alias("norm"), F.slice(F.array_sort(F.flatten(F.collect_list("nearest"))), 1, k + 1).alias("nearest")).collect()
    near = np.full((len(pivots), k + 1), np.inf)
    for r in summary:
        near[r["cell"], : len(r["nearest"])] = r["nearest"]
    slack = SLACK * (1 + max(r["norm"] for r in summary))
    size = np.zeros(len(pivots), np.int64)
    for r in queries.groupBy("cell").count().collect():
        size[r["cell"]] = r["count"]
    if not size.sum():
        return spark.createDataFrame([], SCHEMA)
    between = distances(pivots, pivots)
    first, split = _groups(between, size, max(group_rows, -(-int(size.sum()) // MAX_GROUPS)))
    groups = int((first + split).max())
    ranges, grouped = _ask(pivots, near, first, split, k)
    schema = "vec_id long, embedding array<double>, cell int"
    asked = queries.select(*[c.split()[0] for c in schema.split(", ")])
    ends = asked.mapInArrow(ranges, "group int, cell int, least double, most double").groupBy("group", "cell").agg(F.min("least").alias("least"), F.max("most").alias("most")).toArrow()
    least, most = np.full((groups, len(pivots)), np.inf), np.full((groups, len(pivots)), -np.inf)
    at = ends.column("group").to_numpy(), ends.column("cell").to_numpy()
    least[at], most[at] = ends.column("least").to_numpy(), ends.column("most").to_numpy()
    # Two numbers for each group and pivot: at most MAX_GROUPS and a cell's worth more by MAX_PIVOTS.
    shared = spark.sparkContext.broadcast((least, most))
    slabs = np.ones(groups, np.int64)
    for r in placed.select("cell", "far").mapInArrow(_count(shared, slack), "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect():
        slabs[r["group"]] = -(-r["n"] // slab_rows)
    sent = placed.select("vec_id", "embedding", "cell", "far").mapInArrow(_replicate(shared, slabs, slack), "group int, slab int, vec_id long, embedding array<double>")
    spread = asked.mapInArrow(grouped, "group int, vec_id long, embedding array<double>").mapInArrow(_spread(slabs), "group int, slab int, vec_id long, embedding array<double>")
    found = spread.groupBy("group", "slab").cogroup(sent.groupBy("group", "slab")).applyInArrow(_solve(k, slack), SCHEMA)
    if slabs.max() > 1:
        best = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
        found = found.withColumn("rank", best).where(F.col("rank") <= k)
    return found.withColumn("distance", F.round("distance", 6))


ORACLE = f"""WITH pairs AS (SELECT a.vec_id, b.vec_id AS neighbour_id,
  list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
SELECT vec_id, neighbour_id, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id) AS rank FROM pairs) WHERE rank <= {K}"""
