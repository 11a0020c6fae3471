"""Nearest neighbours and forecasts from neighbours.

Queries are a stated set; candidates are all rows. The query vectors go to the rows by a join on a block number, so each block of queries meets
all rows once and only the best k per query and task survive before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.operators.space_tree import leaf_of, splits
from viewloom.sources.tables import written

#: Query vectors per broadcast block.
BLOCK = 2000
#: Vectors that a task aligns queries with at a time, those of a leaf; queries and pairs that are held in detail at a time.
CHUNK, LEAF, ROWS, PAIRS = 1 << 16, 64, 1 << 13, 1 << 16
#: Leaves of a chunk that a query without a limit looks into, step by step.
NEAR = 4, 32, 128


def knn(rows: DataFrame, queries: DataFrame, id_col: str, vec: str, k: int, exclude_self: bool = True) -> DataFrame:
    """query, neighbour, dist, rank of the k nearest rows (Euclidean, ties by id) of each query row."""
    spark = rows.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("q"), F.col(vec).cast("array<double>").alias("v")).orderBy("q")
    held: list[tuple[int, list[float]]] = []
    parts: list[DataFrame] = []

    def scan(block: list[tuple[int, list[float]]]) -> DataFrame:
        data = spark.sparkContext.broadcast((np.array([q for q, _ in block]), np.array([v for _, v in block])))

        def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, points = data.value
            dist = np.full((len(ids), 0), np.inf)
            near = np.zeros((len(ids), 0), np.int64)
            step = max(1, (1 << 22) // max(1, points.size))
            for frame in frames:
                own = frame["id"].to_numpy()
                x = np.stack(frame["v"].to_numpy()) if len(frame) else np.zeros((0, points.shape[1]))
                for at in range(0, len(x), step):
                    d = np.sqrt(((points[:, None, :] - x[None, at : at + step]) ** 2).sum(axis=2))
                    if exclude_self:
                        d[ids[:, None] == own[None, at : at + step]] = np.inf
                    dist = np.concatenate((dist, d), axis=1)
                    near = np.concatenate((near, np.broadcast_to(own[at : at + step], d.shape)), axis=1)
                    order = np.lexsort((near, dist), axis=1)[:, :k]
                    dist, near = np.take_along_axis(dist, order, 1), np.take_along_axis(near, order, 1)
            real = np.isfinite(dist)
            yield pd.DataFrame({"query": np.repeat(ids, real.sum(axis=1)), "neighbour": near[real], "dist": dist[real]})

        lean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
        return lean.mapInPandas(best, "query long, neighbour long, dist double")

    for row in asked.toLocalIterator():
        held.append((row["q"], row["v"]))
        if len(held) == BLOCK:
            parts.append(scan(held))
            held = []
    if held:
        parts.append(scan(held))
    if not parts:
        return spark.createDataFrame([], "query long, neighbour long, dist double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query").orderBy("dist", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dtw(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of aligning each row of a with each row of b from end to end: sums of absolute differences, steps of (1, 0), (0, 1) or (1, 1)."""
    shape = (len(a), len(b))
    last = np.full((b.shape[1] + 1, *shape), np.inf)
    last[0] = 0
    for i in range(a.shape[1]):
        row = np.full_like(last, np.inf)
        for j in range(b.shape[1]):
            row[j + 1] = np.minimum(np.minimum(last[j], last[j + 1]), row[j]) + np.abs(a[:, i, None] - b[None, :, j])
        last = row
    return last[-1]


def _end_features(x: np.ndarray) -> np.ndarray:
    """First and last sample, greatest and least of the samples between, greatest and least of all: what bounds of alignments need."""
    inner = x[:, 1:-1] if x.shape[1] > 2 else x
    return np.stack((x[:, 0], x[:, -1], inner.max(axis=1), inner.min(axis=1), x.max(axis=1), x.min(axis=1)), axis=1)


def dtw_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least costs of aligning each row of `a` with any row whose features lie in a box (rows of `low` and `high`).

    Both ends are cells of the path of their own. A sample between them meets something in the other's range, so it costs at least what it sticks out.
    """
    own, zero = _end_features(a), np.float64(0)
    out = np.zeros((len(a), len(low)))
    for c in (0, 1) if a.shape[1] > 1 else (0,):
        out += np.maximum(np.maximum(low[None, :, c] - own[:, c, None], own[:, c, None] - high[None, :, c]), zero)
    if a.shape[1] < 3:
        return out
    above, below = np.zeros_like(out), np.zeros_like(out)
    for i in range(1, a.shape[1] - 1):
        above += np.maximum(a[:, i, None] - high[None, :, 4], zero)
        below += np.maximum(low[None, :, 5] - a[:, i, None], zero)
    above = np.maximum(above, low[None, :, 2] - own[:, 4, None])
    below = np.maximum(below, own[:, 5, None] - high[None, :, 3])
    # a cell may stand for both only if the ranges meet
    meet = (high[None, :, 4] >= own[:, 5, None]) & (low[None, :, 5] <= own[:, 4, None])
    return out + np.where(meet, above + below, np.maximum(above, below))


def dtw_pairs(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and costs of those pairs (columns of `a` and `b`) that align at no more than `most`; others are dropped as soon as they cost more."""
    left = np.arange(a.shape[1])
    last = np.full((len(b) + 1, a.shape[1]), np.inf)
    last[0] = 0
    for i in range(len(a)):
        row = np.empty_like(last)
        row[0] = np.inf
        for j in range(len(b)):
            step = np.minimum(last[j], last[j + 1])
            np.minimum(step, row[j], out=step)
            np.abs(np.subtract(a[i], b[j], out=row[j + 1]), out=row[j + 1])
            row[j + 1] += step
        last = row
        if i % 2 == 0 and i + 1 < len(a):
            alive = np.flatnonzero(last[1:].min(axis=0) + np.abs(a[-1] - b[-1]) <= most * (1 + 1e-9))
            if len(alive) < 0.8 * len(left):
                a, b, most, last, left = a[:, alive], b[:, alive], most[alive], last[:, alive], left[alive]
    within = last[-1] <= most
    return left[within], last[-1][within]


def _corner(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """Least costs of a path from the first cell up to where it leaves the first m rows and columns."""
    last: list[np.ndarray] = []
    leave = None
    for i in range(m):
        row: list[np.ndarray] = []
        for j in range(m):
            cell = a[i] - b[j]
            np.abs(cell, out=cell)
            if i and j:
                step = np.minimum(last[j - 1], last[j])
                np.minimum(step, row[j - 1], out=step)
                cell += step
            elif i or j:
                cell += row[j - 1] if j else last[0]
            row.append(cell)
            if i == m - 1 or j == m - 1:
                leave = cell if leave is None else np.minimum(leave, cell)
        last = row
    return leave


def dtw_floor(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """Least costs of aligning `a` with `b` (samples along the first axis, the others broadcast), from m samples of each end, 2 m at most being there.

    The first and the last m rows and columns share no cell. A sample between them has a cell beyond both, which costs at least what it sticks out of
    the other's range; if two such samples share a cell, the ranges' gap is counted once too often.
    """
    out = _corner(a, b, m)
    out += _corner(a[::-1], b[::-1], m)
    if len(a) == 2 * m:
        return out
    inner, zero = slice(m, len(a) - m), out.dtype.type(0)
    top, bottom, others_top, others_bottom = a.max(axis=0), a.min(axis=0), b.max(axis=0), b.min(axis=0)
    above = np.maximum(np.maximum(a[inner].max(axis=0) - others_top, b[inner].max(axis=0) - top), zero)
    below = np.maximum(np.maximum(others_bottom - a[inner].min(axis=0), bottom - b[inner].min(axis=0)), zero)
    out += above
    out += below
    out -= np.maximum(np.maximum(bottom - others_top, others_bottom - top), zero)
    return out


def _upwards(limit: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Limits for bounds in single precision of samples up to `size`: with all that rounding may add to a bound; none where sums may overflow."""
    with np.errstate(over="ignore"):
        up = np.nextafter((limit * (1 + 1e-6 * width) + 1e-6 * width * size + 1e-42).astype(np.float32), np.float32(np.inf))
    return np.where(size < 1e37, up, np.float32(np.inf))


def _ranges(x: np.ndarray) -> np.ndarray:
    """Greatest and negated least of the samples but two at each end, and of all."""
    inner = x[2:-2] if len(x) > 4 else x
    return np.stack((inner.max(axis=0), -inner.min(axis=0), x.max(axis=0), -x.min(axis=0)))


class _Chunk:
    """Vectors in leaves by ends and ranges."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, other: np.ndarray):
        features = _end_features(x)
        leaf = leaf_of(features, *splits(features[:, :4], max(0, int(np.ceil(np.log2(len(x) / LEAF))))))
        order = np.argsort(leaf, kind="stable")
        self.starts = np.flatnonzero(np.r_[True, np.diff(leaf[order]) > 0])
        self.ends = np.r_[self.starts[1:], len(x)]
        self.low, self.high = np.minimum.reduceat(features[order], self.starts), np.maximum.reduceat(features[order], self.starts)
        self.columns, self.ids, self.other = np.ascontiguousarray(x[order].T), ids[order], other[order]
        self.single = self.columns.astype(np.float32)
        self.ranges = _ranges(self.single)
        self.corners = self.single[[0, 1, 0, 1, -1, -2, -1, -2]] if len(self.single) > 3 else self.single
        self.size = np.abs(self.columns).max(axis=0)
        self.leaf_size = np.maximum.reduceat(self.size, self.starts)


class _Nearest:
    """The k best of each query so far, over chunks of vectors (`ids`: least id, its group, the vector's hash, 1 where no other group has it; `other`: the least id of another group).

    `limit`: costs above these don't matter. Three bounds stand before an alignment: of boxes, of two samples at each end and of four.
    """

    def __init__(self, points: np.ndarray, groups: np.ndarray, k: int, limit: np.ndarray | None = None):
        self.points, self.groups, self.k = np.ascontiguousarray(points.T), groups, k
        with np.errstate(over="ignore"):
            self.single = self.points.astype(np.float32)
        self.ranges, self.size = _ranges(self.single), np.abs(self.points).max(axis=0)
        self.greatest, self.least = self.points.max(axis=0), self.points.min(axis=0)
        self.corners = self.single[[0, 0, 1, 1, -1, -1, -2, -2]] if len(self.points) > 3 else self.single
        self.cost, self.near = np.full((len(points), k), np.inf), np.zeros((len(points), k, 3), np.int64)
        self.limit = np.full(len(points), np.inf) if limit is None else limit.copy()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.close: list[tuple[np.ndarray, np.ndarray]] = []
        self.found: list[tuple[np.ndarray, ...]] = []
        self.space = np.empty((12, PAIRS), np.float32)

    def add(self, x: np.ndarray, ids: np.ndarray, other: np.ndarray, rows: np.ndarray | None = None, nearest_only: bool = False) -> None:
        """Queries (`rows` of them) without a limit look into a few of the nearest leaves and then into more (NEAR); after that all look into those that are not too far."""
        rows = np.arange(len(self.limit)) if rows is None else rows
        with np.errstate(over="ignore", invalid="ignore"):
            chunk = _Chunk(x, ids, other)
            for at in range(0, len(rows), ROWS):
                self._some(chunk, rows[at : at + ROWS], nearest_only)

    def _some(self, chunk: _Chunk, rows: np.ndarray, nearest_only: bool) -> None:
        # all leaves as one box first
        whole = dtw_bounds(self.points[:, rows].T, chunk.low.min(axis=0, keepdims=True), chunk.high.max(axis=0, keepdims=True))
        rows = rows[whole[:, 0] <= self.limit[rows] * (1 + 1e-9)]
        if not len(rows):
            return
        bounds = np.concatenate([dtw_bounds(self.points[:, rows[at : at + 64]].T, chunk.low, chunk.high) for at in range(0, len(rows), 64)])
        done, free = np.zeros(bounds.shape, bool), np.isinf(self.limit[rows])
        for most in (*NEAR, len(chunk.starts)):
            few = most < len(chunk.starts)
            if few and not free.any() or nearest_only and most > NEAR[-1]:
                continue
            look = (bounds <= self.limit[rows, None] * (1 + 1e-9)) & ~done
            if few:
                look &= free[:, None] & (bounds <= np.partition(bounds, most - 1, axis=1)[:, most - 1 : most])
            done |= look
            for leaf in np.flatnonzero(look.any(axis=0)):
                self._look(chunk, leaf, rows[look[:, leaf]])
            self._bound(chunk)
            self._align(chunk)
            self._merge()

    def _look(self, chunk: _Chunk, leaf: int, rows: np.ndarray) -> None:
        """Pairs of a leaf's vectors with queries that two samples of each end and the ranges leave."""
        start, n = chunk.starts[leaf], chunk.ends[leaf] - chunk.starts[leaf]
        for first in range(start, start + n, PAIRS):
            columns = slice(first, min(first + PAIRS, start + n))
            wide = columns.stop - columns.start
            step = PAIRS // wide
            for at in range(0, len(rows), step):
                q = rows[at : at + step]
                column, own = self._like(chunk, leaf, q, columns)
                if len(own):
                    self.pairs.append((q[own], column + first))
            if sum(len(q) for q, _ in self.pairs) >= 4 * PAIRS:
                self._bound(chunk)

    def _like(self, chunk: _Chunk, leaf: int, q: np.ndarray, columns: slice) -> tuple[np.ndarray, np.ndarray]:
        width, wide = len(self.points), columns.stop - columns.start
        limit = self.limit[q]
        if width < 4 or np.isinf(limit).all():
            return np.divmod(np.arange(len(q) * wide), len(q))
        # the gap between the ranges, which two samples in a cell count twice, is no more than that
        gap = np.maximum(0, np.maximum(chunk.high[leaf, 5] - self.greatest[q], self.least[q] - chunk.low[leaf, 4]))
        limit = _upwards(limit + gap, self.size[q] + chunk.leaf_size[leaf], width)
        space = self.space[:, : len(q) * wide].reshape(12, wide, len(q))  # queries inside: they are more
        cells, sticks, other = space[:8], space[8:10], space[10:]
        np.subtract(self.corners.take(q, axis=1)[:, None], chunk.corners[:, columns, None], out=cells)
        np.abs(cells, out=cells)
        ends = cells.reshape(2, 4, wide, len(q))
        np.minimum(ends[:, 1], ends[:, 2], out=ends[:, 1])
        np.minimum(ends[:, 1], ends[:, 3], out=ends[:, 1])
        np.add(ends[:, 0], ends[:, 1], out=ends[:, 0])
        out = np.add(cells[0], cells[4], out=cells[0])
        if width > 4:
            ranges = self.ranges.take(q, axis=1)[:, None]
            np.subtract(ranges[:2], chunk.ranges[2:, columns, None], out=sticks)
            np.subtract(chunk.ranges[:2, columns, None], ranges[2:], out=other)
            np.maximum(sticks, other, out=sticks)
            other[0] = 0
            np.maximum(sticks, other[:1], out=sticks)
            out += sticks[0]
            out += sticks[1]
        return np.nonzero(~(out > limit))

    def _bound(self, chunk: _Chunk) -> None:
        """Of these, the pairs that four samples of each end leave."""
        if not self.pairs:
            return
        queries, columns = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        self.pairs, m = [], min(4, len(self.points) // 2)
        for at in range(0, len(queries), PAIRS):
            q, c = queries[at : at + PAIRS], columns[at : at + PAIRS]
            if m > 2:
                limit = _upwards(self.limit[q], self.size[q] + chunk.size[c], len(self.points))
                near = np.flatnonzero(~(dtw_floor(self.single.take(q, axis=1), chunk.single.take(c, axis=1), m) > limit))
                q, c = q[near], c[near]
            real = (chunk.ids[c, 3] == 0) | (chunk.ids[c, 1] != self.groups[q])  # a vector may stand in the query's own group only
            self.close.append((q[real], c[real]))
            if sum(len(q) for q, _ in self.close) >= PAIRS:
                self._align(chunk)

    def _align(self, chunk: _Chunk) -> None:
        if not self.close:
            return
        queries, columns = (np.concatenate(x) for x in zip(*self.close, strict=True))
        self.close = []
        for at in range(0, len(queries), PAIRS):
            q, c = queries[at : at + PAIRS], columns[at : at + PAIRS]
            some, cost = dtw_pairs(self.points.take(q, axis=1), chunk.columns.take(c, axis=1), self.limit[q])
            q, c = q[some], c[some]
            name = np.where(chunk.ids[c, 1] == self.groups[q], chunk.other[c], chunk.ids[c, 0])
            self.found.append((q, cost, name, chunk.ids[c, 0], chunk.ids[c, 2]))
            if sum(len(f[0]) for f in self.found) >= 8 * PAIRS:
                self._merge()

    def _merge(self) -> None:
        if not self.found:
            return
        q, cost, *near = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found = []
        asked = np.unique(q)
        held = np.repeat(asked, self.k), self.cost[asked].ravel(), self.near[asked].reshape(-1, 3)
        q, cost, near = np.r_[held[0], q], np.r_[held[1], cost], np.r_[held[2], np.stack(near, axis=1)]
        best = np.lexsort((near[:, 0], cost, q))
        q = q[best]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = best[place < self.k]
        self.cost[asked], self.near[asked] = cost[best].reshape(-1, self.k), near[best].reshape(-1, self.k, 3)
        self.limit[asked] = np.minimum(self.limit[asked], self.cost[asked, -1])


def _ends(v: Column) -> list[Column]:
    """The first four of `_end_features` as columns."""
    inner = F.when(F.size(v) > 2, F.slice(v, F.lit(2), F.greatest(F.size(v) - 2, F.lit(0)))).otherwise(v)
    return [F.element_at(v, 1), F.element_at(v, -1), F.array_max(inner), F.array_min(inner)]


def _cell(vectors: DataFrame, total: int, most: int = 12) -> Callable[[Column], Column]:
    """The cell of a vector by its ends and ranges: some CHUNK / 16 of `vectors` in each, by splits of a sample of at most 16 * 2^most rows."""
    depth = min(most, max(0, ceil(log2(max(1, total) * 16 / CHUNK))))
    sample = vectors.select(*(c.alias(f"f{i}") for i, c in enumerate(_ends(F.col("v")))), "h").orderBy("h").limit(16 << depth).drop("h")
    tree = vectors.sparkSession.sparkContext.broadcast(splits(np.array(sample.collect(), float).reshape(-1, 4), depth))

    @F.pandas_udf("int")
    def cell(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(leaf_of(np.stack((a, b, c, d), axis=1), *tree.value))

    return lambda v: cell(*_ends(v))


def dtw_nearest(rows: DataFrame, queries: DataFrame, id_col: str, vec: str, group: str, k: int = 1) -> DataFrame:
    """query, neighbour, cost, rank of the k rows of other groups that align best with each query (ties by id); null, unequally long and non-finite vectors go.

    Copies of a vector stand as one with their 2 k least ids, of each group the k least: whatever group a query leaves out, its k least are among them.
    Vectors are dealt out by ends and ranges. Queries go out in blocks of 16 BLOCK, twice: the tasks that hold a query's cell look for k vectors near it,
    then all tasks for those that cost no more than the k-th of these. A task keeps the k best vectors of each query over all its own, so it shuffles queries * k rows at most.
    Alignments whose bound is above the k-th best are not computed.
    """
    spark = rows.sparkSession
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    lean = lambda t: t.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.xxhash64(group).alias("g")).where("id is not null and v is not null and size(v) > 0").where(F.forall("v", number))
    by = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    least = lean(rows).withColumn("nth", by("v", "g")).where(F.col("nth") <= k).withColumn("nth", by("v")).where(F.col("nth") <= 2 * k)
    copies = least.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "g"))).alias("copies"))  # at most 2 k
    first = F.col("copies")[0]
    others = F.filter("copies", lambda c: c["g"] != first["g"])
    vectors = copies.select("v", "copies", first["id"].alias("id"), first["g"].alias("g"), F.xxhash64("v").alias("h"), F.size(others).alias("others"), F.get(others, F.lit(0))["id"].alias("other"))
    vectors = written(vectors, "vectors")
    total = vectors.count()
    parts = max(1, -(-total // CHUNK), min(4 * spark.sparkContext.defaultParallelism, 16 * total // CHUNK))
    cell = _cell(vectors, total)
    dealt = vectors.select("v", "id", "g", "h", (F.col("others") == 0).cast("long").alias("alone"), F.coalesce("other", F.lit(0)).alias("other"), cell(F.col("v")).alias("cell"))
    dealt = dealt.repartitionByRange(parts, "cell", "h").sortWithinPartitions("cell", "h").withColumn("part", F.spark_partition_id())
    dealt, asked = written(dealt, "dealt"), written(lean(queries).withColumn("cell", cell(F.col("v"))), "asked")

    def scan(block: list, home: bool) -> DataFrame:
        width = len(block[0]["v"])
        block = sorted(block, key=lambda r: r["cell"])  # queries that lie close share leaves
        limit = np.array([np.inf if home or r["most"] is None else r["most"] for r in block])
        data = spark.sparkContext.broadcast((*(np.array([r[c] for r in block]) for c in ("id", "v", "g", "cell")), limit))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, points, groups, cells, limit = data.value
            nearest, own = _Nearest(points, groups, k, limit), []

            def add() -> None:
                x, names, other, lies = (np.concatenate(c) for c in zip(*own, strict=True))
                own.clear()
                asking = np.flatnonzero(np.isin(cells, lies)) if home else None
                if asking is None or len(asking):
                    nearest.add(x, names, other, asking, home)

            last = None
            for batch in batches:
                x = np.asarray(batch["v"].flatten()).reshape(-1, width)
                names = np.stack([np.asarray(batch[c]) for c in ("id", "g", "h", "alone")], axis=1)
                other, lies, part = (np.asarray(batch[c]) for c in ("other", "cell", "part"))
                cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
                for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                    if own and (part[start] != last or sum(len(o[0]) for o in own) >= CHUNK):
                        add()
                    last = part[start]
                    own.append((x[start:end], names[start:end], other[start:end], lies[start:end]))
            if own:
                add()
            if home:
                known = np.isfinite(nearest.limit)
                yield pa.RecordBatch.from_pydict({"query": ids[known], "most": nearest.limit[known]})
                return
            real = np.isfinite(nearest.cost)
            near, n = nearest.near[real], real.sum(axis=1)
            yield pa.RecordBatch.from_pydict({"query": np.repeat(ids, n), "g": np.repeat(groups, n), "least": near[:, 0].copy(), "id": near[:, 1].copy(), "h": near[:, 2].copy(), "cost": nearest.cost[real]})

        schema = "query long, most double" if home else "query long, g long, least long, id long, h long, cost double"
        return dealt.where(F.size("v") == width).mapInArrow(best, schema)

    def scans(asked: DataFrame, home: bool) -> DataFrame | None:
        found, held = [], []
        for row in asked.orderBy(F.size("v"), "id").toLocalIterator():
            if held and (len(held) == 16 * BLOCK or len(held[0]["v"]) != len(row["v"])):
                found.append(scan(held, home))
                held = []
            held.append(row)
        if held:
            found.append(scan(held, home))
        return reduce(DataFrame.union, found) if found else None

    near = scans(asked, True)
    if near is None:
        return spark.createDataFrame([], "query long, neighbour long, cost double, rank int")
    limits = near.groupBy(F.col("query").alias("id")).agg(F.min("most").alias("most"))
    found = scans(written(asked.join(limits, "id", "left"), "limited"), False)
    order = lambda *by: F.row_number().over(Window.partitionBy("query").orderBy("cost", *by))
    vectors_of = found.withColumn("nth", order("least")).where(F.col("nth") <= k)
    every = vectors_of.join(vectors.select("id", "h", "copies"), ["id", "h"])
    every = every.select("query", "cost", F.explode(F.filter("copies", lambda c: c["g"] != F.col("g"))["id"]).alias("neighbour"))
    return every.withColumn("rank", order("neighbour")).where(F.col("rank") <= k).select("query", "neighbour", "cost", "rank")


def against_all(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row beside every query row, the queries in blocks of BLOCK that are broadcast. `queries` has `rank` from 0 and other columns than `rows`."""
    blocks = (queries.agg(F.max("rank")).first()[0] or 0) // BLOCK + 1
    found = None
    for k in range(blocks):
        block = queries.where(F.expr(f"rank div {BLOCK} = {k}")).drop("rank")
        part = rows.join(F.broadcast(block), how="cross")
        found = part if found is None else found.union(part)
    return found


def nadaraya_watson(pairs: DataFrame, keys: list[str], target: str, distance2: str, gamma: float) -> DataFrame:
    """Kernel-weighted mean of `target` per key, from rows that carry a squared distance; NaN where all weights are too small for a double."""
    weight = F.exp(-F.lit(gamma) * F.col(distance2))
    total = F.sum(weight)
    mean = F.when(total == 0, F.lit(float("nan"))).otherwise(F.sum(weight * F.col(target)) / total)
    return pairs.groupBy(*keys).agg(mean.alias("forecast"))


def linear_dynamics(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """slope and intercept of y on x per key."""
    return pairs.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))
