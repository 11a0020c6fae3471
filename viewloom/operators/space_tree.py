"""The exact nearest neighbours of every row, by a distributed space partition tree.

Distinct vectors are split into leaves of about `leaf_rows` by planes at medians of a sample: a round of splits for all nodes that are
still too large, until none is. A leaf is one row of a table: its vectors, its bounding box and, for each vector, the best it has found.
Every vector is searched in its own leaf, then in the FIRST nearest other leaves, then in all others whose box is not farther
than its k-th best. Leaves meet as blocks: a pair of leaves is one row of a plain join that holds only those vectors of the one that look into the other.
Where boxes prune little (many dimensions), those vectors would be written once for each leaf they look into. A leaf whose vectors look into more than
MANY others on average is therefore read beside each of them (a Cartesian product of leaves, for which a vector is written once), so what is
written grows with the rows; what is compared still grows with the pairs that boxes can't rule out.

Copies of a vector stand as one with its k + 1 smallest ids, so a hot vector makes no pairs. Boxes are broadcast in blocks of BOX_BYTES; one
scan of the leaves for each. Distances are sums of squares in the order of the components; ties go to the lower id.

Null ids and vectors that are null or hold null or non-finite components are left out; so are vectors of another width than most.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import lgamma, log, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewloom.sources.tables import written

#: Sampled vectors of a node, the depth of a node's splits in a round, and how many trees are broadcast at most.
SAMPLE, DEPTH, TREES = 4096, 8, 1024
#: Leaves that a vector looks into before all that are left, and the bytes of boxes in a broadcast.
FIRST, BOX_BYTES = 2, 32 << 20
#: Copies of a vector, on average over its leaf, that are written to look into others; the parts that leaves are read beside in; pairs held in detail at once.
MANY, PARTS, PAIRS = 4, 16, 1 << 16
#: Stands where there is no id.
NONE = -(2**63)
_LEAF = "leaf long, n int, ids binary, vectors binary, near_ids binary, near_dists binary, seen binary, low binary, high binary"


@contextmanager
def _few_rows(spark: SparkSession, most: int = 8):
    """Arrow batches of a few rows for jobs over rows that are whole leaves; put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# --- the tree -----------------------------------------------------------------------------------------------------


def splits(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and border of each inner node of a complete binary tree, by rows of the sample: the widest dimension at its median."""
    dims, borders = np.zeros((1 << depth) - 1, np.int32), np.full((1 << depth) - 1, np.inf)
    groups = {0: x}
    for node in range(len(dims)):
        own = groups.pop(node, x[:0])
        if len(own) < 2:
            continue
        dim = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.sort(own[:, dim])
        border = order[len(order) // 2]
        if border == order[0]:  # so that both sides get something
            above = order[order > border]
            if not len(above):
                continue
            border = above[0]
        dims[node], borders[node] = dim, border
        right = own[:, dim] >= border
        groups[2 * node + 1], groups[2 * node + 2] = own[~right], own[right]
    return dims, borders


def leaf_of(x: np.ndarray, dims: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The leaf, from 0, of each row."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(int(len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[rows, dims[node]] >= borders[node])
    return node - len(dims)


def _placed(points: DataFrame, leaf_rows: int) -> DataFrame:
    """`points` (id, v, ids) with the number of their leaf."""
    spark, placed = points.sparkSession, points.withColumn("leaf", F.lit(1).cast("long"))
    schema = placed.schema
    for turn in range(20):
        large = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows)
        large = written(large, "nodes")
        count = large.count()
        if not count:
            break
        depth = F.least(F.lit(DEPTH), F.ceil(F.log2(F.col("n") / leaf_rows))).cast("int")
        if count > TREES:  # nodes are small by now: each is split by its own rows
            rows = placed.join(large.withColumn("depth", depth).drop("n"), "leaf", "left")

            def split(frame: pd.DataFrame) -> pd.DataFrame:
                d = frame["depth"].iloc[0]
                if not pd.isna(d):
                    x = np.stack(frame["v"].to_numpy())
                    frame = frame.assign(leaf=(frame["leaf"].to_numpy() << (DEPTH + 1)) + (1 << int(d)) + leaf_of(x, *splits(x, int(d))))
                return frame.drop(columns="depth")

            placed = written(rows.groupBy("leaf").applyInPandas(split, schema).select(*schema.names), "placed")
            continue
        share = F.lit(float(SAMPLE)) / F.col("n")
        picked = placed.join(F.broadcast(large.withColumn("depth", depth)), "leaf")
        picked = picked.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 30)) < share * (1 << 30))

        def fitted(frame: pd.DataFrame) -> pd.DataFrame:
            dims, borders = splits(np.stack(frame["v"].to_numpy()), int(frame["depth"].iloc[0]))
            return pd.DataFrame({"leaf": frame["leaf"].iloc[:1], "dims": [dims.tobytes()], "borders": [borders.tobytes()]})

        trees = picked.select("leaf", "v", "depth").groupBy("leaf").applyInPandas(fitted, "leaf long, dims binary, borders binary").collect()
        held = spark.sparkContext.broadcast({t.leaf: (np.frombuffer(t.dims, np.int32), np.frombuffer(t.borders)) for t in trees})

        @F.pandas_udf("long")
        def place(leaf: pd.Series, v: pd.Series) -> pd.Series:
            out = leaf.to_numpy().copy()
            for name in np.unique(out):
                if (tree := held.value.get(int(name))) is not None:
                    at = np.flatnonzero(leaf.to_numpy() == name)
                    # a node's number goes up by a bit beyond the depth, so numbers of nodes and leaves never meet
                    out[at] = (int(name) << (DEPTH + 1)) + len(tree[0]) + 1 + leaf_of(np.stack(v.to_numpy()[at]), *tree)
            return pd.Series(out)

        placed = written(placed.withColumn("leaf", place("leaf", "v")), "placed")
    return placed


# --- the search ---------------------------------------------------------------------------------------------------


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed component by component."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        step = a[:, j, None] - b[None, :, j]
        out += step * step
    return out


def _best(dists: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by distance and id."""
    order = np.lexsort((ids, dists), axis=1)[:, :k]
    return np.take_along_axis(dists, order, 1), np.take_along_axis(ids, order, 1)


def _found(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of `y` for each row of `x`; `ids` are the smallest ids of each vector of `y`, filled up with NONE, which is infinitely far."""
    squares = _squares(x, y)
    if len(y) > k:  # more than k vectors never matter; those equal to the last are kept for their ids
        last = np.partition(squares, k - 1, axis=1)[:, k - 1]
        most = int((squares <= last[:, None]).sum(axis=1).max())
        near = np.argsort(squares, axis=1, kind="stable")[:, :most]
    else:
        near = np.broadcast_to(np.arange(len(y)), squares.shape)
    dists = np.sqrt(np.take_along_axis(squares, near, 1))
    names = ids[near].reshape(len(x), -1)
    dists = np.where(names == NONE, np.inf, np.repeat(dists, ids.shape[1], axis=1))
    return _best(dists, names, k)


def _leaves(placed: DataFrame, k: int, counted: Accumulator | None) -> DataFrame:
    """One row per leaf, searched within itself."""

    def whole(table: pa.Table) -> pa.Table:
        n = table.num_rows
        x = np.asarray(table["v"].combine_chunks().flatten(), float).reshape(n, -1)
        ids = np.full((n, k), NONE, np.int64)
        for r, own in enumerate(table["ids"].to_pylist()):
            ids[r, : len(own)] = own
        dists, near = _found(x, x, ids, k)
        if counted is not None:
            counted.add(n * n)
        blobs = ids, x, near, dists, np.full((n, FIRST), -1, np.int64), x.min(axis=0), x.max(axis=0)
        return pa.table([table["leaf"][:1], pa.array([n], pa.int32()), *(pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs)], names=[c.split()[0] for c in _LEAF.split(", ")])

    return written(placed.select("leaf", "v", "ids").groupBy("leaf").applyInArrow(whole, _LEAF), "leaves")


class _Row:
    """The arrays of a leaf's row."""

    def __init__(self, row: dict, k: int):
        self.leaf, n = row["leaf"], row["n"]
        arrays = {c: np.frombuffer(row[c], np.int64 if c in ("ids", "near_ids", "seen") else float) for c in ("ids", "vectors", "near_ids", "near_dists", "seen") if c in row}
        self.ids, self.x = arrays["ids"].reshape(n, k), arrays["vectors"].reshape(n, -1)
        if "seen" in arrays:
            self.near_ids, self.near_dists, self.seen = arrays["near_ids"].reshape(n, k), arrays["near_dists"].reshape(n, k), arrays["seen"].reshape(n, FIRST)


def _boxes(leaves: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers and corners of leaves, in blocks of bounded size."""
    held, size = [], 0
    for r in leaves.select("leaf", "low", "high").toLocalIterator():
        held.append((r.leaf, np.frombuffer(r.low), np.frombuffer(r.high)))
        size += 2 * len(r.low)
        if size >= BOX_BYTES:
            yield tuple(map(np.array, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(np.array, zip(*held, strict=True)))


def _close(x: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places of the boxes that are near enough to the rows' own box for one of them to look in; only those are held against each row."""
    gap = np.maximum(np.maximum(low - x.max(axis=0), x.min(axis=0) - high), 0)
    return np.flatnonzero((gap * gap).sum(axis=1) <= reach.max() ** 2 * (1 + 1e-9))


def _visits(leaves: DataFrame, k: int, first: bool) -> DataFrame:
    """leaf (to look into), source, rows (of the source that look), vectors; where these would be too many, one row without a leaf and `others`, all leaves to look into."""
    spark, parts = leaves.sparkSession, []
    for block in _boxes(leaves):
        held = spark.sparkContext.broadcast(block)

        def plan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            every, low, high = held.value
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    own = _Row(row, k)
                    close = _close(own.x, own.near_dists[:, -1], low, high)
                    names, away = every[close], np.zeros((len(own.x), len(close)))
                    for j in range(own.x.shape[1]):
                        step = np.maximum(np.maximum(low[None, close, j] - own.x[:, j, None], own.x[:, j, None] - high[None, close, j]), 0)
                        away += step * step
                    # a box as far as the k-th best may hold a lower id at the same distance
                    look = away <= own.near_dists[:, -1:] ** 2 * (1 + 1e-12)
                    look &= (names != own.leaf)[None, :]
                    if first:
                        nearest = np.argsort(np.where(look, away, np.inf), axis=1, kind="stable")[:, :FIRST]
                        some = np.zeros_like(look)
                        np.put_along_axis(some, nearest, True, axis=1)
                        look &= some
                    else:
                        for c in range(FIRST):
                            look &= own.seen[:, c, None] != names[None, :]
                    if not first and look.sum() > MANY * len(own.x):
                        out.append((None, own.leaf, None, None, names[look.any(axis=0)].tolist()))
                        continue
                    for b in np.flatnonzero(look.any(axis=0)):
                        rows = np.flatnonzero(look[:, b]).astype(np.int32)
                        out.append((int(names[b]), own.leaf, rows.tobytes(), own.x[rows].tobytes(), None))
                for at in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 64], strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["leaf", "source", "rows", "looking", "others"])

        lean = leaves.select("leaf", "n", "ids", "vectors", "near_ids", "near_dists", "seen")
        with _few_rows(spark):
            parts.append(written(lean.mapInArrow(plan, "leaf long, source long, rows binary, looking binary, others array<long>"), "visits"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


def _near_pairs(x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `x` and `y` of all pairs whose distance may be at most `reach` (one for each row of `x`): squares by a matrix product, less a bound of its rounding."""
    with np.errstate(over="ignore", invalid="ignore"):  # what overflows is not a number and stays
        mid = x.mean(axis=0)
        a, b = x - mid, y - mid
        p, q = (a * a).sum(axis=1), (b * b).sum(axis=1)
        slack = 8 * (x.shape[1] + 8) * 2.0**-53 * (np.sqrt(p) + np.sqrt(q.max())) ** 2 + 1e-300
        far = np.hstack((-2 * a, np.ones((len(a), 1)))) @ np.hstack((b, q[:, None])).T > (reach**2 * (1 + 1e-9) + slack - p)[:, None]
    return np.divmod(np.flatnonzero(~far), len(y))


class _Beside:
    """A leaf beside which others are read one by one: the k best that its vectors find in them."""

    def __init__(self, leaf: int, x: np.ndarray, known: np.ndarray, seen: np.ndarray, k: int):
        self.leaf, self.x, self.known, self.seen, self.k = leaf, x, known, seen, k
        self.dists, self.ids = np.full((len(x), k), np.inf), np.full((len(x), k), NONE, np.int64)

    def add(self, leaf: int, y: np.ndarray, ids: np.ndarray) -> int:
        """Looks into a leaf; gives the number of pairs."""
        reach = np.minimum(self.known, self.dists[:, -1])
        step = np.maximum(np.maximum(y.min(axis=0) - self.x, self.x - y.max(axis=0)), 0)
        rows = np.flatnonzero(((step * step).sum(axis=1) <= reach**2 * (1 + 1e-9)) & (self.seen != leaf).all(axis=1))
        if not len(rows):
            return 0
        i, j = _near_pairs(self.x[rows], y, reach[rows])
        i = rows[i]
        for at in range(0, len(i), PAIRS):
            self._merge(i[at : at + PAIRS], y, j[at : at + PAIRS], ids)
        return len(rows) * len(y)

    def _merge(self, i: np.ndarray, y: np.ndarray, j: np.ndarray, ids: np.ndarray) -> None:
        squares = np.zeros(len(i))
        with np.errstate(over="ignore"):
            for step in (self.x[i] - y[j]).T:  # in the order of `_squares`
                squares += step * step
        hit, at = np.unique(i, return_inverse=True)
        names = ids[j]
        dists = np.where(names == NONE, np.inf, np.sqrt(squares)[:, None])
        row = np.concatenate((np.repeat(np.arange(len(hit)), self.k), np.repeat(at, names.shape[1])))
        dists, names = np.concatenate((self.dists[hit].ravel(), dists.ravel())), np.concatenate((self.ids[hit].ravel(), names.ravel()))
        order = np.lexsort((names, dists, row))
        best = order[np.searchsorted(row[order], np.arange(len(hit)))[:, None] + np.arange(self.k)]
        self.dists[hit], self.ids[hit] = dists[best], names[best]


def _beside(leaves: DataFrame, visits: DataFrame, k: int, counted: Accumulator | None) -> DataFrame:
    """leaf, other, rows, got_ids, got_dists of the leaves that look into many others, which are read beside them."""
    many = visits.where("leaf is null").select("source", "others")
    own = leaves.select(F.col("leaf").alias("source"), F.col("vectors").alias("looking"), "near_dists", "seen")
    own = written(many.join(own, "source"), "looking")
    every = leaves.select("leaf", "n", "ids", "vectors").coalesce(PARTS)
    pairs = own.join(every.hint("shuffle_replicate_nl"), F.array_contains("others", F.col("leaf"))).drop("others")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            rows = np.arange(len(held.x), dtype=np.int32)
            values = ([held.leaf], pa.int64()), ([None], pa.int64()), *(([a.tobytes()], pa.binary()) for a in (rows, held.ids, held.dists))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], names=["leaf", "other", "rows", "got_ids", "got_dists"])

        held = None
        for batch in batches:
            for r in range(batch.num_rows):
                part = lambda name, kind, batch=batch, r=r: np.frombuffer(batch[name][r].as_buffer(), kind)
                source, other, n = (batch[name][r].as_py() for name in ("source", "leaf", "n"))
                if held is None or held.leaf != source:  # the pairs of a leaf follow each other; were they torn, it would only give more rows
                    if held is not None:
                        yield found()
                    seen = part("seen", np.int64).reshape(-1, FIRST).copy()
                    held = _Beside(source, part("looking", float).reshape(len(seen), -1).copy(), part("near_dists", float).reshape(-1, k)[:, -1].copy(), seen, k)
                compared = held.add(other, part("vectors", float).reshape(n, -1), part("ids", np.int64).reshape(n, k))
                if counted is not None:
                    counted.add(compared)
        if held is not None:
            yield found()

    return written(pairs.mapInArrow(look, "leaf long, other long, rows binary, got_ids binary, got_dists binary"), "beside")


def _round(leaves: DataFrame, k: int, first: bool, counted: Accumulator | None) -> DataFrame:
    """The leaves after their vectors have looked into others."""
    spark, visits = leaves.sparkSession, _visits(leaves, k, first)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                other = _Row(row, k)
                x = np.frombuffer(row["looking"]).reshape(-1, other.x.shape[1])
                dists, ids = _found(x, other.x, other.ids, k)
                if counted is not None:
                    counted.add(len(x) * len(other.x))
                out.append((row["source"], row["leaf"], row["rows"], ids.tobytes(), dists.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], names=["leaf", "other", "rows", "got_ids", "got_dists"])

    def merge(own: pa.Table, got: pa.Table) -> pa.Table:
        leaf = _Row(own.to_pylist()[0], k)
        ids, dists, seen = leaf.near_ids.copy(), leaf.near_dists.copy(), leaf.seen.copy()
        for r in got.to_pylist():
            rows = np.frombuffer(r["rows"], np.int32)
            more_ids, more = np.frombuffer(r["got_ids"], np.int64).reshape(-1, k), np.frombuffer(r["got_dists"]).reshape(-1, k)
            if first:  # with several blocks of boxes there may be more finds than places to note them: those are left, and looked for again
                free = seen[rows] < 0
                noted = free.any(axis=1)
                rows, more_ids, more = rows[noted], more_ids[noted], more[noted]
                seen[rows, free[noted].argmax(axis=1)] = r["other"]
            dists[rows], ids[rows] = _best(np.hstack((dists[rows], more)), np.hstack((ids[rows], more_ids)), k)
        for name, a in (("near_ids", ids), ("near_dists", dists), ("seen", seen)):
            own = own.set_column(own.schema.get_field_index(name), name, pa.array([a.tobytes()], pa.binary()))
        return own

    with _few_rows(spark):
        pairs = visits.where("leaf is not null").drop("others").join(leaves.select("leaf", "n", "ids", "vectors"), "leaf")
        found = written(pairs.mapInArrow(look, "leaf long, other long, rows binary, got_ids binary, got_dists binary"), "found")
        if not visits.where("leaf is null").isEmpty():
            found = found.union(_beside(leaves, visits, k, counted))
        return written(leaves.groupBy("leaf").cogroup(found.groupBy("leaf")).applyInArrow(lambda a, b: merge(a, b) if a.num_rows else a, _LEAF), "leaves")


def all_knn(rows: DataFrame, id_col: str, vec: str, k: int, leaf_rows: int = 1024, counted: Accumulator | None = None) -> DataFrame:
    """query, neighbour, dist, rank of the k nearest other rows (Euclidean, ties by id) of every row. `counted` gets the pairs of vectors that were compared."""
    spark = rows.sparkSession
    lean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id is not null and v is not null")
    lean = lean.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    width = lean.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if width is None or not width.width:
        return spark.createDataFrame([], "query long, neighbour long, dist double, rank int")
    lean = lean.where(F.size("v") == width.width)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = lean.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    points = written(points.select("id", "v", "ids"), "points")
    leaves = _leaves(_placed(points, leaf_rows), k + 1, counted)
    if leaves.count() > 1:
        for first in (True, False):
            leaves = _round(leaves, k + 1, first, counted)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _Row(row, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(own.ids[:, 0]), pa.array(own.near_ids.tolist()), pa.array(own.near_dists.tolist())], names=["id", "ids", "dists"])

    lists = leaves.select("leaf", "n", "ids", "vectors", "near_ids", "near_dists", "seen")
    with _few_rows(spark):
        lists = written(lists.mapInArrow(out, "id long, ids array<long>, dists array<double>"), "lists")
    named = lean.select("id", "v").join(points.select(F.col("id").alias("first"), "v"), "v").select("id", "first")
    near = named.join(lists.withColumnRenamed("id", "first"), "first").select("id", F.arrays_zip("ids", "dists").alias("near"))
    real = lambda e: (e["ids"] != F.col("id")) & (e["dists"] < F.lit(float("inf")))
    near = near.withColumn("near", F.slice(F.filter("near", real), 1, k))
    each = near.select(F.col("id").alias("query"), F.posexplode("near").alias("at", "e"))
    return each.select("query", F.col("e.ids").alias("neighbour"), F.col("e.dists").alias("dist"), (F.col("at") + 1).cast("int").alias("rank"))


# --- entropies ----------------------------------------------------------------------------------------------------


def digamma(n: int) -> float:
    """Of a whole number; an asymptotic series where the sum would be long."""
    if n > 10_000:
        return log(n) - 1 / (2 * n) - 1 / (12 * n**2)
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def neighbour_entropy(rows: DataFrame, id_col: str, vec: str, k: int = 3, leaf_rows: int = 1024) -> DataFrame:
    """`nats`: the Kozachenko-Leonenko entropy by the k-th nearest other row of every row; `n`, the rows."""
    dims = rows.select(F.max(F.size(vec))).first()[0]
    dist = all_knn(rows, id_col, vec, k, leaf_rows).where(F.col("rank") == k).agg(F.avg(F.log(F.col("dist") + F.lit(2.0**-52))).alias("logs"), F.count(F.lit(1)).alias("n"))
    r = dist.first()
    if not r.n:
        return rows.sparkSession.createDataFrame([], "nats double, n long")
    ball = dims / 2 * log(pi) - lgamma(dims / 2 + 1)
    return rows.sparkSession.createDataFrame([(dims * r.logs + ball + digamma(r.n) - digamma(k), r.n)], "nats double, n long")


def neighbour_information(rows: DataFrame, id_col: str, views: list[str], k: int = 3, leaf_rows: int = 1024) -> float:
    """Mutual information of several array columns in nats: the sum of their entropies less that of all together."""
    joint = rows.withColumn("_all", F.concat(*views))
    found = [neighbour_entropy(joint, id_col, v, k, leaf_rows).first() for v in (*views, "_all")]
    if None in found:
        return float("nan")
    return sum(f.nats for f in found[:-1]) - found[-1].nats
