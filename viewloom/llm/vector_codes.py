"""Vector code compression: each part of an integer vector becomes the index of the nearest entry of the part's codebook.

Components are floor(256 * x). A vector is cut into equal parts; a codebook begins with that part of the vectors with the smallest ids, and each of
a few rounds replaces its entries by the rounded-down means of the parts nearest to them. All distances are exact squared integers;
ties go to the lower index.

The nearest entry is found through segment-mean lower bounds: for the blocks of a part, from one block that is the whole part to
blocks of two components, (difference of the sums)^2 / size + (difference of the residual norms)^2 is at most the squared distance. Sums and squares are exact
integers and the bound is lowered by more than its rounding error, so an entry is only dropped if it is farther than one that was measured.
What no level drops gets its exact distance.

Every round is one pass over the table: tasks sum the parts of each entry, and only codebook-sized sums are merged and come to the driver.

Rows whose vector is null or holds null or non-finite components are dropped, as are rows of another width than the most common one (the
wider, if two are). Widths that the number of parts does not divide are filled up with zeros. Rows with a null id are coded but begin no entry;
repeated ids begin in the order of their vectors. With fewer rows than entries the codebooks are that much smaller. Empty tables give empty results.
Extra columns are ignored. Parts whose width times greatest component reaches 2**30 are an error, as their distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import BROADCAST_KEYS, cut, hot_keys, lookup

#: Vectors whose bounds a task holds at once.
ROWS = 2048


def levels(width: int) -> list[int]:
    """Numbers of blocks, coarse to fine: 1, 2, 4, ... while blocks are equal and have two components or more; parts of one component have one block."""
    found = [1]
    while width % (2 * found[-1]) == 0 and width // (2 * found[-1]) >= 2:
        found.append(2 * found[-1])
    return found


def _segments(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and residual norms of the blocks of each row."""
    cut_up = x.reshape(len(x), blocks, -1)
    size, sums = cut_up.shape[2], cut_up.sum(axis=2)
    return sums.astype(float), np.sqrt((size * (cut_up * cut_up).sum(axis=2) - sums * sums) / size)


def _bound(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """At most the squared distance; the last axis of the segments is summed."""
    if single := own[0].shape[-1] == 1:
        own, other = tuple(s[..., 0] for s in own), tuple(s[..., 0] for s in other)
    means, rests = own[0] - other[0], np.abs(own[1] - other[1])
    rests -= 1e-13 * (own[1] + other[1])
    np.maximum(rests, 0.0, out=rests)
    rests *= rests
    means *= means
    means *= (1 - 1e-12) / size
    rests *= 1 - 1e-12
    means += rests
    return means if single else means.sum(axis=-1)


class Codebook:
    """The entries of one part, with what the bounds need of them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [(b, _segments(entries, b)) for b in levels(entries.shape[1])]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of each row, and how many distances were measured."""
        n, width = x.shape
        (_, coarse), *finer = self.levels
        low = _bound(tuple(s[:, None, :] for s in _segments(x, 1)), tuple(s[None, :, :] for s in coarse), width)
        start = low.argmin(axis=1)
        most = ((x - self.entries[start]) ** 2).sum(axis=1)
        row, entry = np.nonzero(low <= most[:, None])
        for blocks, segments in finer:
            own = _segments(x, blocks)
            kept = _bound(tuple(s[row] for s in own), tuple(s[entry] for s in segments), width // blocks) <= most[row]
            row, entry = row[kept], entry[kept]
        distance = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))  # the start entry of a row always stays
        least = np.minimum.reduceat(distance, heads)
        best = np.flatnonzero(distance == least[row])
        _, first = np.unique(row[best], return_index=True)
        return entry[best[first]], least, n + len(row)


def integers(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, width) of floor(256 * x), filled up with zeros. The lists have one length and no null."""
    n = len(column)
    x = np.asarray(column.flatten(), float).reshape(n, -1)
    v = np.floor(256 * x)
    width = -(-x.shape[1] // parts)
    if v.size and np.abs(v).max() * max(width, 1) >= 1 << 30:
        raise OverflowError("components are too large for exact distances in 64 bits")
    out = np.zeros((n, parts * width), np.int64)
    out[:, : x.shape[1]] = v
    return out.reshape(n, parts, width)


def _pieces(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, integers(piece.column(0), parts)


def clean(rows: DataFrame, name: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """v, vec_id, label_key of the rows that are kept. The key of a label is its text after a mark, that of null another mark."""
    lean = rows.select(F.col(vec).cast("array<double>").alias("v"), F.col(name).cast("long").alias("vec_id"), F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null")).alias("label_key"))
    real = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    lean = lean.where(F.col("v").isNotNull() & F.coalesce(real, F.lit(False)))
    width = lean.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return lean.where(F.size("v") == (width.width if width else 0))


def fit(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """(parts, entries, width) integers: the codebooks of clean() rows; None without a row that has an id."""
    spark = rows.sparkSession
    starts = rows.where("vec_id is not null").orderBy("vec_id", "v").select("v").limit(entries).collect()
    if not starts:
        return None
    books = integers(pa.array([r.v for r in starts], pa.list_(pa.float64())), parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = [Codebook(b) for b in held.value]
            total = np.zeros((len(own), *held.value.shape[1:2], held.value.shape[2] + 1), np.int64)
            for _, x in _pieces(batches, parts):
                for p, book in enumerate(own):
                    index, _, _ = book.nearest(x[:, p])
                    order = np.argsort(index, kind="stable")
                    heads = np.flatnonzero(np.concatenate(([True], np.diff(index[order]) != 0)))
                    found = index[order][heads]
                    total[p, found, :-1] += np.add.reduceat(x[order, p], heads)
                    total[p, found, -1] += np.diff(heads, append=len(order))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["at", "s"])

        # sums of all tasks in 38 digits, as 64 bits might not hold them
        found = rows.select("v").mapInArrow(sums, "at int, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        shape = books.shape[0], books.shape[1], books.shape[2] + 1
        total = np.zeros(int(np.prod(shape)), object)
        for r in found:
            total[r.at] = int(r.s)
        total = total.reshape(shape)
        for p, e in zip(*np.nonzero(total[:, :, -1]), strict=True):
            books[p, e] = [int(s) // int(total[p, e, -1]) for s in total[p, e, :-1]]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label_key, code, error of clean() rows."""
    held = rows.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{k:02x}" for k in range(max(256, books.shape[1]))], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in held.value]
        for piece, x in _pieces(batches, len(own)):
            code, error = np.full(len(x), "", object), np.zeros(len(x), np.int64)
            for p, book in enumerate(own):
                index, distance, _ = book.nearest(x[:, p])
                code, error = code + digits[index], error + distance
            yield pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label_key", "code", "error"])

    return rows.select("v", "vec_id", "label_key").mapInArrow(run, "vec_id long, label_key string, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_vectors(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    kept = clean(rows)
    books = fit(kept, parts, entries, rounds)
    if books is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut(encode(kept, books))
    totals = cut(coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("size")))
    sums = totals.drop("size")
    found = coded.join(F.broadcast(sums), "label_key") if totals.count() <= BROADCAST_KEYS else lookup(coded, sums, "label_key", hot_keys(totals.drop("label_error")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(embeddings: str = "embeddings", rounds: int = 2) -> str:
    """DuckDB twin for 64 components, 16 parts and 64 entries."""
    axes = range(1, 5)
    near = """near{k} AS MATERIALIZED (SELECT rn, p.part, min(({d}) * 64 + entry) AS best FROM p JOIN book{k} b ON p.part = b.part GROUP BY 1, 2)"""
    distance = " + ".join(f"(x{i} - y{i}) * (x{i} - y{i})" for i in axes)
    steps = []
    for k in range(rounds):
        means = ", ".join(f"CASE WHEN n > 0 THEN (s{i} - ((s{i} % n) + n) % n) // n ELSE y{i} END AS y{i}" for i in axes)
        sums = ", ".join(f"CAST(sum(x{i}) AS BIGINT) AS s{i}" for i in axes)
        steps.append(near.format(k=k, d=distance))
        steps.append(f"mean{k} AS (SELECT p.part, best % 64 AS entry, count(*) AS n, {sums} FROM p JOIN near{k} USING (rn, part) GROUP BY 1, 2)")
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, {means} FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry)")
    steps.append(near.format(k=rounds, d=distance))
    parts = ", ".join(f"v[4 * part + {i}] AS x{i}" for i in axes)
    values = ", ".join(f"y{i}" for i in axes)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM {embeddings} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rn, part, {parts} FROM kept, (SELECT unnest(range(16)) AS part)),
book0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, {", ".join(f"x{i} AS y{i}" for i in axes)} FROM p WHERE rn <= 64),
{", ".join(steps)},
coded AS (SELECT rn, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM near{rounds} GROUP BY 1),
hash AS (SELECT sha256(string_agg(concat_ws(',', {values}), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rn), hash"""
