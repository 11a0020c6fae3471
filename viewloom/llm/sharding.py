"""Hilbert-curve sharding: rows that are close in several metadata columns land in the same run of shards.

Numbers are quantised by approximate quantiles, strings by the exact quantiles of their whole values: rows are counted by value, the
values ranked by their order, and a bin begins at the first value that reaches its share of the rows. The bins are the coordinates of a
cell; its place on the Hilbert curve orders the rows, ties go by doc_id and text checksum. The order is cut into `n_shards` runs whose row counts differ by one at most, so
min/max file statistics prune on every one of the columns.

Null coordinates fall in bin 0; null text has size 16 (no bytes) and checksum 0. Rows that are equal in all of
this are interchangeable and get separate slots. Empty tables give empty results. Extra columns are ignored.

The order comes from a range partitioning on (curve index, tie columns), so a cell with a third of all rows is
dealt over many tasks; places follow from one count per task. Nothing is gathered but those counts and at most 2**bits - 1 borders
of each dimension.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from viewloom.llm.common import cut

#: Bits of each coordinate.
BITS = 6


def hilbert_index(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points (rows of non-negative integers below 2**bits), after Skilling (2004)."""
    x = np.array(coords, dtype=np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            flip = (x[i] & level) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where(x[n - 1] & level, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def _hilbert(cells: Column, bits: int) -> Column:
    @F.pandas_udf(LongType())
    def place(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    return place(cells)


def _string_borders(values: DataFrame, name: str, bins: int) -> list[str]:
    """The first values of the bins 1, 2, ... of a string column; fewer than `bins`, as one value never spans two bins."""
    counts = values.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = cut(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33).alias("part")
    sums = ranked.groupBy(part).agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("part", part).withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), "part")
    first = placed.groupBy(F.expr(f"(start + before) * {bins} div total").alias("bin")).agg(F.min("value").alias("value"))
    return sorted((r.value for r in first.where("bin > 0").collect()), key=lambda v: v.encode())


def hilbert_order(rows: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """`rows` with `curve`, the place of the row's cell. Each dimension has `bits` bits; a place has 63 at most."""
    if not 1 <= bits or bits * len(dims) > 63:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits do not fit a place of 63 bits")
    kinds = dict(rows.dtypes)
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [d for d in dims if kinds[d] != "string"]
    found = rows.agg(*(F.percentile_approx(F.col(d).cast("double"), steps, 10_000).alias(d) for d in numbers)).first() if numbers else {}

    def coordinate(d: str) -> Column:
        if d in numbers:
            value, borders = F.col(d).cast("double"), sorted(set(found[d] or []))
            passed = lambda border: border < value
        else:
            value, borders = F.col(d), _string_borders(rows.select(d), d, 1 << bits)
            passed = lambda border: border <= value
        place = F.size(F.filter(F.array(*map(F.lit, borders)), passed)) if borders else F.lit(0)
        return F.when(value.isNull(), F.lit(0)).otherwise(place).cast("int").alias(f"bin_{d}")

    return rows.withColumn("curve", _hilbert(F.struct(*map(coordinate, dims)), bits))


def hilbert_shards(docs: DataFrame, n_shards: int = 40, dims: tuple[str, ...] = ("lang", "source", "size"), bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    lean = docs.select(
        "doc_id",
        *(d for d in dims if d != "size"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    ties = ["curve", "doc_id", "text_crc32", "size"]
    ordered = hilbert_order(cut(lean), list(dims), bits).select(*ties).repartitionByRange(*ties).sortWithinPartitions(*ties)
    ordered = cut(ordered.withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = ordered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + row)
    # Shard s holds the ranks from ceil(s * total / n) on, so the counts differ by one at most.
    placed = placed.withColumn("shard", F.expr(f"cast(rank * {n_shards} div total as int)"))
    first = F.expr(f"(cast(shard as bigint) * total + {n_shards - 1}) div {n_shards}")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_by_curve(docs: DataFrame, path: str, n_files: int = 40, dims: tuple[str, ...] = ("lang", "source", "size"), bits: int = BITS) -> None:
    """The documents themselves, with all their columns, as `n_files` Parquet files along the curve, so that readers prune files by any of the dims.

    The dimension `size` is the text's; columns of `docs` that are called size or curve are written as they are.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size")
    sized = docs.select(F.struct("*").alias("row"), *(size if d == "size" else F.col(d) for d in dims))
    ordered = hilbert_order(sized, list(dims), bits).repartitionByRange(n_files, "curve", "row.doc_id").sortWithinPartitions("curve", "row.doc_id")
    ordered.select("row.*").write.mode("overwrite").parquet(path)
