"""Multi-view rows: splits and concatenations of vectors, missing views, availability masks, subsets, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_vector(v: Column, sizes: list[int]) -> list[Column]:
    """Contiguous views of a vector."""
    found, at = [], 1
    for n in sizes:
        found.append(F.slice(v, at, n))
        at += n
    return found


def block_sizes(width: int, views: int) -> list[int]:
    """Equal blocks; what is left over goes to the first."""
    each = width // views
    return [each + width % views] + [each] * (views - 1)


def concat_views(views: list[Column]) -> Column:
    return F.concat(*views)


def fill_view(v: Column, width: int, fill: float = 0.0) -> Column:
    return F.coalesce(v, F.array_repeat(F.lit(fill), width))


def zero_impute(views: list[Column], widths: list[int], expand: bool = True, no_flag: set[int] = frozenset()) -> Column:
    """All views with zeros for missing ones, then their flags (as wide as the views, or one bit each)."""
    values = [fill_view(v, n) for v, n in zip(views, widths, strict=True)]
    flags = [F.array_repeat(v.isNotNull().cast("double"), n if expand else 1) for i, (v, n) in enumerate(zip(views, widths, strict=True)) if i not in no_flag]
    return F.concat(*values, *flags)


def impute(v: Column, available: Column, sample: Column) -> Column:
    """x b + (1 - b) sample."""
    return F.when(available == 1, v).otherwise(sample)


def subset_masks(views: int, empty: bool = False, full: bool = True) -> list[int]:
    return [m for m in range(1 << views) if (m or empty) and (full or m != (1 << views) - 1)]


def replicate_subsets(rows: DataFrame, views: int, empty: bool = False, full: bool = True) -> DataFrame:
    """Every row once per subset of views (a mask); 2 ** views is a parameter, not data."""
    return rows.withColumn("mask", F.explode(F.array(*map(F.lit, subset_masks(views, empty, full)))))


def complement(mask: Column, views: int) -> Column:
    return mask.bitwiseXOR(F.lit((1 << views) - 1))


def mask_members(mask: Column, views: int) -> Column:
    return F.filter(F.array(*map(F.lit, range(views))), lambda i: F.getbit(mask.cast("long"), i) == 1)


def available(views: list[Column]) -> Column:
    """How many of the views a row has."""
    return sum((v.isNotNull().cast("int") for v in views), F.lit(0))


def mean_code(views: list[Column], width: int) -> Column:
    """The mean of the codes of those views that a row has, entry by entry; null for a row without any."""
    n = available(views)
    entry = lambda i: sum((F.coalesce(F.get(v, i), F.lit(0.0)) for v in views), F.lit(0.0)) / n
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), entry))


def code_spread(views: list[Column], mean: Column) -> Column:
    """Mean squared distance of the views that a row has from their mean code; null for a row without any."""
    apart = lambda v: F.aggregate(F.zip_with(v, mean, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    total = sum((F.coalesce(apart(v), F.lit(0.0)) for v in views), F.lit(0.0))
    n = available(views)
    return F.when(n > 0, total / n)


def per_view(rows: DataFrame, keys: list[str], views: list[str]) -> DataFrame:
    """keys, view and x: a row for each view that a row has, so views of one row stay aligned by its keys; a row without any view has none."""
    each = F.array(*(F.struct(F.lit(i).cast("long").alias("view"), F.col(v).alias("x")) for i, v in enumerate(views)))
    long = rows.select(*keys, F.explode(F.filter(each, lambda e: e["x"].isNotNull())).alias("_e"))
    return long.select(*keys, "_e.view", "_e.x")


def overwrite(base: Column, sample: Column, view_of: list[int], mask: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A whole vector whose entries of views outside the mask come from `sample`, clipped; entry i belongs to view_of[i]."""
    places = F.array(*map(F.lit, view_of))
    seen = lambda i: F.getbit(mask.cast("long"), F.element_at(places, i + 1)) == 1
    picked = F.transform(base, lambda x, i: F.when(seen(i), x).otherwise(F.element_at(sample, i + 1)))
    return F.transform(picked, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def exact_split(rows: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """`part` 'train' for the first floor(fraction * n) rows in the given order, else 'test'.

    The rank is taken in key ranges: counts per range first, then ranks inside a range, so no task holds all rows.
    """
    ranked = ranks(rows, order)
    return ranked.withColumn("part", F.when(F.col("rank") < F.floor(F.col("total") * fraction), "train").otherwise("test")).drop("rank", "total")


def ranks(rows: DataFrame, order: list[str], each: int = 1_000_000) -> DataFrame:
    """`rank` from 0 and `total`, over all rows, without a global window. The first order column must be numeric.

    Rows are dealt over ranges of it, about one for `each` rows (64 to 1024 of them), so a range is a sort that spills.
    """
    first, ranges = order[0], min(1024, max(64, rows.count() // each))
    cuts = rows.agg(F.percentile_approx(first, [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first()["c"] or []
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(first))) if cuts else F.lit(0)
    dealt = rows.withColumn("_b", bucket)
    counts = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_s"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("_b").orderBy(*order)
    return dealt.join(F.broadcast(starts), "_b").withColumn("rank", F.col("_s") + F.row_number().over(inside) - 1).drop("_b", "_s")


def running_sums(rows: DataFrame, keys: list[str], order: list[Column | str], weight: Column | None = None) -> DataFrame:
    """`rows` with _upto, the sum of `weight` (1 without) up to the row in the order inside its key, and _total, that of the key.

    Rows are dealt over ranges of key and order and written once; sums inside a range then only need what the ranges before it hold, so neither a
    hot key nor rows without a key meet in one task. Rows that are equal in the order come in any order.
    """
    from viewloom.sources.tables import written

    names, orders = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    lean = rows.withColumns({n: F.struct(k) for n, k in zip(names, keys, strict=True)} | {n: F.col(o) if isinstance(o, str) else o for n, o in zip(orders, order, strict=True)})
    lean = lean.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    placed = written(lean.repartitionByRange(*names, *orders).withColumn("_p", F.spark_partition_id()), "ranges")
    parts = placed.groupBy(*names, "_p").agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*names, "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy(*names)).alias("_total"))
    inside = Window.partitionBy(*names, "_p").orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("_in", F.sum("_w").over(inside)).join(starts, [*names, "_p"])
    return found.select(*rows.columns, (F.col("_before") + F.col("_in")).alias("_upto"), "_total")


def stratified_head(rows: DataFrame, label: str, order: list[Column], fraction: float) -> DataFrame:
    """Per label the first bround(fraction * n) rows in the given order (half to even)."""
    return running_sums(rows, [label], order).where(F.col("_upto") <= F.bround(F.col("_total") * fraction)).drop("_upto", "_total")
