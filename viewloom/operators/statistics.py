"""Scaling, moments, histograms and discrete information measures as plain aggregations.

Everything is one or two group-bys with map-side sums; statistics that come back to the rows are a single row or a row per
key, joined (a single row by an aggregate over an empty window is avoided: it would gather all rows in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.operators.views import running_sums


def with_totals(rows: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """`rows` with aggregates per key (or over all rows without keys: one row, so its broadcast is bounded)."""
    named = [v.alias(k) for k, v in aggregates.items()]
    if not keys:
        return rows.join(F.broadcast(rows.agg(*named)), how="cross")
    return rows.join(rows.groupBy(*keys).agg(*named), keys)


def zscore(rows: DataFrame, value: str, keys: list[str] = (), train: Column | None = None, sample: bool = True, least: float = 1e-6, out: str = "z") -> DataFrame:
    """Centred and scaled by the mean and deviation of the rows with `train` (all rows without); small deviations count as 1."""
    own = F.when(train, F.col(value)) if train is not None else F.col(value)
    found = with_totals(rows, list(keys), _m=F.avg(own), _s=(F.stddev_samp if sample else F.stddev_pop)(own))
    scale = F.when(F.coalesce(F.col("_s"), F.lit(0.0)) > least, F.col("_s")).otherwise(1.0)
    return found.withColumn(out, (F.col(value) - F.col("_m")) / scale).drop("_m", "_s")


def minmax(rows: DataFrame, value: str, keys: list[str] = (), out: str = "scaled") -> DataFrame:
    found = with_totals(rows, list(keys), _lo=F.min(value), _hi=F.max(value))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return found.withColumn(out, (F.col(value) - F.col("_lo")) / width).drop("_lo", "_hi")


def robust_minmax(rows: DataFrame, value: str, keys: list[str] = (), sigmas: float = 10.0, out: str = "scaled") -> DataFrame:
    """min-max whose limits leave out values `sigmas` population deviations or more above the mean; the output is not clipped."""
    found = with_totals(rows, list(keys), _m=F.avg(value), _s=F.stddev_pop(value))
    plain = F.when(F.col(value) - F.col("_m") < F.lit(sigmas) * F.col("_s"), F.col(value))
    found = found.withColumn("_v", F.coalesce(plain, F.when(F.col("_s") == 0, F.col(value))))
    found = with_totals(found, list(keys), _lo=F.min("_v"), _hi=F.max("_v"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return found.withColumn(out, (F.col(value) - F.col("_lo")) / width).drop("_m", "_s", "_v", "_lo", "_hi")


def correlations(wide: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, r for i <= j from one pass of sums."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = wide.agg(*(F.corr(columns[i], columns[j]).alias(f"{i}_{j}") for i, j in pairs))
    entries = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{i}_{j}").alias("r")) for i, j in pairs]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def double_centred(gram: DataFrame, i: str = "i", j: str = "j", g: str = "g") -> DataFrame:
    """H G H of a Gram matrix in (i, j, g) form."""
    rows = gram.groupBy(i).agg(F.avg(g).alias("_r"))
    columns = gram.groupBy(j).agg(F.avg(g).alias("_c"))
    all_of = gram.agg(F.avg(g).alias("_a"))
    full = gram.join(rows, i).join(columns, j).join(F.broadcast(all_of), how="cross")
    return full.select(i, j, (F.col(g) - F.col("_r") - F.col("_c") + F.col("_a")).alias("centred"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, keys: list[str] = ()) -> DataFrame:
    """Dense counts of equal bins on [low, high]; the last bin is closed, values outside are left out."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = rows.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    grid = rows.select(*keys).distinct().select(*keys, every) if keys else rows.sparkSession.range(1).select(every)
    return grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


# --- discrete information, in bits --------------------------------------------------------------------------


def entropy(rows: DataFrame, columns: list[str], name: str = "bits") -> DataFrame:
    """H of the joint states of `columns`: log2 N - sum(c log2 c) / N over the state counts c."""
    counts = rows.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    return counts.agg((F.log2(F.sum("_c")) - F.sum(F.col("_c") * F.log2("_c")) / F.sum("_c")).alias(name))


def _sum_of_entropies(rows: DataFrame, terms: list[tuple[int, list[str]]]) -> DataFrame:
    """`bits`: the sum of the signed entropies of several sets of columns. The rows are read and grouped once; the sets are summed from those counts."""
    signs: dict[frozenset[str], int] = {}
    for sign, columns in terms:
        signs[frozenset(columns)] = signs.get(frozenset(columns), 0) + sign
    every = list(dict.fromkeys(c for _, columns in terms for c in columns))
    counts = rows.groupBy(*every).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    each = counts.groupingSets([[F.col(c) for c in every if c in key] for key in signs], *every).agg(F.sum("_c").alias("_s"), F.grouping_id().alias("_g"))
    bits = each.groupBy("_g").agg((F.log2(F.sum("_s")) - F.sum(F.col("_s") * F.log2("_s")) / F.sum("_s")).alias("_h"))
    sign = F.lit(0)
    for key, s in signs.items():
        # a column outside the set has a 1 in the number of the set, the first column the highest
        sign = F.when(F.col("_g") == int("".join("0" if c in key else "1" for c in every), 2), s).otherwise(sign)
    return bits.agg(F.sum(sign * F.col("_h")).alias("bits"))


def conditional_entropy(rows: DataFrame, a: list[str], given: list[str]) -> DataFrame:
    return _sum_of_entropies(rows, [(1, [*a, *given]), (-1, given)])


def mutual_information(rows: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    return _sum_of_entropies(rows, [(1, a), (1, b), (-1, [*a, *b])])


def conditional_mutual_information(rows: DataFrame, a: list[str], b: list[str], given: list[str]) -> DataFrame:
    return _sum_of_entropies(rows, [(1, [*a, *given]), (1, [*b, *given]), (-1, [*a, *b, *given]), (-1, given)])


def quantised(rows: DataFrame, columns: list[str], out: str = "state") -> DataFrame:
    """`rows` with q_<column> (rounded, halves away from zero, shifted so that the least is 0) and their joint state.

    The joint state counts through all combinations of the columns' ranges, the first column fastest; a row with a null in one has no states. Ranges come
    from one row of least and greatest values.
    """
    whole = {c: F.round(F.col(c)).cast("long") for c in columns}
    found = with_totals(rows, [], **{f"_lo_{c}": F.min(w) for c, w in whole.items()}, **{f"_hi_{c}": F.max(w) for c, w in whole.items()})
    found = found.withColumns({f"q_{c}": w - F.col(f"_lo_{c}") for c, w in whole.items()})
    state, step = F.lit(0).cast("long"), F.lit(1).cast("long")
    for c in columns:
        state, step = state + F.col(f"q_{c}") * step, step * (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1)
    return found.withColumn(out, state).drop(*(f"_{e}_{c}" for e in ("lo", "hi") for c in columns))


def joint_states(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct joint states with their counts, numbered from 1 with the last column slowest."""
    counts = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, [], list(reversed(columns))).withColumnRenamed("_upto", "state").drop("_total")


def marginal(rows: DataFrame, column: str) -> DataFrame:
    """State, count, probability and cumulative probability."""
    counts = rows.groupBy(F.col(column).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    found = running_sums(counts, [], ["state"], F.col("n"))
    return found.select("state", "n", (F.col("n") / F.col("_total")).alias("p"), (F.col("_upto") / F.col("_total")).alias("cdf"))


def modal_value(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value per key; among ties the one seen first."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def exact_quantile(rows: DataFrame, value: str, p: float, key: str | None = None) -> DataFrame:
    """key, `quantile` (linear between neighbours) of a number without nulls, from counts of its distinct values.

    The values of a key are cut into ranges by an approximate quantile sketch; only the two ranges in which the wanted places lie are ordered.
    """
    key = key or "_all"
    rows = rows.select((F.lit(0) if key == "_all" else F.col(key)).alias(key), F.col(value).alias("_x"))
    cuts = rows.groupBy(key).agg(F.percentile_approx("_x", [i / 128 for i in range(129)], 10_000).alias("_cuts"), F.count(F.lit(1)).alias("_n"))
    placed = rows.join(F.broadcast(cuts) if key == "_all" else cuts, key)
    placed = placed.select(key, "_x", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_x"))).alias("_b"))
    ranges = placed.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_m"), F.first("_n").alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    at = F.lit(p) * (F.col("_n") - 1)
    ranges = ranges.withColumn("_s", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    wanted = ranges.where((F.col("_s") <= F.ceil(at)) & (F.floor(at) < F.col("_s") + F.col("_m"))).select(key, "_b", "_s", "_n")
    inside = placed.drop("_n").join(wanted, [key, "_b"]).groupBy(key, "_b", "_s", "_n", "_x").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(key, "_b").orderBy("_x")
    ranked = inside.withColumn("_to", F.col("_s") + F.sum("_c").over(upto)).withColumn("_from", F.col("_to") - F.col("_c"))
    holds = lambda place: F.max(F.when((F.col("_from") <= place) & (place < F.col("_to")), F.col("_x")))
    found = ranked.groupBy(key).agg(holds(F.floor(at)).alias("_lo"), holds(F.ceil(at)).alias("_hi"), (F.max(at) - F.max(F.floor(at))).alias("_w"))
    found = found.select(key, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias("quantile"))
    return found.drop("_all") if key == "_all" else found
