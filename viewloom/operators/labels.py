"""Labels for samples: annotation codes, a label state machine, forward as-of lookup, change points, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of annotation texts (lower case) and the labels they lead to.
# BLEED_NOT stands apart because the twin's pattern engine has no lookahead.
STABILISATION_START = r"min stabilization period$"
STABILISATION_END = r"min stabilization period (completed|ended)$"
BLEED = r"^bleed #[ ]*[1-9]"
BLEED_NOT = r"^bleed #[ ]*[1-9]( stopped| temporarily stopped)"
BLEED_END = r"^bleed #[ ]*[1-9] (stopped|temporarily stopped)$"
RESUSCITATION_START = (
    r"^((begin |_begin )*resuscitation( with hextend( \(bag #[1-9]\))*)*|cpr|co started|dobutamine started|lr started|"
    r"(na|sodium) nitrite( started)*|resuscitation resumed)$"
)
RESUSCITATION_END = (
    r"^(co stopped|cpr (completed|stopped)|dobutamine stopped|lr (complete|stopped)|resuscitation (\(hextend\) )*(complete[d]*|stopped)|"
    r"(na|sodium) nitrite stopped|stop resuscitation|resuscitation paused)$"
)
NONE, STABLE, BLEEDING, BETWEEN, HEXTEND, OTHER, AFTER_HEXTEND, AFTER_OTHER, POST = -1, 0, 1, 2, 3, 4, 5, 6, 7


def annotation_label(text: Column) -> Column:
    """The label that an annotation text leads to, or null. An end of resuscitation without "hextend" leads to AFTER_OTHER here."""
    hextend = F.contains(text, F.lit("hextend"))
    return (
        F.when(text.rlike(STABILISATION_START), STABLE)
        .when(text.rlike(STABILISATION_END), NONE)
        .when(text.rlike(BLEED) & ~text.rlike(BLEED_NOT), BLEEDING)
        .when(text.rlike(BLEED_END), BETWEEN)
        .when(text.rlike(RESUSCITATION_START), F.when(hextend, HEXTEND).otherwise(OTHER))
        .when(text.rlike(RESUSCITATION_END), F.when(hextend, AFTER_HEXTEND).otherwise(AFTER_OTHER))
    )


def label_state_machine(annotations: DataFrame, key: str, k: str = "k", text: str = "text") -> DataFrame:
    """key, idx, label: the critical annotations of each key and the label of the interval that ends there.

    A fold over each key's ordered texts, which are few (annotations, not samples). A start of stabilisation forgets all before it. An end of
    resuscitation after hextend leads to AFTER_HEXTEND. Labels beyond BETWEEN before the last bleed become BETWEEN; trailing
    AFTER labels go; the last annotation closes with POST. Keys without a bleed have no result.
    """
    rows = annotations.select(key, F.col(k).cast("int").alias("k"), annotation_label(F.col(text)).alias("to"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("k", "to")))).alias("s"), F.max("k").alias("end"))
    empty = F.array().cast("array<struct<idx:int,label:int>>")
    pair = lambda idx, label: F.array(F.struct(idx.alias("idx"), label.cast("int").alias("label")))

    def step(acc, x):
        fresh = x["to"] == STABLE
        state = F.when(fresh, NONE).otherwise(acc["state"])
        found = F.when(fresh, empty).otherwise(acc["found"])
        to = F.when((x["to"] == AFTER_OTHER) & (state == HEXTEND), AFTER_HEXTEND).otherwise(x["to"])
        return F.struct(F.when(to != state, F.concat(found, pair(x["k"], state))).otherwise(found).alias("found"), to.alias("state"))

    folded = lists.select(key, "end", F.aggregate("s", F.struct(empty.alias("found"), F.lit(NONE).alias("state")), step)["found"].alias("f"))
    bleeds = F.transform(F.filter("f", lambda x: x["label"] == BLEEDING), lambda x: x["idx"])
    folded = folded.withColumn("bleed", F.array_max(bleeds)).where("bleed is not null")
    calm = F.transform("f", lambda x: F.struct(x["idx"].alias("idx"), F.when((x["idx"] < F.col("bleed")) & (x["label"] > BETWEEN), BETWEEN).otherwise(x["label"]).alias("label")))
    folded = folded.withColumn("f", calm)
    real = F.array_max(F.transform(F.filter("f", lambda x: ~x["label"].isin(AFTER_HEXTEND, AFTER_OTHER)), lambda x: x["idx"]))
    folded = folded.withColumn("last", real).withColumn("f", F.filter("f", lambda x: x["idx"] <= F.col("last")))
    closed = F.when(F.col("last") < F.col("end"), F.concat("f", pair(F.col("end"), F.lit(POST)))).otherwise(F.col("f"))
    return folded.select(key, F.explode(closed).alias("x")).select(key, "x.idx", "x.label")


def forward_label(series: DataFrame, keys: list[str], is_critical: Column, label: Column, rn: str = "rn", out: str = "label") -> DataFrame:
    """Of every row the label of the next critical row (itself included); past the last one, the last label."""
    ahead = Window.partitionBy(*keys).orderBy(rn).rowsBetween(0, Window.unboundedFollowing)
    behind = Window.partitionBy(*keys).orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(is_critical, label)
    return series.withColumn(out, F.coalesce(F.first(own, True).over(ahead), F.last(own, True).over(behind)))


def asof_forward(samples: DataFrame, points: DataFrame, key: str, t: str, label: str) -> DataFrame:
    """`samples` (key, t) with the label of the first point (key, t, label) at or after t, else the last point's.

    One union and one sort per key; no row meets all points.
    """
    both = samples.withColumn("_own", F.lit(1)).withColumn(label, F.lit(None).cast(dict(points.dtypes)[label]))
    both = both.unionByName(points.select(key, t, label).withColumn("_own", F.lit(0)), allowMissingColumns=True)
    # at equal times samples come first, so that they see the point
    ahead = Window.partitionBy(key).orderBy(F.col(t), F.col("_own").desc()).rowsBetween(0, Window.unboundedFollowing)
    behind = Window.partitionBy(key).orderBy(F.col(t), F.col("_own").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.first(label, True).over(ahead), F.last(label, True).over(behind))
    return both.withColumn(label, found).where("_own = 1").drop("_own")


def change_points(series: DataFrame, keys: list[str], value: str, rn: str = "rn") -> DataFrame:
    """The first row of every run of equal values."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(rn))
    return series.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def runs(series: DataFrame, keys: list[str], value: str, rn: str = "rn") -> DataFrame:
    """keys, value, next (the value after), start and stop (rn of the next run's first row; null at the end)."""
    order = Window.partitionBy(*keys).orderBy(rn)
    found = change_points(series, keys, value, rn)
    return found.select(*keys, value, F.lead(value).over(order).alias("next"), F.col(rn).alias("start"), F.lead(rn).over(order).alias("stop"))


def nearby_pairs(rows: DataFrame, keys: list[str], reach: int, rn: str = "rn") -> DataFrame:
    """keys, left_rn, right_rn: the pairs of a key's rows at most `reach` rows apart, the span that the caller asks for; partners come by ranges of rows."""
    left = rows.select(*keys, F.col(rn).alias("left_rn")).withColumn("right_rn", F.explode(F.sequence(F.col("left_rn") + 1, F.col("left_rn") + reach)))
    return left.join(rows.select(*keys, F.col(rn).alias("right_rn")), [*keys, "right_rn"]).select(*keys, "left_rn", "right_rn")


def phase_of(current: Column, following: Column, patterns: dict[str, tuple[str | None, str | None]]) -> Column:
    """The first phase whose (value, next value) pattern fits; None in a pattern fits all."""
    found = F.lit(None).cast("string")
    for phase, (a, b) in reversed(list(patterns.items())):
        test = (F.lit(True) if a is None else current == a) & (following.isNotNull() if b is None else following == b)
        found = F.when(test, F.lit(phase)).otherwise(found)
    return found
