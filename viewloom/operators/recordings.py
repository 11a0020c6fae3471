"""Labelled recordings: subjects that own several of them, samples of a fixed length, classes of coded statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.operators.views import exact_split
from viewloom.sources.tables import written


def scattered(key: Column) -> Column:
    """A number below 2 ** 60 from the key's digest: an order that has nothing to do with the key's own."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")


def by_subject(rows: DataFrame, subject: str, channels: list[str], fraction: float, least: float = 1e-3) -> DataFrame:
    """`rows` with `part` and a column z_<channel> each; a subject's recordings are one group, whatever their number.

    floor(fraction * subjects) subjects, taken in scattered order, are 'train', the others 'test', so no subject is on both sides. Channels are centred and
    scaled by the subject's own mean and population deviation; one of at most `least` counts as 1. Rows without a subject are left out.
    A row per subject is written; the rows meet it in one join, which Spark splits for a hot subject.
    """
    found = [s for c in channels for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    each = rows.where(F.col(subject).isNotNull()).groupBy(subject).agg(*found)
    placed = exact_split(written(each.withColumn("_h", scattered(F.col(subject)))), ["_h", subject], fraction)
    scale = lambda c: F.when(F.col(f"_s_{c}") > least, F.col(f"_s_{c}")).otherwise(1.0)
    scaled = ((F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in channels)
    return rows.join(placed, subject).select(*(rows[c] for c in rows.columns), "part", *(z.alias(f"z_{c}") for z, c in zip(scaled, channels, strict=True)))


def fixed_samples(series: DataFrame, keys: list[str], size: int, channels: list[str], slopes: list[str], zero_share: float = 0.1, rn: str = "rn") -> DataFrame:
    """Whole samples of `size` rows one after the other: keys, sample and pos (from 0), channels and slopes scaled.

    The last sample counts if it is whole. A sample goes if more than `zero_share` of its rows have channels whose sum is 0 (a null counts as 0).
    All channels are centred and scaled by the first one's mean and population deviation in the sample, slopes are divided by that deviation; 0 counts as 1.
    Windows hold `size` rows; a series that is already dealt by its keys is not shuffled again.
    """
    at = F.col(rn) - 1
    own = Window.partitionBy(*keys, "sample")
    empty = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in channels), F.lit(0.0)) == 0
    rows = series.withColumns({"sample": F.floor(at / size).cast("long"), "pos": (at % size).cast("long")})
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(own), "_z": F.sum(empty.cast("int")).over(own), "_m": F.avg(channels[0]).over(own), "_s": F.stddev_pop(channels[0]).over(own)})
    whole = rows.where((F.col("_n") == size) & (F.col("_z") <= zero_share * size))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return whole.select(*keys, "sample", "pos", *(((F.col(c) - F.col("_m")) / scale).alias(c) for c in channels), *((F.col(c) / scale).alias(c) for c in slopes))


def code_classes(records: DataFrame, keys: list[str], codes: Column, statements: DataFrame, code: str, group: str) -> DataFrame:
    """keys and `classes`: the sorted different classes of all codes that a record's rows carry (an array column).

    Codes without a statement, or whose statement has no class, count for nothing; a record of only such codes, or without codes, has an empty list.
    """
    pairs = records.select(*keys, F.explode_outer(codes).alias("_code")).distinct()
    known = statements.select(F.col(code).alias("_code"), F.col(group).alias("_group")).distinct()
    return pairs.join(known, "_code", "left").groupBy(*keys).agg(F.sort_array(F.collect_set("_group")).alias("classes"))
