"""Evaluation by view subset: errors, accuracies, confusion and McNemar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(predictions: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    hit = (F.col(pred) == F.col(truth)).cast("double")
    return predictions.groupBy(*keys).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def mcnemar(predictions: DataFrame, keys: list[str], pred: str = "pred", ref: str = "ref", truth: str = "truth") -> DataFrame:
    """both right, only the reference right, only the prediction right, both wrong."""
    p, r = F.col(pred) == F.col(truth), F.col(ref) == F.col(truth)
    count = lambda c: F.sum(c.cast("long"))
    return predictions.groupBy(*keys).agg(
        count(r & p).alias("both_right"), count(r & ~p).alias("only_ref"), count(~r & p).alias("only_pred"), count(~r & ~p).alias("both_wrong")
    )


def confusion(predictions: DataFrame, pred: str = "pred", truth: str = "truth", wrong_only: bool = False) -> DataFrame:
    rows = predictions.where(F.col(pred) != F.col(truth)) if wrong_only else predictions
    return rows.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def subset_size(mask: Column) -> Column:
    return F.bit_count(mask)


def valid_partitioning(rows: DataFrame, name: str, index: str, ends: DataFrame) -> DataFrame:
    """name, members, valid: whether a grouping has each index of the range (`ends` is one row with lo and hi) once and nothing else."""
    once = rows.groupBy(name, index).agg(F.count(F.lit(1)).alias("c"))
    sums = once.groupBy(name).agg(F.sum("c").alias("members"), F.count(F.lit(1)).alias("different"), F.min(index).alias("first"), F.max(index).alias("last"))
    whole = (F.col("first") == F.col("lo")) & (F.col("last") == F.col("hi")) & (F.col("members") == F.col("hi") - F.col("lo") + 1)
    return sums.join(F.broadcast(ends), how="cross").select(name, "members", ((F.col("different") == F.col("members")) & whole).alias("valid"))
