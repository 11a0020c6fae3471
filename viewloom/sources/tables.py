"""Readers: Parquet tables, ragged delimited text, annotations, and a catalog parsed from file names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewloom.operators.views import ranks


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp without time zone; no session zone is involved."""
    name = ts if isinstance(ts, str) else "ts"
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})") / F.lit(1e6)


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    """events as one series per user: user_id, rn (from 1, by ts then event_id), t in seconds, event_type, value."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(
        "user_id", "event_id", F.row_number().over(order).cast("long").alias("rn"), seconds("ts").alias("t"), "event_type", "value"
    )


def read_delimited(lines: DataFrame, names: list[str], sep: str = "\t", every: int = 1, order: str | None = None) -> DataFrame:
    """Rows of `lines` (value, and `order` if only each `every`-th is kept) with as many fields as `names`; ragged rows go.

    Strides count before the raggedness test, as a reader that skips first would.
    """
    if every > 1:
        lines = ranks(lines, [order]).where(F.col("rank") % every == 0).drop("rank", "total")
    fields = F.split("value", sep)
    return lines.where(F.size(fields) == len(names)).select(*(fields[i].alias(n) for i, n in enumerate(names)))


def parse_annotations(lines: DataFrame, key: str, order: str, value: str = "value") -> DataFrame:
    """time<TAB>text lines to key, k (dense from 0 per key), t, text (lower case, trimmed); lines without a tab go."""
    fields = F.split(value, "\t")
    rows = lines.where(F.size(fields) > 1).select(
        key, order, F.expr(f"try_cast(split({value}, '\t')[0] AS double)").alias("t"), F.lower(F.trim(F.concat_ws(" ", F.slice(fields, 2, 100_000)))).alias("text")
    )
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).drop(order)


def interpolate_missing(rows: DataFrame, key: str, k: str, t: str) -> DataFrame:
    """Null times become linear in the row number between their known neighbours, and the nearest known time at the ends."""
    before = Window.partitionBy(key).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(k).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(t).isNotNull(), F.col(k))
    found = rows.select(
        "*",
        F.last(t, True).over(before).alias("_t0"),
        F.last(at, True).over(before).alias("_k0"),
        F.first(t, True).over(after).alias("_t1"),
        F.first(at, True).over(after).alias("_k1"),
    )
    line = F.col("_t0") + (F.col("_t1") - F.col("_t0")) * (F.col(k) - F.col("_k0")) / F.nullif(F.col("_k1") - F.col("_k0"), F.lit(0))
    return found.withColumn(t, F.coalesce(F.col(t), line, F.col("_t0"), F.col("_t1"))).drop("_t0", "_k0", "_t1", "_k1")


def name_catalog(paths: DataFrame, path: str) -> DataFrame:
    """host, language directory, leading number and query of a path, beside all columns."""
    return paths.select(
        "*",
        F.regexp_extract(path, "^[a-z]+://([^/]+)", 1).alias("host"),
        F.regexp_extract(path, "^[a-z]+://[^/]+/([^/?#]*)", 1).alias("section"),
        F.expr(f"try_cast(regexp_extract({path}, '^[a-z]+://[^/]+/[^/?#]*/([0-9]+)', 1) AS bigint)").alias("number"),
    )


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by key; a rerun overwrites the same partitions only, so a batch can be restarted."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def line_count(text: Column | str) -> Column:
    """Lines of a text column; a last line without a line end counts."""
    return F.size(F.split(text, "\n")).cast("long")


def clean_record(rows: DataFrame, bookkeeping: list[str], kind: str) -> DataFrame:
    """Without bookkeeping columns, and for kind "feat" without labels."""
    return rows.drop(*bookkeeping, *(["label", "labels"] if kind == "feat" else []))


def complete_view_sets(views: dict[str, list[str]], columns: list[str], rest: str = "rest") -> dict[str, list[str]]:
    """View sets restricted to `columns`; the columns that no view has are the last view, if there are any."""
    found = {name: [c for c in wanted if c in columns] for name, wanted in views.items()}
    left = [c for c in columns if not any(c in v for v in found.values())]
    return found | ({rest: left} if left else {})


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the cluster's checkpoints, deleted when the driver's JVM ends; only a local session may be without one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="viewloom-")
    at = context._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    files.deleteOnExit(at)
    return files.makeQualified(at).toString()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` as a table in the shared folder: it is computed once, its plan ends here and lost executors do not lose it."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def kept(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """`df` written by key to the shared folder and read again: fitted coefficients outlive the job that made them."""
    folder = shared_folder(df.sparkSession, name)
    write_partitioned(df, folder, by)
    return df.sparkSession.read.parquet(folder)
