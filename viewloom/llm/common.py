"""Small helpers that the corpus operators share: table reading, lineage cuts, size estimates."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and \x09-\x0D, as a Java and RE2 character class.
WORD_GAP = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, as a full URI; a temporary one only where that is unset.

    A path without a scheme means the cluster's default file system, as for Spark itself.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="viewloom-checkpoints-"))
    at = context._jvm.org.apache.hadoop.fs.Path(path or context._jsc.sc().getCheckpointDir().get())
    return at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toString()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder in the shared one, on any file system; it is deleted when the driver's JVM ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that lost executors do not lose it and lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows in a partition of a compact frame.
COMPACT_ROWS = 100_000


def compacted(df: DataFrame, *sums: Column) -> tuple[DataFrame, Row]:
    """cut(), then as many partitions as the rows need: every task of the next shuffle leaves files, however few rows it has. Also `n`, the rows, and `sums` of them."""
    done = cut(df)
    found = done.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return done.coalesce(max(8, -(-found.n // COMPACT_ROWS))), found


def compact(df: DataFrame) -> DataFrame:
    return compacted(df)[0]


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Arrow batches of at most so many rows for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def planned_bytes(df: DataFrame) -> int:
    """The size of what `df` reads, as Spark plans with it (file sizes for scans); no job runs.

    Where Spark does not know it (a frame made from an RDD or a checkpoint), 16 MB a partition.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(n >= 1 << 60 for n in sizes):
        return df.rdd.getNumPartitions() << 24
    return sum(sizes)


def pieces(df: DataFrame, each: int, least: int = 8) -> int:
    """How many pieces of about `each` bytes the planned size makes; grows with the data."""
    return max(least, -(-planned_bytes(df) // each))


def n_words(text):
    """Words separated by WORD_GAP; null and blank texts have none."""
    blank = lambda c: c.rlike(f"^{WORD_GAP}").cast("int")
    parts = F.size(F.split(text, WORD_GAP)) - blank(F.substring(text, 1, 1)) - blank(F.substring(text, -1, 1))
    return F.when(F.length(text) > 0, parts).otherwise(0).cast("long")


#: Up to so many keys a semi-join or a lookup is broadcast; beyond that it is a shuffled join.
BROADCAST_KEYS = 200_000


def semi_join(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """`keys` must be materialised; they are counted, and broadcast only when they are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def bounded_sample(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """About `most` different rows of `rows` at most (all, where there are fewer), each once, told apart by a hash of the columns `by`.

    Rows that repeat, or that have null in an id, are one row for the sample, so it is bounded whatever the table holds. The share to draw
    follows from the number of rows; only where so many repeat that this gives less than a quarter, from the number of different rows.
    """
    named = rows.withColumn("row_name", F.xxhash64(*(F.col(c).isNull() for c in by), *by))

    def drawn(size: int) -> DataFrame:
        share = min(1.0, most / max(1, size))
        # hashed again: the count of different rows and other samples go by the same hash
        part = named if share == 1 else named.where(F.pmod(F.xxhash64("row_name", F.lit("sample")), F.lit(1 << 40)) < math.ceil(share * (1 << 40)))
        return part.groupBy("row_name").agg(*(F.first(c).alias(c) for c in rows.columns)).drop("row_name")

    size = rows.count()
    if size <= most:
        return drawn(size)
    found = cut(drawn(size))
    if 4 * found.count() >= most:
        return found
    return drawn(named.agg(F.approx_count_distinct("row_name", 0.02)).first()[0])


def hot_keys(sizes: DataFrame) -> DataFrame | None:
    """Of `sizes` (a key column and `size`, the rows that come to it) the keys with so many rows that they are dealt over salts: key and salts.

    There are at most 100,000 of them. None where there is none.
    """
    total, biggest = sizes.agg(F.sum("size"), F.max("size")).first()
    most = max(HOT_ROWS, (total or 0) // 100_000)
    return sizes.where(F.col("size") > most).withColumn("salts", F.ceil(F.col("size") / most)).drop("size") if (biggest or 0) > most else None


#: Up to so many rows of a key go to one task in any case.
HOT_ROWS = 2048


def lookup(rows: DataFrame, keys: DataFrame, on: str, hot: DataFrame | None, how: str = "inner", spread: list[str] | None = None) -> DataFrame:
    """`rows` joined to `keys`, which has one row per value of `on`; `hot` comes from hot_keys. `how`: inner or left.

    A hot key is repeated under salts, and its rows are dealt over them: by a hash of the columns `spread`, or by their
    place in `rows` where that is a table that does not change. Rows without a key meet nothing wherever they are.
    """
    place = F.xxhash64(*spread) if spread else F.monotonically_increasing_id()
    salt = lambda n: F.pmod(place, n).cast("int")
    lone = F.when(F.col(on).isNull(), salt(F.lit(4096))) if how == "left" else F.when(F.lit(False), 0)
    if hot is None:
        if how == "inner":
            return rows.join(keys, on)
        return rows.withColumn("salt", lone.otherwise(0)).join(keys.withColumn("salt", F.lit(0)), [on, "salt"], how).drop("salt")
    dealt = rows.join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn("salt", lone.when(F.col("salts").isNull(), 0).otherwise(salt(F.col("salts"))))
    again = keys.join(F.broadcast(hot), on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)).cast("int") - 1)))
    return dealt.drop("salts").join(again.drop("salts"), [on, "salt"], how).drop("salt")


def forget(*frames: DataFrame | None) -> None:
    """Delete the checkpoint files under frames made by cut() or compact() that nothing reads any more; Spark keeps them otherwise."""
    for df in frames:
        if df is None:
            continue
        context = df.sparkSession.sparkContext
        at = df._jdf.queryExecution().analyzed().collectLeaves().head().rdd().getCheckpointFile()
        if at.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(at.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
