"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding, each over all that the stage before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of `documents`. run() writes each stage's result as Parquet into the shared folder and reads it again,
so a stage's input is a table and lost executors do not lose it.

Empty input gives an empty result. Null texts have no words and are rejected by the first stage. Rows are told apart
by id and text: a null id or an id on two texts is no reason to keep or drop a row. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.llm import decontaminate, mixing, near_dedup, quality, sharding
from viewloom.llm.common import cut, scratch_folder, semi_join, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer does not reject."""
    return docs.select(*COLUMNS).where(quality.quality_of(docs) >= quality.KEEP_FROM)


def keyed(docs: DataFrame) -> DataFrame:
    """The columns and `row_key`, a hash of id and text: stages decide by it, as ids may be null or stand on different texts."""
    return docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("row_key"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest doc_id (nulls last); of repeated rows, one."""
    docs = keyed(docs)
    classes = near_dedup.near_duplicate_classes(docs.select(F.col("row_key").alias("doc_id"), "text", F.col("doc_id").alias("rank")), rank="rank")
    rows = cut(classes.groupBy(F.col("doc_id").alias("row_key"), F.col("class_id").alias("kept")).agg(F.count(F.lit(1)).alias("n")))
    left = semi_join(docs, rows.where("row_key <> kept").select("row_key"), "row_key", "left_anti")
    again = rows.where("row_key = kept and n > 1").select("row_key", F.lit(1).alias("again"))
    if again.isEmpty():
        return left.select(*COLUMNS)
    marked = semi_join(left, again, "row_key", "left")
    one = marked.where("again = 1").groupBy("row_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return marked.where("again is null").select(*COLUMNS).union(one)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a stretch of a benchmark item."""
    docs = keyed(docs)
    rows = docs.select(F.col("row_key").alias("doc_id"), "text")
    leaks = cut(decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row_key")).distinct())
    return semi_join(docs, leaks, "row_key", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them."""
    docs = docs.select(*COLUMNS)
    return mixing.draw(docs, mixing.mixing_plan(docs)).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document along the Hilbert curve."""
    return sharding.hilbert_shards(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: The first three stages have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
