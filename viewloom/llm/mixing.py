"""Temperature mixing of sources, realised as budgeted block permutations.

A source with share p of the words gets the weight p^a / sum(p^a). The exponent a in [0, 1] is bisected: it is
the largest one whose weights have at least `entropy` times the greatest possible entropy, and it is raised as
far as `max_repeats` asks, so that no source is repeated more often (at a = 1 every source is repeated
budget / words times). A source then owes round(weight * budget) words. It pays with whole passes over its
documents, each pass a permutation of its own, and with the longest prefix of one more permutation that fits.

Defined cases: null is a source of its own. A source without any word has weight 0 and is not drawn. Rows
with the same doc_id are drawn together. Empty tables give empty results. Extra columns stay out of the plan.

The exponent search reads one row per source and brings back sums only: each round evaluates `SECTIONS` exponents
at once. Prefixes are cut in two steps, by word sums of key ranges and then inside a range, so that a source with
a third of all rows is dealt over many tasks. The texts are not shuffled: a row per source decides about them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.llm.common import cut, n_words, pieces, semi_join

SECTIONS, ROUNDS = 15, 12


def _source(col: str = "source") -> Column:
    """Null as a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(col)), F.lit("null"))


def _shuffled(seed: int, block: Column) -> Column:
    """The place of a document in the permutation of a pass: 128 bits in hexadecimal."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), block.cast("string"), F.lit(str(seed))))


def _words(docs: DataFrame) -> Column:
    return n_words(F.col("text")) if "text" in docs.columns else F.col("n_words")


def exponent(sources: DataFrame, total: int, least: int, count: int, budget: int, entropy: float, max_repeats: float) -> float:
    """The exponent for `sources` (one row each, with words > 0)."""
    share = F.col("words") / F.lit(float(total))
    floor = least / total

    def sums(points: list[float]) -> dict[float, tuple[float, float]]:
        each = sources.select(share.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("a"))
        power = F.pow("p", "a")
        rows = each.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s")).collect()
        return {r.a: (r.z, r.s) for r in rows}

    def mixed_enough(a: float, z: float, s: float) -> bool:
        return math.log(z) - a * s / z >= entropy * math.log(count) - 1e-12

    def rests_enough(a: float, z: float, s: float) -> bool:
        return budget / total * floor ** (a - 1) / z <= max_repeats

    def search(wanted, rising: bool) -> float:
        """The end of [0, 1] up to which (rising: from which) the exponents are wanted."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            points = [lo + (hi - lo) * i / (SECTIONS + 1) for i in range(1, SECTIONS + 1)]
            found = sums(points)
            good = [wanted(a, *found[a]) for a in points]
            ends = [lo, *points, hi]
            k = good.index(rising) if rising in good else SECTIONS
            lo, hi = ends[k], ends[k + 1]
        return (lo + hi) / 2

    z, s = sums([1.0])[1.0]
    a = 1.0 if mixed_enough(1.0, z, s) else search(mixed_enough, False)
    found = sums([a])[a]
    return a if rests_enough(a, *found) or budget > max_repeats * total else max(a, search(rests_enough, True))


def mixing_plan(
    docs: DataFrame,
    entropy: float = 0.97,
    max_repeats: float = 4.0,
    budget: int | None = None,
    seed: int = 17,
    n_buckets: int | None = None,
    epochs: float = 1.0,
) -> DataFrame:
    """`docs` has doc_id, source and text or n_words. The budget is in words; without one it is `epochs` times the words there are.

    One row per source: src, source, words, weight, quota (words owed), passes, last (end of the prefix of one more pass, or null).
    """
    n_buckets = n_buckets or pieces(docs, 4 << 20, 64)
    rows = docs.select("doc_id", "source", _source().alias("src"), _words(docs).alias("words"))
    rows = cut(rows) if "text" in docs.columns else rows
    sources = cut(rows.groupBy("src").agg(F.first("source").alias("source"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("docs")))
    drawn = sources.where("words > 0")
    total, least, count = drawn.agg(F.sum("words"), F.min("words"), F.count(F.lit(1))).first()
    budget = budget if budget is not None else math.floor(epochs * (total or 0))
    a = exponent(drawn, total, least, count, budget, entropy, max_repeats) if count > 1 else 1.0
    power = F.when(F.col("words") > 0, F.pow(F.col("words") / F.lit(float(total or 1)), F.lit(a))).otherwise(F.lit(0.0))
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    weighted = sources.select("src", "source", "words", F.lit(a).alias("exponent"), (power / F.lit(norm)).alias("weight"))
    owed = weighted.withColumn("quota", F.round(F.col("weight") * F.lit(float(budget))).cast("long"))
    owed = owed.withColumn("passes", F.when(F.col("words") > 0, F.expr("quota div words")).otherwise(F.lit(0)).cast("long"))
    owed = cut(owed.withColumn("rest", F.col("quota") - F.col("passes") * F.col("words")))

    keyed = semi_join(rows, owed.where("rest > 0").select("src", "passes", "rest"), "src", "inner").withColumn("key", _shuffled(seed, F.col("passes")))
    keyed = keyed.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(n_buckets) / F.lit(2.0**32)).cast("int"))
    by_key = keyed.groupBy("src", "bucket", "key").agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    inside = Window.partitionBy("src", "bucket").orderBy("key")
    sums = keyed.groupBy("src", "bucket").agg(F.sum("words").alias("bucket_words"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "bucket", F.coalesce(F.sum("bucket_words").over(before), F.lit(0)).alias("start"))
    ends = by_key.withColumn("upto", F.sum("words").over(inside)).join(starts, ["src", "bucket"])
    last = ends.where(F.col("start") + F.col("upto") <= F.col("rest")).groupBy("src").agg(F.max("key").alias("last"))
    return owed.join(last, "src", "left").select("src", "source", "words", "exponent", "weight", "quota", "passes", "last")


def draw(docs: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of `docs` as often as the plan says, with n_words, weight, block (the pass) and order_key; sort by these two.

    Columns of `docs` with these four names give way to them (n_words is the word count where there is no text); all others stay, whatever their names.
    """
    decided = cut(plan.select("src", "weight", "passes", "last"))
    rows = docs.select("doc_id", F.struct("*").alias("row"), _words(docs).alias("n_words"), _source().alias("src"))
    rows = semi_join(rows, decided, "src", "inner")
    more = F.coalesce(_shuffled(seed, F.col("passes")) <= F.col("last"), F.lit(False)).cast("long")
    rows = rows.withColumn("times", F.col("passes") + more).where("times > 0")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    rows = rows.withColumn("order_key", _shuffled(seed, F.col("block")))
    own = ("n_words", "weight", "block", "order_key")
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in own), *own)


def mix_sources(docs: DataFrame, entropy: float = 0.97, max_repeats: float = 4.0, budget: int | None = None, seed: int = 17, epochs: float = 1.0) -> DataFrame:
    """One row per drawn copy: doc_id, source, n_words, weight, block, order_key."""
    lean = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("n_words")))
    plan = mixing_plan(lean, entropy, max_repeats, budget, seed, pieces(docs, 4 << 20, 64), epochs)
    return draw(lean, plan, seed).select("doc_id", "source", "n_words", F.round("weight", 6).alias("weight"), "block", "order_key")


def oracle(documents: str = "documents", entropy: float = 0.97, max_repeats: float = 4.0, seed: int = 17, epochs: float = 1.0, columns: str | None = None) -> str:
    """DuckDB twin: a plain bisection in a recursive query and one window over each source."""
    gap = r"[ \t\n\x0B\f\r]+"
    columns = columns or "d.doc_id, d.source, d.words AS n_words, round(s.weight, 6) AS weight, d.block, d.order_key"
    key = "md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null'), {b}, '%d'))" % seed
    return rf"""
WITH RECURSIVE bare AS (
  SELECT *, coalesce('=' || source, 'null') AS src, regexp_replace(text, '^{gap}|{gap}$', '', 'g') AS t FROM {documents}),
doc AS (SELECT * EXCLUDE (t), CAST(CASE WHEN length(t) > 0 THEN len(string_split_regex(t, '{gap}')) ELSE 0 END AS BIGINT) AS words FROM bare),
size AS (SELECT src, CAST(sum(words) AS BIGINT) AS words FROM doc GROUP BY src),
fact AS (SELECT list(words / total) AS ps, min(words / total) AS least, count(*) AS k, any_value(total) AS total, floor({epochs} * any_value(total)) AS budget
         FROM (SELECT words, sum(words) OVER () AS total FROM size WHERE words > 0)),
bisect AS (
  SELECT 0 AS i, 0.0::DOUBLE AS elo, 1.0::DOUBLE AS ehi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi
  UNION ALL
  SELECT i + 1, CASE WHEN mixed THEN e ELSE elo END, CASE WHEN mixed THEN ehi ELSE e END,
         CASE WHEN rests THEN rlo ELSE r END, CASE WHEN rests THEN r ELSE rhi END
  FROM (SELECT i, elo, ehi, rlo, rhi, e, r,
          ln(list_sum(list_transform(ps, lambda p: pow(p, e)))) - e * list_sum(list_transform(ps, lambda p: pow(p, e) * ln(p)))
            / list_sum(list_transform(ps, lambda p: pow(p, e))) >= {entropy} * ln(k) - 1e-12 AS mixed,
          budget / total * pow(least, r - 1) / list_sum(list_transform(ps, lambda p: pow(p, r))) <= {max_repeats} AS rests
        FROM (SELECT *, (elo + ehi) / 2 AS e, (rlo + rhi) / 2 AS r FROM bisect), fact WHERE i < 60)),
power AS (SELECT CASE WHEN k = 1 THEN 1 WHEN budget > {max_repeats} * total THEN elo ELSE greatest(elo, CASE WHEN rhi < 1e-12 THEN 0 ELSE rhi END) END AS a
          FROM bisect, fact WHERE i = 60),
share AS (SELECT src, words, CASE WHEN words > 0 THEN pow(words / total, a) ELSE 0 END AS z, budget FROM size, fact, power),
owed AS (SELECT src, words, weight, quota, CASE WHEN words > 0 THEN quota // words ELSE 0 END AS passes
         FROM (SELECT src, words, z / sum(z) OVER () AS weight, CAST(round(z / sum(z) OVER () * budget) AS BIGINT) AS quota FROM share)),
source_plan AS (SELECT *, quota - passes * words AS rest FROM owed),
cum AS (SELECT d.*, s.passes, s.rest,
          sum(d.words) OVER (PARTITION BY d.src ORDER BY {key.format(b='CAST(s.passes AS VARCHAR)')}
                             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM doc d JOIN source_plan s USING (src)),
copy AS (SELECT *, unnest(range(0, passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS block FROM cum),
placed AS (SELECT *, {key.format(b='CAST(block AS VARCHAR)')} AS order_key FROM copy)
SELECT {columns} FROM placed d JOIN source_plan s USING (src)"""
