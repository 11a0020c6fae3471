"""Recordings by subject, samples of a fixed length, classes of coded statements, rows with missing views, kernel components."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import evaluation as E
from viewloom.operators import kernels, recordings
from viewloom.operators import statistics as S
from viewloom.operators import views as V
from viewloom.plans import SERIES, query
from viewloom.plans.multiview import _PRED, _predictions
from viewloom.sources.tables import event_series, table, written


@query(
    """WITH r AS (SELECT o_custkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey IS NOT NULL),
s AS (SELECT o_custkey, avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS pm, stddev_pop(l_extendedprice) AS ps, avg(l_tax) AS tm, stddev_pop(l_tax) AS ts FROM r GROUP BY 1),
p AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5(o_custkey::VARCHAR), 1, 15))::BIGINT, o_custkey) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part FROM s)
SELECT o_custkey, part, l_orderkey, l_linenumber, round((l_quantity - qm) / CASE WHEN qs > 0.001 THEN qs ELSE 1 END, 5) + 0.0 AS quantity,
  round((l_extendedprice - pm) / CASE WHEN ps > 0.001 THEN ps ELSE 1 END, 5) + 0.0 AS price, round((l_tax - tm) / CASE WHEN ts > 0.001 THEN ts ELSE 1 END, 5) + 0.0 AS tax
FROM r JOIN p USING (o_custkey)"""
)
def subject_recordings(spark, d):
    """Recordings (orders with their lines) under their subject (the customer): split by subject, channels scaled per subject."""
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    found = recordings.by_subject(lines.join(owners, "l_orderkey"), "o_custkey", ["quantity", "price", "tax"], 0.8)
    return found.select("o_custkey", "part", "l_orderkey", "l_linenumber", *((F.round(f"z_{c}", 5) + 0.0).alias(c) for c in ("quantity", "price", "tax")))


@query(
    f"""WITH {SERIES}, x AS (SELECT user_id, rn, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS a, CASE WHEN event_type = 'error' THEN 0 ELSE value / 2 END AS b, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY rn), value) AS da FROM series),
w AS (SELECT *, (rn - 1) // 10 AS sample, (rn - 1) % 10 AS pos FROM x),
s AS (SELECT user_id, sample, avg(a) AS m, stddev_pop(a) AS s FROM w GROUP BY 1, 2 HAVING count(*) = 10 AND count(*) FILTER (WHERE a + b = 0) <= 2)
SELECT user_id, sample, pos, round((a - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) + 0.0 AS a, round((b - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) + 0.0 AS b, round(da / CASE WHEN s > 0 THEN s ELSE 1 END, 5) + 0.0 AS da FROM w JOIN s USING (user_id, sample)"""
)
def fixed_samples(spark, d):
    """Samples of ten events; errors are rows without a signal, and a sample with more than a fifth of them goes."""
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("rn"))
    a = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))
    rows = event_series(spark, d).select("user_id", "rn", a.alias("a"), (a / 2).alias("b"), (F.col("value") - F.coalesce(before, "value")).alias("da"))
    found = recordings.fixed_samples(rows, ["user_id"], 10, ["a", "b"], ["da"], zero_share=0.2)
    return found.select("user_id", "sample", "pos", *((F.round(c, 5) + 0.0).alias(c) for c in ("a", "b", "da")))


@query(
    """WITH e AS (SELECT user_id, ts::DATE AS day, json_extract(props, '$.k')::INTEGER AS code FROM events),
c AS (SELECT DISTINCT user_id, day, r_name FROM e LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey) ON n_nationkey = code)
SELECT user_id, day::VARCHAR AS day, coalesce(string_agg(r_name, ',' ORDER BY r_name), '') AS classes, CASE WHEN day(c.day) % 10 = 9 THEN 'test' ELSE 'train' END AS part FROM c GROUP BY user_id, c.day"""
)
def record_classes(spark, d):
    """The classes of all codes that a user's record of a day carries (code: nation, class: its region), split by the fold of the day."""
    statements = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    records = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), F.map_values(F.from_json("props", "map<string,int>")).alias("codes"))
    found = recordings.code_classes(records, ["user_id", "day"], F.col("codes"), statements, "n_nationkey", "r_name")
    part = F.when(F.dayofmonth("day") % 10 == 9, "test").otherwise("train")
    return found.select("user_id", F.col("day").cast("string").alias("day"), F.concat_ws(",", "classes").alias("classes"), part.alias("part"))


@query(
    """WITH q AS (SELECT round(l_quantity / 2)::BIGINT AS a, round(l_tax * 50)::BIGINT AS b FROM lineitem), s AS (SELECT min(a) AS a0, min(b) AS b0, max(a) - min(a) + 1 AS n FROM q)
SELECT a - a0 AS a, b - b0 AS b, (a - a0) + n * (b - b0) AS state, count(*) AS n FROM q, s GROUP BY ALL"""
)
def quantised_states(spark, d):
    """Values as numbered states, alone and jointly, and how often each joint state comes."""
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") / 2).alias("a"), (F.col("l_tax") * 50).alias("b"))
    found = S.quantised(rows, ["a", "b"])
    return found.groupBy(F.col("q_a").alias("a"), F.col("q_b").alias("b"), "state").agg(F.count(F.lit(1)).alias("n"))


# --- rows with missing views -----------------------------------------------------------------------------------

_THREE = """r AS (SELECT id, v0, v1, v2, label FROM (SELECT doc_id AS id, [n_chars / 1000.0::DOUBLE, length(source) / 10.0::DOUBLE] AS v0 FROM documents)
  FULL JOIN (SELECT doc_id AS id, [quality::DOUBLE, toxic::DOUBLE] AS v1 FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) USING (id)
  FULL JOIN (SELECT vec_id AS id, embedding[1:2]::DOUBLE[] AS v2, label FROM embeddings) USING (id))"""
THREE = ["v0", "v1", "v2"]


def _three(spark, d):
    """Rows by id with three views of two entries each; a table without the row leaves its view out."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array(F.col("n_chars") / 1000.0, F.length("source") / 10.0).alias("v0"))
    marks = table(spark, d, "labels").where("quality is not null and toxic is not null").select(F.col("doc_id").alias("id"), F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("v1"))
    codes = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice(A.doubles("embedding"), 1, 2).alias("v2"), "label")
    return texts.join(marks, "id", "full").join(codes, "id", "full")


@query(
    f"""WITH {_THREE}, m AS (SELECT id, list_filter([v0, v1, v2], lambda v: v IS NOT NULL) AS h FROM r), c AS (SELECT id, h, len(h) AS n, [list_sum([v[1] for v in h]) / len(h), list_sum([v[2] for v in h]) / len(h)] AS c FROM m)
SELECT id, n::INTEGER AS available, round(c[1], 6) AS first, round(c[2], 6) AS second, round(list_sum([(v[1] - c[1]) * (v[1] - c[1]) + (v[2] - c[2]) * (v[2] - c[2]) for v in h]) / n, 6) AS spread FROM c"""
)
def mean_codes(spark, d):
    """The mean code of the views that a row has, and how far they lie from it."""
    views = [F.col(v) for v in THREE]
    rows = _three(spark, d).select("id", *THREE, V.available(views).alias("available"), V.mean_code(views, 2).alias("code"))
    return rows.select("id", "available", F.round(F.col("code")[0], 6).alias("first"), F.round(F.col("code")[1], 6).alias("second"), F.round(V.code_spread(views, F.col("code")), 6).alias("spread"))


@query(
    f"""WITH {_THREE}, p AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part FROM r)
SELECT part, id, label, k AS view, round(v[1] + v[2], 6) AS total FROM (SELECT part, id, label, unnest([0, 1, 2])::BIGINT AS k, unnest([v0, v1, v2]) AS v FROM p) WHERE v IS NOT NULL"""
)
def view_training_sets(spark, d):
    """For each part and view the rows that have it, with their labels; views of one row keep its id."""
    rows = V.exact_split(written(_three(spark, d)), ["id"], 0.8)
    return V.per_view(rows, ["part", "id", "label"], THREE).select("part", "id", "label", "view", F.round(F.col("x")[0] + F.col("x")[1], 6).alias("total"))


QUADRANT = [2 * (i // 32) + (i % 8) // 4 for i in range(64)]


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT label, unnest(range(0, 64)) AS i, unnest(e) AS x FROM e), c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2),
g AS (SELECT vec_id, label, i, x, mask FROM (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(e) AS x FROM e), (SELECT unnest(range(1, 15))::INTEGER AS mask)),
f AS (SELECT vec_id, mask, least(greatest(CASE WHEN (mask >> (2 * (i // 32) + (i % 8) // 4)::INTEGER) & 1 = 1 THEN x ELSE m END, 0), 1) AS y FROM g JOIN c USING (label, i))
SELECT vec_id, mask, round(sum(y), 6) AS total, count(*) FILTER (WHERE y = 0) AS clipped FROM f GROUP BY 1, 2"""
)
def sampled_grids(spark, d):
    """Vectors as grids of 8 x 8 with a view per quadrant: the quadrants outside each proper subset come from the class's mean grid, all clipped to 0 to 1."""
    rows = table(spark, d, "embeddings").where("label is not null").select("vec_id", "label", A.doubles("embedding").alias("e"))
    means = rows.groupBy("label").agg(F.array(*(F.avg(F.col("e")[i]) for i in range(64))).alias("m"))
    grids = V.replicate_subsets(rows.join(means, "label"), 4, full=False)
    whole = grids.select("vec_id", "mask", V.overwrite(F.col("e"), F.col("m"), QUADRANT, F.col("mask")).alias("y"))
    return whole.select("vec_id", "mask", F.round(A.total(F.col("y")), 6).alias("total"), F.size(F.filter("y", lambda x: x == 0)).cast("long").alias("clipped"))


@query(
    f"""WITH {_PRED}, a AS (SELECT mask, avg((pred = truth)::INTEGER) AS acc, count(*) AS n FROM pred GROUP BY 1)
SELECT mask, xor(mask::INTEGER, 15)::INTEGER AS missing, n, round(acc, 6) AS accuracy, round(avg(acc) OVER (PARTITION BY bit_count(mask)), 6) AS of_size, round(max(CASE WHEN mask = 15 THEN acc END) OVER (), 6) AS full_set FROM a"""
)
def accuracy_by_missing(spark, d):
    """The accuracy of each subset of views under the views it lacks, beside the mean of its size and that of the full set."""
    by = written(E.accuracy(_predictions(spark, d), ["mask"]))  # 15 rows
    sizes = by.groupBy(E.subset_size(F.col("mask")).alias("size")).agg(F.avg("accuracy").alias("of_size"))
    full = by.where("mask = 15").select(F.col("accuracy").alias("full_set"))
    both = by.withColumn("size", E.subset_size(F.col("mask"))).join(sizes, "size").join(F.broadcast(full), how="cross")
    return both.select("mask", V.complement(F.col("mask"), 4).alias("missing"), "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "of_size", "full_set")))


@query()
def kernel_components(spark, d):
    """The first three kernel components of every row, in the span of 128 landmark rows."""
    rows = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null").select("vec_id", A.doubles("embedding").alias("v"))
    model = kernels.kernel_pca(rows, "v", kernels.landmark_rows(rows, "vec_id", "v", 128), 0.5, 3)
    if model is None:
        return rows.select("vec_id", F.col("v").alias("codes"))
    return rows.select("vec_id", F.transform(kernels.components(F.col("v"), model), lambda x: F.round(x, 5)).alias("codes"))
