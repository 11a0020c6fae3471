"""Views, neighbours, prox operators, flows, evaluation and sources as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import evaluation as E
from viewloom.operators import neighbours as K
from viewloom.operators import views as V
from viewloom.plans import SERIES, query
from viewloom.sources import tables as T
from viewloom.sources.tables import event_series, table

E64 = "embedding::DOUBLE[]"


def _views(spark, d):
    v = V.split_vector(A.doubles("embedding"), [16] * 4)
    return table(spark, d, "embeddings").select("vec_id", "label", *(x.alias(f"v{i}") for i, x in enumerate(v)))


def _sum(c):
    return F.round(A.total(c), 6)


@query(
    f"SELECT vec_id, i AS view, round(list_sum(e[i * 16 + 1 : i * 16 + 16]), 6) AS total, 16 AS width FROM (SELECT vec_id, {E64} AS e, unnest(range(0, 4)) AS i FROM embeddings)"
)
def view_split_concat(spark, d):
    v = _views(spark, d)
    whole = V.concat_views([F.col(f"v{i}") for i in range(4)])
    long = v.select("vec_id", F.posexplode(F.array(*(F.slice(whole, 1 + 16 * i, 16) for i in range(4)))).alias("view", "x"))
    return long.select("vec_id", F.col("view").cast("long"), _sum(F.col("x")).alias("total"), F.size("x").alias("width"))


@query(
    """SELECT doc_id, coalesce(quality, 0)::DOUBLE AS quality, coalesce(toxic, 0)::DOUBLE AS toxic, CAST(quality IS NOT NULL AS INTEGER) AS b_label
FROM documents LEFT JOIN labels USING (doc_id)"""
)
def view_fill_missing(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("view"))
    rows = table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    full = V.fill_view(F.col("view"), 2)
    return rows.select("doc_id", full[0].alias("quality"), full[1].alias("toxic"), F.col("view").isNotNull().cast("int").alias("b_label"))


@query(
    """SELECT doc_id, [n_chars::DOUBLE, coalesce(quality, 0)::DOUBLE, coalesce(toxic, 0)::DOUBLE, 1.0::DOUBLE, b, b] AS x
FROM (SELECT *, CAST(quality IS NOT NULL AS DOUBLE) AS b FROM documents LEFT JOIN labels USING (doc_id))"""
)
def zero_impute_flags(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("v1"))
    rows = table(spark, d, "documents").select("doc_id", F.array(F.col("n_chars").cast("double")).alias("v0")).join(labels, "doc_id", "left")
    return rows.select("doc_id", V.zero_impute([F.col("v0"), F.col("v1")], [1, 2]).alias("x"))


@query(
    f"""SELECT vec_id, mask, bit_count(mask::INTEGER)::INTEGER AS size, round(list_sum(list_transform(range(0, 4), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN list_sum(e[i * 16 + 1 : i * 16 + 16]) ELSE 0 END)), 6) AS total
FROM (SELECT vec_id, {E64} AS e, unnest(range(1, 16))::INTEGER AS mask FROM embeddings)"""
)
def subset_lattice_replicate(spark, d):
    sums = _views(spark, d).select("vec_id", F.array(*(A.total(F.col(f"v{i}")) for i in range(4))).alias("s"))
    rows = V.replicate_subsets(sums, 4)
    parts = sum((F.when(F.getbit(F.col("mask").cast("long"), F.lit(i)) == 1, F.col("s")[i]).otherwise(0.0) for i in range(4)), F.lit(0.0))
    return rows.select("vec_id", "mask", E.subset_size(F.col("mask")).alias("size"), F.round(parts, 6).alias("total"))


@query(
    "SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY vec_id) - 1 < floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part FROM embeddings"
)
def exact_split_80_20(spark, d):
    return V.exact_split(table(spark, d, "embeddings").select("vec_id"), ["vec_id"], 0.8).select("vec_id", "part")


@query(
    """SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
WHERE r <= round_even(n * 0.2, 0)"""
)
def stratified_topk_by_hash(spark, d):
    return V.stratified_head(table(spark, d, "embeddings").select("vec_id", "label"), "label", [F.md5(F.col("vec_id").cast("string")), F.col("vec_id")], 0.2)


@query("SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 50 AS batch, (row_number() OVER (ORDER BY vec_id) - 1) % 50 AS pos FROM embeddings")
def batch_ids(spark, d):
    found = V.ranks(table(spark, d, "embeddings").select("vec_id"), ["vec_id"])
    return found.select("vec_id", F.expr("rank div 50").alias("batch"), F.expr("rank % 50").cast("long").alias("pos"))


_D2 = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(
    f"""WITH p AS (SELECT vec_id, {E64} AS e FROM embeddings)
SELECT a.vec_id AS query, b.vec_id AS neighbour, round(sqrt({_D2}), 6) AS dist FROM p a, p b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt({_D2}), b.vec_id) <= 3"""
)
def knn_join_k3(spark, d):
    """The stated queries are the rows whose id is divisible by 100, against all rows."""
    e = table(spark, d, "embeddings")
    return K.knn(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 3).select("query", "neighbour", F.round("dist", 6).alias("dist"))


@query(
    f"""WITH p AS (SELECT vec_id, {E64} AS e FROM embeddings),
k AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, sqrt({_D2}) AS dist FROM p a, p b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt({_D2}), b.vec_id) <= 5)
SELECT query, count(*) AS n, round(avg(e[1]), 6) AS forecast, round(sum(exp(-0.05 * dist * dist) * e[1]) / sum(exp(-0.05 * dist * dist)), 6) AS weighted
FROM k JOIN p ON p.vec_id = k.neighbour + 1 GROUP BY 1"""
)
def one_step_knn_forecast(spark, d):
    """Mean and kernel-weighted mean of the successors (next vec_id) of the five nearest rows."""
    e = table(spark, d, "embeddings")
    near = K.knn(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    after = e.select((F.col("vec_id") - 1).alias("neighbour"), F.col("embedding")[0].cast("double").alias("next"))
    w = F.exp(-0.05 * F.col("dist") * F.col("dist"))
    rows = near.join(after, "neighbour")
    return rows.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("next"), 6).alias("forecast"), F.round(F.sum(w * F.col("next")) / F.sum(w), 6).alias("weighted"))


@query(
    f"""WITH {SERIES}, x AS (SELECT user_id, rn, value, lead(value) OVER (PARTITION BY user_id ORDER BY rn) AS nxt FROM series),
q AS (SELECT user_id, value FROM series QUALIFY rn = max(rn) OVER (PARTITION BY user_id))
SELECT q.user_id, round(sum(exp(-0.001 * (x.value - q.value) * (x.value - q.value)) * nxt) / sum(exp(-0.001 * (x.value - q.value) * (x.value - q.value))), 6) AS forecast
FROM q JOIN x USING (user_id) WHERE nxt IS NOT NULL GROUP BY 1"""
)
def nw_rbf_forecast(spark, d):
    """Each user's next value, from where the user's values went before."""
    own = Window.partitionBy("user_id").orderBy("rn")
    rows = event_series(spark, d).select("user_id", "rn", "value", F.lead("value").over(own).alias("nxt"))
    last = rows.groupBy("user_id").agg(F.max_by("value", "rn").alias("q"))
    pairs = rows.where("nxt is not null").join(last, "user_id").withColumn("d2", (F.col("value") - F.col("q")) ** 2)
    return K.nadaraya_watson(pairs, ["user_id"], "nxt", "d2", 0.001).select("user_id", F.round("forecast", 6).alias("forecast"))


@query(
    f"""WITH {SERIES}, tgt AS (SELECT list(value ORDER BY rn) AS y FROM series WHERE user_id = (SELECT min(user_id) FROM series) AND rn <= 4),
w AS (SELECT user_id, rn, [value, lead(value, 1) OVER o, lead(value, 2) OVER o, lead(value, 3) OVER o] AS x FROM series WINDOW o AS (PARTITION BY user_id ORDER BY rn)),
dd AS (SELECT user_id, rn, sqrt((x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2 + (x[4] - y[4]) ** 2) AS dist FROM w, tgt WHERE x[4] IS NOT NULL)
SELECT user_id, rn + 2 AS centre, round(dist, 6) AS dist FROM dd QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY dist, rn) = 1"""
)
def sliding_euclid_match(spark, d):
    """Where the first four values of the first user fit best in every series; the centre of the best place."""
    series = event_series(spark, d)
    first = series.agg(F.min("user_id")).first()[0]
    target = [r["value"] for r in series.where((F.col("user_id") == first) & (F.col("rn") <= 4)).orderBy("rn").collect()]
    own = Window.partitionBy("user_id").orderBy("rn")
    parts = [(F.lead("value", i).over(own) - y) ** 2 for i, y in enumerate(target)]
    rows = series.select("user_id", "rn", F.sqrt(sum(parts[1:], parts[0])).alias("dist")).where("dist is not null")
    best = rows.groupBy("user_id").agg(F.min(F.struct("dist", "rn")).alias("b"))
    return best.select("user_id", (F.col("b.rn") + 2).alias("centre"), F.round("b.dist", 6).alias("dist"))


@query("SELECT event_id, round(sign(value - 50) * greatest(abs(value - 50) - 10, 0), 6) AS v FROM events")
def soft_threshold(spark, d):
    return table(spark, d, "events").select("event_id", F.round(A.soft_threshold(F.col("value") - 50, 10.0), 6).alias("v"))


@query(
    f"""WITH n AS (SELECT vec_id, e[1:16] AS v, sqrt(list_sum(list_transform(e[1:16], lambda x: x * x))) AS size FROM (SELECT vec_id, {E64} AS e FROM embeddings))
SELECT vec_id, round(list_sum(v) * CASE WHEN size > 0.5 THEN 1 - 0.5 / size ELSE 0 END, 6) AS total FROM n"""
)
def prox_l2_group(spark, d):
    return _views(spark, d).select("vec_id", _sum(A.prox_l2("v0", 0.5)).alias("total"))


@query(
    f"""WITH n AS (SELECT vec_id, e[1:16] AS v, sqrt(list_sum(list_transform(e[1:16], lambda x: x * x))) AS size FROM (SELECT vec_id, {E64} AS e FROM embeddings))
SELECT vec_id, round(list_sum(v) * CASE WHEN size > 0.5 THEN 0.5 / size ELSE 1 END, 6) AS total FROM n"""
)
def project_l2_ball(spark, d):
    return _views(spark, d).select("vec_id", _sum(A.project_l2_ball("v0", 0.5)).alias("total"))


@query(
    f"""SELECT vec_id, round(list_sum(list_transform(e, lambda x: CASE WHEN x < 0 THEN x * 0.1 ELSE x END)), 6) AS total,
round(len(list_filter(e, lambda x: x < 0)) * ln(0.1), 6) AS logdet FROM (SELECT vec_id, {E64} AS e FROM embeddings)"""
)
def leaky_relu_logdet(spark, d):
    y, logdet = A.leaky_relu(A.doubles("embedding"), 0.1)
    return table(spark, d, "embeddings").select("vec_id", _sum(y).alias("total"), F.round(logdet, 6).alias("logdet"))


@query(
    f"""WITH p AS (SELECT vec_id, list_transform({E64}, lambda x: 1 / (1 + exp(-x))) AS s FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(s, lambda x: ln(x) - ln(1 - x))), 6) AS total, round(list_sum(list_transform(s, lambda x: -ln(x) - ln(1 - x))), 6) AS logdet,
round(list_sum(list_transform(s, lambda x: ln(x) + ln(1 - x))), 6) AS back FROM p"""
)
def logit_logdet(spark, d):
    s, back = A.sigmoid(A.doubles("embedding"))
    y, logdet = A.logit(F.col("s"))
    rows = table(spark, d, "embeddings").select("vec_id", s.alias("s"), F.round(back, 6).alias("back"))
    return rows.select("vec_id", _sum(y).alias("total"), F.round(logdet, 6).alias("logdet"), "back")


@query(f"SELECT vec_id, round(list_sum(list_transform({E64}, lambda x: x * x)) / 2 + 32 * ln(2 * pi()), 6) AS nll FROM embeddings")
def std_normal_nll(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(A.normal_nll(A.doubles("embedding")), 6).alias("nll"))


@query(
    f"""WITH p AS (SELECT e[1] AS a, e[2] AS b, vec_id FROM (SELECT vec_id, {E64} AS e FROM embeddings))
SELECT vec_id, round(1 + a + b + a * a + a * b + b * b, 6) AS total, 6 AS n FROM p"""
)
def poly_features_deg2(spark, d):
    v = A.doubles("embedding")
    parts = A.monomials([v[0], v[1]], 2)
    return table(spark, d, "embeddings").select("vec_id", F.round(sum(parts[1:], parts[0]), 6).alias("total"), F.lit(len(parts)).alias("n"))


@query(
    """WITH s AS (SELECT event_id, value / 500 AS x FROM events), k AS (SELECT unnest(range(0, 4)) AS k)
SELECT event_id, k, round(CASE WHEN k = 0 THEN 1 ELSE sqrt(2) * cos(k * pi() * x) END, 6) AS basis FROM s, k"""
)
def cosine_basis_eval(spark, d):
    x = F.col("value") / 500
    parts = [F.lit(1.0)] + [F.sqrt(F.lit(2.0)) * F.cos(k * F.pi() * x) for k in range(1, 4)]
    rows = table(spark, d, "events").select("event_id", F.posexplode(F.array(*parts)).alias("k", "b"))
    return rows.select("event_id", F.col("k").cast("long"), F.round("b", 6).alias("basis"))


#: Frequencies and phases of a fixed random-feature map.
RFF = [(0.010, 0.5), (-0.023, 1.9), (0.041, 3.1), (0.007, 4.4)]


@query(
    "WITH c(f, w, h) AS (VALUES " + ", ".join(f"({i}, {w}::DOUBLE, {h}::DOUBLE)" for i, (w, h) in enumerate(RFF)) + ") "
    "SELECT user_id, f, round(avg(sqrt(0.5) * cos(value * w + h)), 6) AS feature FROM events, c GROUP BY 1, 2"
)
def mean_map_features(spark, d):
    terms = [F.round(F.avg(F.sqrt(F.lit(2.0 / len(RFF))) * F.cos(F.col("value") * w + h)), 6).alias(f"f{i}") for i, (w, h) in enumerate(RFF)]
    rows = table(spark, d, "events").groupBy("user_id").agg(*terms)
    return rows.select("user_id", F.posexplode(F.array(*(f"f{i}" for i in range(len(RFF))))).alias("f", "feature"))


# --- evaluation: a score per view subset predicts the label by thresholds --------------------------------------

_PRED = f"""s AS (SELECT vec_id, label, {E64} AS e, unnest(range(1, 16))::INTEGER AS mask FROM embeddings),
pred AS (SELECT vec_id, mask, label AS truth,
  CAST(floor(abs(list_sum(list_transform(range(0, 4), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN round(e[i * 16 + 1] * 1000) ELSE 0 END)))) % 10 AS INTEGER) AS pred,
  CAST(floor(abs(round(e[64] * 1000))) % 10 AS INTEGER) AS ref FROM s)"""


def _predictions(spark, d):
    """A stand-in predictor, the same in SQL: digits of the first value of each view in the subset."""
    v = A.doubles("embedding")
    rows = V.replicate_subsets(table(spark, d, "embeddings").select("vec_id", "label", v.alias("e")), 4)
    parts = sum((F.when(F.getbit(F.col("mask").cast("long"), F.lit(i)) == 1, F.round(F.col("e")[16 * i] * 1000)).otherwise(0.0) for i in range(4)), F.lit(0.0))
    digit = lambda c: (F.floor(F.abs(c)) % 10).cast("int")
    return rows.select("vec_id", "mask", F.col("label").alias("truth"), digit(parts).alias("pred"), digit(F.round(F.col("e")[63] * 1000)).alias("ref"))


@query(f"WITH {_PRED} SELECT mask, round(avg((pred = truth)::INTEGER), 6) AS accuracy, count(*) AS n FROM pred GROUP BY 1")
def accuracy_by_subset(spark, d):
    return E.accuracy(_predictions(spark, d), ["mask"]).select("mask", F.round("accuracy", 6).alias("accuracy"), "n")


@query(
    f"""WITH {_PRED}, a AS (SELECT mask, avg((pred <> truth)::INTEGER) AS err FROM pred GROUP BY 1)
SELECT CAST(bit_count(mask) AS INTEGER) AS size, count(*) AS subsets, round(avg(err), 6) AS error FROM a GROUP BY 1"""
)
def subset_error_by_size(spark, d):
    by = E.accuracy(_predictions(spark, d), ["mask"])
    return by.groupBy(E.subset_size(F.col("mask")).alias("size")).agg(F.count(F.lit(1)).alias("subsets"), F.round(F.avg(1 - F.col("accuracy")), 6).alias("error"))


@query(
    f"""WITH {_PRED} SELECT CAST(bit_count(mask) AS INTEGER) AS size, count(*) FILTER (WHERE ref = truth AND pred = truth) AS both_right, count(*) FILTER (WHERE ref = truth AND pred <> truth) AS only_ref,
count(*) FILTER (WHERE ref <> truth AND pred = truth) AS only_pred, count(*) FILTER (WHERE ref <> truth AND pred <> truth) AS both_wrong FROM pred GROUP BY 1"""
)
def mcnemar_matrix(spark, d):
    rows = _predictions(spark, d).withColumn("size", E.subset_size(F.col("mask")))
    return E.mcnemar(rows, ["size"])


@query(f"WITH {_PRED} SELECT truth, pred, count(*) AS n FROM pred WHERE truth <> pred GROUP BY 1, 2")
def confusion_counts(spark, d):
    return E.confusion(_predictions(spark, d), wrong_only=True)


# --- sources ---------------------------------------------------------------------------------------------------


@query(
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS section,
TRY_CAST(regexp_extract(url, '^[a-z]+://[^/]+/[^/?#]*/([0-9]+)', 1) AS BIGINT) AS number FROM pages"""
)
def file_name_catalog(spark, d):
    return T.name_catalog(table(spark, d, "pages").select("page_id", "url"), "url").drop("url")


@query(
    """SELECT f[1] AS c0, f[2] AS c1, f[3] AS c2 FROM (SELECT string_split(p_name || CASE WHEN p_partkey % 7 = 0 THEN ' ragged' ELSE '' END || ' ' || p_brand, ' ') AS f FROM part) WHERE len(f) = 3"""
)
def clean_malformed_rows(spark, d):
    text = F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, " ragged").otherwise(""), F.lit(" "), "p_brand")
    return T.read_delimited(table(spark, d, "part").select(text.alias("value")), ["c0", "c1", "c2"], " ")


@query(
    """WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN role ELSE turn || chr(9) || upper(role) || ' ' END AS v FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, TRY_CAST(string_split(v, chr(9))[1] AS DOUBLE) AS t, lower(trim(string_split(v, chr(9))[2])) AS text
FROM l WHERE contains(v, chr(9))"""
)
def annotation_parse(spark, d):
    value = F.when(F.col("turn") % 4 == 3, F.col("role")).otherwise(F.concat(F.col("turn").cast("string"), F.lit("\t"), F.upper("role"), F.lit(" ")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", value.alias("value"))
    return T.parse_annotations(rows, "conv_id", "turn").select("conv_id", F.col("k").cast("long"), "t", "text")


@query(
    f"""WITH {SERIES}, m AS (SELECT user_id, rn, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS v FROM series),
b AS (SELECT user_id, rn, v, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS r0,
  first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS r1 FROM m
  WINDOW p AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, rn, round(coalesce(v, v0 + (v1 - v0) * (rn - r0) / nullif(r1 - r0, 0), v0, v1), 6) AS v FROM b"""
)
def linear_interp_missing(spark, d):
    rows = event_series(spark, d).select("user_id", "rn", F.when(~F.col("event_type").isin("error", "view"), F.col("value")).alias("v"))
    return T.interpolate_missing(rows, "user_id", "rn", "v").select("user_id", "rn", F.round("v", 6).alias("v"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_map_lookup(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "map<string,int>")["k"].alias("k"))
