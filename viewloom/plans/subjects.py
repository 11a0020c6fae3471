"""Loaders per subject, window features with a kept basis, spectra and their reconstruction, and forecasts of several steps."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import neighbours as K
from viewloom.operators import series as R
from viewloom.operators import statistics as S
from viewloom.plans import SERIES, query
from viewloom.plans.timeseries import WINDOWS
from viewloom.sources import tables as T
from viewloom.sources.tables import event_series, table

E64 = "embedding::DOUBLE[]"
VIEW_SETS = {"price": ["l_extendedprice", "l_discount", "not_a_column"], "amount": ["l_quantity"]}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINES = """n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_returnflag) AS rn FROM lineitem)"""


def _lines(spark, d) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return table(spark, d, "lineitem").withColumn("rn", F.row_number().over(order).cast("long"))


# --- sources -----------------------------------------------------------------------------------------------


@query("SELECT page_id, len(string_split(html, chr(10)))::BIGINT AS n_lines FROM pages")
def line_counts(spark, d):
    return table(spark, d, "pages").select("page_id", T.line_count("html").alias("n_lines"))


@query(f"SELECT vec_id, round(list_sum({E64}), 6) AS total FROM embeddings")
def feature_records(spark, d):
    """Records of kind "feat" without their bookkeeping and label columns."""
    rows = T.clean_record(table(spark, d, "embeddings").withColumn("header", F.lit("x")), ["header", "version"], "feat")
    return rows.select("vec_id", F.round(A.total(A.doubles("embedding")), 6).alias("total"))


@query("SELECT * FROM (VALUES (0, 'price', ['l_extendedprice', 'l_discount']), (1, 'amount', ['l_quantity']), (2, 'rest', ['l_tax'])) AS t(view, name, columns)")
def completed_view_sets(spark, d):
    """View sets restricted to the columns there are; the columns that no view names are the last view."""
    found = T.complete_view_sets(VIEW_SETS, [c for c in MEASURES if c in table(spark, d, "lineitem").columns])
    return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(found.items())], "view int, name string, columns array<string>")


@query(
    f"""WITH {_LINES} SELECT l_suppkey AS subject, rn, l_returnflag AS label, [l_extendedprice, l_discount]::DOUBLE[] AS price, [l_quantity]::DOUBLE[] AS amount, [l_tax]::DOUBLE[] AS rest
FROM n WHERE (rn - 1) % 5 = 0 AND l_returnflag IN ('R', 'A')"""
)
def subject_views(spark, d):
    """The main loader: order per subject, stride, valid labels only, columns split into completed views."""
    rows = _lines(spark, d).where(((F.col("rn") - 1) % 5 == 0) & F.col("l_returnflag").isin("R", "A"))
    views = T.complete_view_sets(VIEW_SETS, MEASURES)
    return rows.select(F.col("l_suppkey").alias("subject"), "rn", F.col("l_returnflag").alias("label"), *(F.array(*(F.col(c).cast("double") for c in cols)).alias(n) for n, cols in views.items()))


_WIN8 = WINDOWS.format(keys="user_id", source="series", w=8)


@query(
    f"""WITH {SERIES}, {_WIN8} SELECT user_id, win, max(CASE WHEN pos = 4 THEN event_type END) AS label, max(CASE WHEN pos = 4 THEN t END) AS centre,
  [round(avg(value), 6), round(min(value), 6), round(max(value), 6)] AS features FROM win GROUP BY 1, 2 HAVING max(CASE WHEN pos = 4 THEN event_type END) <> 'view'"""
)
def windowed_subject_features(spark, d):
    """Window features with the label and time of the window's centre; the first three features; windows of other labels go whole."""
    win = R.count_windows(event_series(spark, d), ["user_id"], 8)
    features = F.array(*(F.round(f("value"), 6) for f in (F.avg, F.min, F.max, F.stddev_pop)))
    middle = lambda c: F.max(F.when(F.col("pos") == 4, F.col(c)))
    found = win.groupBy("user_id", F.col("win").cast("long").alias("win")).agg(middle("event_type").alias("label"), middle("t").alias("centre"), F.slice(features, 1, 3).alias("features"))
    return found.where("label <> 'view'")


@query(
    """SELECT user_id, count(*) AS labels, min(n) AS fewest FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
GROUP BY 1 HAVING count(*) >= 4 AND min(n) >= 3"""
)
def subjects_with_enough_labels(spark, d):
    """Quality gates of a loader: at least four different labels, the rarest of them three times."""
    each = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("user_id").agg(F.count(F.lit(1)).alias("labels"), F.min("n").alias("fewest")).where("labels >= 4 and fewest >= 3")


@query(
    f"""WITH {SERIES}, d AS (SELECT user_id, rn, (lead(value) OVER w - value) / nullif(lead(t) OVER w - t, 0) AS dx FROM series WINDOW w AS (PARTITION BY user_id ORDER BY rn))
SELECT s.user_id, s.rn, s.value, round(d.dx, 9) AS dx FROM series s JOIN d USING (user_id, rn) WHERE d.dx IS NOT NULL"""
)
def values_with_derivatives(spark, d):
    """Samples and their derivatives, trimmed to equal length."""
    series = event_series(spark, d)
    return R.finite_differences(series, ["user_id"], "value").select("user_id", "rn", "value", F.round("dx", 9).alias("dx"))


@query(
    """SELECT e.user_id, e.n AS samples, o.n AS records FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e
JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON e.user_id = o.o_custkey"""
)
def subjects_in_both_sources(spark, d):
    """Only subjects that both sources have; both are aggregated before they meet."""
    count = lambda t, k: table(spark, d, t).groupBy(F.col(k).alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    return count("events", "user_id").withColumnRenamed("n", "samples").join(count("orders", "o_custkey").withColumnRenamed("n", "records"), "user_id").select("user_id", "samples", "records")


# --- descriptive statistics ----------------------------------------------------------------------------------


@query(f"SELECT vec_id, i, round(x - avg(x) OVER (PARTITION BY i), 6) AS centred FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest({E64}) AS x FROM embeddings)")
def centred_columns(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(A.doubles("embedding")).alias("i", "x"))
    means = rows.groupBy("i").agg(F.avg("x").alias("m"))  # one row per dimension
    return rows.join(F.broadcast(means), "i").select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x") - F.col("m"), 6).alias("centred"))


@query(f"WITH {SERIES} SELECT round(0.5 / var_pop(x), 9) AS bandwidth FROM (SELECT value - lag(value) OVER (PARTITION BY user_id, (rn - 1) // 8 ORDER BY rn) AS x FROM series)")
def kernel_bandwidth(spark, d):
    """Half over the variance of the first differences inside windows of eight."""
    rows = event_series(spark, d).withColumn("win", F.expr("(rn - 1) div 8"))
    step = F.col("value") - F.lag("value").over(Window.partitionBy("user_id", "win").orderBy("rn"))
    return rows.select(step.alias("x")).agg(F.round(0.5 / F.var_pop("x"), 9).alias("bandwidth"))


_TAUS = f"""WITH {SERIES}, g AS (SELECT user_id, event_type, rn, lead(rn) OVER (PARTITION BY user_id, event_type ORDER BY rn) - rn AS gap FROM series),
tau AS (SELECT user_id, event_type, min(gap) + max(gap) AS tau FROM g WHERE gap IS NOT NULL GROUP BY ALL)"""


@query(f"{_TAUS} SELECT event_type, CAST(floor(avg(tau)) AS BIGINT) AS floored, CAST(round_even(avg(tau), 0) AS BIGINT) AS rounded FROM tau GROUP BY 1")
def mean_lags(spark, d):
    """The mean lag of each channel over the subjects: cut off, and rounded half to even."""
    own = Window.partitionBy("user_id", "event_type").orderBy("rn")
    gaps = event_series(spark, d).select("user_id", "event_type", (F.lead("rn").over(own) - F.col("rn")).alias("gap")).where("gap is not null")
    taus = gaps.groupBy("user_id", "event_type").agg((F.min("gap") + F.max("gap")).alias("tau"))
    return taus.groupBy("event_type").agg(F.floor(F.avg("tau")).cast("long").alias("floored"), F.bround(F.avg("tau")).cast("long").alias("rounded"))


STATS = {
    "n": "count(*)",
    "mean": "round(avg(x), 6)",
    "sd": "round(stddev_pop(x), 6)",
    "lowest": "min(x)",
    "highest": "max(x)",
    "energy": "round(sum(x * x), 4)",
    "rms": "round(sqrt(avg(x * x)), 6)",
    "turn": "round(sum(abs(step)), 6)",
    "mean_turn": "round(coalesce(avg(abs(step)), 0), 6)",
    "mean_step": "round(coalesce(avg(step), 0), 6)",
    "rises": "coalesce(sum(CASE WHEN step > 0 THEN 1 ELSE 0 END), 0)",
    "above": "sum(CASE WHEN x > m THEN 1 ELSE 0 END)",
    "crossings": "sum(CASE WHEN (x > m) <> (last > m) THEN 1 ELSE 0 END)",
    "first_high": "min(CASE WHEN x = top THEN pos END)",
    "last_low": "max(CASE WHEN x = low THEN pos END)",
    "slope": "round(regr_slope(x, pos), 6)",
}
_STEPS = """SELECT *, x - last AS step FROM (SELECT user_id, win, pos, value AS x, lag(value) OVER (PARTITION BY user_id, win ORDER BY pos) AS last, avg(value) OVER (PARTITION BY user_id, win) AS m,
  max(value) OVER (PARTITION BY user_id, win) AS top, min(value) OVER (PARTITION BY user_id, win) AS low FROM {})"""
_STATS = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in STATS.items())


@query(f"WITH {SERIES}, {_WIN8}, s AS ({_STEPS.format('win')}) SELECT user_id, CAST(win AS BIGINT) AS win, {_STATS} FROM s GROUP BY 1, 2")
def window_statistics(spark, d):
    """Sixteen aggregate features of each window, as one aggregation."""
    x, pos, step = F.col("value"), F.col("pos"), F.col("value") - F.col("last")
    win = R.count_windows(event_series(spark, d), ["user_id"], 8).withColumn("win", F.col("win").cast("long"))
    own = Window.partitionBy("user_id", "win")
    # the mean in the order of the rows, so that a value beside it falls on the same side in every run
    ordered = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = win.select("user_id", "win", "pos", "value", F.lag("value").over(own.orderBy("pos")).alias("last"), F.avg("value").over(ordered).alias("mid"), F.max("value").over(own).alias("top"), F.min("value").over(own).alias("low"))
    several = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))
    features = {
        "n": F.count(F.lit(1)),
        "mean": F.round(F.avg(x), 6),
        "sd": F.round(F.stddev_pop(x), 6),
        "lowest": F.min(x),
        "highest": F.max(x),
        "energy": F.round(F.sum(F.pow(x, 2)), 4),
        "rms": F.round(F.sqrt(F.avg(F.pow(x, 2))), 6),
        "turn": F.round(F.sum(F.abs(step)), 6),
        "mean_turn": several(F.abs(step)),
        "mean_step": several(step),
        "rises": F.count_if(step > 0),
        "above": F.count_if(x > F.col("mid")),
        "crossings": F.count_if((x > F.col("mid")) != (F.col("last") > F.col("mid"))),
        "first_high": F.min_by("pos", F.struct(-x, pos)),
        "last_low": F.max_by("pos", F.struct(-x, pos)),
        "slope": F.round(F.covar_pop(x, pos) / F.var_pop(pos), 6),
    }
    return rows.groupBy("user_id", "win").agg(*(c.cast("double").alias(n) for n, c in features.items()))


@query(f"SELECT i, round(0.5 * (2 * (1 + ln(2 * pi())) + ln(var_pop(x) * var_pop(y) - covar_pop(x, y) ** 2)), 6) AS nats, round(-0.5 * ln(1 - corr(x, y) ** 2), 6) AS shared FROM (SELECT unnest(range(1, 64)) AS i, e FROM (SELECT {E64} AS e FROM embeddings)), LATERAL (SELECT e[i] AS x, e[i + 1] AS y) GROUP BY 1")
def gaussian_entropy(spark, d):
    """Entropy of each two neighbouring dimensions as a normal pair, and the information that they share (the sum of both less the joint)."""
    e = A.doubles("embedding")
    pairs = table(spark, d, "embeddings").select(F.explode(F.sequence(F.lit(1), F.lit(63))).alias("i"), e.alias("e")).select(F.col("i").cast("long").alias("i"), F.element_at("e", F.col("i")).alias("x"), F.element_at("e", F.col("i") + 1).alias("y"))
    det = F.var_pop("x") * F.var_pop("y") - F.pow(F.covar_pop("x", "y"), 2)
    one = lambda v: 0.5 * (1 + F.log(2 * F.pi()) + F.log(F.var_pop(v)))
    joint = 0.5 * (2 * (1 + F.log(2 * F.pi())) + F.log(det))
    return pairs.groupBy("i").agg(F.round(joint, 6).alias("nats"), F.round(one("x") + one("y") - joint, 6).alias("shared"))


# --- spectra, bases and random features -------------------------------------------------------------------------

SIZE = 16
_WIN16 = WINDOWS.format(keys="user_id", source="series", w=SIZE)


@query(
    f"""WITH {SERIES}, {_WIN16} SELECT a.user_id, a.win::BIGINT AS win, a.pos::BIGINT AS pos, round(any_value(a.value), 6) AS whole,
  round(sum(b.value * (1 + 2 * cos(2 * pi() * (a.pos - b.pos) / {SIZE}) + 2 * cos(4 * pi() * (a.pos - b.pos) / {SIZE}))) / {SIZE}, 6) AS smooth
FROM win a JOIN win b ON a.user_id = b.user_id AND a.win = b.win GROUP BY 1, 2, 3"""
)
def spectrum_reconstruction(spark, d):
    """Each window's values again from its spectrum: from all frequencies, and from the lowest three. The twin has the samples themselves."""
    from viewloom.plans.models import _fft

    half = SIZE // 2

    def value(most: int):
        angle = lambda k: F.lit(2 * pi * k / SIZE) * F.col("pos")
        parts = [F.col("re0")] + [2 * (F.col(f"re{k}") * F.cos(angle(k)) - F.col(f"im{k}") * F.sin(angle(k))) for k in range(1, min(most, half - 1) + 1)]
        parts += [F.col(f"re{half}") * F.cos(angle(half))] if most >= half else []
        return F.round(sum(parts[1:], parts[0]) / SIZE, 6)

    rows = _fft(spark, d).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1)).cast("array<bigint>")))
    return rows.select("user_id", "win", "pos", value(half).alias("whole"), value(2).alias("smooth"))


FEATURES = 16
_FRAC = "({x} - floor({x}))"
_W = "0.04 * (" + _FRAC.format(x="(f + 1) * 0.6180339887498949") + " - 0.5)"
_V = "0.04 * (" + _FRAC.format(x="(f + 1) * 0.7548776662466927") + " - 0.5)"
_H = "2 * pi() * " + _FRAC.format(x="(f + 1) * 0.5698402909980532")
_BASIS = f"basis AS (SELECT f, {_W} AS w, {_V} AS v, {_H} AS h FROM (SELECT unnest(range(0, {FEATURES})) AS f))"
_Z = f"sqrt(2.0 / {FEATURES}) * cos(w * x + v * y + h)"


def feature_basis(spark) -> DataFrame:
    """Coefficients of random cosine features: f, w, v, h, from additive recurrences, so that any run has the same."""
    return spark.range(FEATURES).withColumnRenamed("id", "f").selectExpr("f", f"{_W} AS w", f"{_V} AS v", f"{_H} AS h")


@query(
    f"""WITH {SERIES}, {_BASIS}, xy AS (SELECT user_id, rn, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY rn) AS y FROM series)
SELECT user_id, (rn - 1) // {SIZE} AS win, f, round(avg({_Z}), 6) AS feature, count(*) AS n FROM xy, basis WHERE y IS NOT NULL AND user_id % 3 <> 0 GROUP BY 1, 2, 3"""
)
def kept_basis_features(spark, d):
    """Mean features of each window on a basis that was written as a table and is read again, for the subjects that it was not made for."""
    basis = T.kept(feature_basis(spark), "window-basis", ["f"])
    rows = R.delay_embedding(event_series(spark, d), ["user_id"], "value", 1, 2).where("user_id % 3 <> 0")
    rows = rows.select("user_id", F.expr(f"(rn - 1) div {SIZE}").alias("win"), F.col("x0").alias("x"), F.col("x1").alias("y"))
    # sixteen rows of coefficients
    featured = rows.join(F.broadcast(basis), how="cross").groupBy("user_id", "win", F.col("f").cast("long").alias("f"))
    return featured.agg(F.round(F.avg(F.expr(_Z)), 6).alias("feature"), F.count(F.lit(1)).alias("n"))


_XY = "xy AS (SELECT *, value AS x, after AS y FROM win)"


@query(
    f"""WITH {SERIES}, led AS (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY rn) AS after FROM series), kept AS (SELECT * FROM led WHERE after IS NOT NULL),
{WINDOWS.format(keys="user_id", source="kept", w=SIZE)}, {_XY}, {_BASIS} SELECT user_id, win::BIGINT AS win, f, round(avg({_Z}), 6) AS feature FROM xy, basis GROUP BY 1, 2, 3"""
)
def random_feature_means(spark, d):
    """Mean random Fourier features of each window's delay embedding; sixteen coefficients are broadcast."""
    win = R.count_windows(R.delay_embedding(event_series(spark, d), ["user_id"], "value", 1, 2), ["user_id"], SIZE)
    rows = win.select("user_id", F.col("win").cast("long").alias("win"), F.col("x0").alias("x"), F.col("x1").alias("y")).join(F.broadcast(feature_basis(spark)), how="cross")
    return rows.groupBy("user_id", "win", "f").agg(F.round(F.avg(F.expr(_Z)), 6).alias("feature"))


@query(
    f"""WITH {SERIES}, {_BASIS}, xy AS (SELECT user_id, rn, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY rn) AS y FROM series),
z AS (SELECT user_id, rn, x, y, f, {_Z} AS z FROM xy, basis WHERE y IS NOT NULL)
SELECT a.user_id, a.rn, round(sum(a.z * b.z), 6) AS approximate, round(exp(-0.0001 * ((any_value(a.x) - any_value(b.x)) ** 2 + (any_value(a.y) - any_value(b.y)) ** 2)), 6) AS exact
FROM z a JOIN z b ON a.user_id = b.user_id AND b.rn = a.rn + 1 AND a.f = b.f GROUP BY 1, 2"""
)
def random_kernel(spark, d):
    """The kernel of neighbouring points as a product of their features, beside the exact one."""
    basis = F.broadcast(feature_basis(spark).agg(F.array_sort(F.collect_list(F.struct("f", "w", "v", "h"))).alias("basis")))
    rows = R.delay_embedding(event_series(spark, d), ["user_id"], "value", 1, 2).join(basis, how="cross")
    z = lambda x, y: F.transform("basis", lambda b: F.sqrt(F.lit(2.0 / FEATURES)) * F.cos(b["w"] * F.col(x) + b["v"] * F.col(y) + b["h"]))
    own = Window.partitionBy("user_id").orderBy("rn")
    rows = rows.select("user_id", "rn", "x0", "x1", "basis", F.lead("x0").over(own).alias("y0"), F.lead("x1").over(own).alias("y1")).where("y1 is not null")
    far = F.pow(F.col("x0") - F.col("y0"), 2) + F.pow(F.col("x1") - F.col("y1"), 2)
    return rows.select("user_id", "rn", F.round(A.dot(z("x0", "x1"), z("y0", "y1")), 6).alias("approximate"), F.round(F.exp(-0.0001 * far), 6).alias("exact"))


TERMS = 4
_COS = "cos(pi() * k * (rn - 0.5) / n)"
_COEF = f"""n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM series),
c AS (SELECT user_id, k, sum(value * {_COS}) * (CASE WHEN k = 0 THEN 1 ELSE 2 END) / max(n) AS c FROM n, (SELECT unnest(range(0, {TERMS})) AS k) WHERE n >= 8 GROUP BY user_id, k)"""


def _coefficients(series: DataFrame) -> DataFrame:
    """user_id, n, c0 ...: least-squares coefficients on cosines, which are orthogonal on the midpoints, so they are plain sums."""
    rows = series.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).where("n >= 8")
    at = lambda k: F.cos(F.lit(pi * k) * (F.col("rn") - 0.5) / F.col("n"))
    return rows.groupBy("user_id", "n").agg(*((F.sum(F.col("value") * at(k)) * (1 if k == 0 else 2) / F.max("n")).alias(f"c{k}") for k in range(TERMS)))


@query(f"WITH {SERIES}, {_COEF} SELECT user_id, k, round(c, 6) AS coefficient FROM c")
def basis_coefficients(spark, d):
    found = _coefficients(event_series(spark, d))
    return found.select("user_id", F.posexplode(F.array(*(f"c{k}" for k in range(TERMS)))).alias("k", "c")).select("user_id", F.col("k").cast("long").alias("k"), F.round("c", 6).alias("coefficient"))


@query(f"WITH {SERIES}, {_COEF} SELECT user_id, rn, round(sum(c.c * {_COS}), 6) AS fitted, round(any_value(value) - sum(c.c * {_COS}), 6) AS rest FROM n JOIN c USING (user_id) GROUP BY 1, 2")
def basis_approximation(spark, d):
    """Functions projected on the basis and evaluated again at their samples."""
    series = event_series(spark, d)
    rows = series.join(_coefficients(series), "user_id")
    parts = [F.col(f"c{k}") * F.cos(F.lit(pi * k) * (F.col("rn") - 0.5) / F.col("n")) for k in range(TERMS)]
    fitted = sum(parts[1:], parts[0])
    return rows.select("user_id", "rn", F.round(fitted, 6).alias("fitted"), F.round(F.col("value") - fitted, 6).alias("rest"))


# --- forecasts ---------------------------------------------------------------------------------------------------

GAMMA = 0.01
_PAIRS = "pairs AS (SELECT user_id, rn, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY rn) AS y FROM series)"
_NW = f"sum(exp(-{GAMMA} * (q.x - p.x) ** 2) * p.y) / sum(exp(-{GAMMA} * (q.x - p.x) ** 2))"


@query(
    f"""WITH {SERIES}, {_PAIRS}, s0 AS (SELECT user_id, arg_max(value, rn) AS x FROM series GROUP BY 1),
s1 AS (SELECT q.user_id, {_NW} AS x FROM s0 q JOIN pairs p USING (user_id) WHERE p.y IS NOT NULL GROUP BY 1),
s2 AS (SELECT q.user_id, {_NW} AS x FROM s1 q JOIN pairs p USING (user_id) WHERE p.y IS NOT NULL GROUP BY 1),
s3 AS (SELECT q.user_id, {_NW} AS x FROM s2 q JOIN pairs p USING (user_id) WHERE p.y IS NOT NULL GROUP BY 1)
SELECT user_id, step, round(x, 6) AS forecast FROM (SELECT *, 1 AS step FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3)"""
)
def k_step_forecast(spark, d):
    """Three steps beyond the end of each series, each from the one before, by the kernel-weighted mean of what followed."""
    series = event_series(spark, d)
    pairs = R.next_values(series, ["user_id"], "value").select("user_id", F.col("value").alias("x"), F.col("target").alias("y"))
    now, found = series.groupBy("user_id").agg(F.max_by("value", "rn").alias("now")), []
    for step in range(1, 4):
        near = pairs.join(now, "user_id").withColumn("d2", F.pow(F.col("x") - F.col("now"), 2))
        now = T.written(K.nadaraya_watson(near, ["user_id"], "y", "d2", GAMMA).withColumnRenamed("forecast", "now"), "steps")
        found.append(now.select("user_id", F.lit(step).alias("step"), F.round("now", 6).alias("forecast")))
    return found[0].union(found[1]).union(found[2])


@query(
    f"""WITH {SERIES}, {_PAIRS}, q AS (SELECT rn, x, y FROM pairs WHERE user_id = (SELECT min(user_id) FROM events) AND rn <= 6 AND y IS NOT NULL),
f AS (SELECT p.user_id, q.rn, any_value(q.y) AS truth, {_NW} AS guess FROM q, pairs p WHERE p.y IS NOT NULL GROUP BY 1, 2)
SELECT user_id, round(avg(abs(guess - truth)), 6) AS distance FROM f GROUP BY 1 ORDER BY distance, user_id LIMIT 10"""
)
def nearest_by_forecast(spark, d):
    """The ten series under which a test window (the start of the first series) is forecast best: a top-k report."""
    series = event_series(spark, d)
    pairs = R.next_values(series, ["user_id"], "value").select("user_id", "rn", F.col("value").alias("x"), F.col("target").alias("y"))
    first = series.agg(F.min("user_id").alias("u"))
    test = pairs.join(F.broadcast(first), F.col("user_id") == F.col("u")).where("rn <= 6").select("rn", F.col("x").alias("qx"), F.col("y").alias("truth"))
    # a test window has six rows
    near = pairs.drop("rn").join(F.broadcast(test), how="cross").withColumn("d2", F.pow(F.col("x") - F.col("qx"), 2))
    guess = K.nadaraya_watson(near, ["user_id", "rn", "truth"], "y", "d2", GAMMA)
    return guess.groupBy("user_id").agg(F.round(F.avg(F.abs(F.col("forecast") - F.col("truth"))), 6).alias("distance")).orderBy("distance", "user_id").limit(10)


@query(f"SELECT i, quantile_cont(abs(x), 0.9) AS q FROM (SELECT unnest(range(0, 64)) AS i, unnest({E64}) AS x FROM embeddings) GROUP BY 1")
def exact_quantiles(spark, d):
    """The 0.9 quantile of every dimension's size, from ranks over range partitions: no task holds all values of a dimension."""
    rows = table(spark, d, "embeddings").select(F.posexplode(A.doubles("embedding")).alias("i", "x")).select(F.col("i").cast("long").alias("i"), F.abs("x").alias("x"))
    return S.exact_quantile(rows, "x", 0.9, "i").withColumnRenamed("quantile", "q")


@query(
    f"""WITH v AS (SELECT vec_id, label, {E64} AS e FROM embeddings), q AS (SELECT i, 3 * quantile_cont(abs(x), 0.9) AS most FROM (SELECT unnest(range(1, 5)) AS i, unnest(e[1:4]) AS x FROM v) GROUP BY 1),
o AS (SELECT vec_id, bool_and(abs(e[i]) < most) AS inside, any_value(label) % 2 AS y, any_value(e[1] > 0)::INTEGER AS guess FROM v, q GROUP BY 1)
SELECT count(*) AS n, sum(inside::INTEGER)::BIGINT AS inliers, round(avg((inside AND guess = y)::INTEGER), 6) AS outliers_wrong, round(avg(CASE WHEN inside THEN (guess = y)::INTEGER END), 6) AS inliers_only FROM o"""
)
def inlier_accuracy(spark, d):
    """Accuracy when rows beyond three times the 0.9 quantile in any dimension count as wrong, and over the other rows."""
    rows = table(spark, d, "embeddings").select("label", F.slice(A.doubles("embedding"), 1, 4).alias("e"))
    limits = S.exact_quantile(rows.select(F.posexplode("e").alias("i", "x")).select("i", F.abs("x").alias("x")), "x", 0.9, "i")
    most = limits.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "quantile"))), lambda q: 3 * q["quantile"]).alias("most"))
    inside = F.forall(F.zip_with("e", "most", lambda x, m: F.abs(x) < m), lambda b: b)
    right = (F.when(F.col("e")[0] > 0, 1).otherwise(0) == F.col("label") % 2).cast("int")
    found = rows.join(F.broadcast(most), how="cross").select(inside.alias("inside"), right.alias("right"))
    return found.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("inside").cast("long")).alias("inliers"),
        F.round(F.avg(F.when(F.col("inside"), F.col("right")).otherwise(0)), 6).alias("outliers_wrong"),
        F.round(F.avg(F.when(F.col("inside"), F.col("right"))), 6).alias("inliers_only"),
    )
