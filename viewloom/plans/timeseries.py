"""Segments, windows, smoothing, embeddings, labels and the synchronisation pipeline on the event series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from viewloom.operators import labels as L
from viewloom.operators import series as R
from viewloom.operators import statistics as S
from viewloom.plans import SERIES, query
from viewloom.sources.tables import event_series, table

GAP = 6 * 3600.0
SEGMENTS = f"""{SERIES},
gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY rn) AS step FROM series),
seg AS (SELECT *, CAST(sum(CASE WHEN step > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS BIGINT) AS seg FROM gaps)"""
WINDOWS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rn) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
win AS (
  SELECT *, i // {w} AS win, i % {w} AS pos FROM numbered WHERE i < n // {w} * {w}
  UNION ALL
  SELECT *, n // {w} AS win, i - n + {w} AS pos FROM numbered WHERE n % {w} > 0 AND n >= {w} AND i >= n - {w})"""


def _series(spark, d):
    return event_series(spark, d)


@query(f"WITH {SEGMENTS} SELECT user_id, rn, seg FROM seg")
def session_segments(spark, d):
    return R.segments(_series(spark, d), "user_id", GAP).select("user_id", "rn", F.col("seg").cast("long"))


@query(f"WITH {SERIES}, {WINDOWS.format(keys='user_id', source='series', w=8)} SELECT user_id, rn, win, pos FROM win")
def count_windows_tail_overlap(spark, d):
    return R.count_windows(_series(spark, d), ["user_id"], 8).select("user_id", "rn", F.col("win").cast("long"), F.col("pos").cast("long"))


@query(
    f"""WITH {SEGMENTS}, {WINDOWS.format(keys='user_id, seg', source='seg', w=4)}
SELECT user_id, seg, win, count(*) AS n, round(min(t), 6) AS t0, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS spread
FROM win GROUP BY ALL"""
)
def ts_session_windows(spark, d):
    found = R.count_windows(R.segments(_series(spark, d), "user_id", GAP), ["user_id", "seg"], 4)
    return found.groupBy("user_id", F.col("seg").cast("long").alias("seg"), F.col("win").cast("long").alias("win")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("t"), 6).alias("t0"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value") - F.min("value"), 6).alias("spread")
    )


@query(
    """SELECT l_orderkey, (l_linenumber - 1) // 2 AS win, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem
JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(*) % 2 = 0 AND max(l_linenumber) = count(*)) USING (l_orderkey)
GROUP BY ALL"""
)
def unit_windows(spark, d):
    """Windows of two cycles per unit (an order, its lines as cycles), of units with whole windows only."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    sizes = line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"), F.max("l_linenumber").alias("m")).where("c >= 2 and c % 2 = 0 and m = c")
    rows = line.join(sizes, "l_orderkey").withColumn("win", F.expr("(l_linenumber - 1) div 2").cast("int"))
    return rows.groupBy("l_orderkey", "win").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


_BOX = "sum(value) OVER (PARTITION BY {k} ORDER BY rn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3"


@query(f"WITH {SERIES} SELECT user_id, rn, round({_BOX.format(k='user_id')}, 6) AS smooth FROM series")
def box_smooth_zero_pad(spark, d):
    return R.box_smooth(_series(spark, d), ["user_id"], "value").select("user_id", "rn", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {SEGMENTS} SELECT user_id, rn, round({_BOX.format(k='user_id, seg')}, 6) AS smooth FROM seg")
def segment_smooth(spark, d):
    return R.box_smooth(R.segments(_series(spark, d), "user_id", GAP), ["user_id", "seg"], "value").select("user_id", "rn", F.round("smooth", 6).alias("smooth"))


@query(
    f"""WITH {SERIES}, l AS (SELECT user_id, rn, (value + 2 * lag(value, 1) OVER w + 3 * lag(value, 2) OVER w + 2 * lag(value, 3) OVER w + lag(value, 4) OVER w) / 9 AS tri
FROM series WINDOW w AS (PARTITION BY user_id ORDER BY rn)) SELECT user_id, rn, round(tri, 6) AS tri FROM l WHERE tri IS NOT NULL"""
)
def tri_moving_avg(spark, d):
    return R.triangular_average(_series(spark, d), ["user_id"], "value").select("user_id", "rn", F.round("tri", 6).alias("tri"))


@query(
    f"""WITH {SERIES}, l AS (SELECT user_id, rn, (lead(value) OVER w - value) / nullif(lead(t) OVER w - t, 0) * 3600 AS dx FROM series
WINDOW w AS (PARTITION BY user_id ORDER BY rn)) SELECT user_id, rn, round(dx, 6) AS dx FROM l WHERE dx IS NOT NULL"""
)
def finite_diff(spark, d):
    return R.finite_differences(_series(spark, d), ["user_id"], "value").select("user_id", "rn", F.round(F.col("dx") * 3600, 6).alias("dx"))


@query(
    f"""WITH {SERIES}, l AS (SELECT user_id, rn, value AS x0, lead(value, 2) OVER w AS x1, lead(value, 4) OVER w AS x2 FROM series
WINDOW w AS (PARTITION BY user_id ORDER BY rn)) SELECT * FROM l WHERE x2 IS NOT NULL"""
)
def delay_embedding(spark, d):
    return R.delay_embedding(_series(spark, d), ["user_id"], "value", 2, 3).select("user_id", "rn", "x0", "x1", "x2")


@query(
    f"""WITH {SERIES}, m AS (SELECT unnest(range(0, 8)) AS lag),
p AS (SELECT m.lag, a.user_id, abs(a.value - b.value) AS gap FROM m, series a JOIN series b ON a.user_id = b.user_id AND b.rn = a.rn + m.lag),
g AS (SELECT user_id, lag, round(avg(gap), 6) AS g FROM p GROUP BY ALL),
r AS (SELECT *, lag(g) OVER (PARTITION BY user_id ORDER BY lag) AS before FROM g WHERE lag > 0)
SELECT user_id, coalesce(min(lag) FILTER (WHERE g > before) - 1, max(lag)) AS tau FROM r GROUP BY 1"""
)
def first_local_min_lag(spark, d):
    """The last lag up to which the mean gap keeps falling (from lag 1 on)."""
    order = Window.partitionBy("user_id").orderBy("rn")
    gaps = F.array(*(F.struct(F.lit(m).alias("lag"), F.abs(F.col("value") - F.lead("value", m).over(order)).alias("gap")) for m in range(8)))
    rows = _series(spark, d).select("user_id", gaps.alias("p")).select("user_id", F.explode("p").alias("p")).where("p.gap is not null")
    means = rows.groupBy("user_id", F.col("p.lag").cast("long").alias("lag")).agg(F.round(F.avg("p.gap"), 6).alias("g")).where("lag > 0")
    risen = means.withColumn("before", F.lag("g").over(Window.partitionBy("user_id").orderBy("lag")))
    return risen.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("g") > F.col("before"), F.col("lag"))) - 1, F.max("lag")).alias("tau"))


@query(
    """SELECT event_id, CASE WHEN value > q THEN 0 ELSE value END AS value FROM events, (SELECT quantile_cont(value, 0.99) AS q FROM events)"""
)
def p99_blank(spark, d):
    e = table(spark, d, "events")
    limit = F.broadcast(S.exact_quantile(e.where("value is not null"), "value", 0.99).withColumnRenamed("quantile", "q"))
    return e.join(limit, how="cross").select("event_id", F.when(F.col("value") > F.col("q"), 0.0).otherwise(F.col("value")).alias("value"))


@query(
    f"""WITH {SERIES} SELECT user_id, rn, coalesce(
  first_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS label
FROM series"""
)
def asof_forward_label(spark, d):
    critical = F.col("event_type").isin("error", "signup")
    return L.forward_label(_series(spark, d), ["user_id"], critical, F.col("event_type")).select("user_id", "rn", "label")


@query(
    """WITH p AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, max(value) AS label FROM events WHERE event_type = 'error' GROUP BY ALL),
s AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'view'),
j AS (SELECT s.event_id, s.user_id, p.label FROM s ASOF LEFT JOIN p ON s.user_id = p.user_id AND s.t <= p.t),
e AS (SELECT user_id, arg_max(label, t) AS label FROM p GROUP BY 1)
SELECT j.event_id, coalesce(j.label, e.label) AS label FROM j LEFT JOIN e USING (user_id)"""
)
def asof_join_tables(spark, d):
    """Views labelled by the value of the next error of the user, through the two-table as-of join."""
    e = table(spark, d, "events").withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    points = e.where("event_type = 'error'").groupBy("user_id", "t").agg(F.max("value").alias("label"))
    return L.asof_forward(e.where("event_type = 'view'").select("event_id", "user_id", "t"), points, "user_id", "t", "label").select("event_id", "label")


_CHANGES = f"""{SERIES}, b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS before FROM series),
ch AS (SELECT * FROM b WHERE before IS NULL OR before <> event_type),
runs AS (SELECT user_id, event_type, lead(event_type) OVER w AS next, rn AS start, lead(rn) OVER w AS stop FROM ch WINDOW w AS (PARTITION BY user_id ORDER BY rn))"""


@query(f"WITH {_CHANGES} SELECT user_id, rn, event_type FROM ch")
def change_points(spark, d):
    return L.change_points(_series(spark, d), ["user_id"], "event_type").select("user_id", "rn", "event_type")


@query(f"WITH {_CHANGES} SELECT user_id, start, stop FROM runs WHERE event_type = 'view' AND next = 'click'")
def adjacent_pairs(spark, d):
    return L.runs(_series(spark, d), ["user_id"], "event_type").where("event_type = 'view' and next = 'click'").select("user_id", "start", "stop")


PHASES = {"browse": ("view", "click"), "buy": ("click", "purchase"), "fail": ("error", None), "join": (None, "signup")}
_PHASE = """phases AS (SELECT *, CASE WHEN event_type = 'view' AND next = 'click' THEN 'browse' WHEN event_type = 'click' AND next = 'purchase' THEN 'buy'
  WHEN event_type = 'error' AND next IS NOT NULL THEN 'fail' WHEN next = 'signup' THEN 'join' END AS phase FROM runs)"""


def _phases(spark, d):
    found = L.runs(_series(spark, d), ["user_id"], "event_type")
    return found.withColumn("phase", L.phase_of(F.col("event_type"), F.col("next"), PHASES)).where("phase is not null")


@query(f"WITH {_CHANGES}, {_PHASE} SELECT p.user_id, p.phase, s.rn, s.value FROM phases p JOIN series s ON s.user_id = p.user_id AND s.rn >= p.start AND s.rn < p.stop WHERE phase IS NOT NULL")
def phase_interval_join(spark, d):
    """Samples inside the runs of a phase; each run explodes to its row numbers, so the join is by equality."""
    spans = _phases(spark, d).where("stop is not null").select("user_id", "phase", F.explode(F.sequence("start", F.col("stop") - 1)).alias("rn"))
    return spans.join(_series(spark, d).select("user_id", "rn", "value"), ["user_id", "rn"]).select("user_id", "phase", "rn", "value")


@query(
    f"""WITH {_CHANGES}, {_PHASE}, s AS (SELECT p.user_id, p.phase, s.rn, s.value FROM phases p JOIN series s ON s.user_id = p.user_id AND s.rn >= p.start AND s.rn < p.stop WHERE phase IN ('browse', 'buy'))
SELECT a.phase, a.user_id, a.rn AS left_rn, b.rn AS right_rn FROM s a JOIN s b ON a.user_id = b.user_id AND a.phase = b.phase AND a.rn < b.rn AND b.rn <= a.rn + 20"""
)
def phase_cross_product(spark, d):
    """Pairs of a phase's samples at most 20 rows apart, a span that is asked for; `phase_sample_products` sums over all pairs without making them."""
    rows = phase_interval_join(spark, d).where("phase in ('browse', 'buy')").select("user_id", "phase", "rn")
    return L.nearby_pairs(rows, ["phase", "user_id"], 20)


@query(
    f"""WITH {_CHANGES}, {_PHASE}, s AS (SELECT p.user_id, p.phase, s.rn, s.value FROM phases p JOIN series s ON s.user_id = p.user_id AND s.rn >= p.start AND s.rn < p.stop WHERE phase IS NOT NULL)
SELECT a.user_id, a.phase AS phase_a, b.phase AS phase_b, count(*) AS pairs, round(sum(a.value * b.value), 4) AS sum_product FROM s a JOIN s b ON a.user_id = b.user_id AND a.phase <= b.phase GROUP BY 1, 2, 3"""
)
def phase_sample_products(spark, d):
    """All pairs of a user's samples in two phases (or one), as their number and summed product: sums of either side suffice, no pair is made."""
    own = phase_interval_join(spark, d).groupBy("user_id", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    a, b = (own.select("user_id", F.col("phase").alias(f"phase_{x}"), F.col("n").alias(f"n_{x}"), F.col("total").alias(f"total_{x}")) for x in "ab")
    both = a.join(b, "user_id").where("phase_a <= phase_b")
    pairs = F.col("n_a") * F.col("n_b")
    return both.select("user_id", "phase_a", "phase_b", pairs.alias("pairs"), F.round(F.col("total_a") * F.col("total_b"), 4).alias("sum_product"))


@query(
    f"""WITH {_CHANGES}, {_PHASE}, s AS (SELECT p.user_id, p.phase, s.value, s.event_type FROM phases p JOIN series s ON s.user_id = p.user_id AND s.rn >= p.start AND s.rn < p.stop WHERE phase IS NOT NULL)
SELECT phase, CAST(least(floor(value / 10), 19) AS INTEGER) AS bin, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean
FROM s WHERE value BETWEEN 0 AND 200 GROUP BY 1, 2"""
)
def sync_pipeline(spark, d):
    """The flagship: series, runs, phases, interval join, and histograms per phase."""
    rows = phase_interval_join(spark, d).where("value between 0 and 200")
    return rows.groupBy("phase", F.least(F.floor(F.col("value") / 10), F.lit(19)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean")
    )


#: An annotation text for each type of event, so that the series of a user tells a story to the state machine.
STORY = {"signup": "15 min stabilization period", "error": "bleed #1", "view": "bleed #1 stopped", "click": "resuscitation with hextend", "purchase": "resuscitation complete"}
_TEXT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STORY.items()) + " END"


def _story(rows):
    return rows.withColumn("text", F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in STORY.items())))


_CODE = rf"""CASE WHEN regexp_matches(t, '{L.STABILISATION_START}') THEN 0 WHEN regexp_matches(t, '{L.STABILISATION_END}') THEN -1
  WHEN regexp_matches(t, '{L.BLEED}') AND NOT regexp_matches(t, '{L.BLEED_NOT}') THEN 1 WHEN regexp_matches(t, '{L.BLEED_END}') THEN 2
  WHEN regexp_matches(t, '{L.RESUSCITATION_START}') THEN CASE WHEN contains(t, 'hextend') THEN 3 ELSE 4 END
  WHEN regexp_matches(t, '{L.RESUSCITATION_END}') THEN CASE WHEN contains(t, 'hextend') THEN 5 ELSE 6 END END"""


@query(f"SELECT event_id, {_CODE} AS label FROM (SELECT event_id, {_TEXT} AS t FROM events)")
def annotation_events(spark, d):
    return _story(table(spark, d, "events")).select("event_id", L.annotation_label(F.col("text")).alias("label"))


@query(
    f"""WITH {SERIES}, c AS (SELECT user_id, rn - 1 AS k, {_CODE} AS code FROM (SELECT user_id, rn, {_TEXT} AS t FROM series)),
e AS (SELECT c.user_id, k, code FROM c JOIN (SELECT user_id, coalesce(max(CASE WHEN code = 0 THEN k END), -1) AS fresh FROM c GROUP BY 1) USING (user_id) WHERE code IS NOT NULL AND k >= fresh),
m AS (SELECT user_id, k, CASE WHEN code = 6 AND lag(code) OVER w = 3 THEN 5 ELSE code END AS code FROM e WINDOW w AS (PARTITION BY user_id ORDER BY k)),
f AS (SELECT * FROM (SELECT user_id, k AS idx, coalesce(lag(code) OVER (PARTITION BY user_id ORDER BY k), -1) AS label, code FROM m) WHERE label <> code),
b AS (SELECT user_id, max(idx) AS bleed FROM f WHERE label = 1 GROUP BY 1),
g AS (SELECT user_id, idx, CASE WHEN idx < bleed AND label > 2 THEN 2 ELSE label END AS label FROM f JOIN b USING (user_id)),
l AS (SELECT user_id, max(idx) AS last FROM g WHERE label NOT IN (5, 6) GROUP BY 1)
SELECT user_id, idx::INTEGER AS idx, label FROM g JOIN l USING (user_id) WHERE idx <= last
UNION ALL SELECT user_id, max(k)::INTEGER, 7 FROM c JOIN l USING (user_id) GROUP BY user_id, last HAVING max(k) > last"""
)
def label_state_machine(spark, d):
    return L.label_state_machine(_story(_series(spark, d)).select("user_id", (F.col("rn") - 1).alias("k"), "text"), "user_id")


@query(
    f"""WITH RECURSIVE {SERIES}, r AS (SELECT user_id, rn, value AS ema FROM series WHERE rn = 1
UNION ALL SELECT s.user_id, s.rn, 0.2 * s.value + 0.8 * r.ema FROM r JOIN series s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT user_id, rn, round(ema, 6) AS ema FROM r"""
)
def ema_series(spark, d):
    return R.ema(_series(spark, d), ["user_id"], "value", 0.2).select("user_id", "rn", F.round("ema", 6).alias("ema"))


@query(f"WITH {SERIES}, l AS (SELECT user_id, rn, value, lead(value) OVER (PARTITION BY user_id ORDER BY rn) AS target FROM series) SELECT * FROM l WHERE target IS NOT NULL")
def fetcher_pairs(spark, d):
    return R.next_values(_series(spark, d), ["user_id"], "value").select("user_id", "rn", "value", "target")


@query(
    f"""WITH {SERIES}, l AS (SELECT user_id, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY rn) AS y FROM series)
SELECT user_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS n FROM l WHERE y IS NOT NULL GROUP BY 1"""
)
def linear_dynamics_1d(spark, d):
    from viewloom.operators import neighbours as K

    pairs = R.next_values(_series(spark, d), ["user_id"], "value")
    return K.linear_dynamics(pairs, ["user_id"], "value", "target").select("user_id", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")
