"""Event decoding, epoching, averaging and audits over the event log and the signal view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.operators import events as E
from tempora.plans import views as V
from tempora.plans.registry import registry

QUERIES, ORACLE_SQL, query, r6 = registry()
CODES = {"signup": 1, "click": 2, "view": 9, "purchase": 18, "error": 255}
_CODE = "CASE code " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CODES.items()) + " END"
_NUMBERED = f"SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY t) AS ord, {_CODE} AS code, t, value FROM ({V.LOG})"


def _coded(spark, d):
    code = F.coalesce(*[F.when(F.col("code") == k, F.lit(v)) for k, v in CODES.items()])
    return V.v_log(spark, d).select("subject", F.row_number().over(Window.partitionBy("subject").orderBy("t")).alias("ord"), code.alias("code"), "t", "value")


@query(f"""SELECT subject, ord, printf('%02d%02d', hi, lo) AS trigger, at_us FROM (
             SELECT subject, (ord - 1) // 2 AS ord, max(CASE WHEN ord % 2 = 1 THEN d END) AS hi, max(CASE WHEN ord % 2 = 0 THEN d END) AS lo, min(t) AS at_us
             FROM (SELECT *, CASE WHEN code = 255 THEN 0 ELSE code END AS d FROM ({_NUMBERED})) GROUP BY 1, 2) WHERE lo IS NOT NULL""")
def trigger_decode(spark, d):
    return E.decode_triggers(_coded(spark, d)).select("subject", "ord", "trigger", F.col("at").alias("at_us"))


@query(f"""WITH t AS (SELECT subject, ord, code FROM ({_NUMBERED}) WHERE code <> 255),
                l AS (SELECT subject, ord, CASE WHEN value > 50 THEN 2 ELSE code END AS logged FROM ({_NUMBERED}) WHERE code <> 18)
           SELECT subject, count(*) FILTER (WHERE code = logged) AS matched, count(*) FILTER (WHERE code IS NOT NULL AND logged IS NOT NULL AND code <> logged) AS mismatched,
                  count(*) FILTER (WHERE logged IS NULL) AS only_left, count(*) FILTER (WHERE code IS NULL) AS only_right
           FROM t FULL JOIN l USING (subject, ord) GROUP BY subject""")
def trigger_reconcile(spark, d):
    rows = _coded(spark, d)
    log = rows.filter("code <> 18").select("subject", "ord", F.when(F.col("value") > 50, 2).otherwise(F.col("code")).alias("logged"))
    return E.reconcile(rows.filter("code <> 255").select("subject", "ord", "code"), log, ["subject", "ord"], "code", "logged")


_H = 3600
_SECONDS = f"SELECT subject, (t // 1000000)::BIGINT AS s, code, value FROM ({V.LOG})"


@query(f"""SELECT o.subject, o.s AS onset, x.s AS at, x.s - o.s AS lag, x.value FROM (SELECT * FROM ({_SECONDS}) WHERE code = 'signup') o
           JOIN ({_SECONDS}) x ON x.subject = o.subject AND x.s >= o.s - {6 * _H} AND x.s < o.s + {12 * _H}""")
def epoch_range_join(spark, d):
    """Every event from six hours before to twelve hours after a signup of the same subject."""
    rows = V.v_log(spark, d).select("subject", F.floor(F.col("t") / 1000000).alias("at"), "code", "value")
    onsets = rows.filter("code = 'signup'").select("subject", F.col("at").alias("onset"))
    met = E.range_join(onsets, rows.select("subject", "at", "value"), "subject", "onset", "at", 6 * _H, 12 * _H)
    return met.select("subject", "onset", "at", (F.col("at") - F.col("onset")).alias("lag"), "value")


@query(f"SELECT subject, t_s AS onset, position, t_s + position * 400 AS stimulus_onset FROM (SELECT subject, s AS t_s FROM ({_SECONDS}) WHERE code = 'signup'), (SELECT unnest(range(0, 10))::INT AS position)")
def sequence_onsets(spark, d):
    onsets = V.v_log(spark, d).filter("code = 'signup'").select("subject", F.floor(F.col("t") / 1000000).alias("onset"))
    return E.spread_onsets(onsets, "onset").select("subject", "onset", "position", "stimulus_onset")


@query(f"SELECT condition, channel, tp, round(avg(value), 6) AS y FROM ({V.SIGNAL}) GROUP BY ALL")
def trial_average(spark, d):
    return r6(E.averaged(V.v_signal(spark, d), ["condition", "channel", "tp"], "value"), "y")


@query(f"SELECT subject, tp, round(avg(y), 6) AS y FROM (SELECT subject, tp, channel, avg(value) AS y FROM ({V.SIGNAL}) GROUP BY ALL) GROUP BY ALL")
def channel_average(spark, d):
    per_channel = E.averaged(V.v_signal(spark, d), ["subject", "tp", "channel"], "value")
    return r6(E.averaged(per_channel, ["subject", "tp"], "y"), "y")


@query(f"SELECT tp, -400 + 20 * tp AS ms, round(avg(y), 6) AS y FROM ({V.CURVE}) GROUP BY tp")
def grand_mean(spark, d):
    return r6(E.averaged(V.v_curve(spark, d), ["tp"], "y"), "y").select("tp", E.milliseconds(F.col("tp")).alias("ms"), "y")


@query(f"SELECT tp, round(avg(y) FILTER (WHERE cohort = 'a') - avg(y) FILTER (WHERE cohort = 'b'), 6) AS difference FROM ({V.CURVE}) GROUP BY tp")
def cohort_difference(spark, d):
    a, b = (F.avg(F.when(F.col("cohort") == c, F.col("y"))) for c in "ab")
    return r6(V.v_curve(spark, d).groupBy("tp").agg((a - b).alias("difference")), "difference")


@query(f"SELECT cohort, feature, layer, round(sum(v * w) / sum(w), 6) AS mean FROM ({V.UNITS}) GROUP BY ALL")
def weighted_mean(spark, d):
    return r6(V.v_units(spark, d).groupBy("cohort", "feature", "layer").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("mean")), "mean")


@query(f"SELECT cohort, feature, layer, unit, round(v * w / sum(w) OVER (PARTITION BY cohort, feature, layer), 9) AS share FROM ({V.UNITS})")
def weighted_units(spark, d):
    total = F.sum("w").over(Window.partitionBy("cohort", "feature", "layer"))
    return V.v_units(spark, d).select("cohort", "feature", "layer", "unit", F.round(F.try_divide(F.col("v") * F.col("w"), total), 9).alias("share"))


@query(f"""SELECT subject, channel, tp, round(y - avg(y) FILTER (WHERE tp BETWEEN 2 AND 4) OVER (PARTITION BY subject, channel), 6) AS corrected
           FROM (SELECT subject, channel, tp, avg(value) AS y FROM ({V.SIGNAL}) GROUP BY ALL)""")
def baseline_correct(spark, d):
    epochs = E.averaged(V.v_signal(spark, d), ["subject", "channel", "tp"], "value")
    rows = E.baseline_corrected(epochs, ["subject", "channel"], "y", F.col("tp").between(2, 4))
    return r6(rows.select("subject", "channel", "tp", "corrected"), "corrected")


@query(f"SELECT subject, s // 21600 AS bucket, round(avg(value), 6) AS y FROM ({_SECONDS}) GROUP BY ALL")
def bucket_downsample(spark, d):
    rows = V.v_log(spark, d).select("subject", F.floor(F.col("t") / 1000000).alias("s"), "value")
    return r6(E.downsampled(rows, ["subject"], "s", 21600, "value"), "y")


@query(f"SELECT channel, tp, round(avg(value), 6) AS y FROM ({V.SIGNAL}) WHERE channel IN (2, 4, 6) GROUP BY ALL")
def erp(spark, d):
    """Event-related averages of a sub-selection of channels."""
    return r6(E.averaged(V.v_signal(spark, d).filter(F.col("channel").isin(2, 4, 6)), ["channel", "tp"], "value"), "y")


@query("SELECT label AS condition, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) <> 50")
def rep_audit(spark, d):
    return E.repetition_audit(V.v_vectors(spark, d).withColumnRenamed("class", "condition"), ["condition"], 50)


@query(f"SELECT channel, count(*) AS n, count(*) FILTER (WHERE isnan(x)) AS n_nan FROM (SELECT channel, CASE WHEN value > 45 THEN 'NaN'::DOUBLE ELSE value END AS x FROM ({V.SIGNAL})) GROUP BY channel")
def nan_audit(spark, d):
    rows = V.v_signal(spark, d).withColumn("x", F.when(F.col("value") > 45, F.lit(float("nan"))).otherwise(F.col("value")))
    return E.nan_audit(rows, ["channel"], "x")


@query(f"SELECT subject, count(DISTINCT condition) AS conditions FROM ({V.SIGNAL}) GROUP BY subject")
def condition_count(spark, d):
    return V.v_signal(spark, d).groupBy("subject").agg(F.countDistinct("condition").alias("conditions"))


@query(f"""WITH o AS (SELECT class, stimulus, (row_number() OVER (PARTITION BY class ORDER BY {V.draw_sql(42, "class", "stimulus")}, stimulus) - 1) // 5 AS block FROM ({V.VECTORS}))
           SELECT class, block::INT AS block, component, round(avg(value), 6) AS y FROM ({V.FEAT}) JOIN o USING (class, stimulus) GROUP BY ALL""")
def pseudo_trials(spark, d):
    return r6(E.pseudo_trials(V.v_feat(spark, d), ["class"], "stimulus", 5, 42, "value", ["component"]), "y")


@query(f"SELECT split, count(*) AS n, round(sum(x[1]), 6) AS total FROM ({V.VECTORS}) WHERE split IN ('train', 'val') GROUP BY split")
def split_select(spark, d):
    return r6(V.v_vectors(spark, d).filter(F.col("split").isin("train", "val")).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x")[0]).alias("total")), "total")


@query(f"SELECT stimulus, round(x[1], 6) AS first FROM ({V.VECTORS}) WHERE stimulus NOT IN (SELECT stimulus FROM ({V.VECTORS}) WHERE class = 5)")
def category_exclude(spark, d):
    rows = V.v_vectors(spark, d)
    kept = E.without_category(rows, rows.select("stimulus", F.col("class").alias("action_code")), 5)
    return r6(kept.select("stimulus", F.col("x")[0].alias("first")), "first")


_RECODE = {1: 0, 2: 1, 9: 2, 8: 3, 7: 4, 3: 5}
_RECODED = "CASE class " + " ".join(f"WHEN {k} THEN {v}" for k, v in _RECODE.items()) + " ELSE class END"


@query(f"SELECT stimulus, code, array_to_string([(i = code)::INT FOR i IN range(0, 10)], ',') AS hot FROM (SELECT stimulus, {_RECODED} AS code FROM ({V.VECTORS}))")
def one_hot(spark, d):
    rows = V.v_vectors(spark, d).select("stimulus", E.recoded(F.col("class"), _RECODE).alias("code"))
    return rows.withColumn("hot", F.array_join(F.transform(E.one_hot(F.col("code"), 10), lambda x: x.cast("string")), ","))


@query("SELECT p_partkey AS part, p_brand AS channel FROM part WHERE regexp_matches(p_brand, '^Brand#1 *|^Brand#2 *')")
def channel_pattern(spark, d):
    parts = V.read_table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("channel"))
    return E.channels_like(parts, "^Brand#1 *|^Brand#2 *")


@query(f"SELECT subject, ord, code FROM (SELECT subject, ord, CASE WHEN code = 255 THEN 99999 ELSE code END AS code FROM ({_NUMBERED})) WHERE code NOT IN (10001, 10002, 10003, 99999)")
def control_code_filter(spark, d):
    rows = _coded(spark, d).select("subject", "ord", F.when(F.col("code") == 255, 99999).otherwise(F.col("code")).alias("code"))
    return E.without_control_codes(rows)


@query(f"SELECT subject, code, t FROM ({V.LOG}) WHERE code IN (SELECT DISTINCT code FROM ({V.LOG}) WHERE value > 99)".replace("SELECT subject, code, t", "SELECT subject, code, t AS at_us"))
def split_routing(spark, d):
    """Events whose code is in a set that another table gives."""
    rows = V.v_log(spark, d)
    wanted = rows.filter("value > 99").select("code").distinct()
    return rows.join(wanted, "code", "left_semi").select("subject", "code", F.col("t").alias("at_us"))
