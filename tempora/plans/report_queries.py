"""Report rows, scenario sweeps, cross-modality models, and the scans and sinks behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import events as E
from tempora.operators import linear as L
from tempora.operators import resample as R
from tempora.operators import scenarios as C
from tempora.plans import inference_queries as Q
from tempora.plans import model_queries as M
from tempora.plans import similarity_queries as S
from tempora.plans import views as V
from tempora.plans.registry import registry
from tempora.sources.tables import alpha_for

QUERIES, ORACLE_SQL, query, r6 = registry()


@query(f"""SELECT g.tp, ms, y, lo, hi, p_adj, rejected, upper FROM ({{0}}) g JOIN ({Q.ORACLE_SQL['boot_curve_ci']}) c USING (tp) JOIN ({Q.ORACLE_SQL['signflip_test']}) t USING (tp)
           LEFT JOIN (SELECT tp, round(max(y), 6) AS upper FROM ({V.CURVE}) GROUP BY tp) n USING (tp) WHERE g.tp >= 3""".format(f"SELECT tp, -400 + 20 * tp AS ms, round(avg(y), 6) AS y FROM ({V.CURVE}) GROUP BY tp"))
def report_curve(spark, d):
    """Curve, interval, test and ceiling for each timepoint of the report window."""
    curve = V.v_curve(spark, d)
    mean = r6(E.averaged(curve, ["tp"], "y"), "y").select("tp", E.milliseconds(F.col("tp")).alias("ms"), "y")
    ceiling = r6(curve.groupBy("tp").agg(F.max("y").alias("upper")), "upper")
    return C.report(mean, Q.boot_curve_ci(spark, d).drop("est"), Q.signflip_test(spark, d).select("tp", "p_adj", "rejected"), ceiling, ["tp"], first_tp=3)


@query(f"SELECT tp_train, 7 - tp_train AS row, tp_test, rmse FROM (SELECT tp_train, tp_test, round(avg(rmse), 8) AS rmse FROM ({M.ORACLE_SQL['time_generalization']}) GROUP BY ALL) WHERE tp_train >= 2 AND tp_test >= 2")
def report_time_generalization(spark, d):
    """Timepoint by timepoint, the training axis flipped and the first ticks dropped."""
    mean = M.time_generalization(spark, d).groupBy("tp_train", "tp_test").agg(F.round(F.avg("rmse"), 8).alias("rmse"))
    return mean.filter("tp_train >= 2 AND tp_test >= 2").select("tp_train", (7 - F.col("tp_train")).alias("row"), "tp_test", "rmse")


_SCEN = [("default", 2, 12), ("first half", 2, 6), ("second half", 7, 12)]
_SCEN_SQL = ", ".join(f"('{n}', {a}, {b})" for n, a, b in _SCEN)


@query(f"SELECT scenario, subject, round(avg(y), 6) AS y FROM ({V.CURVE}) c JOIN (VALUES {_SCEN_SQL}) s(scenario, lo, hi) ON tp BETWEEN lo AND hi GROUP BY scenario, subject")
def scenario_frames(spark, d):
    """The same average over each scenario's range of frames."""
    return r6(C.swept(V.v_curve(spark, d), C.frame_scenarios(spark, _SCEN)).groupBy("scenario", "subject").agg(F.avg("y").alias("y")), "y")


@query(f"SELECT feature, tp, round(stat, 6) AS stat, 'a' AS cohort FROM (SELECT feature, tp, avg(y) AS stat FROM ({V.CURVE_F}) WHERE cohort = 'a' GROUP BY ALL) UNION ALL SELECT feature, tp, round(avg(y), 6), 'b' FROM ({V.CURVE_F}) WHERE cohort = 'b' GROUP BY ALL")
def cohort_stack(spark, d):
    """Two cohorts' curves, stacked with their label."""
    rows = V.v_curve(spark, d, "feature")
    one, two = (r6(rows.filter(F.col("cohort") == c).groupBy("feature", "tp").agg(F.avg("y").alias("stat")), "stat") for c in "ab")
    return C.stacked({"a": one, "b": two}, "cohort")


@query(f"""SELECT tp, channel, round(1 - sum((y - intercept - slope * x2) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT t.*, v.x[2] AS x2 FROM ({M._XY}) t JOIN ({V.VECTORS}) v USING (stimulus) WHERE t.split = 'test')
           JOIN ({M._beta_sql('2.0')}) USING (tp, channel) GROUP BY tp, channel""")
def cross_modal_encoding(spark, d):
    """Models fitted on one modality's regressor, scored with the other's."""
    beta = L.ridge_one(M.v_xy(spark, d).filter("split = 'train'"), ["tp", "channel"], 2.0)
    other = V.v_vectors(spark, d).select("stimulus", F.col("x")[1].alias("x2"))
    rows = M.v_xy(spark, d).filter("split = 'test'").join(other, "stimulus").join(F.broadcast(beta), ["tp", "channel"])
    return r6(L.fit_scores(rows.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("x2")), ["tp", "channel"]).select("tp", "channel", "r2"), "r2")


@query(f"SELECT subject, feature, tp, y, CASE WHEN tp = 1 THEN 0.5 ELSE tp * 1.0 END AS alpha FROM (SELECT subject, feature, tp, round(y, 6) AS y FROM ({V.CURVE_F}))")
def alpha_lookup(spark, d):
    """Every fit with the alpha of its own timepoint; the first is a timepoint like any other."""
    fits = V.v_curve(spark, d, "feature").select("subject", "feature", "tp", F.round("y", 6).alias("y"))
    best = fits.select("subject", "feature", "tp", F.when(F.col("tp") == 1, 0.5).otherwise(F.col("tp").cast("double")).alias("alpha"))
    return alpha_for(fits, best, per_tp=True)


@query(f"SELECT feature, p1, p2 FROM (SELECT * FROM (SELECT feature, p AS p1 FROM ({{0}})) JOIN (SELECT feature, p AS p2 FROM ({{1}})) USING (feature)) WHERE feature BETWEEN 4 AND 8".format(*S._PEAK_PAIR))
def mid_level_peaks(spark, d):
    """Peaks of two measures side by side for the middle features."""
    return S.month_peaks(spark, d, "l_quantity", "p1").join(S.month_peaks(spark, d, "l_discount", "p2"), "feature").filter(F.col("feature").between(4, 8))


@query(f"SELECT feature, tp, round(stat, 6) AS stat FROM (SELECT feature, tp, sum(CASE WHEN cohort = 'a' THEN y END) - sum(CASE WHEN cohort = 'b' THEN y END) AS stat FROM ({V.CURVE_F}) GROUP BY ALL)")
def layer_cohort_difference(spark, d):
    """The observed statistic of the label-shuffle test on sums."""
    return r6(R.label_shuffle(V.v_curve(spark, d, "feature"), ["feature", "tp"], 0, 42, how="sum").select("feature", "tp", "stat"), "stat")


@query(f"SELECT stimulus, component, round(sum(value) / 9, 6) AS by_nine, round(avg(value), 6) AS mean FROM (SELECT class AS stimulus, component, value, row_number() OVER (PARTITION BY class, component ORDER BY stimulus) AS frame FROM ({V.FEAT})) WHERE frame >= 10 AND frame < 19 GROUP BY ALL")
def frame_average(spark, d):
    """Means over the frames from 10 up to 19; a divisor that is always nine differs where frames are missing."""
    rows = C.numbered_frames(V.v_vectors(spark, d), "class", "stimulus").filter("frame >= 10 AND frame < 19")
    long = rows.select(F.col("class").alias("stimulus"), F.posexplode("x").alias("component", "value")).withColumn("component", F.col("component") + 1)
    return r6(long.groupBy("stimulus", "component").agg((F.sum("value") / 9).alias("by_nine"), F.avg("value").alias("mean")), "by_nine", "mean")


@query("SELECT p_type AS name, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM (SELECT p_type, min(p_size) / 1000.0 AS p FROM part GROUP BY p_type)")
def significance_stars(spark, d):
    rows = V.read_table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg((F.min("p_size") / 1000).alias("p"))
    return rows.select("name", C.stars(F.col("p")).alias("stars"))


@query(f"SELECT subject, feature, tp, round(y, 6) AS y, a.alpha FROM ({V.CURVE_F}) JOIN (SELECT subject, feature, count(*) / 2.0 AS alpha FROM ({V.CURVE_F}) GROUP BY ALL) a USING (subject, feature)")
def alpha_lookup_averaged(spark, d):
    """Every fit with the one alpha that its subject and feature have for all timepoints (rows without a timepoint)."""
    fits = V.v_curve(spark, d, "feature").select("subject", "feature", "tp", F.round("y", 6).alias("y"))
    mean = fits.groupBy("subject", "feature").agg((F.count(F.lit(1)) / 2.0).alias("alpha")).withColumn("tp", F.lit(None).cast("int"))
    own = fits.select("subject", "feature", "tp", F.lit(-1.0).alias("alpha"))  # of single timepoints, not to be taken
    return alpha_for(fits, mean.unionByName(own))


@query("SELECT brand, rank, feature FROM (SELECT p_brand AS brand, unnest(range(1, len(f) + 1))::INT AS rank, unnest(f) AS feature FROM (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS f FROM part GROUP BY p_brand))")
def feature_lists(spark, d):
    """Feature sets that a configuration holds as list literals, read back as rows in their order."""
    texts = V.read_table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.to_json(F.sort_array(F.collect_set("p_type"))).alias("listed"))
    return texts.select("brand", F.posexplode(C.from_list(F.col("listed"))).alias("rank", "feature")).withColumn("rank", F.col("rank") + 1)


@query(f"SELECT stimulus, split, row_number() OVER (ORDER BY stimulus) AS place, round(list_sum(x), 6) AS total FROM ({V.VECTORS})")
def splits_reassembled(spark, d):
    """Splits that are kept apart, put together again in the order of their stimuli."""
    rows = V.v_vectors(spark, d).select("stimulus", "x")
    m = F.col("stimulus") % 8
    parts = {"train": rows.filter(m <= 5), "val": rows.filter(m == 6), "test": rows.filter(m == 7)}
    whole = R.numbered(C.stacked(parts, "split"), [], "stimulus")
    return r6(whole.select("stimulus", "split", (F.col("k") + 1).alias("place"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total")), "total")
