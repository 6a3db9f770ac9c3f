"""Whole chains: features to scores to tests, for each subject (a class of ``embeddings``) and over all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import encoding as N
from tempora.operators import events as E
from tempora.operators import inference as I
from tempora.operators import linear as L
from tempora.operators import resample as R
from tempora.plans import inference_queries as Q
from tempora.plans import model_queries as M
from tempora.plans import views as V
from tempora.plans.registry import registry

QUERIES, ORACLE_SQL, query, r6 = registry()


def v_responses(spark, d):
    """(subject, stimulus, split, x, tp, y): components 33 to 64 as 8 timepoints of 4 channels, ``x`` the first 32."""
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("x", 4 * t + 33, 4))
    rows = V.v_vectors(spark, d).select(F.col("class").alias("subject"), "stimulus", "split", "x", F.posexplode(at).alias("tp", "y"))
    return rows.withColumn("x", F.slice("x", 1, 32))


def _single(spark, d):
    """``v_responses`` for each of four features of one standardised regressor."""
    scaled = L.standardised(V.v_feat(spark, d).filter("component <= 4"), F.col("split") == "train", ["class", "component"], "value")
    features = scaled.select("stimulus", F.col("component").alias("feature"), F.array("z").alias("x"))
    return v_responses(spark, d).drop("x").join(features, "stimulus")


#: Responses, each feature's alpha by validation error, and test scores averaged over channels.
_CHAIN = f"""(WITH f AS MATERIALIZED ({V.FEAT}),
    x AS (SELECT class AS subject, component AS feature, stimulus, split, (value - m) / CASE WHEN round(s, 12) = 0 THEN 1 ELSE s END AS x FROM f
          JOIN (SELECT class, component, avg(value) AS m, stddev_pop(value) AS s FROM f WHERE split = 'train' GROUP BY ALL) USING (class, component) WHERE component <= 4),
    y AS (SELECT stimulus, ((component - 33) // 4)::INT AS tp, ((component - 33) % 4)::INT AS channel, value AS y FROM f WHERE component > 32),
    r AS MATERIALIZED (SELECT * FROM x JOIN y USING (stimulus)),
    s AS (SELECT subject, feature, tp, channel, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM r WHERE split = 'train' GROUP BY ALL),
    b AS (SELECT *, ((n + alpha) * sxy - sx * sy) / ((sxx + alpha) * (n + alpha) - sx * sx) AS slope, ((sxx + alpha) * sy - sx * sxy) / ((sxx + alpha) * (n + alpha) - sx * sx) AS intercept FROM s, {M._ALPHAS}),
    v AS (SELECT subject, feature, tp, channel, alpha, sqrt(avg((y - intercept - slope * x) ** 2)) AS rmse, corr(y, intercept + slope * x) AS corr FROM r JOIN b USING (subject, feature, tp, channel) WHERE split = 'val' GROUP BY ALL),
    m AS (SELECT subject, feature, tp, alpha, round(avg(rmse), 9) AS rmse FROM v GROUP BY ALL),
    a AS (SELECT subject, feature, tp, alpha FROM m QUALIFY row_number() OVER (PARTITION BY subject, feature, tp ORDER BY rmse, alpha) = 1),
    t AS (SELECT subject, feature, tp, channel, alpha, corr(y, intercept + slope * x) AS corr, 1 - sum((y - intercept - slope * x) ** 2) / (var_pop(y) * count(*)) AS r2
          FROM r JOIN b USING (subject, feature, tp, channel) JOIN a USING (subject, feature, tp, alpha) WHERE split = 'test' GROUP BY ALL)
    SELECT subject, feature, tp, alpha, avg(corr) AS y, avg(r2) AS r2 FROM t GROUP BY ALL)"""


def _chain(spark, d):
    return N.curves(N.encoded(_single(spark, d), ["subject", "feature", "tp"], "x", "y", M._GRID), ["subject", "feature", "tp"])


@query(f"SELECT subject, feature, tp, alpha, round(y, 6) AS y, round(r2, 6) AS r2 FROM {_CHAIN}")
def encoding_scores(spark, d):
    """Alpha, correlation and r2 of each subject, feature and timepoint."""
    return r6(_chain(spark, d), "y", "r2")


_FLIP = f"CASE WHEN b = 0 OR {V.draw_sql(Q.SEED, 'b', 'subject')} % 2 = 0 THEN 1.0 ELSE -1.0 END"


@query(f"""WITH c AS MATERIALIZED (SELECT * FROM {_CHAIN}), t AS ({Q._bh_sql(Q._p_sql(f"SELECT b, feature, tp, avg(({_FLIP}) * y) AS stat FROM c, {Q.BS} r GROUP BY ALL", "feature, tp"), family="feature", cols="feature, tp, round(stat, 6) AS stat, round(p, 6) AS p")})
           SELECT t.*, -400 + 20 * tp AS ms, round(r2, 6) AS r2 FROM t JOIN (SELECT feature, tp, avg(r2) AS r2 FROM c GROUP BY ALL) USING (feature, tp)""")
def encoding_report(spark, d):
    """From features to the report: standardised regressors, alphas, fits, scores, sign flips over subjects, false discovery rate."""
    curve = _chain(spark, d)
    tests = I.bh_fdr(I.rank_p(R.sign_flip(curve, ["feature", "tp"], Q.B, Q.SEED), ["feature", "tp"]), ["feature"])
    fit = curve.groupBy("feature", "tp").agg(F.avg("r2").alias("r2"))
    return r6(tests.join(fit, ["feature", "tp"]).withColumn("ms", E.milliseconds(F.col("tp"))), "stat", "p", "p_adj", "r2")


@query()
def encoding_pca(spark, d):
    """The chain with ten components of scaled features as regressors and thirty alphas (pytest compares it with NumPy)."""
    rows = v_responses(spark, d)
    stimuli = V.v_vectors(spark, d).filter("split = 'train'").select(F.slice("x", 1, 32).alias("x"))
    mean, axes, _ = L.principal_axes(stimuli, "x", 10, scaled=True)
    scored = N.encoded(L.projected(rows.select("subject", "tp", "split", "y", "x"), "x", mean, axes), ["subject", "tp"], "x", "y")
    return r6(N.curves(scored, ["subject", "tp"]), "y", "r2")


@query()
def pca_explained(spark, d):
    """Explained shares of the axes of scaled training features, and which are kept: the first up to 90 % of all, from the fit itself."""
    _, _, share = L.principal_axes(V.v_vectors(spark, d).filter("split = 'train'"), "x", 64, scaled=True)
    total = share.cumsum()
    kept = int((total < 0.9).sum()) + 1
    return r6(spark.createDataFrame([(i + 1, float(s), float(t), i < kept) for i, (s, t) in enumerate(zip(share, total))], "component int, share double, cumulative double, kept boolean"), "share", "cumulative")


_PICK = "row_number() OVER (PARTITION BY {0} ORDER BY {1}, alpha) = 1"
_MEANS = f"""g AS (SELECT alpha, tp, channel, sqrt(sum((y - intercept - slope * x) ** 2) / count(*)) AS rmse, corr(y, intercept + slope * x) AS corr
    FROM ({M._XY}) t JOIN ({M._beta_sql('alpha', 'alpha, ', ', ' + M._ALPHAS)}) USING (tp, channel) WHERE split = 'val' GROUP BY ALL),
    p AS (SELECT tp, alpha, round(avg(rmse), 9) AS rmse FROM g GROUP BY ALL), w AS (SELECT alpha, round(avg(rmse), 9) AS rmse, round(avg(corr), 9) AS corr FROM g GROUP BY ALL),
    pc AS (SELECT tp, alpha, round(avg(corr), 9) AS corr FROM g GROUP BY ALL)"""


@query(f"""WITH {_MEANS} SELECT 'rmse' AS criterion, tp, alpha FROM p QUALIFY {_PICK.format('tp', 'rmse')} UNION ALL SELECT 'corr', tp, alpha FROM pc QUALIFY {_PICK.format('tp', 'corr DESC')}
           UNION ALL SELECT 'rmse', NULL, alpha FROM w QUALIFY {_PICK.format('1', 'rmse')} UNION ALL SELECT 'corr', NULL, alpha FROM w QUALIFY {_PICK.format('1', 'corr DESC')}""")
def best_alpha_variants(spark, d):
    """Alphas by error and by correlation, of each timepoint and (null timepoint) of all together."""
    rows = M.v_xy(spark, d).withColumns({"xs": F.array("x"), "ys": F.array("y")})
    grid = L.ridge_search(rows.filter("split = 'train'"), rows.filter("split = 'val'"), ["tp", "channel"], "xs", "ys", M._GRID)
    chosen = L.best_alpha(grid, ["tp"]).unionByName(L.best_alpha(grid, []).withColumn("tp", F.lit(None).cast("int")))
    return chosen.select("tp", F.inline(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"by_{c}").alias("alpha")) for c in ("rmse", "corr")])))


_GENERAL = f"""(WITH f AS MATERIALIZED ({V.FEAT}), x AS (SELECT stimulus, class AS subject, split, value AS x FROM f WHERE component = 1),
    r AS MATERIALIZED (SELECT subject, stimulus, split, x, ((component - 33) // 4)::INT AS tp, ((component - 33) % 4)::INT AS channel, value AS y FROM x JOIN (SELECT stimulus, component, value FROM f WHERE component > 32) USING (stimulus)),
    s AS (SELECT subject, tp, channel, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM r WHERE split = 'train' GROUP BY ALL),
    b AS (SELECT subject, tp, channel, ((n + 2.0) * sxy - sx * sy) / ((sxx + 2.0) * (n + 2.0) - sx * sx) AS slope, ((sxx + 2.0) * sy - sx * sxy) / ((sxx + 2.0) * (n + 2.0) - sx * sx) AS intercept FROM s),
    c AS (SELECT subject, b.tp AS tp_train, r.tp AS tp_test, channel, corr(y, intercept + slope * x) AS corr FROM r JOIN b USING (subject, channel) WHERE split = 'test' GROUP BY ALL)
    SELECT subject, CASE WHEN subject % 2 = 0 THEN 'a' ELSE 'b' END AS cohort, tp_train, tp_test, avg(corr) AS y FROM c GROUP BY ALL)"""
_CELL = "tp_train, tp_test, round(stat, 6) AS stat, round(p, 6) AS p"


def _general(spark, d):
    """(subject, cohort, tp_train, tp_test, y): each subject's fits of every timepoint, scored at every timepoint."""
    rows = v_responses(spark, d).select("subject", "stimulus", "split", F.col("x")[0].alias("x"), "tp", F.posexplode("y").alias("channel", "y"))
    beta = L.ridge_one(rows.filter("split = 'train'"), ["subject", "tp", "channel"], 2.0).withColumnRenamed("tp", "tp_train")
    tested = rows.filter("split = 'test'").withColumnRenamed("tp", "tp_test").join(beta, ["subject", "channel"])
    scored = L.fit_scores(tested.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("x")), ["subject", "tp_train", "tp_test", "channel"])
    mean = scored.groupBy("subject", "tp_train", "tp_test").agg(F.avg("corr").alias("y"))
    return mean.withColumn("cohort", F.when(F.col("subject") % 2 == 0, "a").otherwise("b"))


@query(f"WITH c AS MATERIALIZED (SELECT * FROM {_GENERAL}) " + Q._bh_sql(Q._p_sql(f"SELECT b, tp_train, tp_test, avg(({_FLIP}) * y) AS stat FROM c, {Q.BS} r GROUP BY ALL", "tp_train, tp_test"), cols=_CELL))
def time_generalization_test(spark, d):
    """Sign flips over subjects of the whole matrix of timepoints, its cells one family."""
    tests = I.rank_p(R.sign_flip(_general(spark, d), ["tp_train", "tp_test"], Q.B, Q.SEED), ["tp_train", "tp_test"])
    return r6(I.bh_fdr(tests, []), "stat", "p", "p_adj")


_MINE = f"""SELECT b, subject, CASE WHEN b = 0 THEN cohort = 'a' ELSE row_number() OVER (PARTITION BY b ORDER BY {V.draw_sql(Q.SEED, 'b', 'subject')}, subject) <= count(*) FILTER (WHERE cohort = 'a') OVER (PARTITION BY b) END AS mine
    FROM (SELECT DISTINCT subject, cohort FROM c) s, {Q.BS} r"""
_APART = f"SELECT b, tp_train, tp_test, avg(y) FILTER (WHERE mine) - avg(y) FILTER (WHERE NOT mine) AS stat FROM c JOIN ({_MINE}) l USING (subject) GROUP BY ALL"


@query(f"WITH c AS MATERIALIZED (SELECT * FROM {_GENERAL}) " + Q._bh_sql(Q._p_sql(_APART, "tp_train, tp_test"), cols=_CELL))
def time_generalization_diff_test(spark, d):
    """Two cohorts' matrices of timepoints, their labels shuffled."""
    tests = I.rank_p(R.label_shuffle(_general(spark, d), ["tp_train", "tp_test"], Q.B, Q.SEED), ["tp_train", "tp_test"])
    return r6(I.bh_fdr(tests, []), "stat", "p", "p_adj")


_TRIAL_ROWS = f"SELECT class, stimulus, (component - 1) // 8 AS row, (component - 1) % 8 AS i, value AS v FROM ({V.FEAT})"


@query(f"SELECT i, j, round(avg(cov), 6) AS cov FROM (SELECT class, i, j, avg(cov) AS cov FROM ({M._lw_sql(_TRIAL_ROWS, 'class, stimulus')}) GROUP BY ALL) GROUP BY i, j")
def mean_cov_epochs(spark, d):
    """Covariance over the timepoints of each trial, averaged over trials and then conditions."""
    per = L.shrunk_covariance(M.v_points(spark, d), ["class", "stimulus"], "x").groupBy("class", "i", "j").agg(F.avg("cov").alias("cov"))
    return r6(per.groupBy("i", "j").agg(F.avg("cov").alias("cov")), "cov")


@query(f"SELECT class AS stimulus, ((component - 1) // 8)::INT AS channel, ((component - 1) % 8)::INT AS place, round(avg(value), 6) AS pooled FROM ({V.FEAT}) GROUP BY ALL")
def temporal_pool(spark, d):
    """Maps of eight channels and eight places, each averaged over the frames of its stimulus (a class)."""
    at = F.col("component") - 1
    rows = V.v_feat(spark, d).select(F.col("class").alias("stimulus"), F.floor(at / 8).cast("int").alias("channel"), (at % 8).cast("int").alias("place"), "value")
    return r6(rows.groupBy("stimulus", "channel", "place").agg(F.avg("value").alias("pooled")), "pooled")
