"""Standardisation, explained variance, ridge encoding, time generalisation, whitening and decoding."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.operators import decode as D
from tempora.operators import linear as L
from tempora.operators import spectral as P
from tempora.plans import views as V
from tempora.plans.registry import registry
from tempora.plans.similarity_queries import _REPS, v_reps

QUERIES, ORACLE_SQL, query, r6 = registry()


@query(f"""SELECT stimulus, component, round((value - m) / CASE WHEN round(s, 12) = 0 THEN 1 ELSE s END, 6) AS z FROM ({V.FEAT})
           JOIN (SELECT component, avg(value) AS m, stddev_pop(value) AS s FROM ({V.FEAT}) WHERE split = 'train' GROUP BY component) USING (component) WHERE split <> 'train'""")
def standardize(spark, d):
    rows = L.standardised(V.v_feat(spark, d), F.col("split") == "train", ["component"], "value")
    return r6(rows.filter("split <> 'train'").select("stimulus", "component", "z"), "z")


@query(f"""SELECT component, round(pct, 6) AS pct, round(total, 6) AS cumulative, component <= coalesce((SELECT min(component) FROM c WHERE total >= 50), 64) AS kept FROM c ORDER BY component""".replace("SELECT component, round", f"""WITH v AS (SELECT component, var_pop(value) AS v FROM ({V.FEAT}) GROUP BY component),
           c AS (SELECT component, 100 * v / sum(v) OVER () AS pct, sum(100 * v / (SELECT sum(v) FROM v)) OVER (ORDER BY component ROWS UNBOUNDED PRECEDING) AS total FROM v) SELECT component, round""", 1))
def cumvar_cut(spark, d):
    """Share of variance by component, its running sum, and the components up to half of all; all if that is never reached."""
    shares = V.v_feat(spark, d).groupBy("component").agg(F.var_pop("value").alias("v")).withColumn("_all", F.lit(1))
    every, upto = Window.partitionBy("_all"), Window.partitionBy("_all").orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    rows = shares.withColumn("pct", F.try_divide(100 * F.col("v"), F.sum("v").over(every))).withColumn("cumulative", F.sum("pct").over(upto))
    cut = F.coalesce(F.min(F.when(F.col("cumulative") >= 50, F.col("component"))).over(every), F.lit(64))
    return r6(rows.select("component", "pct", "cumulative", (F.col("component") <= cut).alias("kept")), "pct", "cumulative")


def v_xy(spark, d):
    """(stimulus, split, x, target, tp, channel, y): one regressor, and components 33 to 64 as 8 timepoints of 4 channels."""
    rows = V.v_vectors(spark, d).select("stimulus", "split", F.col("x")[0].alias("x"), F.posexplode(F.slice("x", 33, 32)).alias("k", "y"))
    return rows.select("stimulus", "split", "x", F.floor(F.col("k") / 4).cast("int").alias("tp"), (F.col("k") % 4).cast("int").alias("channel"), "y")


_XY = f"SELECT f.stimulus, f.split, v.x[1] AS x, ((component - 33) // 4)::INT AS tp, ((component - 33) % 4)::INT AS channel, value AS y FROM ({V.FEAT}) f JOIN ({V.VECTORS}) v USING (stimulus) WHERE component > 32"


def _beta_sql(alpha: str, extra: str = "", source: str = "") -> str:
    return f"""SELECT {extra}tp, channel, ((n + {alpha}) * sxy - sx * sy) / ((sxx + {alpha}) * (n + {alpha}) - sx * sx) AS slope, ((sxx + {alpha}) * sy - sx * sxy) / ((sxx + {alpha}) * (n + {alpha}) - sx * sx) AS intercept
               FROM (SELECT tp, channel, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM ({_XY}) WHERE split = 'train' GROUP BY tp, channel){source}"""


@query(f"SELECT tp, channel, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM ({_beta_sql('2.0')})")
def ridge1_fit(spark, d):
    return r6(L.ridge_one(v_xy(spark, d).filter("split = 'train'"), ["tp", "channel"], 2.0), "slope", "intercept")


def _fitted(spark, d, alpha=2.0):
    rows = v_xy(spark, d)
    beta = L.ridge_one(rows.filter("split = 'train'"), ["tp", "channel"], alpha)
    return rows.filter("split = 'test'").join(F.broadcast(beta), ["tp", "channel"]).withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("x"))


_FIT = f"SELECT t.*, intercept + slope * x AS fitted FROM ({_XY}) t JOIN ({_beta_sql('2.0')}) USING (tp, channel) WHERE split = 'test'"
_SCORES = "round(sqrt(sum((y - fitted) ** 2) / count(*)), 6) AS rmse, round(corr(y, fitted), 6) AS corr, round(1 - sum((y - fitted) ** 2) / (var_pop(y) * count(*)), 6) AS r2"


@query(f"SELECT tp, channel, {_SCORES} FROM ({_FIT}) GROUP BY tp, channel")
def r2_rmse(spark, d):
    return r6(L.fit_scores(_fitted(spark, d), ["tp", "channel"]), "rmse", "corr", "r2")


@query(f"SELECT tp, channel, stimulus, round(y - fitted, 6) AS residual FROM ({_FIT})")
def residuals(spark, d):
    return _fitted(spark, d).select("tp", "channel", "stimulus", F.round(F.col("y") - F.col("fitted"), 6).alias("residual"))


@query(f"""SELECT f.tp AS tp_train, t.tp AS tp_test, channel, {_SCORES.replace('y', 't.y').replace('(t.y,', '(t.y,')} FROM ({_FIT}) f JOIN ({_XY}) t USING (stimulus, channel) GROUP BY f.tp, t.tp, channel""")
def time_generalization(spark, d):
    """Predictions of every training timepoint, made once, against the responses at every timepoint."""
    fitted = _fitted(spark, d).select("stimulus", "channel", F.col("tp").alias("tp_train"), "fitted")
    tested = v_xy(spark, d).filter("split = 'test'").select("stimulus", "channel", F.col("tp").alias("tp_test"), "y")
    return r6(L.fit_scores(fitted.join(tested, ["stimulus", "channel"]), ["tp_train", "tp_test", "channel"]), "rmse", "corr", "r2")


_GRID = [10.0**k for k in range(-5, 6)]
_ALPHAS = "(SELECT unnest([" + ", ".join(repr(a) for a in _GRID) + "]) AS alpha)"


@query(f"""WITH g AS (SELECT alpha, tp, channel, sqrt(sum((y - intercept - slope * x) ** 2) / count(*)) AS rmse, corr(y, intercept + slope * x) AS corr
                     FROM ({_XY}) t JOIN ({_beta_sql('alpha', 'alpha, ', ', ' + _ALPHAS)}) USING (tp, channel) WHERE split = 'val' GROUP BY ALL),
                m AS (SELECT tp, alpha, round(avg(rmse), 9) AS rmse FROM g GROUP BY ALL)
           SELECT tp, alpha FROM m QUALIFY row_number() OVER (PARTITION BY tp ORDER BY rmse, alpha) = 1""")
def best_alpha(spark, d):
    """One regressor: the alpha of the least validation error at each timepoint."""
    rows = v_xy(spark, d).withColumns({"xs": F.array("x"), "ys": F.array("y")})
    one = lambda s: rows.filter(F.col("split") == s)
    grid = L.ridge_search(one("train"), one("val"), ["tp", "channel"], "xs", "ys", np.array(_GRID))
    return L.best_alpha(grid, ["tp"]).select("tp", F.col("by_rmse").alias("alpha"))


def _split(spark, d, split):
    return V.v_vectors(spark, d).filter(F.col("split") == split).select(F.slice("x", 1, 32).alias("x"), F.slice("x", 33, 32).alias("y"))


@query()
def ridge_grid(spark, d):
    """Thirty alphas, 32 regressors and 32 targets, from one eigendecomposition."""
    return L.ridge_search(_split(spark, d, "train"), _split(spark, d, "val"), [], "x", "y")


@query()
def pca(spark, d):
    """The coordinates of all stimuli along the ten main axes of the training stimuli."""
    rows = V.v_vectors(spark, d)
    mean, axes, _ = L.principal_axes(rows.filter("split = 'train'"), "x", 10)
    return L.projected(rows.select("stimulus", "split", "x"), "x", mean, axes)


@query()
def pca_randomized(spark, d):
    rows = V.v_vectors(spark, d)
    mean, axes = L.randomized_axes(rows.filter("split = 'train'"), "x", 10)
    return L.projected(rows.select("stimulus", "split", "x"), "x", mean, axes)


def _lw_sql(source: str, keys: str) -> str:
    """Ledoit-Wolf covariance of long rows (keys, row, i, v)."""
    return f"""WITH z AS (SELECT {keys}, row, i, v - avg(v) OVER (PARTITION BY {keys}, i) AS z FROM ({source})),
        s AS (SELECT {keys}, a.i AS i, b.i AS j, avg(a.z * b.z) AS s FROM z a JOIN z b USING ({keys}, row) GROUP BY {keys}, a.i, b.i),
        f AS (SELECT {keys}, count(*) AS n, sum(q * q) AS fourth FROM (SELECT {keys}, row, sum(z * z) AS q FROM z GROUP BY {keys}, row) GROUP BY {keys}),
        t AS (SELECT {keys}, sum(s) FILTER (WHERE i = j) AS trace, sum(s * s) AS norm, count(*) FILTER (WHERE i = j) AS p FROM s GROUP BY {keys}),
        l AS (SELECT {keys}, trace / p AS mu, least((fourth / n - norm) / (n * p), (norm - trace * trace / p) / p) / ((norm - trace * trace / p) / p) AS shrinkage FROM f JOIN t USING ({keys}))
        SELECT {keys}, i, j, (1 - shrinkage) * s + CASE WHEN i = j THEN shrinkage * mu ELSE 0 END AS cov, shrinkage FROM s JOIN l USING ({keys})"""


_CLASS_ROWS = f"SELECT class, stimulus AS row, component - 1 AS i, value AS v FROM ({V.FEAT})"


@query(f"SELECT class, i, j, round(cov, 6) AS cov, round(shrinkage, 6) AS shrinkage FROM ({_lw_sql(_CLASS_ROWS, 'class')})")
def lw_shrinkage(spark, d):
    rows = V.v_vectors(spark, d).select("class", "x")
    return r6(L.shrunk_covariance(rows, ["class"], "x"), "cov", "shrinkage")


_TIME_ROWS = f"SELECT class, (component - 1) // 8 AS tp, stimulus AS row, (component - 1) % 8 AS i, value AS v FROM ({V.FEAT})"


def v_points(spark, d):
    """(class, stimulus, tp, x): eight timepoints of eight channels."""
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("x", 8 * t + 1, 8))
    return V.v_vectors(spark, d).select("class", "stimulus", F.posexplode(at).alias("tp", "x"))


@query(f"SELECT i, j, round(avg(cov), 6) AS cov FROM (SELECT class, i, j, avg(cov) AS cov FROM ({_lw_sql(_TIME_ROWS, 'class, tp')}) GROUP BY ALL) GROUP BY i, j")
def mean_cov(spark, d):
    """Covariance over trials at each timepoint, averaged over timepoints and then conditions."""
    per = L.shrunk_covariance(v_points(spark, d), ["class", "tp"], "x").groupBy("class", "i", "j").agg(F.avg("cov").alias("cov"))
    return r6(per.groupBy("i", "j").agg(F.avg("cov").alias("cov")), "cov")


@query()
def whiten_apply(spark, d):
    """Trials times the inverse square root of the mean covariance of their condition."""
    points = v_points(spark, d)
    cov = L.shrunk_covariance(points, ["class", "tp"], "x").groupBy("class", "i", "j").agg(F.avg("cov").alias("cov"))
    return L.whitened(points, L.whitening(cov, ["class"]), ["class"], "x")


_TRIALS = f"SELECT f.class, p.block, (component - 1) // 8 AS tp, (component - 1) % 8 AS i, avg(value) AS v FROM ({V.FEAT}) f JOIN (SELECT class, stimulus, floor((rep - 1) / (reps / 6.0))::INT AS block FROM ({_REPS})) p USING (class, stimulus) GROUP BY ALL"


def v_pseudo(spark, d):
    """(class, block, tp, x): six pseudo-trials for each condition, of about a sixth of all its repetitions."""
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("x", 8 * t + 1, 8))
    blocks = v_reps(spark, d).withColumn("block", F.floor((F.col("rep") - 1) / (F.col("reps") / F.lit(6.0))).cast("int"))
    reps = blocks.select("class", "block", F.posexplode(at).alias("tp", "x"))
    long = reps.select("class", "block", "tp", F.posexplode("x").alias("i", "v")).groupBy("class", "block", "tp", "i").agg(F.avg("v").alias("v"))
    return long.groupBy("class", "block", "tp").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("all")).select("class", "block", "tp", F.col("all.v").alias("x"))


@query(f"""WITH t AS ({_TRIALS}), f AS (SELECT unnest(range(0, 6)) AS fold),
           m AS (SELECT fold, class, tp, i, avg(v) AS m FROM t, f WHERE block <> fold GROUP BY ALL),
           d AS (SELECT t.block AS fold, t.class, m.class AS near, t.tp, round(sum((v - m) ** 2), 9) AS d FROM t JOIN m ON m.fold = t.block AND m.tp = t.tp AND m.i = t.i GROUP BY ALL),
           h AS (SELECT x.class AS own, y.near AS other, x.fold, x.tp, CASE WHEN x.d < y.d THEN 1.0 WHEN x.d = y.d THEN 0.5 ELSE 0.0 END AS hit FROM d x JOIN d y ON x.class = y.class AND x.fold = y.fold AND x.tp = y.tp WHERE x.near = x.class AND y.near <> y.class)
           SELECT greatest(own, other) AS i, least(own, other) AS j, tp, round(avg(hit), 6) AS accuracy FROM h GROUP BY ALL""")
def decode_centroid(spark, d):
    return r6(D.decode_centroid(v_pseudo(spark, d), "class", "block", "tp", "x"), "accuracy")


@query()
def decode_svm(spark, d):
    """Linear SVM for each pair and timepoint, six folds, each whitened by its training pseudo-trials (pytest compares every accuracy)."""
    return D.decode_svm(v_pseudo(spark, d), "class", "block", "tp", "x")


@query(f"SELECT tp, round(avg(accuracy), 6) AS accuracy FROM ({ORACLE_SQL['decode_centroid']}) GROUP BY tp")
def decoding_curve(spark, d):
    """The mean over all pairs at each timepoint."""
    return r6(decode_centroid(spark, d).groupBy("tp").agg(F.avg("accuracy").alias("accuracy")), "accuracy")


@query()
def nystroem_kernel_pca(spark, d):
    """Ten components of a polynomial kernel of degree four for all stimuli, the kernel taken against 256 training stimuli."""
    rows = V.v_vectors(spark, d).select("stimulus", "split", "x")
    return L.kernel_components(rows, F.col("split") == "train", "x", 10)


@query()
def kernel_pca(spark, d):
    """Ten components of a polynomial kernel of degree four of all training stimuli, for all stimuli (pytest compares it with the dense solution)."""
    rows = V.v_vectors(spark, d).select("stimulus", "split", "x")
    return P.kernel_pca(rows, F.col("split") == "train", "x", 10)


def _wide(spark, d):
    return P.wide_pca(V.v_vectors(spark, d).select("stimulus", "split", "x"), F.col("split") == "train", "x", 32, tile=16)


@query()
def wide_pca(spark, d):
    """Coordinates of all stimuli along the main axes of scaled training stimuli, columns in tiles as a layer's are."""
    return _wide(spark, d)[0]


@query()
def wide_pca_shares(spark, d):
    """Explained shares of the same fit, and the components kept up to 90 %."""
    return r6(_wide(spark, d)[1], "share", "cumulative")
