"""Permutation tests, bootstraps and false discovery rates over the curve and unit views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import inference as I
from tempora.operators import permute as P
from tempora.operators import resample as R
from tempora.plans import views as V
from tempora.plans.registry import registry

B, SEED, CHANCE = 1000, 42, 25.5
QUERIES, ORACLE_SQL, query, r6 = registry()
BS = f"(SELECT unnest(range(0, {B + 1})) AS b)"
_SIGNED = f"""SELECT b, tp, avg((CASE WHEN b = 0 OR {V.draw_sql(SEED, "b", "subject")} % 2 = 0 THEN 1.0 ELSE -1.0 END) * (y - {CHANCE})) AS stat
              FROM ({V.CURVE}) c, {BS} r GROUP BY b, tp"""


def _p_sql(stats: str, keys: str, two: bool = True, extra: str = "") -> str:
    """Ranked p-values by an explicit rank, from (keys, b, stat)."""
    size = "round(abs(stat), 9)" if two else "round(stat, 9)"
    part = f"PARTITION BY {keys}"
    return f"""SELECT {keys}, stat{extra}, (n + 1 - rk) / n AS p FROM (
                 SELECT *, count(*) OVER ({part}) AS n, rank() OVER ({part} ORDER BY size) + (count(*) OVER (PARTITION BY {keys}, size) - 1) / 2.0 AS rk
                 FROM (SELECT *, {size} AS size FROM ({stats}))) WHERE b = 0"""


def _bh_sql(tests: str, family: str = "1", cols: str = "*") -> str:
    return f"""SELECT {cols}, round(p_adj, 6) AS p_adj, p_adj <= 0.05 AS rejected FROM (
                 SELECT *, least(1.0, min(p * m / rn) OVER (PARTITION BY {family} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj
                 FROM (SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY p) AS rn, count(*) OVER (PARTITION BY {family}) AS m FROM ({tests})))"""


_TEST_COLS = "tp, round(stat, 6) AS stat, round(p, 6) AS p"


@query(_bh_sql(_p_sql(_SIGNED, "tp"), cols=_TEST_COLS))
def signflip_test(spark, d):
    tests = I.rank_p(R.sign_flip(V.v_curve(spark, d), ["tp"], B, SEED, chance=CHANCE), ["tp"])
    return r6(I.bh_fdr(tests, []), "stat", "p", "p_adj")


@query(_bh_sql(_p_sql(_SIGNED, "tp", two=False), cols=_TEST_COLS))
def signflip_test_right(spark, d):
    tests = I.rank_p(R.sign_flip(V.v_curve(spark, d), ["tp"], B, SEED, chance=CHANCE), ["tp"], tail="right")
    return r6(I.bh_fdr(tests, []), "stat", "p", "p_adj")


_MANY = 10_000


@query(_bh_sql(_p_sql(_SIGNED.replace(f"range(0, {B + 1})", f"range(0, {_MANY + 1})"), "tp"), cols=_TEST_COLS))
def signflip_test_10k(spark, d):
    """As many resamples as the studies draw."""
    tests = I.rank_p(R.sign_flip(V.v_curve(spark, d), ["tp"], _MANY, SEED, chance=CHANCE), ["tp"])
    return r6(I.bh_fdr(tests, []), "stat", "p", "p_adj")


_SHUFFLED = f"""SELECT b, tp, avg(y) FILTER (WHERE mine) - avg(y) FILTER (WHERE NOT mine) AS stat FROM ({V.CURVE}) c JOIN (
    SELECT b, subject, CASE WHEN b = 0 THEN cohort = 'a' ELSE row_number() OVER (PARTITION BY b ORDER BY {V.draw_sql(SEED, "b", "subject")}, subject) <= count(*) FILTER (WHERE cohort = 'a') OVER (PARTITION BY b) END AS mine
    FROM (SELECT DISTINCT subject, cohort FROM ({V.CURVE})) s, {BS} r) l USING (subject) GROUP BY b, tp"""


@query(_bh_sql(_p_sql(_SHUFFLED, "tp"), cols=_TEST_COLS))
def labelshuffle_test(spark, d):
    tests = I.rank_p(R.label_shuffle(V.v_curve(spark, d), ["tp"], B, SEED), ["tp"])
    return r6(I.bh_fdr(tests, []), "stat", "p", "p_adj")


_TTEST = f"SELECT feature, tp, exp(-abs(avg(y) - {CHANCE})) AS p FROM ({V.CURVE_F}) GROUP BY feature, tp"


@query(_bh_sql(f"SELECT feature, tp, round(p, 9) AS p FROM ({_TTEST})", family="feature", cols="feature, tp, round(p, 6) AS p"))
def bh_fdr(spark, d):
    """Benjamini-Hochberg within each feature, over scores that stand in for p-values."""
    scores = V.v_curve(spark, d, "feature").groupBy("feature", "tp").agg(F.round(F.exp(-F.abs(F.avg("y") - CHANCE)), 9).alias("p"))
    return r6(I.bh_fdr(scores, ["feature"]), "p", "p_adj")


@query(f"""SELECT subject, tp, rank() OVER (PARTITION BY subject ORDER BY v) + (count(*) OVER (PARTITION BY subject, v) - 1) / 2.0 AS rank
           FROM (SELECT subject, tp, round(y, 1) AS v FROM ({V.CURVE}))""")
def average_rank(spark, d):
    rows = V.v_curve(spark, d).select("subject", "tp", F.round("y", 1).alias("v"))
    return I.average_rank(rows, ["subject"], "v").select("subject", "tp", "rank")


def _boot_sql(units: str, within: str, unit: str, extra: str = "") -> str:
    """(within, extra, b, unit, w) of the keyed bootstrap."""
    part = ", ".join(x for x in (within, extra) if x)
    lead, over = (f"{part}, ", f"PARTITION BY {part} ") if part else ("", "")
    key = (part.split(", ") if part else []) + ["b", "k"]
    return f"""SELECT {lead}b, {unit}, count(*) AS w FROM (
                 SELECT {lead}b, CASE WHEN b = 0 THEN k ELSE {V.draw_sql(SEED, *key)} % n END AS k FROM (
                   SELECT *, row_number() OVER ({over}ORDER BY {unit}) - 1 AS k, count(*) OVER ({over}) AS n FROM ({units})) u, {BS} r) x
               JOIN (SELECT *, row_number() OVER ({over}ORDER BY {unit}) - 1 AS k FROM ({units})) n USING ({lead}k) GROUP BY {lead}b, {unit}"""


_SUBJECTS = f"SELECT DISTINCT subject FROM ({V.CURVE})"
_W = _boot_sql(_SUBJECTS, "", "subject")
_W_TP = _boot_sql(f"SELECT DISTINCT subject, tp FROM ({V.CURVE})", "", "subject", "tp")
_W_COHORT = _boot_sql(f"SELECT DISTINCT cohort, subject FROM ({V.CURVE})", "cohort", "subject")
_MEANS = f"SELECT b, tp, sum(w * y) / sum(w) AS stat FROM ({_W}) w JOIN ({V.CURVE}) c USING (subject) GROUP BY b, tp"
_MEANS_TP = f"SELECT b, tp, sum(w * y) / sum(w) AS stat FROM ({_W_TP}) w JOIN ({V.CURVE}) c USING (subject, tp) GROUP BY b, tp"
_MEANS_COHORT = f"SELECT cohort, b, tp, sum(w * y) / sum(w) AS stat FROM ({_W_COHORT}) w JOIN ({V.CURVE}) c USING (cohort, subject) GROUP BY cohort, b, tp"
_MEANS_F = f"SELECT feature, b, tp, sum(w * y) / sum(w) AS stat FROM ({_W}) w JOIN ({V.CURVE_F}) c USING (subject) GROUP BY feature, b, tp"
_MEANS_FC = f"SELECT feature, cohort, b, tp, sum(w * y) / sum(w) AS stat FROM ({_W_COHORT}) w JOIN ({V.CURVE_F}) c USING (cohort, subject) GROUP BY feature, cohort, b, tp"


def _ci_sql(rows: str, keys: str, value: str) -> str:
    lead, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {lead}round(quantile_disc({value}::DOUBLE, 0.025) FILTER (WHERE b > 0), 6) AS lo, round(max({value}::DOUBLE) FILTER (WHERE b = 0), 6) AS est,
                      round(quantile_disc({value}::DOUBLE, 0.975) FILTER (WHERE b > 0), 6) AS hi FROM ({rows}) {group}"""


def _peak_sql(rows: str, keys: str, at: str = "tp") -> str:
    return f"SELECT {keys}, {at} AS peak FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(stat, 9) DESC, {at}) = 1"


@query(_ci_sql(_MEANS_TP, "tp", "stat"))
def boot_curve_ci(spark, d):
    return r6(I.interval(R.bootstrap_mean(V.v_curve(spark, d), ["tp"], B, SEED, tp="tp"), ["tp"], "stat"), "lo", "est", "hi")


@query(_ci_sql(f"SELECT 'all' AS scope, * FROM ({_peak_sql(_MEANS, 'b')})", "scope", "peak"))
def boot_peak_ci(spark, d):
    peaks = I.peak(R.bootstrap_mean(V.v_curve(spark, d), ["tp"], B, SEED), ["b"])
    return r6(I.interval(peaks.withColumn("scope", F.lit("all")), ["scope"], "peak"), "lo", "est", "hi")


_DIFF = f"SELECT b, tp, sum(CASE WHEN cohort = 'a' THEN stat ELSE -stat END) AS stat FROM ({_MEANS_COHORT}) GROUP BY b, tp"


def _difference(spark, d, features=()):
    means = R.bootstrap_mean(V.v_curve(spark, d, *features), [*features, "tp"], B, SEED, within=["cohort"])
    return means, means.groupBy(*features, "b", "tp").agg(F.sum(F.when(F.col("cohort") == "a", F.col("stat")).otherwise(-F.col("stat"))).alias("stat"))


@query(_ci_sql(_DIFF, "tp", "stat"))
def boot_diff_ci(spark, d):
    return r6(I.interval(_difference(spark, d)[1], ["tp"], "stat"), "lo", "est", "hi")


@query(f"""WITH m AS ({_MEANS_COHORT}), p AS ({_peak_sql("SELECT * FROM m", "cohort, b")}), x AS ({_peak_sql("SELECT b, tp, sum(CASE WHEN cohort = 'a' THEN stat ELSE -stat END) AS stat FROM m GROUP BY b, tp", "b")}),
           u AS (SELECT 'cohort ' || cohort AS what, b, peak FROM p UNION ALL SELECT 'peak of difference', b, peak FROM x
                 UNION ALL SELECT 'difference of peaks', b, abs(sum(CASE WHEN cohort = 'a' THEN peak ELSE -peak END)) FROM p GROUP BY b)
           {_ci_sql("SELECT * FROM u", "what", "peak")}""")
def boot_diff_peak(spark, d):
    means, diff = _difference(spark, d)
    peaks = I.peak(means, ["cohort", "b"])
    apart = peaks.groupBy("b").agg(F.abs(F.sum(F.when(F.col("cohort") == "a", F.col("peak")).otherwise(-F.col("peak")))).alias("peak"))
    rows = peaks.select(F.concat(F.lit("cohort "), "cohort").alias("what"), "b", "peak").unionByName(I.peak(diff, ["b"]).withColumn("what", F.lit("peak of difference"))).unionByName(apart.withColumn("what", F.lit("difference of peaks")))
    return r6(I.interval(rows, ["what"], "peak"), "lo", "est", "hi")


def feature_pairs(peaks, keys, feature="feature"):
    """(a, b_feature, keys, diff) for feature pairs a > b, joined on the shared draw."""
    left, right = peaks.withColumnRenamed(feature, "f1").withColumnRenamed("peak", "p1"), peaks.withColumnRenamed(feature, "f2").withColumnRenamed("peak", "p2")
    return left.join(right, keys).filter("f1 > f2").select("f1", "f2", *keys, (F.col("p1") - F.col("p2")).alias("diff"))


_PAIRS = "SELECT x.feature AS f1, y.feature AS f2, x.b, x.peak - y.peak AS diff FROM ({0}) x JOIN ({0}) y ON x.b = y.b AND x.feature > y.feature"
_FLAGS = "(lo <> 0 AND hi <> 0) AS flag_nonzero, (lo > 0 OR hi < 0) AS flag_apart"


@query(f"SELECT *, {_FLAGS} FROM ({_ci_sql(_PAIRS.format(_peak_sql(_MEANS_F, 'feature, b')), 'f1, f2', 'diff')})")
def boot_pair_peak(spark, d):
    """Pairwise peak differences under shared draws, and both readings of a significant interval."""
    peaks = I.peak(R.bootstrap_mean(V.v_curve(spark, d, "feature"), ["feature", "tp"], B, SEED), ["feature", "b"])
    ci = I.interval(feature_pairs(peaks, ["b"]), ["f1", "f2"], "diff")
    return r6(ci, "lo", "est", "hi").withColumns({"flag_nonzero": (F.col("lo") != 0) & (F.col("hi") != 0), "flag_apart": (F.col("lo") > 0) | (F.col("hi") < 0)})


_DD = f"SELECT feature, b, tp, sum(CASE WHEN cohort = 'a' THEN stat ELSE -stat END) AS stat FROM ({_MEANS_FC}) GROUP BY feature, b, tp"
_DD_PAIRS = _PAIRS.format(_peak_sql(_DD, "feature, b"))
_RECENTRED = """SELECT f1, f2, (1 + count(*) FILTER (WHERE abs(diff - x0) > abs(x0))) / (count(*) + 1) AS p FROM ({0}) d JOIN (SELECT f1, f2, diff AS x0 FROM ({0}) WHERE b = 0) o USING (f1, f2) WHERE b > 0 GROUP BY f1, f2"""


@query(f"SELECT * FROM ({_bh_sql(_RECENTRED.format(_DD_PAIRS), cols='f1, f2, round(p, 6) AS p')}) JOIN ({_ci_sql(_DD_PAIRS, 'f1, f2', 'diff')}) USING (f1, f2)")
def boot_pair_diffdiff(spark, d):
    peaks = I.peak(_difference(spark, d, ("feature",))[1], ["feature", "b"])
    pairs = feature_pairs(peaks, ["b"])
    tests = r6(I.bh_fdr(I.recentred_p(pairs, ["f1", "f2"]), []), "p", "p_adj")
    return tests.join(r6(I.interval(pairs, ["f1", "f2"], "diff"), "lo", "est", "hi"), ["f1", "f2"])


_UNIT_SIGNED = f"""SELECT cohort, feature, layer, b, sum((CASE WHEN b = 0 OR {V.draw_sql(SEED, "b", "unit")} % 2 = 0 THEN 1.0 ELSE -1.0 END) * v) AS stat
                   FROM ({V.UNITS}) c, {BS} r GROUP BY cohort, feature, layer, b"""


@query(_bh_sql(_p_sql(_UNIT_SIGNED, "cohort, feature, layer"), family="cohort, feature", cols="cohort, feature, layer, round(stat, 6) AS stat, round(p, 6) AS p"))
def unit_signflip(spark, d):
    """Every cohort, feature and layer; a family is a cohort's feature."""
    tests = I.rank_p(R.sign_flip(V.v_units(spark, d).withColumnRenamed("v", "y"), ["cohort", "feature", "layer"], B, SEED, unit="unit", how="sum"), ["cohort", "feature", "layer"])
    return r6(I.bh_fdr(tests, ["cohort", "feature"]), "stat", "p", "p_adj")


_UW = _boot_sql(f"SELECT DISTINCT layer, unit FROM ({V.UNITS}) WHERE cohort = 'F'", "layer", "unit")
_USUM = f"SELECT layer, feature, b, sum(w * v) AS stat FROM ({_UW}) w JOIN (SELECT layer, feature, unit, v FROM ({V.UNITS}) WHERE cohort = 'F') u USING (layer, unit) GROUP BY layer, feature, b"


def _unit_sums(spark, d):
    """The sums of both cohorts, each drawn for itself under the same keys."""
    units = V.v_units(spark, d).filter(F.col("cohort").isin("F", "O"))
    sums = R.bootstrap_sum(units, ["cohort", "layer", "feature"], B, SEED, within=["layer"], apart=["cohort"])
    return [sums.filter(F.col("cohort") == c).drop("cohort") for c in "FO"]


def _cohorts_sql(text: str) -> str:
    return f"SELECT 'F' AS cohort, * FROM ({text}) UNION ALL SELECT 'O', * FROM ({text.replace("cohort = 'F'", "cohort = 'O'")})"


def _cohorts(spark, d, of):
    """The rows of both cohorts, each made of its own sums."""
    one, two = (of(sums).withColumn("cohort", F.lit(c)) for c, sums in zip("FO", _unit_sums(spark, d)))
    return one.unionByName(two)


@query(_cohorts_sql(_ci_sql(_USUM, "layer, feature", "stat")))
def unit_boot_sum(spark, d):
    return r6(_cohorts(spark, d, lambda sums: I.interval(sums, ["layer", "feature"], "stat")), "lo", "est", "hi")


_UPEAK = _peak_sql(_USUM, "feature, b", "layer")


@query(_cohorts_sql(_ci_sql(_UPEAK, "feature", "peak")))
def unit_boot_peak(spark, d):
    return r6(_cohorts(spark, d, lambda sums: I.interval(I.peak(sums, ["feature", "b"], at="layer"), ["feature"], "peak")), "lo", "est", "hi")


def _unit_pairs(sums):
    pairs = feature_pairs(I.peak(sums, ["feature", "b"], at="layer"), ["b"])
    tests = r6(I.bh_fdr(I.recentred_p(pairs, ["f1", "f2"]), []), "p", "p_adj")
    return tests.join(r6(I.interval(pairs, ["f1", "f2"], "diff"), "lo", "est", "hi"), ["f1", "f2"])


@query(_cohorts_sql(f"SELECT * FROM ({_bh_sql(_RECENTRED.format(_PAIRS.format(_UPEAK)), cols='f1, f2, round(p, 6) AS p')}) JOIN ({_ci_sql(_PAIRS.format(_UPEAK), 'f1, f2', 'diff')}) USING (f1, f2)"))
def unit_boot_pair(spark, d):
    return _cohorts(spark, d, _unit_pairs)


_USUM_O = _USUM.replace("cohort = 'F'", "cohort = 'O'")
_CROSS = f"SELECT layer, feature, b, x.stat - y.stat AS diff FROM ({_USUM}) x JOIN ({_USUM_O}) y USING (layer, feature, b)"
_CROSS_PEAK = f"SELECT feature, b, abs(x.peak - y.peak) AS diff FROM ({_UPEAK}) x JOIN ({_peak_sql(_USUM_O, 'feature, b', 'layer')}) y USING (feature, b)"


@query(f"SELECT 'sum' AS what, layer, feature, lo, est, hi FROM ({_ci_sql(_CROSS, 'layer, feature', 'diff')}) UNION ALL SELECT 'peak', NULL, feature, lo, est, hi FROM ({_ci_sql(_CROSS_PEAK, 'feature', 'diff')})")
def unit_boot_cross(spark, d):
    """Two cohorts of units: the difference of their sums, and the distance of their peak layers."""
    one, two = _unit_sums(spark, d)
    sums = one.join(two.withColumnRenamed("stat", "other"), ["layer", "feature", "b"]).withColumn("diff", F.col("stat") - F.col("other"))
    keys = ["feature", "b"]
    peaks = I.peak(one, keys, at="layer").join(I.peak(two, keys, at="layer").withColumnRenamed("peak", "other"), keys).withColumn("diff", F.abs(F.col("peak") - F.col("other")))
    rows = I.interval(sums, ["layer", "feature"], "diff").withColumn("what", F.lit("sum"))
    more = I.interval(peaks, ["feature"], "diff").withColumns({"what": F.lit("peak"), "layer": F.lit(None).cast("int")})
    return r6(rows.unionByName(more), "lo", "est", "hi").select("what", "layer", "feature", "lo", "est", "hi")


_MODAL_Y = "SELECT vec_id AS stimulus, unnest(range(1, 33))::INT AS component, unnest(embedding[1:32])::DOUBLE AS x, unnest(embedding[33:64])::DOUBLE AS y FROM embeddings"
_PERM = f"""SELECT b, stimulus, other FROM (SELECT b, stimulus, row_number() OVER (PARTITION BY b ORDER BY stimulus) AS place FROM s, {BS}) p
            JOIN (SELECT b, stimulus AS other, CASE WHEN b = 0 THEN row_number() OVER (PARTITION BY b ORDER BY stimulus) ELSE row_number() OVER (PARTITION BY b ORDER BY {V.draw_sql(SEED, "b", "stimulus")}, stimulus) END AS place FROM s, {BS}) q USING (b, place)"""


@query(f"""WITH m AS ({_MODAL_Y}), s AS (SELECT DISTINCT stimulus FROM m), perm AS ({_PERM}),
           st AS (SELECT component, b, corr(x.x, y.y) AS stat FROM perm JOIN m x USING (stimulus) JOIN (SELECT stimulus AS other, component, y FROM m) y USING (other, component) GROUP BY component, b)
           {_bh_sql(_p_sql("SELECT * FROM st", "component"), cols="component, round(stat, 6) AS stat, round(p, 6) AS p")}""")
def stimperm_corr_test(spark, d):
    """Paired correlation over stimuli, against permutations of one side's stimuli."""
    return _stimperm(V.v_vectors(spark, d))


def _stimperm(x, b=B):
    pair = x.select("stimulus", F.slice("x", 1, 32).alias("x"), F.slice("x", 33, 32).alias("y"))
    per = P.correlations(P.permuted_products(pair, [], "stimulus", "y", "x", b, SEED, by="draws"), [])
    tests = I.rank_p(per.select((F.col("component") + 1).alias("component"), "b", F.col("r").alias("stat")), ["component"])
    return r6(I.bh_fdr(tests, []), "stat", "p", "p_adj")
