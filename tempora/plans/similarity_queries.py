"""Dissimilarity matrices, RSA, CKA, feature and cross-modality similarity, noise ceiling, variance partitioning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.functions.rng import draw
from tempora.operators import inference as I
from tempora.operators import permute as P
from tempora.operators import resample as R
from tempora.operators import similarity as S
from tempora.operators.linear import correlation, dot
from tempora.operators.nested import partition_scores
from tempora.plans import inference_queries as Q
from tempora.plans import views as V
from tempora.plans.registry import registry

QUERIES, ORACLE_SQL, query, r6 = registry()
_LONG = f"SELECT stimulus, component, value FROM ({V.FEAT})"
_UNIT = f"SELECT stimulus, component, (value - avg(value) OVER w) / sqrt(var_pop(value) OVER w * 64) AS u FROM ({{}}) WINDOW w AS (PARTITION BY stimulus)"
_RANKED = f"SELECT stimulus, component, rank() OVER (PARTITION BY stimulus ORDER BY value) + (count(*) OVER (PARTITION BY stimulus, value) - 1) / 2.0 AS value FROM ({_LONG})"
_RDM = "SELECT x.stimulus AS i, y.stimulus AS j, 1 - sum(x.u * y.u) AS d FROM ({0}) x JOIN ({0}) y ON x.component = y.component AND x.stimulus > y.stimulus GROUP BY x.stimulus, y.stimulus"


def _vectors(spark, d):
    return V.v_vectors(spark, d).select("stimulus", "x")


@query(f"SELECT i, j, round(d, 6) AS d FROM ({_RDM.format(_UNIT.format(_LONG))})")
def rdm_pearson(spark, d):
    return S.rdm(_vectors(spark, d), "stimulus", "x", places=6)


@query(f"SELECT i, j, round(d, 6) AS d FROM ({_RDM.format(_UNIT.format(_RANKED))})")
def rdm_spearman(spark, d):
    return S.rdm(_vectors(spark, d), "stimulus", "x", "spearman", places=6)


@query(f"SELECT i, j, round(d, 6) AS d FROM ({_RDM.format(f'SELECT stimulus, component, value AS u FROM ({_LONG})')})")
def rdm_dot(spark, d):
    return S.rdm(_vectors(spark, d), "stimulus", "x", "dot", places=6)


_HALF = "SELECT stimulus, component, (value - avg(value) OVER w) / sqrt(var_pop(value) OVER w * 32) AS u FROM ({}) WHERE component {} 32 WINDOW w AS (PARTITION BY stimulus)"


def _halved(spark, d):
    return _vectors(spark, d).select("stimulus", F.slice("x", 1, 32).alias("one"), F.slice("x", 33, 32).alias("two"))


def _half_rdms(spark, d):
    """(i, j, a, b): the dissimilarities of both halves of the components, from one pass over pairs of blocks."""
    return S.rdms(_halved(spark, d), "stimulus", {"a": "one", "b": "two"})


@query(f"""WITH a AS ({_RDM.format(_HALF.format(_LONG, '<='))}), b AS ({_RDM.format(_HALF.format(_LONG, '>'))}),
           r AS (SELECT rank() OVER (ORDER BY round(a.d, 9)) + (count(*) OVER (PARTITION BY round(a.d, 9)) - 1) / 2.0 AS x, rank() OVER (ORDER BY round(b.d, 9)) + (count(*) OVER (PARTITION BY round(b.d, 9)) - 1) / 2.0 AS y FROM a JOIN b USING (i, j))
           SELECT round(corr(x, y), 6) AS similarity FROM r""")
def rsa(spark, d):
    return r6(S.rdm_rank_correlation(_halved(spark, d), "stimulus", "one", "two"), "similarity")


@query(f"WITH a AS ({_RDM.format(_HALF.format(_LONG, '<='))}), b AS ({_RDM.format(_HALF.format(_LONG, '>'))}) SELECT round(corr(a.d, b.d), 6) AS similarity FROM a JOIN b USING (i, j)")
def rsa_pearson(spark, d):
    return r6(S.rdm_correlation(_halved(spark, d), "stimulus", "one", "two"), "similarity")


_CKA = f"""WITH f AS ({V.FEAT}), n AS (SELECT count(DISTINCT stimulus) AS n FROM f),
    c AS (SELECT x.component AS i, y.component AS j, covar_pop(x.value, y.value) * count(*) AS c FROM f x JOIN f y USING (stimulus) GROUP BY 1, 2),
    h AS (SELECT sum(c * c) FILTER (WHERE i <= 32 AND j > 32) AS xy, sum(c * c) FILTER (WHERE i <= 32 AND j <= 32) AS xx, sum(c * c) FILTER (WHERE i > 32 AND j > 32) AS yy FROM c)
    SELECT round((xy / (n - 1) ** 2) / (sqrt((xx / (n - 1) ** 2) * (yy / (n - 1) ** 2)) + 1e-10), 6) AS cka FROM h, n"""


@query(_CKA)
def cka(spark, d):
    v = V.v_vectors(spark, d).select(F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b"))
    return r6(S.linear_cka(v, "a", "b"), "cka")


_MODAL = f"SELECT x.stimulus, x.class, x.component, x.value AS a, y.value AS b FROM ({V.FEAT}) x JOIN ({V.FEAT}) y ON x.stimulus = y.stimulus AND y.component = x.component + 32 WHERE x.component <= 32"


def _modal(spark, d):
    pairs = F.arrays_zip("a", "b")
    halves = V.v_vectors(spark, d).withColumns({"a": F.slice("x", 1, 32), "b": F.slice("x", 33, 32)})
    return halves.select("stimulus", "class", F.posexplode(pairs)).select("stimulus", "class", (F.col("pos") + 1).alias("component"), F.col("col.a").alias("a"), F.col("col.b").alias("b"))


@query(f"SELECT f1, f2, round(avg(greatest(least(r, 1.0), -1.0)), 6) AS similarity FROM (SELECT x.class AS f1, y.class AS f2, x.component, corr(x.value, y.value) AS r FROM (SELECT class, component, value, row_number() OVER (PARTITION BY class, component ORDER BY stimulus) AS k FROM ({V.FEAT})) x JOIN (SELECT class, component, value, row_number() OVER (PARTITION BY class, component ORDER BY stimulus) AS k FROM ({V.FEAT})) y ON x.component = y.component AND x.k = y.k AND x.class > y.class GROUP BY ALL) GROUP BY f1, f2")
def feature_similarity(spark, d):
    """Classes stand for features: mean over components of the clipped correlation over paired stimuli."""
    k = F.row_number().over(Window.partitionBy("class").orderBy("stimulus"))
    rows = V.v_vectors(spark, d).select("class", k.alias("k"), F.posexplode("x").alias("component", "value"))
    one, two = rows.toDF("f1", "k", "component", "u"), rows.toDF("f2", "k", "component", "v")
    per = one.join(two, ["k", "component"]).filter("f1 > f2").groupBy("f1", "f2", "component").agg(correlation("u", "v").alias("r"))
    return r6(per.groupBy("f1", "f2").agg(F.avg(S.clipped(F.col("r"))).alias("similarity")), "similarity")


@query(f"SELECT class, round(corr(a, b), 6) AS r, count(*) AS n FROM ({_MODAL}) GROUP BY class")
def cross_modal_corr(spark, d):
    return r6(_modal(spark, d).groupBy("class").agg(correlation("a", "b").alias("r"), F.count(F.lit(1)).alias("n")), "r")


@query(f"SELECT tp, round(avg(r), 6) AS r FROM (SELECT (component - 1) // 4 AS tp, component, corr(a, b) AS r FROM ({_MODAL}) GROUP BY ALL) GROUP BY tp")
def response_corr(spark, d):
    """Channels are four components each: correlation over stimuli, then the mean over channels."""
    per = _modal(spark, d).groupBy(F.floor((F.col("component") - 1) / 4).alias("tp"), "component").agg(correlation("a", "b").alias("r"))
    return r6(per.groupBy("tp").agg(F.avg("r").alias("r")), "r")

PERMUTATIONS, PERM_SEED = 1000, 42


def _walked_sql(items: str, within: str) -> str:
    """(within, b, k, v): the places 0 to n - 1 of ``items`` (within, stimulus) and where the keyed network sends them; b = 0 leaves them."""
    lead, over = (f"{within}, ", f"PARTITION BY {within} ") if within else ("", "")
    half = "greatest(1, ceil(CASE WHEN n > 1 THEN floor(log2(n - 1)) + 1 ELSE 0 END / 2.0))::BIGINT"
    keys = ", ".join(V.draw_sql(PERM_SEED, "b", r) for r in range(P.ROUNDS))
    body = "SELECT *, v >> h AS l, v & ((1::BIGINT << h) - 1) AS r FROM w WHERE NOT done"
    for k in range(P.ROUNDS):
        mixed = f"((r * {P.FIRST} + keys[{k + 1}]) % 4294967296)"
        turned = f"((({mixed} >> 16) * {P.SECOND} + {mixed}) % 4294967296)"
        body = f"SELECT * EXCLUDE (l, r), r AS l, xor(l, {turned} >> (32 - h)) AS r FROM ({body})"
    return f"""(WITH RECURSIVE i AS (SELECT {lead}(row_number() OVER ({over}ORDER BY stimulus) - 1)::BIGINT AS k, count(*) OVER ({over}) AS n FROM ({items})),
        w AS (SELECT {lead}b, k, n, {half} AS h, [{keys}] AS keys, k AS v, b = 0 AS done, 0 AS step FROM i, (SELECT unnest(range(0, {PERMUTATIONS + 1})) AS b) q
              UNION ALL SELECT {lead}b, k, n, h, keys, l << h | r, (l << h | r) < n, step + 1 FROM ({body}))
        SELECT {lead}b, k, v FROM w WHERE done)"""


def _halves(spark, d):
    return V.v_vectors(spark, d).select("class", "stimulus", F.slice("x", 1, 32).alias("x"), F.slice("x", 33, 32).alias("y"))


_PAIRED = f"SELECT class, stimulus, x[1:32] AS x, x[33:64] AS y FROM ({V.VECTORS})"


@query(f"""WITH v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY class ORDER BY stimulus) - 1 AS k FROM ({_PAIRED})),
           s AS (SELECT class, b, corr(p, q) AS stat FROM (SELECT class, b, unnest(a.x) AS p, unnest(c.y) AS q FROM {_walked_sql(_PAIRED, 'class')} w JOIN v a USING (class, k) JOIN (SELECT class, k AS v, y FROM v) c USING (class, v)) GROUP BY class, b)
           SELECT class, round(stat, 6) AS r, round(p, 6) AS p FROM ({Q._p_sql('SELECT * FROM s', 'class')})""")
def cross_modal_test(spark, d):
    """Two modalities' correlation over all stimuli and components of a feature (a class), against permuted stimuli."""
    stats = P.flat_correlation(P.permuted_products(_halves(spark, d), ["class"], "stimulus", "x", "y", PERMUTATIONS, PERM_SEED), ["class"])
    return r6(I.rank_p(stats.withColumnRenamed("r", "stat"), ["class"]).withColumnRenamed("stat", "r"), "r", "p")


@query(f"""WITH v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY stimulus) - 1 AS k FROM ({_PAIRED})),
           c AS (SELECT b, j, corr(p, q) AS r FROM (SELECT b, unnest(range(0, 32)) AS j, unnest(a.x) AS p, unnest(e.y) AS q FROM {_walked_sql(_PAIRED, '')} w JOIN v a USING (k) JOIN (SELECT k AS v, y FROM v) e USING (v)) GROUP BY b, j),
           s AS (SELECT (j // 4)::INT AS tp, b, avg(r) AS stat FROM c GROUP BY 1, 2)
           {Q._bh_sql(Q._p_sql('SELECT * FROM s', 'tp'), cols='tp, round(stat, 6) AS r, round(p, 6) AS p')}""")
def response_corr_test(spark, d):
    """The curve of response correlations, mean over channels, against permuted stimuli, with its false discovery rate."""
    per = P.correlations(P.permuted_products(_halves(spark, d), [], "stimulus", "x", "y", PERMUTATIONS, PERM_SEED), [])
    curve = per.groupBy(F.floor(F.col("component") / 4).cast("int").alias("tp"), "b").agg(F.avg("r").alias("stat"))
    return r6(I.bh_fdr(I.rank_p(curve, ["tp"]), []).withColumnRenamed("stat", "r"), "r", "p", "p_adj")


@query(f"SELECT component, round((n * r) / (n - 1) * (sd_a * sd_b) / ((sd_a + 1e-8) * (sd_b + 1e-8)), 6) AS parity, round(r, 6) AS pearson FROM (SELECT component, count(*) AS n, corr(a, b) AS r, stddev_pop(a) AS sd_a, stddev_pop(b) AS sd_b FROM ({_MODAL}) GROUP BY component)")
def colwise_corr(spark, d):
    from tempora.operators.linear import parity_corr

    return r6(_modal(spark, d).groupBy("component").agg(parity_corr("a", "b").alias("parity"), correlation("a", "b").alias("pearson")), "parity", "pearson")


SPLITS = 100
_REPS = f"SELECT class, stimulus, row_number() OVER (PARTITION BY class ORDER BY {V.draw_sql(42, 'class', 'stimulus')}, stimulus) AS rep, count(*) OVER (PARTITION BY class) AS reps FROM ({V.VECTORS})"


def v_reps(spark, d):
    """(class, stimulus, rep, reps, x): the repetitions of each condition in a keyed random order, and how many there are."""
    order = Window.partitionBy("class").orderBy(draw(42, F.col("class"), F.col("stimulus")), "stimulus")
    return V.v_vectors(spark, d).withColumns({"rep": F.row_number().over(order), "reps": F.count(F.lit(1)).over(Window.partitionBy("class"))}).select("class", "stimulus", "rep", "reps", "x")


@query(f"""WITH r AS ({_REPS}), s AS (SELECT unnest(range(1, {SPLITS + 1})) AS split),
           h AS (SELECT split, class, stimulus, row_number() OVER (PARTITION BY split, class ORDER BY {V.draw_sql(7, 'split', 'class', 'rep')}, rep) <= reps // 2 AS first FROM r, s),
           m AS (SELECT h.split, component, class, avg(value) FILTER (WHERE first) AS a, avg(value) FILTER (WHERE NOT first) AS b, avg(value) AS w FROM h JOIN ({V.FEAT}) f USING (class, stimulus) GROUP BY ALL)
           SELECT component, round(avg(lo), 6) AS lower, round(avg(hi), 6) AS upper FROM (SELECT split, component, corr(a, b) AS lo, corr(a, w) AS hi FROM m GROUP BY ALL) GROUP BY component""")
def noise_ceiling(spark, d):
    """All repetitions of each condition, split into halves ``SPLITS`` times."""
    return _ceiling(v_reps(spark, d), SPLITS, F.floor(F.col("reps") / 2))


def _ceiling(reps, splits, half):
    rows = reps.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    order = Window.partitionBy("split", "class").orderBy(draw(7, F.col("split"), F.col("class"), F.col("rep")), "rep")
    halves = rows.withColumn("first", F.row_number().over(order) <= half).select("split", "class", "first", F.posexplode("x").alias("component", "value"))
    means = halves.groupBy("split", "component", "class").agg(F.avg(F.when(F.col("first"), F.col("value"))).alias("a"), F.avg(F.when(~F.col("first"), F.col("value"))).alias("b"), F.avg("value").alias("w"))
    per = means.groupBy("split", "component").agg(correlation("a", "b").alias("lo"), correlation("a", "w").alias("hi"))
    return r6(per.groupBy((F.col("component") + 1).alias("component")).agg(F.avg("lo").alias("lower"), F.avg("hi").alias("upper")), "lower", "upper")


_PARTS = f"SELECT tp, feature, avg(y) / 50 AS part FROM ({V.CURVE_F}) GROUP BY tp, feature"
_FULL = f"SELECT tp, avg(y) / 50 AS whole FROM ({V.CURVE}) GROUP BY tp"


def _scores(spark, d):
    parts = V.v_curve(spark, d, "feature").groupBy("tp", "feature").agg((F.avg("y") / 50).alias("part"))
    return parts, V.v_curve(spark, d).groupBy("tp").agg((F.avg("y") / 50).alias("whole"))


def _partition_sql(order: str, best: str, side: str, value: str) -> str:
    return f"""SELECT tp, feature, round(greatest(0.0, {value}), 6) AS variance FROM (
        SELECT *, {side}(whole, {best}(mean) OVER (PARTITION BY tp)) AS fitted FROM (
          SELECT *, (whole + sum(part) OVER w) / (row_number() OVER w + 1) AS mean FROM ({_PARTS}) JOIN ({_FULL}) USING (tp) WINDOW w AS (PARTITION BY tp ORDER BY part {order}, feature ROWS UNBOUNDED PRECEDING)))"""


@query(_partition_sql("DESC", "max", "greatest", "fitted - part"))
def variance_partition_unique(spark, d):
    return r6(partition_scores(*_scores(spark, d), ["tp"]), "variance")


@query(_partition_sql("ASC", "min", "least", "part - fitted"))
def variance_partition_added(spark, d):
    return r6(partition_scores(*_scores(spark, d), ["tp"], unique=False), "variance")


_PEAKS = "SELECT feature, max(tp) AS p FROM (SELECT feature, tp, row_number() OVER (PARTITION BY feature ORDER BY round(avg(y), 9) DESC, tp) AS rn FROM ({0}) GROUP BY feature, tp) WHERE rn = 1 GROUP BY feature"
_BY_MONTH = "SELECT month(l_shipdate)::INT AS feature, l_linenumber AS tp, {} AS y FROM lineitem"
_P1, _P2 = _PEAKS.format(_BY_MONTH.format("l_quantity")), _PEAKS.format(_BY_MONTH.format("l_discount"))


_PEAK_PAIR = (_P1, _P2)


def month_peaks(spark, d, value, name):
    rows = V.read_table(spark, d, "lineitem").groupBy(F.month("l_shipdate").alias("feature"), F.col("l_linenumber").alias("tp")).agg(F.avg(value).alias("stat"))
    return I.peak(rows, ["feature"]).withColumnRenamed("peak", name)


def _peak_ranks(spark, d, features=12):
    both = month_peaks(spark, d, "l_quantity", "p1").join(month_peaks(spark, d, "l_discount", "p2"), "feature").filter(F.col("feature") <= features)
    both = both.withColumn("_all", F.lit(1))
    return I.average_rank(I.average_rank(both, ["_all"], "p1", "r1"), ["_all"], "p2", "r2")


def _ranks_sql(features: int) -> str:
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return f"SELECT feature, {rank.format('p1')} AS r1, {rank.format('p2')} AS r2 FROM (SELECT feature, a.p AS p1, b.p AS p2 FROM ({_P1}) a JOIN ({_P2}) b USING (feature) WHERE feature <= {features})"


@query(f"SELECT round(corr(r1, r2), 6) AS spearman, count(*) AS n FROM ({_ranks_sql(12)})")
def peak_association(spark, d):
    return r6(_peak_ranks(spark, d).agg(correlation("r1", "r2").alias("spearman"), F.count(F.lit(1)).alias("n")), "spearman")


@query(f"""WITH RECURSIVE f AS ({_ranks_sql(5)}), v AS (SELECT row_number() OVER (ORDER BY feature) AS k, r1, r2 FROM f),
           p AS (SELECT [k] AS used, 1 AS n FROM v UNION ALL SELECT list_append(used, v.k), n + 1 FROM p, v WHERE NOT list_contains(used, v.k)),
           s AS (SELECT used, corr(a.r1, b.r2) AS r FROM (SELECT used, unnest(used) AS j, unnest(range(1, 6)) AS k FROM p WHERE n = 5) q JOIN v a ON a.k = q.k JOIN v b ON b.k = q.j GROUP BY used)
           SELECT count(*) AS orderings, round((SELECT corr(r1, r2) FROM v), 6) AS observed, round(avg((round(abs(r), 9) >= round(abs((SELECT corr(r1, r2) FROM v)), 9))::INT), 6) AS p FROM s""")
def exact_perm(spark, d):
    """Every ordering of a few peaks: the share whose correlation is at least as large."""
    rows = _peak_ranks(spark, d, 5).withColumn("k", F.row_number().over(Window.partitionBy("_all").orderBy("feature")))
    packed = rows.groupBy("_all").agg(F.sort_array(F.collect_list(F.struct("k", "r1", "r2"))).alias("v"))
    orders = packed.withColumn("used", F.array().cast("array<int>"))
    for _ in range(5):  # five peaks: 120 rows in the end
        orders = orders.withColumn("next", F.explode(F.array_except(F.sequence(F.lit(1), F.size("v")), "used"))).withColumn("used", F.concat("used", F.array("next"))).drop("next")
    long = orders.select("used", F.explode("v").alias("e"), "v").select("used", F.col("e.r1").alias("a"), F.col("e.r2").alias("own"), F.expr("v[used[e.k - 1] - 1].r2").alias("b"))
    per = long.groupBy("used").agg(correlation("a", "b").alias("r"), correlation("a", "own").alias("observed"))
    return r6(per.agg(F.count(F.lit(1)).alias("orderings"), F.first("observed").alias("observed"), F.avg((F.round(F.abs("r"), 9) >= F.round(F.abs("observed"), 9)).cast("int")).alias("p")), "observed", "p")

@query(f"""WITH RECURSIVE f AS ({_ranks_sql(7)}), v AS (SELECT row_number() OVER (ORDER BY feature) AS k, r1, r2 FROM f),
           p AS (SELECT [k] AS used, 1 AS n FROM v UNION ALL SELECT list_append(used, v.k), n + 1 FROM p, v WHERE NOT list_contains(used, v.k)),
           s AS (SELECT used, corr(a.r1, b.r2) AS r FROM (SELECT used, unnest(used) AS j, unnest(range(1, 8)) AS k FROM p WHERE n = 7) q JOIN v a ON a.k = q.k JOIN v b ON b.k = q.j GROUP BY used)
           SELECT count(*) AS orderings, round((SELECT corr(r1, r2) FROM v), 6) AS observed, round(avg((round(abs(r), 9) >= round(abs((SELECT corr(r1, r2) FROM v)), 9))::INT), 6) AS p FROM s""")
def exact_perm_seven(spark, d):
    """All 5,040 orderings of seven peaks as a range of numbers: the share whose correlation is at least as large, either side."""
    ranks = _peak_ranks(spark, d, 7).groupBy().agg(F.sort_array(F.collect_list(F.struct("feature", "r1", "r2"))).alias("v")).select(F.col("v.r1").alias("r1"), F.col("v.r2").alias("r2"))
    tried = P.orderings(spark, 7).crossJoin(ranks)  # one row of seven peaks
    moved = F.transform("used", lambda k: F.element_at("r2", k))
    both = tried.select(_pearson(F.col("r1"), moved).alias("r"), _pearson(F.col("r1"), F.col("r2")).alias("observed"))
    hit = F.round(F.abs("r"), 9) >= F.round(F.abs("observed"), 9)
    return r6(both.agg(F.count(F.lit(1)).alias("orderings"), F.first("observed").alias("observed"), F.avg(hit.cast("int")).alias("p")), "observed", "p")


def _pearson(x, y):
    """Pearson's correlation of two short arrays, null where one is constant."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    spread = lambda a, b: dot(a, b) - add(a) * add(b) / F.size(x)
    return F.try_divide(spread(x, y), F.sqrt(spread(x, x) * spread(y, y)))


_UNIT_PEAKS = "SELECT unit, feature, tp AS p1 FROM (SELECT l_suppkey AS unit, month(l_shipdate)::INT AS feature, l_linenumber AS tp, avg(l_quantity) AS y FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY unit, feature ORDER BY round(y, 9) DESC, tp) = 1"
_UNIT_RANK = "rank() OVER (PARTITION BY unit ORDER BY {0}) + (count(*) OVER (PARTITION BY unit, {0}) - 1) / 2.0"
_UNIT_R = f"SELECT unit, corr(r1, r2) AS y FROM (SELECT unit, {_UNIT_RANK.format('p1')} AS r1, {_UNIT_RANK.format('p2')} AS r2 FROM ({_UNIT_PEAKS}) a JOIN (SELECT feature, p AS p2 FROM ({_P2})) b USING (feature)) GROUP BY unit HAVING stddev_pop(r1) > 0 AND stddev_pop(r2) > 0"


@query(f"""WITH c AS MATERIALIZED ({_UNIT_R}), t AS ({Q._p_sql(f"SELECT 'all' AS scope, b, avg((CASE WHEN b = 0 OR {V.draw_sql(Q.SEED, 'b', 'unit')} % 2 = 0 THEN 1.0 ELSE -1.0 END) * y) AS stat FROM c, {Q.BS} r GROUP BY b", "scope", two=False)})
           SELECT scope, round(stat, 6) AS r, round(p, 6) AS p, (SELECT count(*) FROM c) AS units FROM t""")
def peak_association_units(spark, d):
    """Each unit's rank correlation of its own peaks with the other measure's, units without one left out: right-tailed sign flips over units."""
    cells = V.read_table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.month("l_shipdate").alias("feature"), F.col("l_linenumber").alias("tp")).agg(F.avg("l_quantity").alias("stat"))
    peaks = I.peak(cells, ["unit", "feature"]).withColumnRenamed("peak", "p1").join(month_peaks(spark, d, "l_discount", "p2"), "feature")
    ranked = I.average_rank(I.average_rank(peaks, ["unit"], "p1", "r1"), ["unit"], "p2", "r2")
    units = ranked.groupBy("unit").agg(correlation("r1", "r2").alias("y")).filter("y IS NOT NULL").withColumn("scope", F.lit("all"))
    tests = I.rank_p(R.sign_flip(units, ["scope"], Q.B, Q.SEED, unit="unit"), ["scope"], tail="right")
    return r6(tests.join(units.groupBy("scope").agg(F.count(F.lit(1)).alias("units")), "scope").withColumnRenamed("stat", "r"), "r", "p")


@query(f"SELECT feature, stimulus, round(list_sum(x), 6) AS total, len(x) AS width FROM (SELECT 'all' AS feature, stimulus, list(value ORDER BY part, component) AS x FROM (SELECT stimulus, component, value, (component - 1) // 16 AS part FROM ({V.FEAT})) GROUP BY stimulus)")
def feature_concat(spark, d):
    parts = [V.v_vectors(spark, d).select("stimulus", F.lit(f"part {k}").alias("name"), F.slice("x", 16 * k + 1, 16).alias("x")) for k in range(4)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    whole = S.concatenated(rows, "stimulus", "name", "x")
    return r6(whole.select(F.lit("all").alias("feature"), "stimulus", F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total"), F.size("x").cast("long").alias("width")), "total")


@query("""WITH n AS (SELECT list(DISTINCT p_type ORDER BY p_type) AS names FROM part)
          SELECT array_to_string(names, ', ') AS feature_set, 'none' AS left_out FROM n
          UNION ALL SELECT array_to_string(list_filter(names, lambda x: x <> f), ', '), f FROM (SELECT names, unnest(names) AS f FROM n)""")
def loo_sets(spark, d):
    names = [r[0] for r in V.read_table(spark, d, "part").select("p_type").distinct().orderBy("p_type").collect()]  # six types
    return S.leave_one_out(names, spark)


@query()
def rsa_kendall(spark, d):
    """Kendall's tau-b of the two halves' dissimilarities, over every pair of stimuli."""
    return spark.createDataFrame([(round(S.rdm_kendall(_halved(spark, d), "stimulus", "one", "two"), 6),)], "similarity double")
