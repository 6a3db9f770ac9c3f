"""Variance partitioning from features to tests: nested models, what each feature explains alone, sign flips and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import encoding as E
from tempora.operators import events as M
from tempora.operators import inference as I
from tempora.operators import linear as L
from tempora.operators import nested as N
from tempora.operators import resample as R
from tempora.operators import scenarios as C
from tempora.plans import inference_queries as Q
from tempora.plans import similarity_queries as S
from tempora.plans import views as V
from tempora.plans.registry import registry

QUERIES, ORACLE_SQL, query, r6 = registry()

#: Seven features: columns of the first 32 components.
WIDTHS = {"f1": 5, "f2": 5, "f3": 5, "f4": 5, "f5": 4, "f6": 4, "f7": 4}
BLOCKS: dict[str, range] = {}
for _name, _width in WIDTHS.items():
    BLOCKS[_name] = range(sum(map(len, BLOCKS.values())), sum(map(len, BLOCKS.values())) + _width)
ONE_EACH = {f: range(k, k + 1) for k, f in enumerate(WIDTHS)}
BASE = ["f1", "f7"]
MODELS = N.feature_models(list(WIDTHS)) | N.feature_models(list(WIDTHS), BASE)


def v_subjects(spark, d, means: bool):
    """(subject, split, x, y): components 1 to 32 as regressors, or the mean of each feature's; 33 to 64 as targets, 8 timepoints of 4 channels."""
    rows = V.v_vectors(spark, d)
    mean = lambda b: L.dot(F.slice("x", b[0] + 1, len(b)), F.array_repeat(F.lit(1.0 / len(b)), len(b)))
    x = F.array(*[mean(b) for b in BLOCKS.values()]) if means else F.slice("x", 1, 32)
    return rows.select(F.col("class").alias("subject"), "split", x.alias("x"), F.slice("x", 33, 32).alias("y"))


def _scored(spark, d, means=True):
    scores = N.nested_scores(v_subjects(spark, d, means), ["subject"], "x", "y", ONE_EACH if means else BLOCKS, MODELS)
    return scores.withColumns({"tp": F.floor(F.col("target") / 4).cast("int"), "channel": F.col("target") % 4})


_SIZE = len(WIDTHS) + 1
_X = ", ".join(f"list_sum(x[{b[0] + 1}:{b[-1] + 1}]) / {len(b)}" for b in BLOCKS.values())
_OF = ", ".join(f"('{m}', {sorted([list(WIDTHS).index(f) + 1 for f in fs] + [_SIZE])})" for m, fs in MODELS.items())
_PIVOT = "OVER (PARTITION BY model, alpha, subject{})"
_FIT_OF = "SELECT model, alpha, subject, target, stimulus, sum(x[i] * v) AS fit, any_value(y[target]) AS y FROM b JOIN {}r USING (subject) WHERE split = '{}' GROUP BY ALL"


def _solved_sql(rows: str, of: str, size: int, targets: int, which: str = "TRUE") -> str:
    """Common tables r (subject, stimulus, split, x with a last 1, y) and b (model, alpha, subject, i, target, v): every model solved for itself by Gauss-Jordan steps."""
    return f"""r AS MATERIALIZED ({rows}),
    z AS (SELECT subject, stimulus, unnest(range(1, {size + targets + 1})) AS k, unnest(list_concat(x, y)) AS v FROM r WHERE split = 'train'),
    g AS MATERIALIZED (SELECT a.subject, a.k AS i, b.k AS j, sum(a.v * b.v) AS s FROM z a JOIN z b USING (subject, stimulus) WHERE a.k <= {size} GROUP BY ALL),
    m(model, cols) AS (VALUES {of}), al AS (SELECT unnest([{", ".join(repr(float(a)) for a in L.alpha_grid())}]) AS alpha),
    s AS (SELECT 0 AS step, model, cols, alpha, subject, i, j, s + CASE WHEN i = j THEN alpha ELSE 0 END AS v FROM g, m, al WHERE {which} AND list_contains(cols, i) AND (j > {size} OR list_contains(cols, j))
          UNION ALL
          SELECT step + 1, model, cols, alpha, subject, i, j, CASE WHEN i = p THEN prow / pp ELSE v - pcol * prow / pp END FROM (
            SELECT *, max(CASE WHEN i = p THEN v END) {_PIVOT.format(', j')} AS prow, max(CASE WHEN j = p THEN v END) {_PIVOT.format(', i')} AS pcol, max(CASE WHEN i = p AND j = p THEN v END) {_PIVOT.format('')} AS pp
            FROM (SELECT *, cols[step + 1] AS p FROM s WHERE step < len(cols)))),
    b AS MATERIALIZED (SELECT model, alpha, subject, i, j - {size} AS target, v FROM s WHERE step = len(cols) AND j > {size})"""


#: The alpha of the least validation error of each model and subject.
_CHOSEN = f"""v AS (SELECT model, alpha, subject, target, sqrt(avg((y - fit) ** 2)) AS rmse FROM ({_FIT_OF.format('', 'val')}) GROUP BY ALL),
    a AS (SELECT model, alpha, subject FROM (SELECT model, alpha, subject, round(avg(rmse), 9) AS rmse FROM v GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY model, subject ORDER BY rmse, alpha) = 1)"""
_TEST = "CASE WHEN round(var_pop(y), 12) > 0 AND isfinite(corr(y, fit)) THEN corr(y, fit) END AS corr, CASE WHEN round(var_pop(y), 12) > 0 THEN 1 - sum((y - fit) ** 2) / (var_pop(y) * count(*)) END AS r2"
_ROWS = f"SELECT class AS subject, stimulus, split, [{_X}, 1.0] AS x, x[33:64] AS y FROM ({V.VECTORS})"
_SCORES = f"""(WITH RECURSIVE {_solved_sql(_ROWS, _OF, _SIZE, 32)}, {_CHOSEN}, t AS ({_FIT_OF.format('a USING (model, alpha, subject) JOIN ', 'test')})
    SELECT subject, model, alpha, ((target - 1) // 4)::INT AS tp, ((target - 1) % 4)::INT AS channel, {_TEST} FROM t GROUP BY ALL)"""


@query(f"SELECT subject, model, tp, alpha, round(avg(corr), 6) AS y, round(avg(r2), 6) AS r2 FROM {_SCORES} GROUP BY subject, model, tp, alpha")
def nested_models(spark, d):
    """Full, leave-one-out and baseline-plus-one models of seven features, each with its own alpha of thirty: a regressor for each feature."""
    return r6(_scored(spark, d).groupBy("subject", "model", "tp", "alpha").agg(F.avg("corr").alias("y"), F.avg("r2").alias("r2")), "y", "r2")


@query()
def nested_models_wide(spark, d):
    """The same with all 32 regressors in seven features (pytest compares it with refits)."""
    return r6(_scored(spark, d, means=False).groupBy("subject", "model", "tp", "alpha").agg(F.avg("corr").alias("y"), F.avg("r2").alias("r2")), "y", "r2")


def _alone(spark, d, unique, means=True):
    """(subject, feature, tp, y): what each feature explains alone, by channel, averaged over channels."""
    found = N.explained_alone(_scored(spark, d, means), ["subject"], unique)
    return found.groupBy("subject", "feature", F.floor(F.col("target") / 4).cast("int").alias("tp")).agg(F.avg("variance").alias("y"))


def _alone_sql(unique: bool) -> str:
    lead, whole, order, best, side = ("without ", N.FULL, "DESC", "max", "greatest") if unique else ("base and ", N.BASE, "ASC", "min", "least")
    value = "fitted - part" if unique else "part - fitted"
    keys = "subject, tp, channel"
    return f"""(WITH c AS MATERIALIZED (SELECT * FROM {_SCORES}),
        p AS (SELECT {keys}, substr(model, {len(lead) + 1}) AS feature, corr ** 2 AS part FROM c WHERE starts_with(model, '{lead}')), w AS (SELECT {keys}, corr ** 2 AS whole FROM c WHERE model = '{whole}'),
        k AS (SELECT *, (whole + sum(part) OVER o) / (row_number() OVER o + 1) AS mean FROM p JOIN w USING ({keys}) WINDOW o AS (PARTITION BY {keys} ORDER BY part {order}, feature ROWS UNBOUNDED PRECEDING)),
        h AS (SELECT *, {side}(whole, {best}(mean) OVER (PARTITION BY {keys})) AS fitted FROM k)
        SELECT subject, feature, tp, avg(greatest(0.0, {value})) AS y FROM h GROUP BY ALL)"""


def _tested(curve):
    """Right-tailed sign flips over subjects with a rate for each feature, and the interval of whole curves drawn with replacement."""
    keys = ["feature", "tp"]
    tests = I.bh_fdr(I.rank_p(R.sign_flip(curve, keys, Q.B, Q.SEED), keys, tail="right"), ["feature"])
    bounds = I.interval(R.bootstrap_mean(curve, keys, Q.B, Q.SEED), keys, "stat").select(*keys, "lo", "hi")
    return r6(tests.join(bounds, keys), "stat", "p", "p_adj", "lo", "hi")


def _tested_sql(unique: bool) -> str:
    flip = f"CASE WHEN b = 0 OR {V.draw_sql(Q.SEED, 'b', 'subject')} % 2 = 0 THEN 1.0 ELSE -1.0 END"
    flips = f"SELECT b, feature, tp, avg(({flip}) * y) AS stat FROM c, {Q.BS} r GROUP BY ALL"
    boot = f"SELECT feature, b, tp, sum(w * y) / sum(w) AS stat FROM ({Q._boot_sql('SELECT DISTINCT subject FROM c', '', 'subject')}) w JOIN c USING (subject) GROUP BY ALL"
    return f"""WITH c AS MATERIALIZED (SELECT * FROM {_alone_sql(unique)}),
        t AS ({Q._bh_sql(Q._p_sql(flips, "feature, tp", two=False), family="feature", cols="feature, tp, round(stat, 6) AS stat, round(p, 6) AS p")})
        SELECT t.*, lo, hi FROM t JOIN ({Q._ci_sql(boot, "feature, tp", "stat")}) USING (feature, tp)"""


@query(_tested_sql(True))
def unique_variance_test(spark, d):
    """What the full model loses without each feature, at each timepoint, with its test and interval over subjects."""
    return _tested(_alone(spark, d, unique=True))


@query(_tested_sql(False))
def added_variance_test(spark, d):
    """What two baseline features gain with each other one, with its test and interval over subjects."""
    return _tested(_alone(spark, d, unique=False))


#: Stimuli of a subject fall into so many categories, by their number.
CATEGORIES = 5
_WITHOUT = f"SELECT class || '|' || w AS subject, stimulus, split, [{_X}, 1.0] AS x, x[33:64] AS y FROM ({V.VECTORS}), (SELECT unnest(range(0, {CATEGORIES + 1})) AS w) WHERE stimulus % {CATEGORIES} <> w"


@query(f"""WITH RECURSIVE {_solved_sql(_WITHOUT, f"('full', {list(range(1, _SIZE + 1))})", _SIZE, 32)}, {_CHOSEN},
           o AS (SELECT split_part(subject, '|', 1) AS own, alpha FROM a WHERE split_part(subject, '|', 2) = '{CATEGORIES}'),
           t AS ({_FIT_OF.format("o ON split_part(b.subject, '|', 1) = own AND b.alpha = o.alpha JOIN ", 'test').replace('model, alpha, subject', 'model, b.alpha, subject', 1)}),
           c AS (SELECT split_part(subject, '|', 1)::INT AS subject, split_part(subject, '|', 2)::INT AS without, alpha, (target - 1) // 4 AS tp, {_TEST} FROM t GROUP BY subject, alpha, target)
           SELECT subject, CASE WHEN without < {CATEGORIES} THEN without END AS without, alpha, tp::INT AS tp, round(avg(corr), 6) AS y, round(avg(r2), 6) AS r2 FROM c GROUP BY ALL""")
def excluded_categories(spark, d):
    """The encoding chain refitted without each category of stimuli, all of them from one table of moments by category."""
    stimuli = V.v_vectors(spark, d)
    mean = lambda b: L.dot(F.slice("x", b[0] + 1, len(b)), F.array_repeat(F.lit(1.0 / len(b)), len(b)))
    rows = stimuli.select(F.col("class").alias("subject"), "split", (F.col("stimulus") % CATEGORIES).cast("int").alias("category"), F.array(*[mean(b) for b in BLOCKS.values()]).alias("x"), F.slice("x", 33, 32).alias("y"))
    scores = N.excluded_scores(rows, ["subject"], "category", "x", "y").withColumn("tp", F.floor(F.col("target") / 4).cast("int"))
    return r6(scores.groupBy("subject", "without", "alpha", "tp").agg(F.avg("corr").alias("y"), F.avg("r2").alias("r2")), "y", "r2")


#: Months are the frames of a supplier, line numbers its components, return flags the channels.
SWEEP = [C.Scenario("all frames", 1, 12), C.Scenario("first half", 1, 6), C.Scenario("second half", 7, 12), C.Scenario("middle, four components", 4, 9, (1, 2, 3, 4))]
_SWEPT_OF = ", ".join(f"('{s.name}', {[*(s.components or range(1, 8)), 8]})" for s in SWEEP)
_SWEPT_ROWS = f"""WITH p AS (SELECT l_suppkey AS stimulus, l_linenumber AS k, month(l_shipdate) AS f, l_quantity::DOUBLE AS v FROM lineitem),
    sc(scenario, lo, hi) AS (VALUES {', '.join(f"('{s.name}', {s.first_frame}, {s.last_frame})" for s in SWEEP)}),
    x AS (SELECT scenario, stimulus, map_from_entries(list((k, m))) AS by_k FROM (SELECT scenario, stimulus, k, avg(v) AS m FROM p JOIN sc ON f BETWEEN lo AND hi GROUP BY ALL) GROUP BY ALL),
    w AS (SELECT scenario, stimulus, [by_k[1], by_k[2], by_k[3], by_k[4], by_k[5], by_k[6], by_k[7], 1.0] AS x FROM x),
    y AS (SELECT l_suppkey AS stimulus, [avg(l_discount * 100) FILTER (WHERE l_returnflag = 'A'), avg(l_discount * 100) FILTER (WHERE l_returnflag = 'N'), avg(l_discount * 100) FILTER (WHERE l_returnflag = 'R')]::DOUBLE[] AS y FROM lineitem GROUP BY ALL)
    SELECT scenario AS subject, stimulus, CASE WHEN stimulus % 4 <= 1 THEN 'train' WHEN stimulus % 4 = 2 THEN 'val' ELSE 'test' END AS split, x, y FROM w JOIN y USING (stimulus)"""


@query(f"""WITH RECURSIVE {_solved_sql(_SWEPT_ROWS, _SWEPT_OF, 8, 3, 'model = subject')}, {_CHOSEN}, t AS ({_FIT_OF.format('a USING (model, alpha, subject) JOIN ', 'test')})
           SELECT model AS scenario, alpha, (target - 1)::INT AS channel, round(sqrt(avg((y - fit) ** 2)), 6) AS rmse, round(corr(y, fit), 6) AS corr FROM t GROUP BY ALL""")
def scenario_encoding(spark, d):
    """Scenarios of other frames and components, each with its own regressors and alpha, from one scan of the frames."""
    lines = V.read_table(spark, d, "lineitem")
    frames = lines.select(F.col("l_suppkey").alias("stimulus"), F.month("l_shipdate").alias("frame"), F.col("l_linenumber").alias("component"), F.col("l_quantity").cast("double").alias("value"))
    flag = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_discount") * 100)).cast("double")
    y = lines.groupBy(F.col("l_suppkey").alias("stimulus")).agg(F.array(*[flag(f) for f in "ANR"]).alias("y"))
    m = F.col("stimulus") % 4
    rows = C.framed(frames, SWEEP, "stimulus").join(y, "stimulus").withColumn("split", F.when(m <= 1, "train").when(m == 2, "val").otherwise("test"))
    scores = E.encoded(rows, ["scenario"], "x", "y")
    return r6(scores.select("scenario", "alpha", (F.col("target") - 1).alias("channel"), "rmse", "corr"), "rmse", "corr")


_CEILING = f"SELECT ((component - 33) // 4)::INT AS tp, round(avg(lower), 6) AS lower, round(avg(upper), 6) AS upper FROM ({S.ORACLE_SQL['noise_ceiling']}) WHERE component > 32 GROUP BY 1"
_CURVES = f"SELECT subject, model, tp, avg(corr) AS y FROM {_SCORES} GROUP BY ALL"
_FLIPS = f"SELECT b, model, tp, avg((CASE WHEN b = 0 OR {V.draw_sql(Q.SEED, 'b', 'subject')} % 2 = 0 THEN 1.0 ELSE -1.0 END) * y) AS stat FROM c, {Q.BS} r GROUP BY ALL"
_BOOT = f"SELECT model, b, tp, sum(w * y) / sum(w) AS stat FROM ({Q._boot_sql('SELECT DISTINCT subject FROM c', '', 'subject')}) w JOIN c USING (subject) GROUP BY ALL"


@query(f"""WITH c AS MATERIALIZED ({_CURVES}), t AS ({Q._bh_sql(Q._p_sql(_FLIPS, "model, tp"), family="model", cols="model, tp")})
           SELECT model, tp, -400 + 20 * tp AS ms, round(y, 6) AS y, lo, hi, p_adj, rejected, lower, upper FROM (SELECT model, tp, avg(y) AS y FROM c GROUP BY ALL) JOIN (SELECT model, tp, p_adj, rejected FROM t) USING (model, tp)
           JOIN ({Q._ci_sql(_BOOT, "model, tp", "stat")}) USING (model, tp) JOIN ({_CEILING}) USING (tp) WHERE tp >= 1""")
def report_models(spark, d):
    """A report row for each model and timepoint: curve, interval, test, and the noise ceiling of the responses' split halves."""
    curve, keys = _scored(spark, d).groupBy("subject", "model", "tp").agg(F.avg("corr").alias("y")), ["model", "tp"]
    mean = curve.groupBy(*keys).agg(F.round(F.avg("y"), 6).alias("y")).select(*keys, M.milliseconds(F.col("tp")).alias("ms"), "y")
    tests = r6(I.bh_fdr(I.rank_p(R.sign_flip(curve, keys, Q.B, Q.SEED), keys), ["model"]), "p_adj").select(*keys, "p_adj", "rejected")
    bounds = r6(I.interval(R.bootstrap_mean(curve, keys, Q.B, Q.SEED), keys, "stat"), "lo", "hi").select(*keys, "lo", "hi")
    ceiling = S.noise_ceiling(spark, d).filter("component > 32").groupBy(F.floor((F.col("component") - 33) / 4).cast("int").alias("tp"))
    ceiling = r6(ceiling.agg(F.avg("lower").alias("lower"), F.avg("upper").alias("upper")), "lower", "upper")
    rows = C.report(mean, bounds, tests, mean.select(*keys).join(ceiling, "tp"), keys, first_tp=1)
    return rows.select(*keys, "ms", "y", "lo", "hi", "p_adj", "rejected", "lower", "upper")


#: Two modalities (or layers): four features of four components each, from 1 to 16 and from 17 to 32.
_FOURS = {"one": 1, "two": 17}
_OF_FOUR = f"('chain', {list(range(1, 6))})"


def _four(first):
    mean = lambda at: L.dot(F.slice("x", at, 4), F.array_repeat(F.lit(0.25), 4))
    return F.array(*[mean(first + 4 * k) for k in range(4)])


def _four_sql(first: int) -> str:
    return "[" + ", ".join(f"list_sum(x[{first + 4 * k}:{first + 4 * k + 3}]) / 4" for k in range(4)) + ", 1.0]"


def _chained(spark, d, fitted, tested):
    """(subject, tp, alpha, y, r2): alphas and fits with one side's features, test scores with another's."""
    rows = V.v_vectors(spark, d)
    x = F.when(F.col("split") == "test", _four(_FOURS[tested])).otherwise(_four(_FOURS[fitted]))
    scores = E.encoded(rows.select(F.col("class").alias("subject"), "split", x.alias("x"), F.slice("x", 33, 32).alias("y")), ["subject"], "x", "y")
    return scores.groupBy("subject", F.floor((F.col("target") - 1) / 4).cast("int").alias("tp"), "alpha").agg(F.avg("corr").alias("y"), F.avg("r2").alias("r2"))


def _chained_sql(fitted: str, tested: str) -> str:
    rows = f"SELECT class AS subject, stimulus, split, CASE WHEN split = 'test' THEN {_four_sql(_FOURS[tested])} ELSE {_four_sql(_FOURS[fitted])} END AS x, x[33:64] AS y FROM ({V.VECTORS})"
    return f"""(WITH RECURSIVE {_solved_sql(rows, _OF_FOUR, 5, 32)}, {_CHOSEN}, t AS ({_FIT_OF.format('a USING (model, alpha, subject) JOIN ', 'test')})
        SELECT subject, tp, alpha, avg(corr) AS y, avg(r2) AS r2 FROM (SELECT subject, alpha, target, ((target - 1) // 4)::INT AS tp, {_TEST} FROM t GROUP BY ALL) GROUP BY ALL)"""


@query(" UNION ALL ".join(f"SELECT '{a}' AS fitted, '{b}' AS tested, subject, tp, alpha, round(y, 6) AS y, round(r2, 6) AS r2 FROM {_chained_sql(a, b)}" for a in _FOURS for b in _FOURS))
def cross_modal_chain(spark, d):
    """The whole chain across modalities: four regressors and thirty alphas of either one, scored with its own and the other's features."""
    of = {a: C.stacked({b: _chained(spark, d, a, b) for b in _FOURS}, "tested") for a in _FOURS}
    return r6(C.stacked(of, "fitted"), "y", "r2")


_LAYERS = f"SELECT subject, tp, one.y - two.y AS y FROM {_chained_sql('one', 'one')} one JOIN {_chained_sql('two', 'two')} two USING (subject, tp)"


@query(f"""WITH c AS MATERIALIZED ({_LAYERS}) {Q._bh_sql(Q._p_sql(f"SELECT b, tp, avg((CASE WHEN b = 0 OR {V.draw_sql(Q.SEED, 'b', 'subject')} % 2 = 0 THEN 1.0 ELSE -1.0 END) * y) AS stat FROM c, {Q.BS} r GROUP BY ALL", "tp"), cols="tp, round(stat, 6) AS stat, round(p, 6) AS p")}""")
def layer_chain_test(spark, d):
    """The chain with another layer's activations instead: the difference of their curves, with sign flips over subjects."""
    one, two = (_chained(spark, d, k, k).select("subject", "tp", F.col("y").alias(k)) for k in _FOURS)
    curve = one.join(two, ["subject", "tp"]).select("subject", "tp", (F.col("one") - F.col("two")).alias("y"))
    return r6(I.bh_fdr(I.rank_p(R.sign_flip(curve, ["tp"], Q.B, Q.SEED), ["tp"]), []), "stat", "p", "p_adj")
