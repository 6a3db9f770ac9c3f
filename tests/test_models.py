import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import decode as D
from tempora.operators import events as E
from tempora.operators import inference as I
from tempora.operators import linear as L
from tempora.operators import similarity as S
from tempora.sources import tables as T


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    y = x @ rng.normal(size=(5, 3)) + rng.normal(size=(80, 3))
    return x, y, spark.createDataFrame([(i % 2, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "half int, x array<double>, y array<double>").repartition(5)


def test_moments_and_ridge(xy):
    x, y, df = xy
    row = L.moments(df, [], "x", "y").first()
    gram, xty, _ = L.split_moments(row["d"], row["q"], row["sums"])
    ones = np.hstack([x, np.ones((80, 1))])
    assert np.allclose(gram, ones.T @ ones) and np.allclose(xty, ones.T @ y)
    beta = L.ridge(gram, xty, np.array([0.0, 3.0]))
    assert np.allclose(beta[0], np.linalg.lstsq(ones, y, rcond=None)[0])
    assert np.allclose(beta[1], np.linalg.solve(ones.T @ ones + 3 * np.eye(6), ones.T @ y))


def test_ridge_search_scores(xy):
    x, y, df = xy
    got = L.ridge_search(df.filter("half = 0"), df.filter("half = 1"), [], "x", "y", np.array([2.0])).orderBy("target").collect()
    ones = np.hstack([x, np.ones((80, 1))])
    a, b = ones[::2], ones[1::2]
    fitted = b @ np.linalg.solve(a.T @ a + 2 * np.eye(6), a.T @ y[::2])
    assert np.allclose([r["rmse"] for r in got], np.sqrt(((fitted - y[1::2]) ** 2).mean(axis=0)))
    assert np.allclose([r["corr"] for r in got], [np.corrcoef(fitted[:, k], y[1::2, k])[0, 1] for k in range(3)])


def test_whitened_covariance_is_identity(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(1, a.tolist()) for a in x], "k int, x array<double>")
    w = L.whitening(L.shrunk_covariance(df, ["k"], "x"), ["k"])
    white = np.array([r["x"] for r in L.whitened(df, w, ["k"], "x").collect()])
    assert np.allclose(np.cov(white.T, bias=True), np.eye(3), atol=0.1)


def test_axes_agree_with_svd(xy):
    x, _, df = xy
    mean, axes, _ = L.principal_axes(df, "x", 3)
    _, _, vt = np.linalg.svd(x - x.mean(axis=0))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.abs(axes @ vt[:3].T), np.eye(3), atol=1e-6)
    _, rough = L.randomized_axes(df, "x", 3)
    assert np.allclose(np.abs(rough @ axes.T), np.eye(3), atol=1e-3)


def test_cka_of_itself_and_of_a_rotation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    q = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    df = spark.createDataFrame([(a.tolist(), (a @ q).tolist()) for a in x], "a array<double>, b array<double>")
    assert abs(S.linear_cka(df, "a", "a").first()[0] - 1) < 1e-6 and abs(S.linear_cka(df, "a", "b").first()[0] - 1) < 1e-6


def test_pairs_are_complete(spark):
    df = spark.range(150).withColumnRenamed("id", "k")
    got = {(r["k_i"], r["k_j"]) for r in S.pairs(df, "k", block=32).collect()}
    assert got == {(i, j) for i in range(150) for j in range(i)}
    assert S.pairs(df.limit(0), "k").count() == 0


def test_adjusted_p_is_monotone(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.9,), (0.02,)], "p double")
    rows = sorted((r["p"], r["p_adj"]) for r in I.bh_fdr(df, []).collect())
    assert [round(a, 4) for _, a in rows] == [0.0333, 0.0333, 0.0333, 0.0375, 0.9]


def test_svm_separates():
    x, y = np.array([[2.0, 1], [1, 2], [-1, -2], [-2, -1]]), np.array([1.0, 1, -1, -1])
    alpha, offset = D.hinge_duals((x @ x.T)[None], y, np.ones((1, 4), bool))
    assert ((x @ ((alpha[0] * y) @ x) + offset[0]) * y > 0).all()


def test_range_join_equals_brute_force(spark):
    on = [(1, t) for t in (0, 7, 100)]
    at = [(1, t) for t in range(-20, 130, 3)]
    got = E.range_join(spark.createDataFrame(on, "s int, onset long"), spark.createDataFrame(at, "s int, at long"), "s", "onset", "at", 6, 12)
    assert {(r["onset"], r["at"]) for r in got.collect()} == {(o, a) for _, o in on for _, a in at if o - 6 <= a < o + 12}


def test_sinks_and_scans(spark, tmp_path):
    df = spark.createDataFrame([("images", 1, "train", 0.5), ("images", 2, "test", 0.7)], "modality string, subject int, split string, x double")
    T.write_partitioned(df, str(tmp_path / "e"), ["modality", "subject", "split"])
    assert T.read_epochs(spark, str(tmp_path / "e"), subject=2).first()["x"] == 0.7
    T.write_csv(spark.createDataFrame([(5, 0, 30)], "stimulus long, split_code int, action_code int"), str(tmp_path / "c"))
    assert T.read_csv(spark, str(tmp_path / "c"), header=True).collect()[0]["action_code"] == 30
    assert T.typed(spark.createDataFrame([("7", "1", "2")], "a string, b string, c string"), T.STIMULI).first()["stimulus"] == 7


def test_randomness_ignores_partitions(spark):
    from tempora.functions.rng import draw

    one = spark.range(200, numPartitions=1).select(F.sum(draw(1, F.col("id")))).first()[0]
    assert one == spark.range(200, numPartitions=7).select(F.sum(draw(1, F.col("id")))).first()[0]


def test_kernel_components_match_the_dense_solution(spark, xy):
    x, _, df = xy
    got = np.array([r["x"] for r in L.kernel_components(df.select("half", "x"), F.lit(True), "x", 3, degree=2, landmarks=80).collect()])
    gram = (x @ x.T / 5 + 1) ** 2
    values = np.linalg.eigvalsh(gram - gram.mean(axis=0) - gram.mean(axis=1)[:, None] + gram.mean())[::-1][:3]
    assert np.allclose((got**2).sum(axis=0), values, rtol=1e-6) and np.allclose(got.T @ got, np.diag(values), atol=1e-6 * values[0])


def test_kendall_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    a[:2], b[:2] = (0, 8), (0, 8)
    frames = [spark.createDataFrame([(k, 0, float(v)) for k, v in enumerate(c)], "i int, j int, d double") for c in (a, b)]
    s = np.array([np.sign(a[p] - a[q]) * np.sign(b[p] - b[q]) for p in range(60) for q in range(p)])
    ta, tb = (sum(c[p] == c[q] for p in range(60) for q in range(p)) for c in (a, b))
    assert abs(S.kendall(*frames) - s.sum() / np.sqrt((1770 - ta) * (1770 - tb))) < 1e-9


def test_whole_queries_read_every_row(spark, sf_dir):
    import pandas as pd

    from tempora.plans import catalog, model_queries, similarity_queries

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    n, low = len(x), np.tril_indices(len(x), -1)
    for name, d in (("rdm_pearson", 1 - np.corrcoef(x)), ("rdm_dot", 1 - x @ x.T)):
        got = catalog.QUERIES[name](spark, sf_dir).orderBy("i", "j").toPandas()
        assert len(got) == n * (n - 1) // 2 and np.allclose(got["d"], d[low], atol=1e-5)
    halves = [np.round(1 - np.corrcoef(h)[low], 9) for h in (x[:, :32], x[:, 32:])]
    assert abs(catalog.QUERIES["rsa"](spark, sf_dir).first()[0] - np.corrcoef(*[pd.Series(h).rank() for h in halves])[0, 1]) < 1e-5
    assert similarity_queries.v_reps(spark, sf_dir).count() == n
    assert {r["block"] for r in model_queries.v_pseudo(spark, sf_dir).collect()} == set(range(6))


def test_binned_ranks_equal_average_ranks(spark):
    import pandas as pd

    values = np.concatenate([np.random.default_rng(7).integers(0, 90, 700), np.full(500, 40)]) / 7.0
    df = spark.createDataFrame([(float(v),) for v in values], "a double").repartition(6)
    (cuts,) = S.bin_cuts(df, ["a"], rows=50)
    got = {r["a"]: r["rank"] for r in S.spread_ranks(df, "a", cuts).collect()}
    assert len(cuts) > 10 and got == dict(zip(values, pd.Series(values).rank()))


@pytest.mark.parametrize("keys", [[-3, -1, 5, 130], [10**13, 7, -(10**15)], ["b", "a", "zz"], [4], []])
def test_pairs_of_any_keys(spark, keys):
    kind = "string" if keys and isinstance(keys[0], str) else "long"
    df = spark.createDataFrame([(k, [float(n), 1.0]) for n, k in enumerate(keys)] + [(None, [0.0, 0.0])], f"k {kind}, x array<double>")
    for block in (1, 2, 64):
        got = {(r["k_i"], r["k_j"]): (r["x_i"][0], r["x_j"][0]) for r in S.pairs(df, "k", block).collect()}
        assert got == {(a, b): (float(keys.index(a)), float(keys.index(b))) for a in keys for b in keys if a > b}


def test_pairs_within_groups(spark):
    df = spark.createDataFrame([(g, k) for g in (0, 1) for k in range(5 + g)], "g int, k int")
    assert sorted(tuple(r) for r in S.pairs(df, "k", 2, ["g"]).collect()) == sorted((g, i, j) for g in (0, 1) for i in range(5 + g) for j in range(i))


def test_constant_vectors_and_zero_divisors_give_nulls(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0, 1.0]), (1, [1.0, 2.0, 4.0]), (2, [3.0, 1.0, 2.0])], "k int, x array<double>")
    got = {(r["i"], r["j"]): r["d"] for r in S.rdm(df, "k", "x").collect()}
    assert got[1, 0] is None and got[2, 0] is None and abs(got[2, 1] - (1 - np.corrcoef([1, 2, 4], [3, 1, 2])[0, 1])) < 1e-9
    flat = spark.createDataFrame([(0, 2.0, 1.0), (0, 2.0, 1.0)], "k int, x double, y double")
    assert L.ridge_one(flat, ["k"], 0.0).first()["slope"] is None
    assert L.fit_scores(flat.withColumn("fitted", F.col("x")), ["k"]).first()["r2"] is None
    one = spark.createDataFrame([(c, 0, 0, [float(c)]) for c in (0, 1)], "class int, block int, tp int, x array<double>")
    assert [r["accuracy"] for r in D.decode_centroid(one, "class", "block", "tp", "x").collect()] == [None]


def test_kendall_is_exact(spark):
    rng = np.random.default_rng(5)
    for values in ("many", "ties", "outlier"):
        a, b = rng.normal(size=1500), rng.normal(size=1500)
        b = a + b
        if values == "ties":
            a, b = np.round(a), np.round(b)
        if values == "outlier":
            a[0], b[1] = 1e6, -1e7
        a, b = a.round(9), b.round(9)
        frames = [spark.createDataFrame([(k, 0, float(v)) for k, v in enumerate(x)], "i int, j int, d double") for x in (a, b)]
        s = np.sign(a[:, None] - a[None]) * np.sign(b[:, None] - b[None])
        n, ties = 1500 * 1499 / 2, [sum(c * (c - 1) / 2 for c in np.unique(x, return_counts=True)[1]) for x in (a, b)]
        want = s.sum() / 2 / np.sqrt((n - ties[0]) * (n - ties[1]))
        assert all(abs(S.kendall(*frames, rows=rows) - want) < 1e-12 for rows in (50, 20_000))
    assert np.isnan(S.kendall(frames[0].withColumn("d", F.lit(1.0)), frames[1]))


def test_ranges_share_few_copies_of_the_rows(spark, monkeypatch):
    """However many ranges there are, and where rows don't fit a task's memory too, each row is sent to a few tasks once; results are those of rows in memory."""
    seen, send = [], S._sent

    def counted(blocks, *more):
        sent = send(blocks, *more)
        seen.append(sent[0].count() / blocks.count())
        return sent

    monkeypatch.setattr(S, "_sent", counted)
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for k in range(90)], "k int, a array<double>, b array<double>").repartition(3)
    found = [S.rdm_rank_correlation(df, "k", "a", "b", block=4, steps=1 << 22, listed=40, held=held).first()[0] for held in (600, 1 << 27)]
    assert found[0] == pytest.approx(found[1], abs=1e-12) and seen == [S.RANGE_TASKS] * 2


@pytest.mark.parametrize("n", [0, 1, 129, 8192, 8193, 20_000, 40_000])
def test_rising_pairs_in_their_own_list(n):
    """Lists of one strip and of several, with and without ties in either order, are counted in place and exactly."""
    rng = np.random.default_rng(n)
    for top in (5, 10**9):
        x, y = np.sort(rng.integers(0, top, n)), rng.integers(0, top, n)
        y += x // 3
        want = sum(int(((x[at : at + 500, None] < x) & (y[at : at + 500, None] < y)).sum()) for at in range(0, n, 500))
        held = np.zeros(S.room_for(n), np.int64)
        held[:n] = np.sort(x << 31 | S.LOW - y)
        assert S.rising(held, n) == want
    whole = np.sort(rng.integers(0, 7, n) << 31)
    runs = np.unique(whole, return_counts=True)[1]
    assert S._same(whole) == S._same(whole, shift=31) == (runs * (runs - 1) // 2).sum()
    assert S._same(whole, lambda part: part >> 31 == 3) == (runs[3] * (runs[3] - 1) // 2 if n > 50 else 0)


def test_concordant_pairs_by_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 64, 100):
        x, y = rng.integers(0, 9, n), rng.integers(0, 9, n)
        assert S.concordant(x, y) == sum((x[i] < x[j]) == (y[i] < y[j]) and x[i] != x[j] and y[i] != y[j] for i in range(n) for j in range(i))


def test_svm_against_dual_conditions():
    """Many problems at once, some rows left out: each meets the optimality conditions of the hinge loss with a free intercept."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 12, 4)), np.tile([1.0, -1.0], 6)
    inside = rng.random((40, 12)) < 0.8
    inside[:, :4] = True
    alpha, offset = D.hinge_duals(x @ x.swapaxes(1, 2), y, inside, c=0.7)
    for z, a, b, held in zip(x, alpha, offset, inside):
        margin = y * (z @ ((a * y) @ z) + b)
        assert abs((a * y).sum()) < 1e-9 and (a[~held] == 0).all()
        assert (margin[held & (a == 0)] >= 1 - 1e-6).all() and (margin[held & (a == 0.7)] <= 1 + 1e-6).all()
        assert np.allclose(margin[held & (a > 0) & (a < 0.7)], 1, atol=1e-6)


@pytest.fixture
def written(monkeypatch):
    """How many rows each table has that the similarity operators write."""
    counts, write = [], S.kept

    def counted(df, name):
        made = write(df, name)
        counts.append(made.count())
        return made

    monkeypatch.setattr(S, "kept", counted)
    return counts


def test_rank_correlation_writes_no_pairs(spark, sf_dir, written):
    from tempora.plans import catalog

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert catalog.QUERIES["rsa"](spark, sf_dir).first()[0] is not None
    assert max(written) <= vectors


@pytest.mark.parametrize("kind", ["spread", "ties", "copies", "close", "constant", "none"])
def test_rank_correlation_of_pairs_made_again(spark, kind):
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(0 if kind == "none" else 50, 8))
    if kind == "ties":
        x = np.round(x)
    if kind == "copies":
        x = x[rng.integers(0, 5, 50)]
    if kind == "close":
        x = np.arange(8.0) ** 2 % 5 + x * 1e-4
    if kind == "constant":
        x[:5, :4], x[7:9, 4:] = 1, 2
    df = spark.createDataFrame([(f"k{n}", r[:4].tolist(), r[4:].tolist()) for n, r in enumerate(x)], "k string, a array<double>, b array<double>")
    x = x[(np.ptp(x[:, :4], axis=1) > 0) & (np.ptp(x[:, 4:], axis=1) > 0)]
    ranks = [pd.Series((1 - np.corrcoef(h)[np.tril_indices(len(x), -1)]).round(9) + 0.0).rank() for h in (x[:, :4], x[:, 4:]) if len(x)]
    for limits in ({}, {"steps": 1 << 26, "listed": 300}, {"steps": 1 << 26, "listed": 300, "held": 600, "block": 4}):  # one list, steps counted, rows in spans
        got = S.rdm_rank_correlation(df, "k", "a", "b", **limits).first()[0]
        assert got is None if kind == "none" else abs(got - np.corrcoef(*ranks)[0, 1]) < 1e-9


def test_kendall_writes_no_pairs(spark, sf_dir, written):
    from tempora.plans import catalog, similarity_queries

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    got = catalog.QUERIES["rsa_kendall"](spark, sf_dir).first()[0]
    assert max(written) <= vectors
    assert got == round(S.kendall_of(similarity_queries._half_rdms(spark, sf_dir)), 6)


@pytest.mark.parametrize("kind", ["spread", "ties", "copies", "close", "constant", "none"])
def test_kendall_of_pairs_made_again(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(0 if kind == "none" else 50, 8))
    if kind == "ties":
        x = np.round(x)
    if kind == "copies":
        x = x[rng.integers(0, 5, 50)]
    if kind == "close":
        x = np.arange(8.0) ** 2 % 5 + x * 1e-4
    if kind == "constant":
        x[:5, :4], x[7:9, 4:] = 1, 2
    df = spark.createDataFrame([(n, r[:4].tolist(), r[4:].tolist()) for n, r in enumerate(x)], "k long, a array<double>, b array<double>")
    x = x[(np.ptp(x[:, :4], axis=1) > 0) & (np.ptp(x[:, 4:], axis=1) > 0)]
    signs = [np.sign(d[:, None] - d) for d in ((1 - np.corrcoef(h)[np.tril_indices(len(x), -1)]).round(9) + 0.0 for h in (x[:, :4], x[:, 4:]) if len(x))]
    for limits in ({}, {"listed": 60}, {"listed": 200, "held": 600, "block": 4}):  # one list, many and ranges of ties, rows in spans
        got = S.rdm_kendall(df, "k", "a", "b", **limits)
        assert np.isnan(got) if kind == "none" else abs(got - (signs[0] * signs[1]).sum() / np.sqrt((signs[0] ** 2).sum() * (signs[1] ** 2).sum())) < 1e-12
