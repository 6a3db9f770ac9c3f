"""Rows of queries without SQL against dense solutions, and dissimilarities of awkward tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.operators import linear as L
from tempora.operators import similarity as S
from tempora.plans import model_queries as M
from tempora.plans import views as V


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = V.v_vectors(spark, sf_dir).orderBy("stimulus").collect()
    return [r["stimulus"] for r in rows], np.array([r["class"] for r in rows]), np.array([r["split"] for r in rows]), np.array([r["x"] for r in rows])


def test_coordinates(spark, sf_dir, vectors):
    ids, _, split, x = vectors
    mean = x[split == "train"].mean(axis=0)
    _, _, vt = np.linalg.svd(x[split == "train"] - mean, full_matrices=False)
    want = (x - mean) @ vt[:10].T
    got = np.array([r["x"] for r in M.pca(spark, sf_dir).orderBy("stimulus").collect()])
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-6
    rough = np.array([r["x"] for r in M.pca_randomized(spark, sf_dir).orderBy("stimulus").collect()])
    inside = ((x - mean) @ vt.T)[split == "train"]
    assert rough.shape == want.shape and (rough[split == "train"] ** 2).sum() > 0.8 * (inside[:, :10] ** 2).sum()


def test_every_alpha_of_the_grid(spark, sf_dir, vectors):
    _, _, split, x = vectors
    ones = lambda s: np.hstack([x[split == s][:, :32], np.ones(((split == s).sum(), 1))])
    a, b, y, z = ones("train"), ones("val"), x[split == "train"][:, 32:], x[split == "val"][:, 32:]
    got = {(round(np.log10(r["alpha"]), 6), r["target"]): r for r in M.ridge_grid(spark, sf_dir).collect()}
    assert len(got) == 30 * 32
    for alpha in L.alpha_grid():
        fitted = b @ np.linalg.solve(a.T @ a + alpha * np.eye(33), a.T @ y)
        for t in range(32):
            r = got[round(np.log10(alpha), 6), t + 1]
            assert abs(r["rmse"] - np.sqrt(((z - fitted)[:, t] ** 2).mean())) < 1e-6
            if alpha < 1e6:
                assert abs(r["corr"] - np.corrcoef(fitted[:, t], z[:, t])[0, 1]) < 1e-5


def test_whitened_rows(spark, sf_dir, vectors):
    ids, of, _, x = vectors
    got = {(r["stimulus"], r["tp"]): r["x"] for r in M.whiten_apply(spark, sf_dir).collect()}
    assert len(got) == 8 * len(ids)
    for c in np.unique(of):
        rows = x[of == c].reshape(-1, 8, 8)
        covs = []
        for t in range(8):
            z = rows[:, t] - rows[:, t].mean(axis=0)
            n, p = z.shape
            s = z.T @ z / n
            mu = np.trace(s) / p
            delta = ((s - mu * np.eye(p)) ** 2).sum() / p
            beta = min(delta, sum(((np.outer(v, v) - s) ** 2).sum() for v in z) / n**2 / p)
            covs.append(beta / delta * mu * np.eye(p) + (1 - beta / delta) * s)
        values, vectors_ = np.linalg.eigh(np.mean(covs, axis=0))
        w = vectors_ @ np.diag(values**-0.5) @ vectors_.T
        for k in np.flatnonzero(of == c):
            for t in range(8):
                assert np.allclose(got[ids[k], t], x[k].reshape(8, 8)[t] @ w, atol=1e-8)


@pytest.mark.parametrize("metric", ["pearson", "spearman", "dot"])
def test_dissimilarities_of_awkward_tables(spark, metric):
    """Keys as text, null and repeated keys, ties in vectors, a constant vector; blocks of four."""
    rng = np.random.default_rng(1)
    rows = [(f"k{k:02d}", rng.integers(0, 4, 6).astype(float).tolist(), rng.normal(size=3).tolist()) for k in range(23)]
    rows += [("k05", [9.0, 1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0, 3.0]), (None, [1.0] * 6, [1.0, 2.0, 3.0]), ("zz", [2.0] * 6, [3.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "k string, x array<double>, y array<double>").repartition(5)
    got = sorted(((r["i"], r["j"], r["a"], r["b"]) for r in S.rdms(df, "k", {"a": "x", "b": "y"}, metric, block=4).collect()), key=str)

    def rank(v):
        v = np.array(v)
        return np.array([(v < e).sum() + ((v == e).sum() + 1) / 2 for e in v])

    def apart(u, v):
        if metric == "dot":
            return 1 - np.dot(u, v)
        u, v = (rank(u), rank(v)) if metric == "spearman" else (u, v)
        return None if np.std(u) == 0 or np.std(v) == 0 else 1 - np.corrcoef(u, v)[0, 1]

    want = sorted(((p[0], q[0], apart(p[1], q[1]), apart(p[2], q[2])) for p in rows for q in rows if p[0] and q[0] and p[0] > q[0]), key=str)
    assert [g[:2] for g in sorted(got, key=lambda g: (g[:2], str(g[2])))] == [w[:2] for w in sorted(want, key=lambda w: (w[:2], str(w[2])))]
    table: dict = {}
    for i, j, a, b in want:
        table.setdefault((i, j), []).append((a, b))
    for i, j, a, b in got:
        assert any((a is None) == (c is None) and (a is None or abs(a - c) < 1e-9) and (b is None or abs(b - e) < 1e-9) for c, e in table[i, j])
    assert S.rdms(df.filter(F.lit(False)), "k", {"d": "x"}).count() == 0


@pytest.mark.parametrize("metric", ["pearson", "spearman", "dot"])
def test_rounded_dissimilarities_of_awkward_tables(spark, metric):
    """Rounded inside tasks: the same pairs and values as rounded afterwards, over several spans, with null, repeated and constant rows."""
    rng = np.random.default_rng(2)
    rows = [(f"k{k:02d}", rng.normal(size=6).tolist()) for k in range(41)]
    rows += [("k05", [9.0, 1.0, 2.0, 3.0, 4.0, 5.0]), (None, [1.0] * 6), ("zz", [2.0] * 6)]
    df = spark.createDataFrame(rows, "k string, x array<double>").repartition(5)
    got = S.rdm(df, "k", "x", metric, block=4, places=6).collect()
    want = S.rdm(df, "k", "x", metric, block=4).withColumn("d", F.round("d", 6)).collect()
    assert len(got) == len(want) > 800 and sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    far = spark.createDataFrame([(k, [1e30 * k, 1.0]) for k in range(9)], "k long, x array<double>")
    assert sorted(S.rdm(far, "k", "x", "dot", places=6).collect()) == sorted(S.rdm(far, "k", "x", "dot").collect())
    assert S.rdm(df.filter(F.lit(False)), "k", "x", places=6).count() == 0


def test_pairs_are_put_out_by_value_where_many_share_one(monkeypatch):
    """More values than a dictionary holds, several pairs a value: batches rise in d, which Parquet then stores in few bytes; few values keep the order of keys."""
    rng = np.random.default_rng(3)
    z = S.unit_rows(rng.normal(size=(300, 8)), "pearson")
    side = lambda a, b: [(pa.array(np.arange(a, b)), z[a:b], False)]
    want = 1 - z[:150] @ z[150:].T
    for held, sorted_ in ((1000, True), (1 << 17, False)):
        monkeypatch.setattr(S, "DICTIONARY", held)
        parts = list(S._listed(side(0, 150), side(150, 300), 1e3))
        assert (np.diff(np.concatenate([d for *_, d in parts])) >= 0).all() == sorted_
        table = np.full((150, 150), np.nan)
        for keys, high, low, d in parts:
            table[keys.take(pa.array(low)).to_numpy(), keys.take(pa.array(high)).to_numpy() - 150] = d
        assert np.abs(table - want).max() <= 0.0005001 and np.array_equal(table, np.round(table, 3))


def test_rows_are_sent_to_few_spans():
    """Each row is sent once for each span: as often for a hundred thousand rows as for ten thousand."""
    assert [S.spans(n, 64, 256) for n in (0, 200, 1000, 10_256, 102_564, 615_384)] == [1, 1, 4, 16, 16, 16]
    assert S.spans(10_000, 100_000, 256) == 40  # wide rows: a span stays bounded


def test_correlation_of_dissimilarities_keeps_no_pairs(spark):
    """Over all pairs at once, from moments of tasks; a constant vector's pairs don't count, a constant side gives null."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    x[7, 3:] = 1.0
    df = spark.createDataFrame([(k, x[k, :3].tolist(), x[k, 3:].tolist()) for k in range(40)], "k int, x array<double>, y array<double>").repartition(3)
    one, two = np.corrcoef(x[:, :3]), np.corrcoef(np.delete(x[:, 3:], 7, axis=0))
    apart = lambda c: c[np.tril_indices(len(c), -1)]
    want = np.corrcoef(apart(np.delete(np.delete(one, 7, 0), 7, 1)), apart(two))[0, 1]
    got = S.rdm_correlation(df, "k", "x", "y", block=4)
    assert abs(got.first()["similarity"] - want) < 1e-9
    assert S.rdm_correlation(df.limit(1), "k", "x", "y").first()["similarity"] is None
