"""The encoding chain against dense NumPy, and scans and sinks with nulls and empty tables."""

import numpy as np
import pytest

from tempora.operators import encoding as N
from tempora.operators import linear as L
from tempora.plans import views as V
from tempora.sources import tables as T


def _ridge(x, y, alpha):
    z = np.hstack([x, np.ones((len(x), 1))])
    return np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ y)


def _predict(x, beta):
    return np.hstack([x, np.ones((len(x), 1))]) @ beta


@pytest.mark.parametrize("criterion", ["rmse", "corr"])
def test_encoded_against_dense_fits(spark, criterion):
    rng = np.random.default_rng(3)
    grid = [0.01, 1.0, 100.0]
    rows, want = [], {}
    for group in (1, None):
        parts = {s: (rng.normal(size=(n, 3)), rng.normal(size=(n, 2))) for s, n in (("train", 20), ("val", 9), ("test", 11))}
        rows += [(group, s, x.tolist(), y.tolist()) for s, (xs, ys) in parts.items() for x, y in zip(xs, ys)]
        loss = []
        for alpha in grid:
            fit = _predict(parts["val"][0], _ridge(*parts["train"], alpha))
            truth = parts["val"][1]
            loss.append(np.sqrt(((fit - truth) ** 2).mean(axis=0)).mean() if criterion == "rmse" else -np.mean([np.corrcoef(fit[:, k], truth[:, k])[0, 1] for k in range(2)]))
        alpha = grid[int(np.argmin(loss))]
        fit, truth = _predict(parts["test"][0], _ridge(*parts["train"], alpha)), parts["test"][1]
        for k in range(2):
            error = ((fit[:, k] - truth[:, k]) ** 2).sum()
            want[group, k + 1] = alpha, np.sqrt(error / 11), np.corrcoef(fit[:, k], truth[:, k])[0, 1], 1 - error / (truth[:, k].var() * 11)
    rows += [(7, "train", [1.0, 2.0, 3.0], [1.0, 2.0])]  # no other split: no rows
    df = spark.createDataFrame(rows, "g int, split string, x array<double>, y array<double>")
    got = {(r["g"], r["target"]): (r["alpha"], r["rmse"], r["corr"], r["r2"]) for r in N.encoded(df, ["g"], "x", "y", grid, criterion).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        np.testing.assert_allclose(got[key], values, atol=1e-8)
    assert N.encoded(df.limit(0), ["g"], "x", "y", grid).count() == 0


def test_scaled_axes_against_dense_decomposition(spark, sf_dir):
    train = V.v_vectors(spark, sf_dir).filter("split = 'train'")
    x = np.array([r["x"] for r in train.select("x").collect()])
    x[:, 5] = 2.0  # a constant column
    mean, axes, share = L.principal_axes(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>"), "x", 4, scaled=True)
    sd = x.std(axis=0)
    sd[5] = 1
    z = (x - x.mean(axis=0)) / sd
    _, singular, vectors = np.linalg.svd(z, full_matrices=False)
    np.testing.assert_allclose(share, (singular**2 / (singular**2).sum())[:4], atol=1e-9)
    np.testing.assert_allclose(np.abs((x - mean) @ axes.T), np.abs(z @ vectors[:4].T), atol=1e-6)


def test_scans_read_only_what_is_asked(spark):
    path = T.shared_path(spark, "epochs")
    rows = spark.createDataFrame([("eeg", 1, "train", 1.0), ("eeg", 1, "test", 2.0), ("eeg", 2, "test", None)], "modality string, subject int, split string, value double")
    T.write_partitioned(rows, path, ["modality", "subject", "split"])
    found = T.read_epochs(spark, path, subject=1, split="test")
    assert [r["value"] for r in found.collect()] == [2.0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "subject" in plan.split("PartitionFilters")[1].split("]")[0]
