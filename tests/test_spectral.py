"""Kernel components and components of wide vectors against dense solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import spectral as S


def dense_kernel(train, rows, degree, k):
    width = train.shape[1]
    gram, other = (train @ train.T / width + 1) ** degree, (rows @ train.T / width + 1) ** degree
    values, vectors = np.linalg.eigh(gram - gram.mean(axis=0) - gram.mean(axis=1)[:, None] + gram.mean())
    axes = vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
    return (other - other.mean(axis=1)[:, None] - gram.mean(axis=0) + gram.mean()) @ axes


def up_to_sign(a, b):
    return a * np.sign((a * b).sum(axis=0)) - b


def test_kernel_components_of_all_rows(spark, monkeypatch):
    """500 training rows in blocks of 64: what the blocks give is the dense solution, training rows and others alike."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(620, 6)) * np.array([3, 2, 1.5, 1, 0.7, 0.4])
    df = spark.createDataFrame([(k, k % 31 < 25, a.tolist()) for k, a in enumerate(x)], "id int, train boolean, x array<double>").repartition(3)
    got = {r["id"]: r["x"] for r in S.kernel_pca(df, F.col("train"), "x", 5).collect()}
    assert len(got) == 620
    train = x[[k for k in range(620) if k % 31 < 25]]
    assert len(train) == 500
    want = dense_kernel(train, x, 4, 5)
    assert np.abs(up_to_sign(np.array([got[k] for k in range(620)]), want)).max() < 1e-6 * np.abs(want).max()


def test_kernel_product_passes_every_block(spark):
    rng = np.random.default_rng(4)
    x, v = rng.normal(size=(300, 4)), rng.normal(size=(300, 2))
    table = spark.createDataFrame([(b, x[30 * b : 30 * b + 30].tobytes(), v[30 * b : 30 * b + 30].tobytes()) for b in range(10)], "block long, x binary, v binary")
    got = {r["block"]: np.frombuffer(r["y"]).reshape(-1, 2) for r in S.kernel_product(table.select("block", "x"), table, S.poly_kernel(4, 3), 4, 2).collect()}
    want = (x @ x.T / 4 + 1) ** 3 @ v
    assert len(got) == 10 and all(np.allclose(got[b], want[30 * b : 30 * b + 30]) for b in range(10))


def test_kernel_components_of_few_or_equal_rows(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(5, 3)), 4, axis=0)
    df = spark.createDataFrame([(k, a.tolist()) for k, a in enumerate(x)], "id int, x array<double>")
    got = np.array([r["x"] for r in S.kernel_pca(df, F.lit(True), "x", 10, degree=2).orderBy("id").collect()])
    assert got.shape == (20, 4)  # five different rows have four centred components
    assert np.abs(up_to_sign(got, dense_kernel(x, x, 2, 4))).max() < 1e-6
    assert S.kernel_pca(df.limit(0), F.lit(True), "x", 3).count() == 0


def test_kernel_components_take_few_products(spark, monkeypatch):
    """From the linear kernel's axes four products of all training rows do, and training rows aren't met again; axes that no line holds are found too."""
    met, product = [], S.kernel_product
    monkeypatch.setattr(S, "kernel_product", lambda left, *more: met.append(left.count()) or product(left, *more))
    monkeypatch.setattr(S, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    df = spark.createDataFrame([(k, k < 1200, a.tolist()) for k, a in enumerate(x)], "id int, train boolean, x array<double>").coalesce(2)
    got = {r["id"]: r["x"] for r in S.kernel_pca(df, F.col("train"), "x", 4).collect()}
    want = dense_kernel(x[:1200], x, 4, 4)
    assert len(got) == 1500 and np.abs(up_to_sign(np.array([got[k] for k in range(1500)]), want)).max() < 1e-6
    assert len(met) <= 5 and met[-1] < met[0] / 3
    both = np.vstack([x[:600, :6], -x[:600, :6]]) * np.array([3, 3, 1, 1, 1, 1])  # of such rows the main even axes are at right angles to all lines
    df = spark.createDataFrame([(k, a.tolist()) for k, a in enumerate(both)], "id int, x array<double>").coalesce(2)
    got = np.array([r["x"] for r in S.kernel_pca(df, F.lit(True), "x", 8).orderBy("id").collect()])
    want = dense_kernel(both, both, 4, 8)
    assert np.abs(up_to_sign(got, want)).max() < 1e-6 * np.abs(want).max()


@pytest.mark.parametrize("tile", [7, 64])
def test_wide_components_equal_svd(spark, tile):
    """Columns in tiles, with constant columns: axes, shares and the cut of the dense solution of scaled columns."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 5)) @ (rng.normal(size=(5, 60)) * np.array([9, 6, 4, 2, 1])[:, None]) + 0.01 * rng.normal(size=(90, 60)) + 3
    x[:, 11] = 5.0
    df = spark.createDataFrame([(k, k < 70, a.tolist()) for k, a in enumerate(x)], "id int, train boolean, x array<double>").repartition(4)
    coordinates, shares = S.wide_pca(df, F.col("train"), "x", 4, tile=tile)
    sd = x[:70].std(axis=0)
    z = (x - x[:70].mean(axis=0)) / np.where(np.round(sd, 12) == 0, 1, sd)
    _, sizes, vt = np.linalg.svd(z[:70])
    got = np.array([r["x"] for r in coordinates.orderBy("id").collect()])
    assert np.abs(up_to_sign(got, z @ vt[:4].T)).max() < 1e-6
    share = sizes**2 / (sizes**2).sum()
    rows = shares.orderBy("component").collect()
    assert np.allclose([r["share"] for r in rows], share[:4]) and np.allclose([r["cumulative"] for r in rows], share.cumsum()[:4])
    assert [r["kept"] for r in rows] == [k == 0 or share.cumsum()[k - 1] < 0.9 for k in range(4)]


def test_tree_of_factors(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(40 * 6, 3))
    m[:, 2] = m[:, 0] + m[:, 1]
    table = spark.createDataFrame([(b, m[6 * b : 6 * b + 6].tobytes()) for b in range(40)], "c long, m binary")
    q = m @ S.tall_root(table, "c", "m", 3)
    assert np.allclose(q.T @ q, np.diag([1, 1, 0]), atol=1e-9)
