"""Nested models against refits, decoding with whitening inside the folds against one problem at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import decode as D
from tempora.operators import linear as L
from tempora.operators import nested as N
from tempora.operators import scenarios as C
from tempora.plans import model_queries as M
from tempora.plans import nested_queries as Q


def test_sweeps_equal_refits_and_undo_each_other():
    rng = np.random.default_rng(0)
    x, y = np.hstack([rng.normal(size=(60, 9)), np.ones((60, 1))]), rng.normal(size=(60, 3))
    blocks, alphas = {"a": range(3), "b": range(3, 5), "c": range(5, 9)}, np.array([1e-3, 2.0, 50])
    models = N.feature_models(list(blocks)) | N.feature_models(list(blocks), ["a"])
    assert sorted(models) == ["base", "base and b", "base and c", "full", "without a", "without b", "without c"]
    found = N.fitted(x.T @ x, x.T @ y, blocks, models, alphas)
    for name, features in models.items():
        at = [*sorted(k for f in features for k in blocks[f]), 9]
        for alpha, beta in zip(alphas, found[name]):
            assert np.allclose(beta[at], np.linalg.solve(x[:, at].T @ x[:, at] + alpha * np.eye(len(at)), x[:, at].T @ y))
            assert (np.delete(beta, at, axis=0) == 0).all()
    m = (x.T @ x)[None] + np.eye(10)
    assert np.allclose(N.sweep(N.sweep(N.sweep(m, [0, 1]), [4, 7]), [1, 4]), N.sweep(N.sweep(m, [0]), [7]))


def test_wide_nested_models_equal_refits(spark, sf_dir):
    rows = Q.v_subjects(spark, sf_dir, means=False).collect()
    got = {(r["subject"], r["model"], r["tp"]): (r["alpha"], r["y"], r["r2"]) for r in Q.nested_models_wide(spark, sf_dir).collect()}
    subjects = sorted({r["subject"] for r in rows})
    assert len(got) == len(subjects) * 8 * len(Q.MODELS)
    for subject in subjects[:4]:
        part = {s: [np.array([r[c] for r in rows if r["subject"] == subject and r["split"] == s]) for c in "xy"] for s in N.SPLITS}
        ones = {s: np.hstack([x, np.ones((len(x), 1))]) for s, (x, _) in part.items()}
        for model, features in Q.MODELS.items():
            at = [*[k for f in features for k in Q.BLOCKS[f]], 32]
            gram, xty = ones["train"][:, at].T @ ones["train"][:, at], ones["train"][:, at].T @ part["train"][1]
            betas = [np.linalg.solve(gram + a * np.eye(len(at)), xty) for a in L.alpha_grid()]
            loss = [np.sqrt(((part["val"][1] - ones["val"][:, at] @ b) ** 2).mean(axis=0)).mean() for b in betas]
            best = int(np.argmin(np.round(loss, 9)))
            fit, y = ones["test"][:, at] @ betas[best], part["test"][1]
            corr = np.array([np.corrcoef(fit[:, k], y[:, k])[0, 1] for k in range(32)]).reshape(8, 4).mean(axis=1)
            r2 = (1 - ((y - fit) ** 2).sum(axis=0) / ((y - y.mean(axis=0)) ** 2).sum(axis=0)).reshape(8, 4).mean(axis=1)
            for tp in range(8):
                alpha, c, r = got[subject, model, tp]
                assert np.isclose(alpha, L.alpha_grid()[best]) and abs(c - corr[tp]) < 2e-6 and abs(r - r2[tp]) < 2e-6


def test_explained_alone(spark):
    scores = [(1, "full", 0, 0.5, 0.3), (1, "without a", 0, 0.4, 0.1), (1, "without b", 0, 0.6, 0.2), (1, "full", 1, None, None), (1, "without a", 1, 0.1, 0.1)]
    df = spark.createDataFrame(scores, "subject int, model string, target int, corr double, r2 double")
    got = {r["feature"]: r["variance"] for r in N.explained_alone(df, ["subject"]).collect()}
    full = max(0.25, (0.25 + 0.36) / 2, (0.25 + 0.36 + 0.16) / 3)
    assert np.isclose(got["a"], full - 0.16) and got["b"] == 0 and len(got) == 2
    by_r2 = {r["feature"]: r["variance"] for r in N.explained_alone(df, ["subject"], by="r2").collect()}
    assert np.isclose(by_r2["a"], 0.2) and np.isclose(by_r2["b"], 0.1)


def shrunk(rows):
    n, p = rows.shape
    z = rows - rows.mean(axis=0)
    s = z.T @ z / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, sum(((np.outer(v, v) - s) ** 2).sum() for v in z) / n**2 / p)
    return s if delta == 0 else beta / delta * mu * np.eye(p) + (1 - beta / delta) * s


def one_svm(x, y, c=1.0):
    """Weights and intercept by sweeps over all pairs of rows."""
    k, alpha = x @ x.T, np.zeros(len(x))
    for _ in range(3000):
        moved = 0.0
        for i in range(len(x)):
            for j in range(i):
                e = k @ (alpha * y) - y
                curve = k[i, i] + k[j, j] - 2 * k[i, j]
                low, high = (max(0, alpha[j] - alpha[i]), min(c, c + alpha[j] - alpha[i])) if y[i] != y[j] else (max(0, alpha[i] + alpha[j] - c), min(c, alpha[i] + alpha[j]))
                new = np.clip(alpha[j] + y[j] * (e[i] - e[j]) / curve, low, high)
                step = new - alpha[j]
                alpha[i], alpha[j], moved = alpha[i] - y[i] * y[j] * step, new, max(moved, abs(step))
        if moved < 1e-11:
            break
    r = y - k @ (alpha * y)
    free = (alpha > 1e-9) & (alpha < c - 1e-9)
    up, low = ((y > 0) & (alpha < c - 1e-9)) | ((y < 0) & (alpha > 1e-9)), ((y > 0) & (alpha > 1e-9)) | ((y < 0) & (alpha < c - 1e-9))
    return (alpha * y) @ x, r[free].mean() if free.any() else (r[up].max() + r[low].min()) / 2


def test_every_accuracy_of_the_svm(spark, sf_dir):
    trials = {(r["class"], r["block"], r["tp"]): np.array(r["x"]) for r in M.v_pseudo(spark, sf_dir).collect()}
    classes = sorted({k[0] for k in trials})
    got = {(r["i"], r["j"], r["tp"]): r["accuracy"] for r in M.decode_svm(spark, sf_dir).collect()}
    assert len(got) == len(classes) * (len(classes) - 1) // 2 * 8
    for i in classes[:6]:
        for j in [c for c in classes if c < i]:
            right = np.zeros(8)
            for fold in range(6):
                y = np.repeat([1.0, -1.0], 5)
                rows = [np.array([trials[c, b, t] for c in (i, j) for b in range(6) if b != fold]) for t in range(8)]
                w = L.inverse_root(np.mean([shrunk(r) for r in rows], axis=0))
                for t in range(8):
                    weights, offset = one_svm(rows[t] @ w, y)
                    side = [np.round(trials[c, fold, t] @ w @ weights + offset, 9) * s for c, s in ((i, 1), (j, -1))]
                    right[t] += sum(1.0 if v > 0 else 0.5 if v == 0 else 0.0 for v in side)
            for t in range(8):
                assert abs(got[i, j, t] - right[t] / 12) < 1e-9, (i, j, t)


def test_ragged_conditions_use_what_they_share(spark):
    rng = np.random.default_rng(4)
    full = [(s, c, b, t, rng.normal(size=3).tolist()) for s in (1, 2) for c in "abc" for b in range(4) for t in range(3)]
    schema = "subject int, c string, b int, tp int, x array<double>"
    ragged = [r for r in full if not (r[1] == "b" and r[2] == 3 and r[3] == 2) and not (r[1] == "c" and r[2] > 0)]
    got = {(r["subject"], r["i"], r["j"], r["tp"]): r["accuracy"] for r in D.decode_svm(spark.createDataFrame(ragged, schema), "c", "b", "tp", "x", ["subject"]).collect()}
    alike = [r for r in full if r[2] < 3 and r[1] in "ab"]
    want = {(r["subject"], r["i"], r["j"], r["tp"]): r["accuracy"] for r in D.decode_svm(spark.createDataFrame(alike, schema), "c", "b", "tp", "x", ["subject"]).collect()}
    assert got == pytest.approx(want) and len(got) == 6
    with pytest.raises(Exception, match="more than one row"):
        D.decode_svm(spark.createDataFrame([*full, full[0]], schema), "c", "b", "tp", "x", ["subject"]).collect()
    assert D.decode_svm(spark.createDataFrame(full, schema).filter(F.lit(False)), "c", "b", "tp", "x").count() == 0


def test_models_without_a_category_equal_refits(spark):
    rng = np.random.default_rng(8)
    rows = [(s, ("train", "val", "test")[k % 3], None if k % 7 == 6 else "abc"[k % 7 % 3], rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for s in (1, 2) for k in range(120)]
    rows += [(3, "train", "a", [1.0, 2.0, 3.0], [1.0, 2.0])]  # no test rows
    df = spark.createDataFrame(rows, "subject int, split string, category string, x array<double>, y array<double>").repartition(3)
    alphas = np.array([0.1, 10.0])
    got = {(r["subject"], r["without"], r["target"]): r for r in N.excluded_scores(df, ["subject"], "category", "x", "y", alphas).collect()}
    assert len(got) == 2 * 4 * 2
    for s in (1, 2):
        of = lambda split, c: [(np.array([*r[3], 1.0]), np.array(r[4])) for r in rows if r[0] == s and r[1] == split and (c is None or r[2] != c)]  # noqa: E731, B023

        def fit(c, alpha):
            x, y = map(np.array, zip(*of("train", c)))
            return np.linalg.solve(x.T @ x + alpha * np.eye(4), x.T @ y)

        x, y = map(np.array, zip(*of("val", None)))
        alpha = alphas[np.argmin([np.sqrt(((y - x @ fit(None, a)) ** 2).mean(axis=0)).mean() for a in alphas])]
        for c in (None, "a", "b", "c"):
            x, y = map(np.array, zip(*of("test", c)))
            fitted = x @ fit(c, alpha)
            for t in range(2):
                r = got[s, c, t]
                assert r["alpha"] == alpha and np.isclose(r["rmse"], np.sqrt(((y - fitted) ** 2).mean(axis=0))[t]) and np.isclose(r["corr"], np.corrcoef(y[:, t], fitted[:, t])[0, 1])


def test_ranges_of_frames_are_two_look_ups(spark):
    rng = np.random.default_rng(9)
    rows = [(s, f, c, None if rng.random() < 0.1 else float(rng.normal())) for s in range(6) for f in range(1, 9) for c in (1, 2, 3) if rng.random() < 0.8 and not (s == 5 and c == 3)]
    df = spark.createDataFrame([*rows, rows[0]], "stimulus int, frame int, component int, value double").repartition(3)
    sweep = [C.Scenario("all", 1, 8), C.Scenario("late", 5, 7, (1, 2)), C.Scenario("none", 20, 30)]
    got = {(r["scenario"], r["stimulus"]): r["x"] for r in C.framed(df, sweep, "stimulus").collect()}
    want = {}
    for s in sweep:
        for stimulus in range(6):
            means = []
            for c in s.components or (1, 2, 3):
                values = [r[3] for r in [*rows, rows[0]] if r[0] == stimulus and r[2] == c and s.first_frame <= r[1] <= s.last_frame and r[3] is not None]
                means += [sum(values) / len(values)] if values else []
            if len(means) == len(s.components or (1, 2, 3)):
                want[s.name, stimulus] = means
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    assert ("all", 5) not in got and ("late", 5) in got and not any(k[0] == "none" for k in got)
