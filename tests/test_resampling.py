"""Resampling by matrix products and keyed bijections against draws made one at a time."""

import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tempora.functions import rng as rng_
from tempora.operators import permute as P
from tempora.operators import resample as R


def drawn(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16)


def curves(spark):
    """Thirty units with holes: some lack a point, some points are null, and one key is null."""
    rng = random.Random(4)
    rows = [(u, "ab"[u % 2], f, t, rng.gauss(0, 1) if rng.random() < 0.95 else None) for u in range(30) for f in ("x", None) for t in range(4) if rng.random() < 0.9]
    return rows, spark.createDataFrame(rows, "subject int, cohort string, feature string, tp int, y double").repartition(5)


def mean(values):
    return sum(values) / len(values) if values else None


def close(got, want):
    assert set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


def test_sign_flips(spark, monkeypatch):
    monkeypatch.setattr(R, "RESAMPLES", 7)
    rows, df = curves(spark)
    got = {(r["feature"], r["tp"], r["b"]): r["stat"] for r in R.sign_flip(df, ["feature", "tp"], 20, 5, chance=0.25).collect()}
    sign = lambda b, u: 1 if b == 0 or drawn(5, b, u) % 2 == 0 else -1
    keys = {r[2:4] for r in rows}
    close(got, {(*k, b): mean([sign(b, r[0]) * (r[4] - 0.25) for r in rows if r[2:4] == k and r[4] is not None]) for k in keys for b in range(21)})


def test_label_shuffles(spark, monkeypatch):
    monkeypatch.setattr(R, "UNITS", 4)
    rows, df = curves(spark)
    for bits in (1, 10):
        limits = R.shuffle_limits(df.select("subject", "cohort").distinct(), "subject", "cohort", "a", 12, 9, bits)
        assert limits == {b: sorted((drawn(9, b, u), u) for u in range(30))[14] for b in range(1, 13)}
    got = {(r["feature"], r["tp"], r["b"]): r["stat"] for r in R.label_shuffle(df, ["feature", "tp"], 12, 9).collect()}
    want = {}
    for b in range(13):
        mine = {u for u in range(30) if u % 2 == 0} if b == 0 else {u for _, u in sorted((drawn(9, b, u), u) for u in range(30))[:15]}
        for k in {r[2:4] for r in rows}:
            one, two = ([r[4] for r in rows if r[2:4] == k and r[4] is not None and (r[0] in mine) == side] for side in (True, False))
            want[(*k, b)] = mean(one) - mean(two)
    close(got, want)


def test_bootstraps(spark, monkeypatch):
    monkeypatch.setattr(R, "UNITS", 4)
    monkeypatch.setattr(R, "RESAMPLES", 5)
    rows, df = curves(spark)
    got = {(r["cohort"], r["feature"], r["tp"], r["b"]): r["stat"] for r in R.bootstrap_mean(df, ["feature", "tp"], 11, 3, within=["cohort"]).collect()}
    want = {}
    for c in "ab":
        units = sorted({r[0] for r in rows if r[1] == c})
        for b in range(12):
            taken = units if b == 0 else [units[drawn(3, c, b, k) % len(units)] for k in range(len(units))]
            for k in {r[2:4] for r in rows}:
                values = [r[4] for u in taken for r in rows if r[0] == u and r[2:4] == k and r[4] is not None]
                if values:
                    want[(c, *k, b)] = mean(values)
    close(got, want)
    by_tp = {(r["tp"], r["b"]): r["stat"] for r in R.bootstrap_mean(df.filter("feature = 'x'"), ["tp"], 6, 3, tp="tp").collect()}
    want = {}
    for t in range(4):
        have = {r[0]: r[4] for r in rows if r[2:4] == ("x", t)}
        units = sorted(have)
        for b in range(7):
            values = [have[u] for u in (units if b == 0 else [units[drawn(3, t, b, k) % len(units)] for k in range(len(units))])]
            want[t, b] = mean([v for v in values if v is not None])
    close(by_tp, want)


def test_numbers_of_units_need_no_single_task(spark):
    df = spark.createDataFrame([(g, u) for g in ("a", "b", None) for u in range(200)], "g string, u int").repartition(7)
    got = R.numbered(df, ["g"], "u").collect()
    assert len(got) == 600 and all(r["k"] == r["u"] and r["n"] == 200 for r in got)
    assert sorted(r["k"] for r in R.numbered(df.filter("g = 'a'"), [], "u").collect()) == list(range(200))


def test_keyed_bijections():
    keys = P.round_keys(7, np.arange(6))
    assert keys[3].tolist() == [drawn(7, 3, r) for r in range(P.ROUNDS)]
    for n in (1, 2, 3, 5, 16, 17, 1000, 70_000):
        moved = P.bijection(np.arange(n)[None], n, keys[:, None])
        assert all(sorted(m.tolist()) == list(range(n)) for m in moved)
        assert (P.bijection(np.arange(n), n, keys[2]) == moved[2]).all()  # the key alone decides
    spread = P.bijection(np.arange(1000)[None], 1000, P.round_keys(1, np.arange(400))[:, None])
    assert len({m.tobytes() for m in spread}) == 400
    assert abs(np.bincount(spread[:, 0] // 100, minlength=10) - 40).max() < 25  # any item goes anywhere
    assert abs(np.corrcoef(np.arange(1000), spread.mean(axis=0))[0, 1]) < 0.2


def test_permuted_products(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 90, 3)), rng.normal(size=(2, 90, 3))
    rows = [(g, 1000 - k, x[g, k].tolist(), y[g, k].tolist()) for g in range(2) for k in range(90 - 40 * g)]
    df = spark.createDataFrame(rows, "g int, item int, x array<double>, y array<double>").repartition(3)
    got = P.permuted_products(df, ["g"], "item", "x", "y", 9, 4)
    per = {(r["g"], r["b"], r["component"]): r["r"] for r in P.correlations(got, ["g"]).collect()}
    flat = {(r["g"], r["b"]): r["r"] for r in P.flat_correlation(got, ["g"]).collect()}
    assert len(per) == 60 and len(flat) == 20
    for g in range(2):
        n = 90 - 40 * g
        a, c = x[g, :n][::-1], y[g, :n][::-1]  # places follow the items' order
        for b in range(10):
            to = np.arange(n) if b == 0 else P.bijection(np.arange(n), n, P.round_keys(4, np.array([b]))[0])
            assert abs(flat[g, b] - np.corrcoef(a.ravel(), c[to].ravel())[0, 1]) < 1e-9
            for k in range(3):
                assert abs(per[g, b, k] - np.corrcoef(a[:, k], c[to][:, k])[0, 1]) < 1e-9


def test_orderings_are_unranked(spark):
    for n in (1, 2, 5):
        rows = P.orderings(spark, n).orderBy("ordering").collect()
        assert [tuple(r["used"]) for r in rows] == list(itertools.permutations(range(1, n + 1)))


def test_constant_sides_give_nulls(spark):
    df = spark.createDataFrame([(k, [1.0], [float(k)]) for k in range(5)], "item int, x array<double>, y array<double>")
    assert all(r["r"] is None for r in P.correlations(P.permuted_products(df, [], "item", "x", "y", 2, 1), []).collect())
    assert P.permuted_products(df.filter(F.lit(False)), [], "item", "x", "y", 2, 1).count() == 0


def test_permutations_by_draws(spark, monkeypatch):
    """Places of sorted draws, over several spans and ranges, against a sort of all draws."""
    monkeypatch.setattr(P, "BLOCK", 8)
    monkeypatch.setattr(P, "SPAN", 16)
    monkeypatch.setattr(P, "RANGE", 20)
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(2, 70, 2))
    df = spark.createDataFrame([(3 * k, x[k].tolist(), y[k].tolist()) for k in range(70)], "item int, x array<double>, y array<double>").repartition(3)
    got = {(r["b"], r["component"]): r["r"] for r in P.correlations(P.permuted_products(df, [], "item", "y", "x", 5, 4, by="draws"), []).collect()}
    assert len(got) == 12
    for b in range(6):
        others = list(range(70)) if b == 0 else sorted(range(70), key=lambda k: (drawn(4, b, 3 * k), k))
        for c in range(2):
            assert abs(got[b, c] - np.corrcoef(x[:, c], y[others, c])[0, 1]) < 1e-9


def test_draws_side_by_side(monkeypatch):
    """Keys of any length and number have the draws that MD5 gives one by one."""
    monkeypatch.setattr(rng_, "FEW", 1)
    monkeypatch.setattr(rng_, "TILE", 50)
    starts, ends = ["", "42|", "é|17|", "x" * 30], [str(k) for k in range(0, 1200, 7)] + ["", "y" * 40]
    got = R.draws([s.encode() for s in starts], [e.encode() for e in ends])
    assert got.tolist() == [[drawn(s + e) for e in ends] for s in starts]
    assert R.draws([], [b"1"]).shape == (0, 1) and R.draws([b"1"], []).shape == (1, 0)


def test_cohorts_apart_share_their_draws(spark):
    """Groups of other sizes are drawn for themselves under keys that don't name them."""
    rows = [(c, u, float(u * (1 + (c == "O")))) for c, n in (("F", 9), ("O", 14)) for u in range(n)]
    df = spark.createDataFrame(rows, "cohort string, unit int, v double").withColumn("layer", F.lit(1))
    got = {(r["cohort"], r["b"]): r["stat"] for r in R.bootstrap_sum(df, ["cohort", "layer"], 6, 3, within=["layer"], apart=["cohort"]).collect()}
    values = {c: [v for d, _, v in rows if d == c] for c in "FO"}
    close(got, {(c, b): sum(v if b == 0 else [v[drawn(3, 1, b, k) % len(v)] for k in range(len(v))]) for c, v in values.items() for b in range(7)})
