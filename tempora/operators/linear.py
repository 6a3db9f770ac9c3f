"""Linear models over grouped data: moments by group, ridge by one eigendecomposition, scores, whitening, PCA.

Rows meet only as sums.  ``moments`` adds up products inside each task and merges one small row
for each task and group; everything after it works on arrays whose size depends on the number of
columns alone, so it runs in tasks keyed by group, or on the driver for a single group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate, null where either side is constant (the built-in one raises an error there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def moments(df: DataFrame, keys: list[str], x: str, y: str | None = None, weight: bool = False) -> DataFrame:
    """(keys, n, d, q, sums): for each group, all sums of products of the columns of [x, y, 1], row by row."""
    y_col = F.col(y) if y else F.array().cast("array<double>")
    rows = df.select(*keys, F.col(x).alias("_x"), y_col.alias("_y"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + (", " if keys else "") + "n long, d int, q int, sums array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]:
                if not len(part):
                    continue
                z = np.hstack([np.stack(part["_x"]), np.stack(part["_y"]).reshape(len(part), -1), np.ones((len(part), 1))])
                old = held.setdefault(key, [0, len(part["_x"].iloc[0]), len(part["_y"].iloc[0]), 0.0])
                old[0] += len(part)
                old[3] = old[3] + z.T @ z
        rows = [(*k, n, d, q, s.ravel()) for k, (n, d, q, s) in held.items()]
        yield pd.DataFrame(rows, columns=[*keys, "n", "d", "q", "sums"])

    parts = rows.mapInPandas(partial, schema)
    added = parts.select(*keys, "n", "d", "q", F.posexplode("sums")).groupBy(*keys, "pos").agg(F.sum("n").alias("n"), F.first("d").alias("d"), F.first("q").alias("q"), F.sum("col").alias("s"))
    merged = added.groupBy(*keys).agg(F.first("n").alias("n"), F.first("d").alias("d"), F.first("q").alias("q"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("all"))
    return merged.select(*keys, "n", "d", "q", F.col("all.s").alias("sums"))


def split_moments(d: int, q: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of [x, y, 1]: the Gram matrix of [x, 1], its products with y, and the products of y (last row: sums)."""
    z = np.asarray(sums).reshape(d + q + 1, d + q + 1)
    a = [*range(d), d + q]
    return z[np.ix_(a, a)], z[np.ix_(a, range(d, d + q))], z[d:, d : d + q]


def ridge(gram: np.ndarray, xty: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Coefficients (alpha, column of [x, 1], target); the intercept is penalised like the others."""
    values, vectors = np.linalg.eigh(gram)
    return np.stack([vectors @ ((vectors.T @ xty) / (np.maximum(values, 0) + a)[:, None]) for a in alphas])


def scores(beta: np.ndarray, n: int, gram: np.ndarray, xty: np.ndarray, yy: np.ndarray, denom: str = "rows") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rmse, corr, r2) for each target, from another split's moments alone."""
    q = beta.shape[1]
    total = yy[-1]
    square = np.diag(yy[:q])
    fitted_sum = gram[-1] @ beta
    fitted_square = np.einsum("iq,ij,jq->q", beta, gram, beta)
    cross = np.einsum("iq,iq->q", beta, xty)
    sse = np.maximum(square - 2 * cross + fitted_square, 0)
    var_y, var_f = square - total**2 / n, np.maximum(fitted_square - fitted_sum**2 / n, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = (cross - total * fitted_sum / n) / np.sqrt(var_y * var_f)
        r2 = 1 - sse / var_y
    return np.sqrt(sse / (n if denom == "rows" else q)), corr, r2


def alpha_grid(low: float = -5, high: float = 15, count: int = 30) -> np.ndarray:
    return 10.0 ** np.linspace(low, high, count)


def ridge_search(train: DataFrame, val: DataFrame, keys: list[str], x: str, y: str, alphas: np.ndarray | None = None, denom: str = "rows") -> DataFrame:
    """(keys, alpha, target, rmse, corr, r2): fits on ``train`` scored on ``val`` for every alpha, without a refit."""
    grid = alpha_grid() if alphas is None else np.asarray(alphas)
    fitted = moments(train, keys, x, y)
    other = moments(val, keys, x, y).select(*keys, F.col("n").alias("n2"), F.col("sums").alias("sums2"))
    both = fitted.join(other, keys) if keys else fitted.crossJoin(other)  # one row each
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                gram, xty, _ = split_moments(row["d"], row["q"], row["sums"])
                gram2, xty2, yy2 = split_moments(row["d"], row["q"], row["sums2"])
                for alpha, beta in zip(grid, ridge(gram, xty, grid)):
                    rmse, corr, r2 = scores(beta, row["n2"], gram2, xty2, yy2, denom)
                    yield pd.DataFrame({**{k: row[k] for k in keys}, "alpha": alpha, "target": np.arange(1, row["q"] + 1, dtype=np.int32), "rmse": rmse, "corr": corr, "r2": r2})

    return both.mapInPandas(solve, "".join(f"{k} {kinds[k]}, " for k in keys) + "alpha double, target int, rmse double, corr double, r2 double")


def best_alpha(grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, by_rmse, by_corr): the alpha of the least mean RMSE and of the greatest mean correlation, the first on ties."""
    mean = grid.groupBy(*keys, "alpha").agg(F.round(F.avg("rmse"), 9).alias("rmse"), F.round(F.avg("corr"), 9).alias("corr"))
    return mean.groupBy(*keys).agg(F.min_by("alpha", F.struct("rmse", "alpha")).alias("by_rmse"), F.min_by("alpha", F.struct(-F.col("corr"), "alpha")).alias("by_corr"))


def ridge_one(df: DataFrame, keys: list[str], alpha: float, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, slope, intercept) of ridge with one regressor, in closed form; null where the fit isn't determined."""
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    a, b, c = F.col("sxx") + alpha, F.col("sx"), F.col("n") + alpha
    det = a * c - b * b
    return s.select(*keys, F.try_divide(c * F.col("sxy") - b * F.col("sy"), det).alias("slope"), F.try_divide(a * F.col("sy") - b * F.col("sxy"), det).alias("intercept"))


def fit_scores(df: DataFrame, keys: list[str], y: str = "y", fitted: str = "fitted", targets: int | None = None) -> DataFrame:
    """(keys, rmse, corr, r2); RMSE by rows, or by ``targets`` for parity with studies that divide so; r2 is null where ``y`` is constant."""
    count = F.count(F.lit(1)) if targets is None else F.lit(targets)
    error = F.sum(F.pow(F.col(y) - F.col(fitted), 2))
    return df.groupBy(*keys).agg(F.sqrt(error / count).alias("rmse"), correlation(y, fitted).alias("corr"), (1 - F.try_divide(error, F.var_pop(y) * F.count(F.lit(1)))).alias("r2"))


def parity_corr(x: str, y: str) -> Column:
    """Covariance by n - 1 over population deviations plus 1e-8, as some studies report it."""
    return F.covar_samp(x, y) / ((F.stddev_pop(x) + 1e-8) * (F.stddev_pop(y) + 1e-8))


def standardised(df: DataFrame, train: Column, keys: list[str], value: str) -> DataFrame:
    """``df`` with ``z``: value less the training mean over the training deviation (population; 0 counts as 1)."""
    fitted = df.filter(train).groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    scale = F.when(F.round("_sd", 12) == 0, 1.0).otherwise(F.col("_sd"))
    return df.join(fitted, keys).withColumn("z", (F.col(value) - F.col("_mean")) / scale).drop("_mean", "_sd")


def shrunk_covariance(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, i, j, cov, shrinkage): the Ledoit-Wolf covariance of each group's rows."""
    width = F.size(x)
    centre = df.select(*keys, F.posexplode(x).alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("m"))
    packed = centre.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).select(*keys, F.col("c.m").alias("_c"))
    joined = df.join(packed, keys) if keys else df.crossJoin(packed)
    centred = joined.select(*keys, width.alias("p"), F.zip_with(x, "_c", lambda a, b: a - b).alias("z"))
    norms = centred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("p").alias("p"), F.sum(F.pow(dot(F.col("z"), F.col("z")), 2)).alias("fourth"))
    products = moments(centred, keys, "z").select(*keys, "n", "d", F.posexplode("sums").alias("pos", "v"))
    second = products.select(*keys, "d", F.floor(F.col("pos") / (F.col("d") + 1)).cast("int").alias("i"), (F.col("pos") % (F.col("d") + 1)).alias("j"), (F.col("v") / F.col("n")).alias("s")).filter("i < d AND j < d").drop("d")
    totals = second.groupBy(*keys).agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("trace"), F.sum(F.pow("s", 2)).alias("norm"))
    both = norms.join(totals, keys) if keys else norms.crossJoin(totals)
    mu = F.col("trace") / F.col("p")
    delta = (F.col("norm") - F.lit(2.0) * mu * F.col("trace") + mu * mu * F.col("p")) / F.col("p")
    beta = (F.col("fourth") / F.col("n") - F.col("norm")) / (F.col("n") * F.col("p"))
    level = both.select(*keys, mu.alias("mu"), F.when(delta > 0, F.least(beta, delta) / delta).otherwise(0.0).alias("shrinkage"))
    rows = second.join(level, keys) if keys else second.crossJoin(level)
    return rows.select(*keys, "i", "j", ((1 - F.col("shrinkage")) * F.col("s") + F.when(F.col("i") == F.col("j"), F.col("shrinkage") * F.col("mu")).otherwise(0.0)).alias("cov"), "shrinkage")


def inverse_root(cov: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T


def whitening(cov: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, w): the inverse square root of each group's covariance (i, j, cov), as rows."""
    kinds = {f.name: f.dataType.simpleString() for f in cov.schema}

    def root(pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(pdf["i"].max()) + 1
        m = np.zeros((p, p))
        m[pdf["i"], pdf["j"]] = pdf["cov"]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "w": [inverse_root(m).tolist()]})

    return cov.groupBy(*keys).applyInPandas(root, "".join(f"{k} {kinds[k]}, " for k in keys) + "w array<array<double>>")


def whitened(df: DataFrame, w: DataFrame, keys: list[str], x: str) -> DataFrame:
    """``df`` with ``x`` multiplied by its group's whitening."""
    return df.join(w, keys).withColumn(x, F.transform("w", lambda row: dot(row, F.col(x)))).drop("w")


def principal_axes(train: DataFrame, x: str, k: int, scaled: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes k x d, explained share) of the rows, from their moments; the largest loading of an axis is positive.

    With ``scaled`` the axes are those of columns scaled to deviation 1 (0 counts as 1), and come
    divided by the deviations, so that rows less the mean times the axes are the coordinates.
    """
    row = moments(train, [], x).first()
    gram, _, _ = split_moments(row["d"], 0, row["sums"])
    mean = gram[-1, :-1] / row["n"]
    cov = gram[:-1, :-1] / row["n"] - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0)) if scaled else np.ones(len(cov))
    sd[np.round(sd, 12) == 0] = 1
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    axes = vectors[:, ::-1][:, :k].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return mean, axes / sd, values[::-1][:k] / values.sum()


def projected(df: DataFrame, x: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``df`` with ``x`` replaced by its coordinates along the axes, which go to the tasks as one broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((mean, axes))
    return _each_block(df, x, lambda z: (z - shared.value[0]) @ shared.value[1].T)


def _each_block(df: DataFrame, x: str, of) -> DataFrame:
    """``df`` with ``x`` (an array, last column) replaced by the rows of ``of(block of rows)``."""
    others = [c for c in df.columns if c != x]
    kind = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(**{x: list(of(np.stack(pdf[x])))})

    return df.select(*others, x).mapInPandas(run, "".join(f"{c} {kind[c]}, " for c in others) + f"{x} array<double>")


def randomized_axes(train: DataFrame, x: str, k: int, seed: int = 42, more: int = 8, power: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) for very wide rows (Halko, Martinsson, Tropp): only sketches of k + ``more`` columns leave the tasks."""
    width = len(train.select(x).first()[0])
    rng = np.random.default_rng(seed)
    total = _column_sums(train, x, lambda z: np.vstack([z.sum(axis=0), np.full(z.shape[1], len(z))]))
    mean = total[0] / total[1, 0]
    basis = np.linalg.qr(rng.normal(size=(width, k + more)))[0]
    for _ in range(power):
        basis = np.linalg.qr(_column_sums(train, x, lambda z, b=basis: ((z - mean).T @ ((z - mean) @ b)).T).T)[0]
    small = _column_sums(train, x, lambda z, b=basis: ((z - mean) @ b).T @ ((z - mean) @ b))
    vectors = np.linalg.eigh(small)[1][:, ::-1][:, :k]
    axes = (basis @ vectors).T
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def _column_sums(df: DataFrame, x: str, of) -> np.ndarray:
    """The sum over all row blocks z of the small matrix ``of(z)``."""

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                part = of(np.stack(pdf["_x"]))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"r": np.arange(len(total)), "v": list(total)})

    rows = df.select(F.col(x).alias("_x")).mapInPandas(block, "r long, v array<double>")
    summed = rows.select("r", F.posexplode("v")).groupBy("r", "pos").agg(F.sum("col").alias("s")).groupBy("r").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("all"))
    return np.array([[p["s"] for p in r["all"]] for r in summed.orderBy("r").collect()])


def kernel_components(df: DataFrame, train: Column, x: str, k: int, degree: int = 4, landmarks: int = 256, seed: int = 42) -> DataFrame:
    """``df`` with ``x`` replaced by its coordinates in polynomial kernel PCA (Nyström).

    Kernel values are taken against ``landmarks`` training rows drawn by a keyed order, a bounded
    number; with as many landmarks as training rows the result is exact.  The kernel is
    (x.y / width + 1) to the ``degree``.
    """
    from tempora.functions.rng import draw

    key = draw(seed, F.to_json(F.struct(x)))
    marks = np.array([r["_x"] for r in df.filter(train).select(F.col(x).alias("_x")).orderBy(key).limit(landmarks).collect()])
    width, m = marks.shape[1], len(marks)
    gram = (marks @ marks.T / width + 1) ** degree
    values, vectors = np.linalg.eigh(gram - gram.mean(axis=0) - gram.mean(axis=1)[:, None] + gram.mean())
    axes = vectors[:, ::-1][:, :k] / np.sqrt(np.maximum(values[::-1][:k], 1e-12))
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])

    def project(block: np.ndarray) -> np.ndarray:
        z = (block @ marks.T / width + 1) ** degree
        return (z - z.mean(axis=1)[:, None] - gram.mean(axis=0) + gram.mean()) @ axes

    return _each_block(df, x, project)
