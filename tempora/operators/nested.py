"""Nested linear models from one table of moments, and the variance that each feature explains alone.

A group's rows meet once, as sums of products.  The sweep operator turns the matrix of sums into a
model of any set of its columns: sweeping a column adds it to the model, sweeping it back takes
it out.  So the full model, the models without each feature and the models of a baseline with
each feature are neighbours of one another, a few columns apart, and none is fitted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators import linear as L

SPLITS = ("train", "val", "test")
FULL, BASE = "full", "base"


def sweep(m: np.ndarray, columns: list[int]) -> np.ndarray:
    """Matrices (..., n, n) swept on a block of columns: its inverse stands in the block, coefficients beside it, and what is left elsewhere.

    Sweeping once more on columns that are swept takes them out again.
    """
    rest = [k for k in range(m.shape[-1]) if k not in set(columns)]
    block = np.linalg.inv(m[..., columns, :][..., columns])
    beside = block @ m[..., columns, :][..., rest]
    below = m[..., rest, :][..., columns]
    out = np.empty_like(m)
    out[..., np.array(columns)[:, None], columns] = block
    out[..., np.array(columns)[:, None], rest] = beside
    out[..., np.array(rest, int)[:, None], columns] = -below @ block
    out[..., np.array(rest, int)[:, None], rest] = m[..., rest, :][..., rest] - below @ beside
    return out


def feature_models(features: list[str], base: list[str] | None = None) -> dict[str, list[str]]:
    """The full set and the sets without each feature; or with ``base``, the base and the base with each other feature."""
    if base is None:
        return {FULL: list(features)} | {f"without {f}": [g for g in features if g != f] for f in features}
    return {BASE: list(base)} | {f"base and {f}": [*base, f] for f in features if f not in base}


def fitted(gram: np.ndarray, xty: np.ndarray, blocks: dict[str, range], models: dict[str, list[str]], alphas: np.ndarray) -> dict[str, np.ndarray]:
    """Each model's coefficients (alpha, column of [x, 1], target), 0 for columns that it hasn't; the intercept belongs to all models and is penalised.

    A model is swept from the nearest of the models before it.
    """
    d, q = xty.shape
    m = np.zeros((len(alphas), d + q, d + q))
    m[:, :d, :d] = gram + np.asarray(alphas)[:, None, None] * np.eye(d)
    m[:, :d, d:] = xty
    known: list[tuple[frozenset, np.ndarray]] = [(frozenset(), sweep(m, [d - 1]))]
    out = {}
    for name, wanted in sorted(models.items(), key=lambda kv: (kv[0] not in (FULL, BASE), kv[0])):
        want = frozenset(wanted)
        columns = lambda parts: sorted(c for f in parts for c in blocks[f])
        near, state = min(known, key=lambda k: len(columns(k[0] ^ want)))
        for turned in (want - near, near - want):
            state = sweep(state, columns(turned)) if turned else state
        if name in (FULL, BASE):
            known.append((want, state))
        beta = np.zeros((len(alphas), d, q))
        held = [*columns(want), d - 1]
        beta[:, held] = state[:, held, d:]
        out[name] = beta
    return out


def known_scores(beta: np.ndarray, n: int, gram: np.ndarray, xty: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`tempora.operators.linear.scores`, with nulls for correlation and r2 of targets without variance, and for what isn't finite."""
    rmse, corr, r2 = L.scores(beta, n, gram, xty, yy)
    square = np.diag(yy)[: beta.shape[1]]
    varies = square - yy[-1] ** 2 / n > 1e-10 * np.maximum(square, 1e-300)
    return rmse, np.where(varies & np.isfinite(corr), corr, None), np.where(varies & np.isfinite(r2), r2, None)


def nested_scores(rows: DataFrame, keys: list[str], x: str, y: str, blocks: dict[str, range], models: dict[str, list[str]], alphas: np.ndarray | None = None, criterion: str = "rmse") -> DataFrame:
    """(keys, model, alpha, target, rmse, corr, r2) on the test rows of each group of ``rows`` (keys, split, x, y).

    ``blocks`` names the columns of ``x`` that make a feature, ``models`` the features of a model.
    Each group's model has the alpha of its least mean RMSE over targets on the validation rows,
    or with ``criterion`` "corr" of the greatest mean correlation; the first on ties.  Rows are read
    once; groups that lack a split give nothing, targets without variance have null scores.
    """
    grid = L.alpha_grid() if alphas is None else np.asarray(alphas)
    sums = L.moments(rows.filter(F.col("split").isin(*SPLITS)), [*keys, "split"], x, y)
    of = [c for s in SPLITS for c in (F.max(F.when(F.col("split") == s, F.col("n"))).alias(f"n_{s}"), F.max(F.when(F.col("split") == s, F.col("sums"))).alias(s))]
    groups = sums.groupBy(*keys).agg(F.max("d").alias("d"), F.max("q").alias("q"), *of).dropna(subset=list(SPLITS))
    kinds = dict(groups.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                parts = {s: L.split_moments(row["d"], row["q"], row[s]) for s in SPLITS}
                for name, betas in fitted(*parts["train"][:2], blocks, models, grid).items():
                    tried = [L.scores(b, row["n_val"], *parts["val"]) for b in betas]
                    loss = [np.mean(rmse) if criterion == "rmse" else -np.mean(corr) for rmse, corr, _ in tried]
                    best = int(np.argmin(np.round(np.nan_to_num(loss, nan=np.inf), 9)))
                    rmse, corr, r2 = known_scores(betas[best], row["n_test"], *parts["test"])
                    yield pd.DataFrame({**{k: row[k] for k in keys}, "model": name, "alpha": grid[best], "target": np.arange(row["q"], dtype=np.int32), "rmse": rmse, "corr": corr, "r2": r2})

    # one row a group and as much work as there are models: groups are dealt out evenly
    dealt = groups.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys) if keys else groups
    return dealt.mapInPandas(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "model string, alpha double, target int, rmse double, corr double, r2 double")


def excluded_scores(rows: DataFrame, keys: list[str], category: str, x: str, y: str, alphas: np.ndarray | None = None, criterion: str = "rmse") -> DataFrame:
    """(keys, without, alpha, target, rmse, corr, r2): test scores of models refitted without each category, and (null) of the whole.

    ``rows`` are (keys, split, category, x, y).  A group's rows meet once, as sums of products by split and
    category; what a category adds is taken off the whole, in training and test rows, so that
    no category costs a pass of its own.  The alpha is the whole's, chosen on all validation rows.
    A category that leaves no training or test rows gives nothing; rows of a null category are in every model.
    """
    grid = L.alpha_grid() if alphas is None else np.asarray(alphas)
    sums = L.moments(rows.filter(F.col("split").isin(*SPLITS)), [*keys, "split", category], x, y)
    parts = sums.groupBy(*keys).agg(F.max("d").alias("d"), F.max("q").alias("q"), F.collect_list(F.struct("split", F.col(category).alias("c"), "n", "sums")).alias("parts"))  # a row for each split and category
    kinds, kind = dict(parts.dtypes), dict(rows.dtypes)[category]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                whole: dict[str, list] = {s: [0, 0.0] for s in SPLITS}
                of: dict[tuple, tuple] = {}
                for part in row["parts"]:
                    z = np.asarray(part["sums"])
                    whole[part["split"]][0] += part["n"]
                    whole[part["split"]][1] = whole[part["split"]][1] + z
                    of[part["split"], part["c"]] = (part["n"], z)
                if not all(n for n, _ in whole.values()):
                    continue
                split = {s: L.split_moments(row["d"], row["q"], z) for s, (_, z) in whole.items()}
                tried = [L.scores(b, whole["val"][0], *split["val"]) for b in L.ridge(*split["train"][:2], grid)]
                loss = [np.mean(rmse) if criterion == "rmse" else -np.mean(corr) for rmse, corr, _ in tried]
                alpha = grid[[int(np.argmin(np.round(np.nan_to_num(loss, nan=np.inf), 9)))]]
                for c in [None, *sorted({c for _, c in of if c is not None})]:
                    less = {s: [whole[s][k] - (of.get((s, c), (0, 0.0))[k] if c is not None else 0) for k in (0, 1)] for s in ("train", "test")}
                    if not (less["train"][0] and less["test"][0]):
                        continue
                    train, test = (L.split_moments(row["d"], row["q"], less[s][1]) for s in ("train", "test"))
                    rmse, corr, r2 = known_scores(L.ridge(*train[:2], alpha)[0], less["test"][0], *test)
                    yield pd.DataFrame({**{k: row[k] for k in keys}, "without": pd.Series([c] * row["q"], dtype=object), "alpha": alpha[0], "target": np.arange(row["q"], dtype=np.int32), "rmse": rmse, "corr": corr, "r2": r2})

    return parts.mapInPandas(run, "".join(f"{k} {kinds[k]}, " for k in keys) + f"without {kind}, alpha double, target int, rmse double, corr double, r2 double")


def partition_scores(parts: DataFrame, whole: DataFrame, keys: list[str], unique: bool = True) -> DataFrame:
    """Unique (or added) variance of each part: the closest scores that satisfy full >= part (or part >= base), in closed form.

    The closest full score is the largest mean of itself with the top k parts, and the closest base
    score the smallest mean of itself with the bottom k parts.
    """
    order = F.col("part").desc() if unique else F.col("part").asc()
    window = Window.partitionBy(*keys).orderBy(order, "feature")
    running = parts.join(whole, keys).withColumn("mean", (F.col("whole") + F.sum("part").over(window)) / (F.row_number().over(window) + 1))
    every = Window.partitionBy(*keys)
    fitted_ = F.greatest("whole", F.max("mean").over(every)) if unique else F.least("whole", F.min("mean").over(every))
    return running.select(*keys, "feature", F.greatest(F.lit(0.0), (fitted_ - F.col("part")) if unique else (F.col("part") - fitted_)).alias("variance"))


def explained_alone(scores: DataFrame, keys: list[str], unique: bool = True, by: str = "corr") -> DataFrame:
    """(keys, target, feature, variance) of :func:`nested_scores`: what the full model loses without a feature, or the base gains with it.

    ``by`` is "corr" for squared correlations or "r2"; models with a null score take no part.
    """
    value = F.pow("corr", 2) if by == "corr" else F.col("r2")
    rows = scores.select(*keys, "target", "model", value.alias("v")).filter("v IS NOT NULL")
    lead = "without " if unique else "base and "
    parts = rows.filter(F.col("model").startswith(lead)).select(*keys, "target", F.substring("model", len(lead) + 1, 1000).alias("feature"), F.col("v").alias("part"))
    whole = rows.filter(F.col("model") == (FULL if unique else BASE)).select(*keys, "target", F.col("v").alias("whole"))
    return partition_scores(parts, whole, [*keys, "target"], unique)
