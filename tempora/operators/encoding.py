"""The encoding chain: alphas chosen on one split, fits on another, scores on a third, all from one table of moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import linear as L

SPLITS = ("train", "val", "test")


def encoded(rows: DataFrame, keys: list[str], x: str, y: str, alphas: np.ndarray | None = None, criterion: str = "rmse") -> DataFrame:
    """(keys, alpha, target, rmse, corr, r2) on the test rows of each group of ``rows`` (keys, split, x, y).

    Each group's alpha has the least mean RMSE over its targets on the validation rows, or with
    ``criterion`` "corr" the greatest mean correlation; the first on ties.  Rows are read once and
    meet as sums of products, a row for each group and split.  Groups without rows in one of the
    splits give nothing.
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
                betas = L.ridge(parts["train"][0], parts["train"][1], grid)
                tried = [L.scores(b, row["n_val"], *parts["val"]) for b in betas]
                loss = [np.mean(rmse) if criterion == "rmse" else -np.mean(corr) for rmse, corr, _ in tried]
                best = int(np.argmin(np.round(np.nan_to_num(loss, nan=np.inf), 9)))
                rmse, corr, r2 = L.scores(betas[best], row["n_test"], *parts["test"])
                yield pd.DataFrame({**{k: row[k] for k in keys}, "alpha": grid[best], "target": np.arange(1, row["q"] + 1, dtype=np.int32), "rmse": rmse, "corr": corr, "r2": r2})

    return groups.mapInPandas(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "alpha double, target int, rmse double, corr double, r2 double")


def curves(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alpha, y, r2): correlation and r2, averaged over channels."""
    return scored.groupBy(*keys, "alpha").agg(F.avg("corr").alias("y"), F.avg("r2").alias("r2"))
