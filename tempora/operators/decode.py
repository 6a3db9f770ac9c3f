"""Pairwise decoding of conditions from pseudo-trials, one fold for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.linear import dot
from tempora.operators.similarity import pairs


def decode_centroid(trials: DataFrame, condition: str, block: str, tp: str, x: str) -> DataFrame:
    """(i, j, tp, accuracy) by the nearest mean of the other blocks; each block is held out once, ties count half.

    Distances to all condition means are taken once for a trial, not once for a pair.  Conditions of
    a single block have no other blocks: their accuracies are null.
    """
    long = trials.select(condition, block, tp, F.posexplode(x).alias("c", "v"))
    totals = long.groupBy(condition, tp, "c").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    means = long.join(totals, [condition, tp, "c"]).groupBy(condition, block, tp).agg(F.sort_array(F.collect_list(F.struct("c", F.try_divide(F.col("s") - F.col("v"), F.col("n") - 1).alias("m")))).alias("all"))
    means = means.select(F.col(condition).alias("near"), block, tp, F.col("all.m").alias("m"))
    gap = F.zip_with(x, "m", lambda a, b: a - b)
    met = trials.join(means, [block, tp]).select(F.col(condition).alias("own"), "near", block, tp, gap.alias("g")).select("own", "near", block, tp, F.round(dot(F.col("g"), F.col("g")), 9).alias("d"))
    mine = met.filter("own = near").select("own", block, tp, F.col("d").alias("own_d"))
    hit = F.when(F.col("own_d").isNull() | F.col("d").isNull(), None).when(F.col("own_d") < F.col("d"), 1.0).when(F.col("own_d") == F.col("d"), 0.5).otherwise(0.0)
    hits = met.filter("own <> near").join(mine, ["own", block, tp]).withColumn("hit", hit)
    return hits.groupBy(F.greatest("own", "near").alias("i"), F.least("own", "near").alias("j"), tp).agg(F.avg("hit").alias("accuracy"))


#: Numbers of a block of pairs that a task solves at once, 8 bytes each.
SOLVED_AT_ONCE = 4_000_000


def shrunk_in_folds(z: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf covariances (pair, fold, channel, channel) of the rows outside each fold, averaged over timepoints.

    ``z`` is (pair, side, block, timepoint, channel); a fold holds one block of either side out.  Sums of
    products are made once over all blocks, and a fold's own are taken off; norms of centred rows
    follow from the rows' products with one another.
    """
    pairs_, sides, blocks, times, p = z.shape
    rows = z.transpose(0, 3, 2, 1, 4).reshape(pairs_, times, blocks * sides, p)
    n = sides * (blocks - 1)
    held = z.transpose(0, 2, 3, 1, 4)  # pair, fold, timepoint, side, channel
    mean = (rows.sum(axis=2)[:, None] - held.sum(axis=3)) / n
    second = (rows.swapaxes(2, 3) @ rows)[:, None] - held.swapaxes(3, 4) @ held
    cov = second / n - mean[..., :, None] * mean[..., None, :]
    inside = 1.0 - np.kron(np.eye(blocks), np.ones(sides))  # fold, row
    products = rows @ rows.swapaxes(2, 3)
    size = np.einsum("ptaa->pta", products)[:, None] - 2 * (rows[:, None] @ mean.reshape(pairs_, blocks, times, p, 1))[..., 0] + (mean**2).sum(axis=-1)[..., None]
    fourth = (size**2 * inside[None, :, None, :]).sum(axis=-1)
    trace, norm = np.einsum("pftcc->pft", cov), (cov**2).sum(axis=(-1, -2))
    mu = trace / p
    delta = (norm - mu * trace) / p
    beta = (fourth / n - norm) / (n * p)
    with np.errstate(divide="ignore", invalid="ignore"):
        shrinkage = np.where(delta > 0, np.minimum(beta, delta) / delta, 0.0)[..., None, None]
    return ((1 - shrinkage) * cov + shrinkage * mu[..., None, None] * np.eye(p)).mean(axis=2)


def hinge_duals(products: np.ndarray, y: np.ndarray, inside: np.ndarray, c: float = 1.0, tol: float = 1e-9, rounds: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """(dual weights, intercept) of many linear SVMs with hinge loss at once, from the products of their rows.

    ``products`` is (problem, row, row), ``y`` 1 or -1 for each row, ``inside`` says which rows a problem
    has.  Each round moves every unsolved problem along its most violating pair; all of it on arrays.
    """
    many = np.arange(len(products))
    alpha, slope = np.zeros(products.shape[:2]), np.broadcast_to(y, products.shape[:2]).astype(float)  # of the dual, times y
    size = np.einsum("baa->ba", products)
    for _ in range(rounds):
        up = inside & (((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0)))
        low = inside & (((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c)))
        high, least = np.where(up, slope, -np.inf), np.where(low, slope, np.inf)
        i, j = high.argmax(axis=1), least.argmin(axis=1)
        gap = high[many, i] - least[many, j]
        todo = np.flatnonzero(gap > tol)
        if not len(todo):
            break
        i, j, k = i[todo], j[todo], products[todo]
        at = np.arange(len(todo))
        curve = np.maximum(size[todo, i] + size[todo, j] - 2 * k[at, i, j], 1e-12)
        room_i = np.where(y[i] > 0, c - alpha[todo, i], alpha[todo, i])
        room_j = np.where(y[j] > 0, alpha[todo, j], c - alpha[todo, j])
        step = np.minimum(gap[todo] / curve, np.minimum(room_i, room_j))
        # a full step lands on the edge itself, not beside it
        alpha[todo, i] = np.clip(np.where(step == room_i, np.where(y[i] > 0, c, 0.0), alpha[todo, i] + y[i] * step), 0, c)
        alpha[todo, j] = np.clip(np.where(step == room_j, np.where(y[j] > 0, 0.0, c), alpha[todo, j] - y[j] * step), 0, c)
        slope[todo] -= step[:, None] * (k[at, i] - k[at, j])
    free = inside & (alpha > 0) & (alpha < c)
    up = inside & (((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0)))
    low = inside & (((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c)))
    middle = (np.where(up, slope, -np.inf).max(axis=1) + np.where(low, slope, np.inf).min(axis=1)) / 2
    count = free.sum(axis=1)
    return alpha, np.where(count > 0, np.where(free, slope, 0.0).sum(axis=1) / np.maximum(count, 1), middle)


def fold_accuracies(z: np.ndarray, c: float = 1.0) -> np.ndarray:
    """(pair, timepoint): the share of held-out rows on the right side, over all folds, each whitened by its training rows."""
    pairs_, sides, blocks, times, p = z.shape
    rows = z.transpose(0, 3, 2, 1, 4).reshape(pairs_, 1, times, blocks * sides, p)
    inverse = np.linalg.inv(shrunk_in_folds(z))[:, :, None]  # the square of the whitening: products of whitened rows need no root
    products = (rows @ inverse @ rows.swapaxes(3, 4)).reshape(-1, blocks * sides, blocks * sides)
    y = np.tile([1.0, -1.0], blocks)
    inside = np.kron(1 - np.eye(blocks), np.ones(sides)) > 0
    inside = np.broadcast_to(inside[None, :, None], (pairs_, blocks, times, blocks * sides)).reshape(-1, blocks * sides)
    alpha, offset = hinge_duals(products, y, inside, c)
    side = np.round(np.einsum("ba,bac->bc", alpha * y, products) + offset[:, None], 9)
    right = np.where(side == 0, 0.5, (side > 0) == (y > 0)) * ~inside
    return right.reshape(pairs_, blocks, times, -1).sum(axis=(1, 3)) / (sides * blocks)


def decode_svm(trials: DataFrame, condition: str, block: str, tp: str, x: str, within: list[str] | None = None, c: float = 1.0) -> DataFrame:
    """(within, i, j, tp, accuracy) of a linear SVM with hinge loss between conditions; each block is held out once.

    A fold's rows, all pseudo-trials of both conditions outside the held-out block, give its whitening:
    the inverse root of their Ledoit-Wolf covariance, averaged over timepoints.  A pair uses the blocks
    and timepoints that both conditions have whole (a block without one of a condition's timepoints
    doesn't count); below two common blocks it has no rows.  Repeated rows of a (condition, block, tp) give an error.
    """
    within = within or []
    layout = F.sort_array(F.collect_list(F.struct(F.col(block).alias("block"), F.col(tp).alias("tp"), F.col(x).alias("x"))))
    packed = trials.groupBy(*within, condition).agg(layout.alias("p"))
    packed = packed.select(*within, condition, F.col("p.block").alias("block"), F.col("p.tp").alias("tp"), F.flatten(F.col("p.x")).alias("v"))
    packed = packed.withColumn("layout", F.xxhash64("block", "tp"))
    met = pairs(packed, condition, within=within)
    kinds = dict(trials.dtypes)
    schema = ", ".join([*[f"{w} {kinds[w]}" for w in within], f"i {kinds[condition]}", f"j {kinds[condition]}", f"tp {kinds[tp]}", "accuracy double"])
    names = [*within, "i", "j", "tp", "accuracy"]
    sides = [f"{n}_{e}" for e in "ij" for n in ("block", "tp", "v", "layout")]
    return met.select(*within, f"{condition}_i", f"{condition}_j", *sides).mapInArrow(_decoded(len(within), names, c), schema)


def _decoded(lead: int, names: list[str], c: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            columns = {n: batch.column(n) for n in batch.schema.names}
            layouts = np.stack([columns["layout_i"].to_numpy(), columns["layout_j"].to_numpy()])
            _, kind = np.unique(layouts, axis=1, return_inverse=True)
            for k in range(kind.max() + 1):  # layouts of conditions, one by design
                rows = np.flatnonzero(kind == k)
                picked = []
                for e in "ij":
                    keys = [columns[f"{n}_{e}"][int(rows[0])].values for n in ("block", "tp")]
                    picked.append(keys)
                blocks, times, at = _common(*picked)
                if len(blocks) < 2 or not len(times):
                    continue
                width = [len(columns[f"v_{e}"][int(rows[0])].values) // len(picked[s][0]) for s, e in enumerate("ij")][0]
                step = max(1, SOLVED_AT_ONCE // (len(times) * len(blocks) * (2 * len(blocks)) * max(2 * len(blocks), width)))
                for first in range(0, len(rows), step):
                    part = pa.array(rows[first : first + step])
                    z = np.stack([columns[f"v_{e}"].take(part).flatten().to_numpy().reshape(len(part), -1, width)[:, at[s]] for s, e in enumerate("ij")], axis=1)
                    accuracy = fold_accuracies(z.reshape(len(part), 2, len(blocks), len(times), width), c)
                    spread = pa.array(np.repeat(part.to_numpy(), len(times)))
                    keys = [batch.column(n).take(spread) for n in range(lead + 2)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(np.tile(times, len(part))).cast(picked[0][1].type), pa.array(accuracy.ravel())], names=names)

    return run


def _common(one: list[pa.Array], two: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(blocks, timepoints, places of their product in either layout) that two layouts (blocks, timepoints of their rows) share whole."""
    sides = [list(zip(s[0].to_pylist(), s[1].to_pylist())) for s in (one, two)]
    if any(len(set(s)) < len(s) for s in sides):
        raise ValueError("a condition has more than one row for a block and timepoint")
    times = sorted({t for _, t in sides[0]} & {t for _, t in sides[1]})
    whole = [{b for b in {b for b, _ in s} if all((b, t) in set(s) for t in times)} for s in sides]
    blocks = sorted(whole[0] & whole[1])
    places = [{key: n for n, key in enumerate(s)} for s in sides]
    return np.array(blocks), np.array(times), [np.array([p[b, t] for b in blocks for t in times], int) for p in places]
