"""Principal components of what doesn't fit anywhere: kernels of all rows, and rows of very many columns.

Matrices are tables of blocks: a block's numbers are the bytes of 8-byte floats, row by row.  Only
matrices with as many rows and columns as there are components, and a few more, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.sources.tables import kept

#: Rows of a block, and columns of a tile of a wide table.
BLOCK_ROWS, TILE_COLUMNS = 2048, 4096
#: Blocks of rows that a task holds at most while all other blocks pass by, and rows of either that meet at a time.
HELD_BLOCKS, STRIP, ACROSS = 32, 256, 512
#: The random part of a start from the linear kernel, and the columns up to which there is one.
NOISE, LINEAR_COLUMNS = 0.03, 512
#: R factors that meet in a node of the tree.
FAN = 16


def _floats(value: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(value).reshape(-1, columns)


def row_blocks(df: DataFrame, x: str, size: int | None = None) -> DataFrame:
    """``df`` in blocks: (block, others as arrays, x) with the rows' vectors as one matrix."""
    others = [c for c in df.columns if c != x]
    kinds, size = dict(df.dtypes), size or BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                m = part.column(len(others)).flatten().to_numpy().astype(float)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(k)) for k in range(len(others))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([m.tobytes()])], names=[*others, x])

    blocks = df.select(*others, F.col(x).cast("array<double>").alias(x)).mapInArrow(run, ", ".join([*[f"{c} array<{kinds[c]}>" for c in others], f"{x} binary"]))
    return kept(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")


def block_sum(df: DataFrame, columns: list[str], of: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all rows of a small matrix ``of(bytes of the columns)``; tasks add up their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(len(columns))]):
                part = np.atleast_2d(of(*row))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], names=["r", "v"])

    parts = df.select(*columns).mapInArrow(run, "r long, v array<double>")
    summed = parts.select("r", F.posexplode("v")).groupBy("r", "pos").agg(F.sum("col").alias("s")).toArrow()
    out = np.zeros((max(summed.column("r").to_pylist(), default=-1) + 1, max(summed.column("pos").to_pylist(), default=-1) + 1))
    out[summed.column("r").to_numpy(), summed.column("pos").to_numpy()] = summed.column("s").to_numpy()
    return out


def kernel_product(left: DataFrame, right: DataFrame, kernel: Callable[..., np.ndarray], d: int, m: int) -> DataFrame:
    """(block, y): the kernel of ``left`` (block, x) against all of ``right`` (block, x, v), times ``v``; the kernel itself is never kept.

    A group holds its left blocks while all right blocks pass by, sorted behind them.  Blocks are dealt
    evenly to as many groups as there are cores, or a multiple, so that right blocks are sent few times.
    """
    many, cores = left.count(), _cores(left)
    groups = max(1, min(many, cores * -(-many // (cores * HELD_BLOCKS))))
    dealt = left.select("block").withColumn("g", ((F.row_number().over(Window.orderBy("block")) - 1) % groups).cast("long"))  # a number for each block of rows
    mine = left.join(dealt, "block").select("g", F.lit(0).alias("kind"), "block", "x", F.lit(None).cast("binary").alias("v"))
    every = right.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(1).alias("kind"), "block", "x", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, room = None, [], np.empty(STRIP * ACROSS)
        for batch in batches:
            for g, kind, block, x, v in zip(*[c.to_pylist() for c in batch.columns]):
                if g != group:
                    yield from done(held)
                    group, held = g, []
                z = _floats(x, d)
                if kind == 0:
                    held.append((block, z, np.zeros((len(z), m))))
                    continue
                w = _floats(v, m)
                for _, rows, y in held:
                    for at in range(0, len(rows), STRIP):
                        for beside in range(0, len(z), ACROSS):
                            y[at : at + STRIP] += kernel(rows[at : at + STRIP], z[beside : beside + ACROSS], room) @ w[beside : beside + ACROSS]
        yield from done(held)

    def done(held: list) -> Iterator[pa.RecordBatch]:
        for block, _, y in held:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([y.tobytes()])], names=["block", "y"])

    rows = mine.unionByName(every).withColumn("g", F.col("g").cast("int")).repartitionById(groups, "g").sortWithinPartitions("g", "kind")
    return rows.mapInArrow(run, "block long, y binary")


def _cores(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def poly_kernel(width: int, degree: int) -> Callable[..., np.ndarray]:
    """(x.y / width + 1) to a whole ``degree``, by squaring: a general power takes many times as long as the product; ``room`` may be used for it."""

    def of(a: np.ndarray, b: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
        z = np.matmul(a / width, b.T, out=None if room is None else room[: len(a) * len(b)].reshape(len(a), len(b)))
        z += 1
        left, out = degree, None
        while left:
            if left & 1:
                out = z.copy() if out is None and left > 1 else z if out is None else out * z
            left >>= 1
            if left:
                z *= z
        return np.ones(z.shape) if out is None else out

    return of


def _signs(df: DataFrame, column: str, of: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """For each component 1 or -1, so that its largest entry over all blocks becomes positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                m = of(value)
                top = np.abs(m).argmax(axis=0)
                v = m[top, np.arange(m.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(np.round(np.abs(v), 12)), pa.array(np.sign(v))], names=["k", "size", "sign"])

    best = df.select(column).mapInArrow(run, "k long, size double, sign double").groupBy("k").agg(F.max(F.struct("size", "sign")).alias("top"))
    signs = {r["k"]: r["top"]["sign"] or 1.0 for r in best.collect()}  # a row for each component
    return np.array([signs[k] for k in sorted(signs)])


def kernel_pca(df: DataFrame, train: Column, x: str, k: int, degree: int = 4, more: int = 30, rounds: int = 40, tol: float = 1e-7, seed: int = 42) -> DataFrame:
    """``df`` with ``x`` replaced by its coordinates in polynomial kernel PCA of all training rows.

    The kernel, (x.y / width + 1) to the ``degree``, is centred.  Block Lanczos: a basis of ``k + more``
    columns grows by the kernel's products with its newest part, until the residuals of the first
    ``k`` axes are below ``tol`` of the largest value; after ``rounds`` without that it raises.  It
    begins with the linear kernel's axes and some noise, which holds a part of every other axis, so that
    residuals are small only when those are found too.  The kernel is made block by block in each round,
    so memory depends on the block's size only; training rows get their coordinates from the rounds'
    products.  With fewer training rows than ``k`` there are as many components as the kernel has.
    """
    others = [c for c in df.columns if c != x]
    flagged = df.select(*others, F.coalesce(train, F.lit(False)).alias("_train"), x)
    rest = row_blocks(flagged.filter(~F.col("_train")).drop("_train"), x).withColumnRenamed(x, "x")
    own = row_blocks(flagged.filter("_train").drop("_train"), x).withColumnRenamed(x, "x")
    trained = own.select("block", "x")
    first = df.select(F.size(x)).first()
    n = flagged.filter("_train").count()
    if first is None or n == 0:
        return df.select(*others, F.col(x).cast("array<double>").alias(x)).limit(0)
    d, m = first[0], max(1, min(k + more, n - 1))
    kernel = poly_kernel(d, degree)
    linear = _linear_axes(trained, d, m, n) if d <= LINEAR_COLUMNS else np.zeros((d, 0))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, value in zip(*[c.to_pylist() for c in batch.columns]):
                z = _floats(value, d)
                v = np.random.default_rng([seed, block]).normal(size=(len(z), m))
                v[:, : linear.shape[1]] = NOISE * v[:, : linear.shape[1]] + z @ linear
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([v.tobytes()])], names=["block", "v"])

    newest = kept(trained.select("block", "x").mapInArrow(start, "block long, v binary"), "start")
    newest = _orthonormal(newest, block_sum(newest, ["v"], lambda v: _moments(_floats(v, m))), n, m)
    basis: list[DataFrame] = []  # tables (block, v) and (block, y), of m columns each
    images: list[DataFrame] = []
    while True:
        image = kept(kernel_product(trained, trained.join(newest, "block"), kernel, d, m), "image")
        basis.append(newest)
        images.append(image)
        size = len(basis)
        gram = block_sum(_side_by_side([*basis, *images]), ["parts"], lambda v: _moments(np.hstack([_floats(u, m) for u in v])))
        # columns are centred by their sums, which the last row of the moments holds
        centred = gram[:-1, :-1] - np.outer(gram[-1, :-1], gram[-1, :-1]) / n
        q, w = slice(0, size * m), slice(size * m, 2 * size * m)
        norms, turn = np.linalg.eigh(centred[q, q])
        root = turn[:, norms > 1e-10] / np.sqrt(norms[norms > 1e-10])  # columns have length 1, or 0 where the kernel's rank ended
        values, vectors = np.linalg.eigh(root.T @ ((centred[q, w] + centred[q, w].T) / 2) @ root)
        values, axes = values[::-1][:k], (root @ vectors[:, ::-1])[:, :k]
        residual = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", axes, centred[w, w], axes) - values**2, 0))
        if (residual <= tol * values[0]).all() or size * m >= n - 1:
            break
        if size == rounds:
            raise ArithmeticError(f"residuals {residual / values[0]} after {rounds} rounds")
        newest = _next(basis, images[-1], centred, gram[-1, :-1], n, m)
        if newest is None:
            break
    found = values > 1e-10 * max(values[0], 1e-300)
    values, axes = values[found], axes[:, found]
    by, mean = axes / np.sqrt(values), gram[-1, q] / n
    scaled = kept(_times(_side_by_side(basis), by, m, mean), "axes")
    signs, k = np.diag(_signs(scaled, "v", lambda v: _floats(v, len(values)))), len(values)
    scaled = _times(_side_by_side([scaled]), signs, k, np.zeros(k))
    met = kept(kernel_product(rest.select("block", "x"), trained.join(scaled, "block"), kernel, d, k), "coordinates")
    # basis columns have no mean to speak of, so that the rounds' images are the kernel's products with the axes
    seen = kept(_times(_side_by_side(images), by @ signs, m, np.zeros(len(by))).withColumnRenamed("v", "y"), "coordinates")
    mean = block_sum(seen, ["y"], lambda y: _floats(y, k).sum(axis=0)) / n
    both = seen.join(own.drop("x"), "block").unionByName(met.join(rest.drop("x"), "block"))
    return _rows_of(both, others, x, k, mean[0])


def _linear_axes(trained: DataFrame, d: int, m: int, n: int) -> np.ndarray:
    """Weights of the columns for the centred linear kernel's main axes, each of as many units as there are rows; fewer where rows have fewer axes."""
    moments = block_sum(trained, ["x"], lambda v: _moments(_floats(v, d)))
    values, vectors = np.linalg.eigh(moments[:-1, :-1] / n - np.outer(moments[-1, :-1], moments[-1, :-1]) / n**2)
    there = values > 1e-10 * max(values[-1], 1e-300)
    return (vectors[:, there] / np.sqrt(values[there]))[:, ::-1][:, :m]


def _moments(z: np.ndarray) -> np.ndarray:
    z = np.hstack([z, np.ones((len(z), 1))])
    return z.T @ z


def _side_by_side(tables: list[DataFrame]) -> DataFrame:
    """(block, parts): the matrices of a block from tables (block, matrix), in the order of the tables."""
    rows = None
    for k, t in enumerate(tables):
        t = t.toDF("block", "m").withColumn("k", F.lit(k))
        rows = t if rows is None else rows.unionByName(t)
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("all")).select("block", F.col("all.m").alias("parts"))


def _times(blocks: DataFrame, by: np.ndarray, m: int, mean: np.ndarray) -> DataFrame:
    """(block, v): the matrices of a block side by side (parts), less ``mean``, times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, parts in zip(*[c.to_pylist() for c in batch.columns]):
                z = (np.hstack([_floats(u, m) for u in parts]) - mean) @ by
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([z.tobytes()])], names=["block", "v"])

    return blocks.mapInArrow(run, "block long, v binary")


def _orthonormal(table: DataFrame, gram: np.ndarray, n: int, m: int) -> DataFrame:
    """The table's columns, centred and made orthonormal."""
    values, vectors = np.linalg.eigh(gram[:-1, :-1] - np.outer(gram[-1, :-1], gram[-1, :-1]) / n)
    turn = np.where(values > 1e-13 * values[-1], vectors / np.sqrt(np.maximum(values, 1e-300)), 0)
    return kept(_times(_side_by_side([table]), turn, m, gram[-1, :-1] / n), "basis")


def _next(basis: list[DataFrame], image: DataFrame, centred: np.ndarray, sums: np.ndarray, n: int, m: int) -> DataFrame | None:
    """The newest image less its part in the basis, orthonormal; nothing if the basis holds it."""
    size = len(basis)
    q, w = np.arange(size * m), np.arange(2 * size * m - m, 2 * size * m)
    inside = np.linalg.lstsq(centred[np.ix_(q, q)], centred[np.ix_(q, w)], rcond=None)[0]
    left = centred[np.ix_(w, w)] - centred[np.ix_(w, q)] @ inside
    values, vectors = np.linalg.eigh((left + left.T) / 2)
    if values[-1] <= 1e-12 * np.trace(centred[np.ix_(w, w)]):
        return None
    turn = np.where(values > 1e-10 * values[-1], vectors / np.sqrt(np.maximum(values, 1e-300)), 0)
    by = np.vstack([-inside @ turn, turn])
    out = _times(_side_by_side([*basis, image]), by, m, np.concatenate([sums[q], sums[w]]) / n)
    return kept(out, "basis")


def _rows_of(blocks: DataFrame, others: list[str], x: str, k: int, mean: np.ndarray) -> DataFrame:
    """(others, x): a row for each row of the blocks (others as arrays, y), ``y`` less ``mean``."""
    kinds = {c: t[6:-1] for c, t in blocks.dtypes if c in others}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, y in enumerate(batch.column(len(others)).to_pylist()):
                z = _floats(y, k) - mean
                lists = [batch.column(c)[at].values for c in range(len(others))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(list(z))], names=[*others, x])

    return blocks.select(*others, "y").mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in others], f"{x} array<double>"]))


def added(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): matrices of one key and shape added up, as they pass by in the order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for k, v in zip(*[c.to_pylist() for c in batch.columns]):
                if k != at and total is not None:
                    yield one(at, total)
                total = np.frombuffer(v) + (total if k == at else 0.0)
                at = k
        if total is not None:
            yield one(at, total)

    def one(k: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([total.tobytes()])], names=[key, value])

    return df.select(key, value).repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{key} long, {value} binary")


def tall_root(df: DataFrame, key: str, value: str, width: int) -> np.ndarray:
    """The matrix that makes the columns of the blocks, stacked, orthonormal: from their R factors, which meet in a tree, ``FAN`` at a node."""

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v in zip(*[c.to_pylist() for c in batch.columns]):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.linalg.qr(_floats(v, width), "r").tobytes()])], names=["node", "r"])

    def stacked(table: pa.Table) -> pa.Table:
        r = np.linalg.qr(np.vstack([_floats(v, width) for v in table.column("r").to_pylist()]), "r")
        return pa.table({"node": table.column("up").slice(0, 1), "r": pa.array([r.tobytes()])})

    level = kept(df.select(key, value).mapInArrow(factors, "node long, r binary"), "factors")
    while (many := level.count()) > 1:
        level = kept(level.withColumn("up", F.pmod(F.xxhash64("node"), F.lit(-(-many // FAN)))).groupBy("up").applyInArrow(stacked, "node long, r binary"), "factors")
    root = level.first()
    _, sizes, turn = np.linalg.svd(_floats(root["r"], width) if root else np.zeros((1, width)))
    sizes = np.pad(sizes, (0, width - len(sizes)))
    return np.where(sizes > 1e-12 * max(sizes[0], 1e-300), turn.T / np.maximum(sizes, 1e-300), 0)


def _products(left: DataFrame, right: DataFrame, on: str, to: str, width: int, turned: bool) -> DataFrame:
    """(to, m): tiles (block, c, z) times the matrices (on, m) of their rows' or columns' side, added up along the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, z, columns, m in zip(*[c.to_pylist() for c in batch.columns]):
                tile, by = _floats(z, columns), _floats(m, width)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([((tile.T if turned else tile) @ by).tobytes()])], names=[to, "m"])

    return kept(added(left.join(right, on).select(to, "z", "columns", "m").mapInArrow(run, f"{to} long, m binary"), to, "m"), "products")


def wide_pca(df: DataFrame, train: Column, x: str, k: int, share: float = 0.9, tile: int = TILE_COLUMNS, more: int = 8, power: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``x`` replaced by its coordinates, (component, share, cumulative, kept)) of scaled vectors of any width.

    Columns are scaled by the training rows' mean and deviation (0 counts as 1).  The main axes come
    from ``power`` + 1 rounds of products with a random start of ``k + more`` columns, made orthonormal
    by a tree of QR factors over tiles of columns; no matrix as wide as the vectors reaches the driver.
    Components up to ``share`` of all variance are ``kept``.  Shares and axes come from the same fit.
    """
    others = [c for c in df.columns if c != x]
    first = df.select(F.size(x)).first()
    if first is None:
        return df.select(*others, F.col(x).cast("array<double>").alias(x)), df.sparkSession.createDataFrame([], "component int, share double, cumulative double, kept boolean")
    width, wide = min(k + more, first[0]), first[0]
    both = [row_blocks(df.filter(train), x), row_blocks(df.filter(~train), x)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, v in zip(*[c.to_pylist() for c in batch.columns]):
                z = _floats(v, wide)
                for c in range(0, wide, tile):
                    part = np.ascontiguousarray(z[:, c : c + tile])
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([c // tile]), pa.array([part.shape[1]], pa.int32()), pa.array([part.tobytes()])], names=["block", "c", "columns", "z"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, columns, v in zip(*[c.to_pylist() for c in batch.columns]):
                z = _floats(v, columns)
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([np.stack([np.full(columns, len(z)), z.sum(axis=0), (z * z).sum(axis=0)]).tobytes()])], names=["c", "s"])

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, c, columns, v, s in zip(*[c.to_pylist() for c in batch.columns]):
                n, total, square = np.frombuffer(s).reshape(3, columns)
                sd = np.sqrt(np.maximum(square / n - (total / n) ** 2, 0))
                z = np.where(np.round(sd, 12) == 0, 0.0, (_floats(v, columns) - total / n) / np.where(np.round(sd, 12) == 0, 1.0, sd))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([c]), pa.array([columns], pa.int32()), pa.array([z.tobytes()])], names=["block", "c", "columns", "z"])

    form = "block long, c long, columns int, z binary"
    raw = [b.select("block", x).mapInArrow(cut, form) for b in both]
    stats = kept(added(raw[0].select("c", "columns", "z").mapInArrow(sums, "c long, s binary"), "c", "s"), "column-sums")
    tiles = [kept(r.join(stats, "c").select("block", "c", "columns", "z", "s").mapInArrow(scaled, form), "tiles") for r in raw]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, s in zip(*[c.to_pylist() for c in batch.columns]):
                v = np.random.default_rng([seed, c]).normal(size=(len(s) // 24, width))
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([v.tobytes()])], names=["c", "m"])

    def turned(table: DataFrame, key: str, by: np.ndarray) -> DataFrame:
        return _times(table.select(F.col(key).alias("block"), F.array("m").alias("parts")), by, width, np.zeros(width)).toDF(key, "m")

    axes = kept(stats.mapInArrow(start, "c long, m binary"), "start")
    for _ in range(power + 1):
        rows = _products(tiles[0], axes, "c", "block", width, False)
        columns = _products(tiles[0], turned(rows, "block", tall_root(rows, "block", "m", width)), "block", "c", width, True)
        axes = kept(turned(columns, "c", tall_root(columns, "c", "m", width)), "axes")
    rows = _products(tiles[0], axes, "c", "block", width, False)
    small = block_sum(rows, ["m"], lambda m: _floats(m, width).T @ _floats(m, width))
    values, vectors = np.linalg.eigh(small)
    vectors = vectors[:, ::-1][:, :k]
    by = np.hstack([vectors, np.zeros((width, width - vectors.shape[1]))])
    signs = _signs(turned(axes, "c", by), "m", lambda v: _floats(v, width)[:, : vectors.shape[1]])
    total = block_sum(tiles[0], ["z"], lambda z: np.array([[(np.frombuffer(z) ** 2).sum()]]))[0, 0]
    part = np.maximum(values[::-1][:k], 0) / max(total, 1e-300)
    upto = part.cumsum()
    shares = [(i + 1, float(p), float(u), bool(i == 0 or upto[i - 1] < share)) for i, (p, u) in enumerate(zip(part, upto))]
    final = kept(turned(axes, "c", vectors * signs), "axes")
    out = None
    for blocks, parts in zip(both, tiles):
        met = _products(parts, final, "c", "block", vectors.shape[1], False).withColumnRenamed("m", "y").join(blocks.drop(x), "block")
        one = _rows_of(met, others, x, vectors.shape[1], np.zeros(vectors.shape[1]))
        out = one if out is None else out.unionByName(one)
    return out, df.sparkSession.createDataFrame(shares, "component int, share double, cumulative double, kept boolean")
