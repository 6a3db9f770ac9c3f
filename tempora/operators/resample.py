"""Null distributions and bootstraps as products of small matrices.

Resample b = 0 is the observed statistic.  A task meets a few thousand units at a time, as a matrix of
units by points; it draws the weights of a block of resamples for these units and multiplies.  Only
sums of a block of resamples and a point leave the task, so what is shuffled doesn't grow with units.
Draws are keyed: those of a unit and resample are the same wherever and however often they are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.rng import draw, md5_words
from tempora.sources.tables import kept

#: Units of a product, resamples of a block, and numbers of a block of weights at most.
UNITS, RESAMPLES, WEIGHTS = 4096, 512, 4_000_000
#: Counts of drawn units that a task of a bootstrap holds, parts that its resamples are dealt to at least, and draws' ends made at once.
DRAWN, SHARES, ENDS = 16_000_000, 32, 1 << 18


def packed(curve: DataFrame, unit: list[str], key: list[str], value: str = "y") -> DataFrame:
    """One row for each unit: its points as an array of (key, value), as many as there are keys."""
    return curve.groupBy(*unit).agg(F.collect_list(F.struct(*key, F.col(value).cast("double").alias("y"))).alias("points"))


def resamples(df: DataFrame, B: int) -> DataFrame:
    """``df`` once for each b from 0 to B."""
    return df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B))))


def text_of(*parts: Column) -> Column:
    """The parts of a draw's key as its text has them, without nulls."""
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def draws(starts: list[bytes], ends: list[bytes]) -> np.ndarray:
    """The keyed draws of :func:`tempora.functions.rng.draw`, (start, end), for keys made of both."""
    return md5_words(starts, ends)


class Points:
    """The units of an Arrow batch as a matrix: ``y`` (unit, point), ``known`` (whether it has the point), and the points' keys."""

    def __init__(self, lists: pa.ListArray, names: list[str]):
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        unit = np.repeat(np.arange(len(lists)), sizes)
        code, first = np.zeros(len(flat), np.int64), np.zeros(min(1, len(flat)), np.int64)
        for name in names:
            index = flat.field(name).dictionary_encode().indices
            index = index.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            _, first, code = np.unique(code * (index.max(initial=0) + 1) + index, return_index=True, return_inverse=True)
        self.keys = [flat.field(name).take(pa.array(first)) for name in names]
        y = flat.field("y")
        value, there = y.fill_null(0.0).to_numpy(zero_copy_only=False), y.is_valid().to_numpy(zero_copy_only=False).astype(float)
        shape = (len(lists), max(1, len(first)))
        at = unit * shape[1] + code
        self.y = np.bincount(at, value, shape[0] * shape[1]).reshape(shape)
        self.known = np.bincount(at, there, shape[0] * shape[1]).reshape(shape)

    def rows(self, lead: list[pa.Array], names: list[str], b: np.ndarray, sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        """A row for each resample and point; ``lead`` are arrays of one value each."""
        many = len(self.keys[0]) if self.keys else 1
        spread = pa.array(np.zeros(len(b) * many, np.int64))
        keys = [a.take(spread) for a in lead] + [k.take(pa.array(np.tile(np.arange(many), len(b)))) for k in self.keys]
        return pa.RecordBatch.from_arrays([*keys, pa.array(np.repeat(b, many)), *[pa.array(v[:, :many].ravel()) for v in sums.values()]], names=[*names, "b", *sums])


def _blocks(B: int, units: int) -> Iterator[np.ndarray]:
    step = max(1, min(RESAMPLES, WEIGHTS // max(1, units)))
    for at in range(0, B + 1, step):
        yield np.arange(at, min(at + step, B + 1), dtype=np.int32)


def _products(rows: DataFrame, key: list[str], B: int, weigh: Callable[[np.ndarray, pa.RecordBatch], np.ndarray], kind: str) -> DataFrame:
    """(key, b, s, n) from rows (points, ...): sums over units of weight times value, and how many units have the point.

    Of weights that are signs every unit counts; with ``kind`` "halves" the weights are 1 or 0, ``n`` counts
    the ones, and ``s2`` and ``n2`` are the same of the other units.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["points"].dataType.elementType}
    names = ["s", "n", "s2", "n2"] if kind == "halves" else ["s", "n"]
    schema = "".join(f"{k} {kinds[k]}, " for k in key) + "b int, " + ", ".join(f"{c} double" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), UNITS):
                part = batch.slice(at, UNITS)
                points = Points(part.column(0), key)
                for b in _blocks(B, len(part)):
                    w = weigh(b, part)
                    if kind == "halves":
                        found = [w @ points.y, w @ points.known, (1 - w) @ points.y, (1 - w) @ points.known]
                    else:
                        found = [w @ points.y, np.broadcast_to(points.known.sum(axis=0), (len(b), points.y.shape[1]))]
                    yield points.rows([], key, b, dict(zip(names, found)))

    sums = rows.mapInArrow(run, schema).groupBy(*key, "b").agg(*[F.sum(c).alias(c) for c in names])
    return kept(sums, "sums")  # a row for each resample and point, used more than once


def sign_flip(curve: DataFrame, key: list[str], B: int, seed: int, unit: str = "subject", chance: float = 0.0, how: str = "mean") -> DataFrame:
    """(key, b, stat): the mean or sum over units of curves less chance, each unit's curve flipped as a whole by a keyed sign."""
    units = packed(curve.withColumn("_y", F.col("y") - chance), [unit], key, "_y").select("points", text_of(F.col(unit)).alias("u"))

    def weigh(b: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        ends = [(f"|{u}" if u else "").encode() for u in part.column(1).to_pylist()]
        w = 1.0 - 2.0 * (draws([f"{seed}|{i}".encode() for i in b.tolist()], ends) & 1)
        w[b == 0] = 1.0
        return w

    sums = _products(units, key, B, weigh, "signs")
    return sums.select(*key, "b", (F.try_divide("s", "n") if how == "mean" else F.col("s")).alias("stat"))


def shuffle_limits(units: DataFrame, unit: str, cohort: str, first: str, B: int, seed: int, bits: int = 10) -> dict[int, tuple[int, object]]:
    """For each b > 0 the draw and unit of the last unit, in the order of (draw, unit), that gets the first label.

    As many units as are in the first cohort get it.  Each b's draws are counted by their leading
    ``bits``; only the range that holds its place is looked into, so no b's units are sorted whole.
    """
    size = units.filter(F.col(cohort) == first).count()
    if not size or not B:
        return {}
    text = units.select(text_of(F.col(unit)).alias("u"), F.col(unit).alias("unit"))
    shift = 32 - bits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((B + 1, 1 << bits), np.int64)
        for batch in batches:
            ends = [f"|{u}".encode() for u in batch.column(0).to_pylist()]
            for b in _blocks(B, len(ends)):
                place = draws([f"{seed}|{i}".encode() for i in b.tolist()], ends) >> shift
                total[b] += np.bincount((place + (np.arange(len(b), dtype=np.int64) << bits)[:, None]).ravel(), minlength=len(b) << bits).reshape(len(b), -1)
        for b in range(B + 1):
            at = np.flatnonzero(total[b])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b, np.int32)), pa.array(at), pa.array(total[b, at])], names=["b", "range", "n"])

    counts = text.select("u").mapInArrow(counted, "b int, range long, n long").groupBy("b", "range").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))  # 2^bits ranges at most
    holds = counts.withColumn("upto", upto).filter((F.col("upto") >= size) & (F.col("upto") - F.col("n") < size) & (F.col("b") > 0))
    found = {r["b"]: (r["range"], size - r["upto"] + r["n"]) for r in holds.collect()}  # a row for each b
    ranges = np.full(B + 1, -1, np.int64)
    ranges[list(found)] = [v[0] for v in found.values()]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [f"|{u}".encode() for u in batch.column(0).to_pylist()]
            for b in _blocks(B, len(ends)):
                got = draws([f"{seed}|{i}".encode() for i in b.tolist()], ends)
                i, j = np.nonzero((got >> shift) == ranges[b][:, None])
                yield pa.RecordBatch.from_arrays([pa.array(b[i]), pa.array(got[i, j].astype(np.int64)), batch.column(1).take(pa.array(j))], names=["b", "draw", "unit"])

    kind = dict(units.dtypes)[unit]
    rest = text.mapInArrow(inside, f"b int, draw long, unit {kind}")
    wanted = units.sparkSession.createDataFrame([(b, place) for b, (_, place) in found.items()], "b int, place long")
    ranked = rest.withColumn("rn", F.row_number().over(Window.partitionBy("b").orderBy("draw", "unit"))).join(wanted, "b")
    return {r["b"]: (r["draw"], r["unit"]) for r in ranked.filter("rn = place").collect()}  # a row for each b


def label_shuffle(curve: DataFrame, key: list[str], B: int, seed: int, unit: str = "subject", cohort: str = "cohort", first: str = "a", how: str = "mean") -> DataFrame:
    """(key, b, stat): first cohort minus the rest, with labels shuffled over units in sizes that stay."""
    limits = shuffle_limits(curve.select(unit, cohort).distinct(), unit, cohort, first, B, seed)
    least = np.array([limits.get(b, (-1, None))[0] for b in range(B + 1)], np.int64)
    units = packed(curve, [unit, cohort], key).select("points", text_of(F.col(unit)).alias("u"), F.col(unit).alias("unit"), F.coalesce(F.col(cohort) == first, F.lit(False)).alias("own"))

    def mine(b: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        got = draws([f"{seed}|{i}".encode() for i in b.tolist()], [f"|{u}".encode() for u in part.column(1).to_pylist()]).astype(np.int64)
        w = got < least[b][:, None]
        names = None
        for i, j in zip(*np.nonzero(got == least[b][:, None])):  # the last unit itself, and any with its draw
            names = names or part.column(2).to_pylist()
            w[i, j] = names[j] <= limits[int(b[i])][1]
        w[b == 0] = part.column(3).to_numpy(zero_copy_only=False)
        return w.astype(float)

    sums = _products(units, key, B, mine, "halves")
    of = (lambda s, n: F.try_divide(s, n)) if how == "mean" else (lambda s, n: F.when(F.col(n) > 0, F.col(s)))
    return sums.select(*key, "b", (of("s", "n") - of("s2", "n2")).alias("stat"))


def numbered(units: DataFrame, within: list[str], unit: str) -> DataFrame:
    """``units`` with ``k``, their place from 0 in the order of ``unit`` within ``within``, and ``n``, how many there are.

    Rows are sorted by ranges; a part's first place is how many rows the parts before it have.
    """
    own = [*within, unit]
    ordered = units.repartitionByRange(*own).sortWithinPartitions(*own).withColumn("_at", F.monotonically_increasing_id())
    ordered = kept(ordered, "ordered")
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part"), *within).agg(F.count(F.lit(1)).alias("_m"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*within or [F.lit(1)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("_m").over(Window.partitionBy(*within or [F.lit(1)]))
    starts = sizes.withColumns({"_before": before, "n": every})  # a row for each part and group
    starts = starts.select(F.col("_part").alias("_p"), *[F.col(w).alias(f"_{w}") for w in within], "_before", "_first", "n")
    alike = [F.col("_part") == F.col("_p"), *[F.col(w).eqNullSafe(F.col(f"_{w}")) for w in within]]
    met = ordered.withColumn("_part", part).join(starts, alike)
    return met.select(*units.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("k"), "n")


def _unit_blocks(rows: DataFrame, groups: list[str], key: list[str], lead: Column) -> DataFrame:
    """(groups, n, lead, keys, k, y, known) from rows (groups, points, k, n): units of a group packed as matrices of at most ``UNITS`` units by points, as bytes."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["points"].dataType.elementType}
    types = dict(rows.dtypes)
    listed = "struct<" + ", ".join(["at: int", *[f"{c}: {kinds[c]}" for c in key]]) + ">"
    schema = "".join(f"{g} {types[g]}, " for g in groups) + f"n long, lead string, keys array<{listed}>, k binary, y binary, known binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(len(batch), np.int64)
            for g in range(len(groups)):
                index = batch.column(4 + g).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                code = np.unique(code * (index.max(initial=0) + 1) + index, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            starts = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), len(batch)]
            for first, stop in zip(starts, starts[1:]):
                for at in range(first, stop, UNITS):
                    part = batch.take(pa.array(order[at : min(at + UNITS, stop)]))
                    points = Points(part.column(0), key)
                    many = points.y.shape[1] if key else 1
                    fields = [pa.array(np.arange(many, dtype=np.int32)), *points.keys]
                    fields = [f.slice(0, len(fields[-1])) for f in fields]
                    keys = pa.ListArray.from_arrays(pa.array([0, len(fields[0])], pa.int32()), pa.StructArray.from_arrays(fields, ["at", *key]))
                    bytes_ = [pa.array([v.tobytes()]) for v in (part.column(1).to_numpy(), points.y, points.known.astype(np.uint8))]
                    yield pa.RecordBatch.from_arrays([*[part.column(4 + g).slice(0, 1) for g in range(len(groups))], part.column(2).slice(0, 1), part.column(3).slice(0, 1), keys, *bytes_], names=[*groups, "n", "lead", "keys", "k", "y", "known"])

    return rows.select("points", "k", "n", lead.alias("lead"), *groups).mapInArrow(run, schema)


def _times_drawn(lead: str, b: np.ndarray, n: int) -> np.ndarray:
    """(b, unit): how often each of ``n`` units is drawn; b = 0 takes each once."""
    taken = np.zeros((len(b), n), np.uint16)
    for at in range(0, n, ENDS):
        ends = [str(i).encode() for i in range(at, min(at + ENDS, n))]
        for first in range(0, len(b), 8):
            got = draws([f"{lead}|{i}|".encode() for i in b[first : first + 8].tolist()], ends)
            got -= got // np.uint32(n) * np.uint32(n)
            for r, row in enumerate(got):
                taken[first + r] += np.bincount(row, minlength=n).astype(np.uint16)
    taken[b == 0] = 1
    return taken


def _bootstrapped(points: DataFrame, within: list[str], unit: str, key: list[str], B: int, seed: int, extra: list[str], apart: list[str] | None = None) -> DataFrame:
    """(within, apart, extra, key, b, s, n) from rows (within, apart, extra, unit, points): sums with weights of draws with replacement.

    A task draws a few resamples of a group and keeps how often each unit is taken, in two bytes, while the
    group's units pass by as matrices; ``apart`` names groups that the draws' keys don't have.
    """
    groups = [*within, *(apart or []), *extra]
    rows = numbered(points, groups, unit)
    most = rows.agg(F.max("n")).first()[0] or 0
    step = max(1, min(RESAMPLES, DRAWN // max(1, most), -(-(B + 1) // SHARES)))
    blocks = -(-(B + 1) // step)
    packed_ = _unit_blocks(rows, groups, key, text_of(F.lit(seed), *[F.col(g) for g in [*within, *extra]]))
    spread = packed_.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.select("_block", "n", "lead", "keys", "k", "y", "known", *groups).repartition(*groups, "_block").sortWithinPartitions(*groups, "_block")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["points"].dataType.elementType} | {g: t for g, t in rows.dtypes if g in groups}
    names = [*groups, *key]
    schema = "".join(f"{k} {kinds[k]}, " for k in names) + "b int, s double, n double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, b, taken = None, None, None
        for batch in batches:
            for r in range(len(batch)):
                block, n, lead = (batch.column(c)[r].as_py() for c in range(3))
                if (lead, n, block) != at:
                    at = (lead, n, block)
                    b = np.arange(block * step, min((block + 1) * step, B + 1), dtype=np.int32)
                    taken = _times_drawn(lead, b, n)
                k = np.frombuffer(batch.column(4)[r].as_buffer(), np.int64)
                y = np.frombuffer(batch.column(5)[r].as_buffer()).reshape(len(k), -1)
                known = np.frombuffer(batch.column(6)[r].as_buffer(), np.uint8).reshape(len(k), -1)
                w = taken[:, k].astype(float)
                listed = batch.column(3)[r].values
                many = len(listed)
                spread_, again = pa.array(np.zeros(len(b) * many, np.int64)), pa.array(np.tile(np.arange(many), len(b)))
                own = [batch.column(7 + g).slice(r, 1).take(spread_) for g in range(len(groups))]
                sums = [(w @ y)[:, :many].ravel(), (w @ known.astype(float))[:, :many].ravel()]
                yield pa.RecordBatch.from_arrays([*own, *[listed.field(c).take(again) for c in key], pa.array(np.repeat(b, many)), *map(pa.array, sums)], names=[*names, "b", "s", "n"])

    sums = spread.mapInArrow(run, schema).groupBy(*names, "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return kept(sums, "sums")  # a row for each resample and point, used more than once


def bootstrap_mean(curve: DataFrame, key: list[str], B: int, seed: int, unit: str = "subject", within: list[str] | None = None, tp: str | None = None) -> DataFrame:
    """(within, key, b, stat): means over units drawn with replacement, whole curves at once, or for each ``tp`` by itself.

    The k-th draw of resample b takes the unit at place draw mod n, in the order of units; b = 0 takes
    every unit once.  Draws are independent for each value of ``within`` and ``tp``.
    """
    within, extra = within or [], [tp] if tp else []
    inner = [k for k in key if k not in [*within, *extra]]
    sums = _bootstrapped(packed(curve, [*within, *extra, unit], inner), within, unit, inner, B, seed, extra)
    return sums.filter("n > 0").select(*within, *key, "b", (F.col("s") / F.col("n")).alias("stat"))


def bootstrap_sum(units: DataFrame, key: list[str], B: int, seed: int, unit: str = "unit", within: list[str] | None = None, apart: list[str] | None = None) -> DataFrame:
    """(key, b, stat): sums of unit values ``v`` drawn with replacement within ``within``, the draws shared by all other keys.

    Units of each value of ``apart`` are drawn for themselves, by draws whose keys don't have it.
    """
    within, apart = within or [], apart or []
    inner = [k for k in key if k not in [*within, *apart]]
    sums = _bootstrapped(packed(units, [*within, *apart, unit], inner, "v"), within, unit, inner, B, seed, [], apart)
    return sums.filter("n > 0").select(*key, "b", F.col("s").alias("stat"))


def permutation(items: DataFrame, item: str, B: int, seed: int) -> DataFrame:
    """(b, item, other): a keyed permutation of the items for each b; b = 0 leaves them in place."""
    ordered = Window.partitionBy("b").orderBy(item)
    shuffled = Window.partitionBy("b").orderBy(draw(seed, F.col("b"), F.col(item)), item)
    rows = resamples(items.select(item).distinct(), B).withColumn("place", F.row_number().over(ordered)).withColumn("to", F.when(F.col("b") == 0, F.col("place")).otherwise(F.row_number().over(shuffled)))
    return rows.select("b", item, "place").join(rows.select("b", F.col("to").alias("place"), F.col(item).alias("other")), ["b", "place"]).drop("place")
