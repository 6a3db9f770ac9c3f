"""Repeated strings of a hundred bytes, found by distributed prefix doubling.

A window is a string of ``span`` bytes inside one document.  A window that also starts earlier
(smaller id, or the same id and a smaller start) is repeated, and its bytes go.

1. *Reduction, exact.*  An anchor is the ``k``-byte string of a window with the least hash; equal
   windows have equal anchors.  The windows that share an anchor make a context, a string of at
   most ``2 * span - k`` bytes.  Of equal contexts the first stays and the others are settled:
   all their windows are repeated.  A context whose anchor occurs in no other context is settled
   too: its windows occur nowhere else.  What is left goes through the same with longer anchors,
   so the rows that are sorted grow with what is repeated in different surroundings only.
2. *Prefix doubling.*  Every window left starts as a row of names of its first bytes at growing
   offsets.  Spark sorts the distinct pairs (rank here, rank ``offset`` further on), a pair's
   place in that order is the rank of the doubled prefix, and windows whose pair is unique drop
   out.  Ranks of ``span`` bytes end it; the first place of a rank stays.
3. The settled spans of each document meet its text, and what they don't cover is hashed.

Contexts are compared by two 64-bit hashes (anchor and whole), first names are 64-bit hashes.
Rows are combined in the task before any shuffle, and rows fetch their group by a join that
Spark can split where one group is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_table, drop_table, table, whole_batches
from .common import write_table as _write_table
from .kernels import _power, hashes_of, in_bits, mixed, sums_of

SPAN = 100
#: Lengths of the anchors of one reduction after the other.
ANCHORS = (24, 90)
#: Bytes of text that a task turns into hashes at a time; longer texts are taken in overlapping pieces.
PIECE = 1 << 18
#: Bits of a table that lets rows through to an exact join: 2^27 (16 MB) at most; beyond, it only lets more through.
TABLE_BITS = 27
NO_ID = -(2**63)
_U = np.uint64
_PLACE = (1 << 28) - 1
SEGMENTS = "d long, x long, lo long, body binary"


def write_table(df: DataFrame, name: str) -> DataFrame:
    return _write_table(df, name, tidy=True)


def _slid_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` numbers in a row, from running minima to both sides of every ``w``-th place."""
    y = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, _U)]).reshape(-1, w)
    ahead, back = np.minimum.accumulate(y, axis=1).ravel(), np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def contexts(data: np.ndarray, bounds: np.ndarray, k: int, span: int) -> tuple[np.ndarray, ...]:
    """(piece, first window, windows, hash of the anchor, hash of the context) of the pieces that ``bounds`` cuts ``data`` into."""
    if len(data) < span:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    sums, n = sums_of(data, exact=True), len(data) - k + 1
    grams = mixed((sums[k:] - sums[:n]) * _power(len(sums))[1][:n] + _U(k))  # as hashes_of, for every place
    least = _slid_least((grams & _U(~_PLACE & (2**64 - 1))) | np.arange(n, dtype=_U), span - k + 1)
    anchor = (least & _U(_PLACE)).astype(np.int64)
    turn = np.ones(len(anchor) + 1, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=turn[1:-1])
    inside = np.ones(len(anchor), bool)
    for end in bounds[1:-1]:  # windows over the end of a piece
        inside[max(0, end - span + 1) : end] = False
        turn[max(0, end - span + 1)] = True
        turn[min(end, len(anchor))] = True
    first, last = np.flatnonzero(inside & turn[:-1]), np.flatnonzero(inside & turn[1:])
    return np.searchsorted(bounds, first, "right") - 1, first, last - first + 1, grams[anchor[first]], hashes_of(sums, first, last + span)


def _pieces(batch: pa.RecordBatch, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, place of each piece in its row, bytes, bounds) of slices of about ``PIECE`` bytes; every window is inside one piece."""
    bodies = batch.column(3).cast(pa.large_binary())
    offsets = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1] if len(bodies) else np.zeros(1, np.int64)
    data = np.frombuffer(bodies.buffers()[2] or b"", np.uint8) if len(bodies) else np.zeros(0, np.uint8)
    rows, starts, stops, size = [], [], [], 0
    for row in np.flatnonzero(np.diff(offsets) >= span):
        for at in range(int(offsets[row]), int(offsets[row + 1]) - span + 1, PIECE):
            rows.append(row)
            starts.append(at)
            stops.append(min(at + PIECE + span - 1, int(offsets[row + 1])))
            size += stops[-1] - at
            if size >= PIECE:
                yield _joined(data, offsets, rows, starts, stops)
                rows, starts, stops, size = [], [], [], 0
    if rows:
        yield _joined(data, offsets, rows, starts, stops)


def _joined(data: np.ndarray, offsets: np.ndarray, rows: list, starts: list, stops: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    where = np.array(rows)
    bounds = np.concatenate([[0], np.cumsum(np.array(stops) - np.array(starts))])
    return where, np.array(starts) - offsets[where], np.concatenate([data[a:b] for a, b in zip(starts, stops)]), bounds


def _anchors(k: int, span: int):
    """Each slice's anchors and how many contexts of the slice have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in _pieces(batch, span):
                found, many = np.unique(contexts(data, bounds, k, span)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(many)], names=["a", "n"])

    return run


def _key(d: np.ndarray, x: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Spreads places over 64 bits, as :func:`key` does."""
    d, x, lo = d.view(_U), x.view(_U), lo.astype(_U)
    return x ^ ((lo * _U(2654435761)) << _U(20)) ^ (d << _U(44)) ^ (d << _U(23))


def key(d: Column, x: Column, lo: Column) -> Column:
    spread = F.shiftleft(lo * F.lit(2654435761), 20)
    return x.bitwiseXOR(spread).bitwiseXOR(F.shiftleft(d, 44)).bitwiseXOR(F.shiftleft(d, 23))


def _found(k: int, span: int, table: Broadcast, bits: int, bodies: bool):
    """Contexts whose anchor's bit is set; or, with their bytes, those whose place's bit is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, x, base = (batch.column(i).to_numpy() for i in range(3))
            for rows, begin, data, bounds in _pieces(batch, span):
                piece, first, many, a, c = contexts(data, bounds, k, span)
                row = rows[piece]
                lo = base[row] + begin[piece] + first - bounds[piece]
                keep = np.flatnonzero(in_bits(table.value, bits, _key(d[row], x[row], lo) if bodies else a))
                row, lo, many, first = row[keep], lo[keep], many[keep], first[keep]
                if bodies:
                    last = pa.array([data[s : s + n].tobytes() for s, n in zip(first, many + span - 1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(d[row]), pa.array(x[row]), pa.array(lo), last], names=["d", "x", "lo", "body"])
                else:
                    columns = [a[keep].view(np.int64), c[keep].view(np.int64), d[row], x[row], lo * 256 + many]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["a", "c", "d", "x", "at"])

    return run


def _order(at: str) -> Column:
    """A place as one number, ordered by id and start."""
    return (F.col("d").cast("decimal(20,0)") * F.lit(2**40).cast("decimal(13,0)") + F.col(at)).cast("decimal(38,0)")


def _reduced(segments: DataFrame, k: int, span: int) -> tuple[DataFrame, DataFrame]:
    """(settled spans, what is left of the segments) after one reduction."""
    share = segments.sparkSession.sparkContext.broadcast
    repeated = write_table(segments.mapInArrow(_anchors(k, span), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1").select("a"), "anchors")
    words, bits = bit_table(repeated, "a", repeated.count(), TABLE_BITS)
    drop_table(repeated)
    rows = write_table(segments.mapInArrow(_found(k, span, share(words), bits, False), "a long, c long, d long, x long, at long"), "contexts")
    groups = write_table(rows.groupBy("a", "c").agg(F.min(_order("at")).alias("first"), F.count(F.lit(1)).alias("n")), "context-groups")
    kinds = groups.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"))
    groups_of = groups.join(kinds, "a").filter("n > 1 OR kinds > 1").select("a", "c", "first", "kinds")
    judged = rows.join(groups_of, ["a", "c"]).select("d", "x", "at", (_order("at") == F.col("first")).alias("early"), "kinds").filter("NOT early OR kinds > 1")
    judged = write_table(judged.select("d", "x", F.shiftright("at", 8).alias("lo"), F.col("at").bitwiseAND(F.lit(255)).alias("windows"), "early"), "judged")
    drop_table(rows)
    drop_table(groups)
    live = judged.filter("early").select("d", "x", "lo")
    words, bits = bit_table(live.select(key(F.col("d"), F.col("x"), F.col("lo")).alias("key")), "key", live.count(), TABLE_BITS)
    left = segments.mapInArrow(_found(k, span, share(words), bits, True), SEGMENTS).join(live, ["d", "x", "lo"], "left_semi")
    settled = judged.filter("NOT early").select("d", "x", F.col("lo").alias("start"), (F.col("lo") + F.col("windows") + F.lit(span - 1)).alias("stop"))
    return settled, write_table(left.select("d", "x", "lo", "body"), "segments")


def _names(span: int, parts: int):
    """For every window and pair of parts: the names of both parts, hashes of ``span / parts`` bytes."""
    h = span // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, x, base = (batch.column(i).to_numpy() for i in range(3))
            for rows, begin, data, bounds in _pieces(batch, span):
                start = np.arange(len(data) - span + 1)
                piece = np.searchsorted(bounds, start, "right") - 1
                start = start[start + span <= bounds[piece + 1]]
                piece = np.searchsorted(bounds, start, "right") - 1
                row = rows[piece]
                j, sums = base[row] + begin[piece] + start - bounds[piece], sums_of(data, exact=True)
                name = [hashes_of(sums, start + p * h, start + p * h + h).view(np.int64) for p in range(parts)]
                for p in range(parts // 2):
                    columns = [d[row], x[row], j, np.full(len(j), p), name[2 * p], name[2 * p + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["d", "x", "j", "part", "r1", "r2"])

    return run


def doubled(pairs: DataFrame, parts: int) -> DataFrame:
    """(d, x, j) of the windows that occur earlier too, from rows (d, x, j, part, r1, r2) of ``parts`` pairs of ranks each.

    A round ranks pairs by their place in sorted order, leaves unique ones out, and pairs the ranks
    of neighbouring parts: the prefixes grow twofold until one part is the whole window.
    """
    while True:
        met = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(_order("j")).alias("first")).filter("n > 1")
        ranks = met.repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2").withColumn("rank", F.monotonically_increasing_id())
        ranks = write_table(ranks.select("r1", "r2", "rank", "first"), "ranks")
        held = pairs.join(ranks, ["r1", "r2"])
        if parts == 1:
            return held.filter(_order("j") > F.col("first")).select("d", "x", "j")
        sides = [F.max(F.when(F.col("part") % 2 == side, F.col("rank"))).alias(name) for side, name in enumerate(("r1", "r2"))]
        halves = held.groupBy("d", "x", "j", F.floor(F.col("part") / 2).alias("half")).agg(*sides)
        pairs = write_table(halves.filter("r1 IS NOT NULL AND r2 IS NOT NULL").withColumnRenamed("half", "part"), "pairs")
        parts //= 2


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for body, starts, stops in zip(batch.column(1), batch.column(2), batch.column(3)):
            data = body.as_py()
            gone = spans = 0
            if starts.is_valid:
                a, b = starts.values.to_numpy(), stops.values.to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                opens = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                a, b = a[opens], b[np.concatenate([opens[1:], [len(b)]]) - 1]
                gone, spans = int((b - a).sum()), len(a)
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
                data, whole = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2])), len(data)
            else:
                whole = len(data)
            for column, value in zip(out, (whole, gone, spans, hashlib.sha256(data).hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.int64()) for v in out[:3]], pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, span: int = SPAN, anchors: tuple[int, ...] = ANCHORS) -> DataFrame:
    """(d, x, start, stop), unordered and overlapping: bytes of document ``d`` (its text's hash: ``x``) that repeated windows cover."""
    whole = whole_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("x"), F.lit(0).cast("long").alias("lo"), F.col("text").cast("binary").alias("body"))
    segments, spans = whole.filter(F.octet_length("body") >= span), None
    for k in anchors:
        settled, left = _reduced(segments, k, span)
        spans = settled if spans is None else spans.unionByName(settled)
        if k != anchors[0]:
            drop_table(segments)
        segments = left
    late = doubled(segments.mapInArrow(_names(span, 4), "d long, x long, j long, part long, r1 long, r2 long"), 2)
    return spans.unionByName(late.select("d", "x", F.col("j").alias("start"), (F.col("j") + F.lit(span)).alias("stop")))


def suffix_dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null and empty ones have none; those shorter than ``span`` keep all.  A
    null id counts as the smallest.  Rows of one id are one document for the order: a string at the
    same start in two of them is earlier in neither, so equal rows get equal results.  Strings are
    judged on the input.  Other columns are ignored; an empty table gives no rows.
    """
    rows = whole_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spans = write_table(repeated_spans(rows, span), "spans")
    gone = spans.groupBy("d", "x").agg(F.collect_list(F.struct("start", "stop")).alias("s"))
    gone = gone.select("d", "x", F.col("s.start").alias("starts"), F.col("s.stop").alias("stops"))
    texts = rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("x"), F.col("text").cast("binary").alias("body"))
    met = texts.join(gone, ["d", "x"], "left").select("doc_id", "body", "starts", "stops")
    return met.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}
ORACLE_SQL: dict = {}
