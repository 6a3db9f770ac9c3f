"""Line de-duplication over content-defined chunks.

A line is a physical line or a piece of one, since passages are also copied into the middle of
a line: pieces end at points and at words chosen by their hash.  A rolling hash over two
neighbouring line hashes sets the chunk boundaries at its local minima, so that they depend on
nearby lines only and shift with them, and no chunk inside a text has one line.  Of a chunk that
occurs anywhere twice, the first occurrence stays, by document id and place.  The others are
compared with it byte by byte, grown outwards word by word as far as both texts agree, and removed
if they come to ``MIN_WORDS`` words.

Chunks are hashed twice rather than written: the first pass counts their hashes, the second gives
the places of those that a bit table of the repeated hashes lets pass, and these meet the repeated
hashes in an exact join.  Texts are shuffled once, and the first occurrences travel as byte ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import bit_table, drop_table, table, whole_batches, write_table

#: The least words of a removed run.
MIN_WORDS = 20
#: One word in so many ends a piece of a line.
PIECE_WORDS = 10
#: A chunk ends after so many lines, and a line after so many words, at the latest: equal ones in a row have no minima.
MOST_LINES, MOST_WORDS = 6, 40
#: Lines next to a chunk that decide where its neighbour ends.
NEAR_LINES = 4
#: Bytes of a first holder's text that travel in one range, besides the chunks at both ends.
REGION = 8192
#: The bit table has 16 bits for each repeated chunk, up to this power of two; beyond, more chunks pass on to the exact join.
TABLE_BITS = 27
_CLOSES = np.isin(np.arange(256), list(b".,;:!?"))
_NO_ID = -(2**63)
_SPAN = "start int, size int, before int, after int, chunk long"


def _bounded(ends: np.ndarray, most: int) -> np.ndarray:
    """``ends``, and one more after each ``most`` items since the last; the last item is an end."""
    since = np.append(0, np.flatnonzero(ends)[:-1] + 1)
    return ends | ((np.arange(len(ends)) - np.repeat(since, np.diff(np.append(since, len(ends)))) + 1) % most == 0)


def chunks_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first byte in it, bytes, bytes before it, bytes after it, hash) of all chunks of two lines or more.

    The bytes before reach back over the previous chunk and ``NEAR_LINES`` lines more, those after
    likewise: where two texts agree so far, they have the neighbouring chunk in common as well.
    """
    doc, start, stop = K.word_spans(data, bounds)
    if not len(doc):
        return (np.zeros(0, np.int64),) * 5 + (np.zeros(0, np.uint64),)
    sums = K.sums_of(data, exact=True)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    closes = _CLOSES[data[stop - 1]] | ((K.hashes_of(sums, start, stop) >> np.uint64(40)) % np.uint64(PIECE_WORDS) == 0)
    closes[:-1] |= (breaks[start[1:]] > breaks[stop[:-1]]) | (doc[1:] != doc[:-1])
    closes[-1] = True
    end = np.flatnonzero(_bounded(closes, MOST_WORDS))
    begin = np.append(0, end[:-1] + 1)
    doc, start, stop = doc[end], start[begin], stop[end]
    line = K.hashes_of(sums, start, stop)
    rolling = K.mixed(line * np.uint64(0x9E3779B97F4A7C15))
    same = doc[1:] == doc[:-1]
    rolling[1:] = np.where(same, K.mixed(line[:-1] * np.uint64(0xBF58476D1CE4E5B9) + line[1:]), rolling[1:])
    cut = np.append(~same, True)
    cut[1:-1] |= same[:-1] & same[1:] & (rolling[1:-1] < rolling[:-2]) & (rolling[1:-1] < rolling[2:])
    to = np.flatnonzero(_bounded(cut, MOST_LINES))
    first = np.append(0, to[:-1] + 1)
    opening, closing = np.searchsorted(doc, doc[to]), np.searchsorted(doc, doc[to], "right") - 1
    low = np.maximum(opening, np.append(0, first[:-1]) - NEAR_LINES)
    high = np.minimum(closing, np.append(to[1:], to[-1]) + NEAR_LINES)
    before, after = start[first] - start[low], stop[high] - stop[to]
    several = to > first
    first, to = first[several], to[several]
    return doc[to], start[first] - bounds[doc[to]], stop[to] - start[first], before[several], after[several], K.hashes_of(sums, start[first], stop[to])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, data, bounds in K.text_slices(batch.column(1)):
            found = chunks_of(data, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + found[0])), pa.array(found[5].view(np.int64))], names=["rid", "chunk"])


def _suspects(shared, bits: int) -> Callable:
    """The chunks (ids, ``_SPAN``) whose bit is set; the text is the last column."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for lo, _, data, bounds in K.text_slices(batch.column(batch.num_columns - 1)):
                found = chunks_of(data, bounds)
                keep = np.flatnonzero(K.in_bits(words, bits, found[5]))
                row = pa.array(lo + found[0][keep])
                columns = [batch.column(k).take(row) for k in range(batch.num_columns - 1)]
                columns += [pa.array(x[keep], pa.int32()) for x in found[1:5]] + [pa.array(found[5][keep].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "start", "size", "before", "after", "chunk"])

    return passed


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


def repeated_bytes(data: np.ndarray, sources: list[tuple[np.ndarray, int, bool, np.ndarray]]) -> np.ndarray:
    """Which bytes of a text repeat its sources.

    A source is a byte range of a text, the place it starts at, whether that text is this one, and
    the spans to compare: rows of (start here, bytes, start there).
    """
    gone = np.zeros(len(data), bool)
    for other, base, itself, spans in sources:
        for start, size, there in spans.tolist():
            stop, at = start + size, there - base
            if gone[start:stop].all() or not np.array_equal(data[start:stop], other[at : at + size]):
                continue
            # Within one text a copy grows up to its source's end at most, and the source up to the copy's start.
            room = start - (there + size) if itself else len(data)
            less = _agreeing(data[:start][::-1][:at], other[:at][::-1])
            more = _agreeing(data[stop:][: len(other)], other[at + size :])
            first, last = start - min(less, max(0, room)), stop + min(more, max(0, room))
            while first < start and first and not K.BLANK[data[first - 1]]:
                first += 1
            while last > stop and last < len(data) and not K.BLANK[data[last]]:
                last -= 1
            gone[first:last] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for start, stop in zip(edges[::2], edges[1::2]):
        if word_count(data[start:stop]) < MIN_WORDS:
            gone[start:stop] = False
    return gone


def word_count(data: np.ndarray) -> int:
    solid = ~K.BLANK[data]
    return int(solid[:1].sum() + (solid[1:] & ~solid[:-1]).sum())


def _sources(cell: pa.ListScalar) -> list[tuple[np.ndarray, int, bool, np.ndarray]]:
    values = cell.values
    body, base, itself, spans = (values.field(n) for n in ("body", "base", "itself", "spans"))
    out = []
    for k in range(len(values)):
        held = spans[k].values
        out.append((np.frombuffer(body[k].as_buffer(), np.uint8), base[k].as_py(), itself[k].as_py(), np.stack([held.field(i).to_numpy() for i in range(3)], axis=1)))
    return out


def _cleaned(text_at: int) -> Callable:
    """The rows without the bytes that repeat their ``sources`` (last column), and how many words went."""

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, sources in zip(batch.column(text_at), batch.column(batch.num_columns - 1)):
                body, lost = text.as_buffer(), 0
                if sources.is_valid and body is not None:
                    data = np.frombuffer(body, np.uint8)
                    gone = repeated_bytes(data, _sources(sources))
                    if gone.any():
                        body, lost = data[~gone].tobytes(), word_count(data) - word_count(data[~gone])
                texts.append(None if body is None else bytes(body))
                removed.append(lost)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=[*batch.schema.names[:-1], "removed_words"])

    return cleaned


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, and ``removed_words``; all rows and columns stay.

    The first holder of a chunk is the row with the smallest doc_id, and keeps it; a null id comes
    before all others.  Rows that repeat both doc_id and text count as one row and are cut alike.
    Null and empty texts, and texts of one line, stay as they are; an empty table gives no rows.  A
    clashing column ``removed_words`` is replaced.  Should two different chunks ever share a 64-bit
    hash, the comparison finds out and the later one stays.
    """
    names = [c for c in docs.columns if c != "removed_words"]
    kinds = {f.name: f for f in docs.schema.fields}
    rows = whole_batches(docs).select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_rid"))
    ids = ["_rid"]
    if not rows.groupBy("_rid").count().filter("count > 1").isEmpty():
        ids, rows = ["_rid", "_key"], rows.withColumn("_key", F.xxhash64("text"))  # tells texts of one id apart
    slim = rows.select(*ids, "text")
    hashes = slim.select("_rid", "text").mapInArrow(_hashes, "rid long, chunk long")
    often = write_table(hashes.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("holder")).filter("n > 1").drop("n"), "repeated-hashes")
    words, bits = bit_table(often, "chunk", often.count(), TABLE_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    places = slim.mapInArrow(_suspects(shared, bits), ", ".join(f"{c} long" for c in ids) + ", " + _SPAN)
    found = write_table(places.join(often, "chunk"), "repeated-chunks")

    source = [f"source{c}" for c in ids]
    first = found.filter("_rid = holder").groupBy("chunk").agg(F.min(F.struct(*ids, "start", "before", "after")).alias("f"))
    first = first.select("chunk", *[F.col(f"f.{c}").alias(s) for c, s in zip(ids, source)], F.col("f.start").alias("there"), "f.before", "f.after")
    first = write_table(first, "first-holders")  # a join of two plain tables can split a hot chunk
    again = found.drop("before", "after", "holder").join(first, "chunk").filter(" OR ".join(f"{c} <> {s}" for c, s in zip([*ids, "start"], [*source, "there"])))
    spans = again.groupBy(*ids, *source, F.floor(F.col("there") / REGION).alias("region")).agg(
        F.min(F.col("there") - F.col("before")).alias("base"), F.max(F.col("there") + F.col("size") + F.col("after")).alias("upto"), F.sort_array(F.collect_set(F.struct("start", "size", "there"))).alias("spans")
    )  # at most one span for each chunk of the text
    spans = write_table(spans.drop("region"), "spans")
    drop_table(found)
    drop_table(often)

    texts = slim if len(ids) == 1 else slim.dropDuplicates(ids)
    held = texts.select(*[F.col(c).alias(s) for c, s in zip(ids, source)], F.col("text").alias("source_text"))
    body = F.substring(F.col("source_text").cast("binary"), F.col("base") + 1, F.col("upto") - F.col("base"))
    itself = F.lit(True)
    for c, s in zip(ids, source):
        itself = itself & (F.col(c) == F.col(s))
    ranges = held.join(spans, source).select(*ids, F.struct(body.alias("body"), "base", itself.alias("itself"), "spans").alias("s"))
    cases = ranges.groupBy(*ids).agg(F.collect_list("s").alias("sources"))  # at most one for each chunk of the text
    rest = rows.select(*ids, *[F.col(c).alias(f"_c{k}") for k, c in enumerate(names) if c != "text"]).join(cases, ids, "left")
    whole = texts.join(rest, ids).select(*["text" if c == "text" else F.col(f"_c{k}").alias(c) for k, c in enumerate(names)], "sources")
    return whole.mapInArrow(_cleaned(names.index("text")), T.StructType([*(T.StructField(c, kinds[c].dataType) for c in names), T.StructField("removed_words", T.LongType())]))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE_SQL: dict = {}
